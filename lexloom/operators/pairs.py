"""Instruction pairs: from turns, from other schemas; validity, greedy deduplication, statistics, curation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import chat, lexicon as L, text as T
from ..functions.answers import technical
from ..shared import shared_dir, stash
from .mix import within

#: Rounds of the greedy deduplication, at most; chains of rows that block each other in turn are short.
ROUNDS = 10_000


def pair_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, instruction, response): each user turn with the assistant turn right after it.

    A join on the next turn's number, so that no conversation has to be gathered in one task.
    """
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return user.join(reply, ["conv_id", "turn"])


def adapt(df: DataFrame, instruction: str, extra: str | None, response: str, source: str | Column) -> DataFrame:
    """(instruction, response, domain, source) of another schema; extra input goes below the instruction; parts must not be empty."""
    head, tail = T.one_line(F.coalesce(instruction, F.lit(""))), T.one_line(F.coalesce(F.col(extra), F.lit(""))) if extra else F.lit("")
    i = F.when(tail != "", F.concat(head, F.lit("\n\nInput:\n"), tail)).otherwise(head)
    s = F.lit(source) if isinstance(source, str) else source
    keep = [c for c in df.columns if c not in (instruction, extra, response, "domain", "source")]
    out = df.select(*keep, i.alias("instruction"), T.one_line(F.coalesce(response, F.lit(""))).alias("response"), s.alias("source"))
    return out.where("instruction <> '' AND response <> ''").withColumn("domain", T.pair_domain(F.concat_ws(" ", "instruction", "response"), "source"))


def valid(df: DataFrame) -> DataFrame:
    """Pairs with both parts and a known domain."""
    return df.where((T.one_line("instruction") != "") & (T.one_line("response") != "") & F.col("domain").isin(*L.PAIR_DOMAIN_SET))


def greedy_pairs(df: DataFrame, seq: str, first: str | Column, second: str | Column) -> DataFrame:
    """Adds `verdict`: kept, duplicate_first or duplicate_second, as one pass in order would have it.

    A row is kept if no kept row before it has its first key, or its second. Rounds: among undecided rows those
    that come first for both keys are kept, and undecided rows that share a key with kept ones are dropped;
    minima pre-aggregate, tables are written to the shared folder between rounds. Rows of a null key: as equal.
    """
    folder = shared_dir(df.sparkSession)
    rows = df.select(F.col(seq).alias("s"), F.coalesce(T.col(first), F.lit("")).alias("a"), F.coalesce(T.col(second), F.lit("")).alias("b"))
    left = stash(rows, folder, "rows")
    kept: list[DataFrame] = []
    for k in range(ROUNDS):
        lo_a, lo_b = left.groupBy("a").agg(F.min("s").alias("sa")), left.groupBy("b").agg(F.min("s").alias("sb"))
        now = left.join(lo_a, "a").join(lo_b, "b").where("s = sa AND s = sb").select("s", "a", "b")
        now = stash(now, folder, f"kept-{k}")
        kept.append(now)
        left = left.join(now.select("a").distinct(), "a", "left_anti").join(now.select("b").distinct(), "b", "left_anti").select("s", "a", "b")
        left = stash(left, folder, f"left-{k}")
        if left.limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"rows are still undecided after {ROUNDS} rounds")
    kept = stash(reduce(DataFrame.union, kept), folder, "kept")
    by_a = kept.select("a", F.col("s").alias("ka"))
    mark = rows.join(by_a, "a", "left").join(kept.select("s", F.lit(True).alias("k")), "s", "left")
    verdict = F.when(F.col("k"), "kept").when(F.col("ka") < F.col("s"), "duplicate_first").otherwise("duplicate_second")
    return df.join(mark.select(F.col("s").alias(seq), verdict.alias("verdict")), seq)


def pair_counters(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    return df.agg(F.count("*").alias("input"), *(F.count_if(F.col(verdict) == v).alias(v) for v in ("kept", "duplicate_first", "duplicate_second")))


def capped(df: DataFrame, seq: str, most: int) -> DataFrame:
    """Rows up to and with the `most`-th kept one: where a run with a limit would have stopped."""
    last = df.where("verdict = 'kept'").select(seq).orderBy(seq).limit(most).agg(F.max(seq).alias("_last"), F.count("*").alias("_n"))
    return df.crossJoin(F.broadcast(last)).where((F.col("_n") < most) | (F.col(seq) <= F.col("_last"))).drop("_last", "_n")


def pair_stats(df: DataFrame) -> DataFrame:
    """Pairs and mean response words, overall (null) and by domain and by source."""
    rows = df.select("domain", "source", T.n_words("response", "hyphen").alias("w"))
    return rows.groupingSets([[], [F.col("domain")], [F.col("source")]], "domain", "source").agg(F.count("*").alias("pairs"), F.sum("w").alias("words"), F.round(F.avg("w"), 2).alias("mean_words"))


def scaffold_counters(df: DataFrame, limit: int, band: tuple[int, int]) -> DataFrame:
    """One row of the chat filter's counters; its three reasons count independently of each other."""
    wi, wr = T.n_words(T.one_line("instruction"), "space"), T.n_words(T.one_line("response"), "space")
    rows = df.select(wi.alias("wi"), wr.alias("wr"), (wi > limit).alias("long"), chat.scaffolded("instruction").alias("si"), chat.scaffolded("response").alias("sr"))
    kept = ~F.col("long") & ~F.col("si") & ~F.col("sr") & F.col("wr").between(*band)
    return rows.agg(F.count("*").alias("input"), F.count_if("long").alias("dropped_long"), F.count_if("si").alias("dropped_scaffolded_instruction"), F.count_if("sr").alias("dropped_scaffolded_response"), F.count_if(kept).alias("kept"), F.max("wi").alias("max_words_seen"), F.max(F.when(kept, F.col("wi"))).alias("max_words_kept"))


def keep_shortest(df: DataFrame, key: str | Column, size: Column, seq: str) -> DataFrame:
    """Of each key the row of least size, the first of equals; of rows that repeat key, size and `seq` one stays."""
    best = df.withColumn("_key", T.col(key)).withColumn("_rank", F.struct(size.alias("n"), F.col(seq).alias("s")))
    low = best.groupBy("_key").agg(F.min("_rank").alias("_low")).select(F.col("_key").alias("_k"), "_low")
    kept = best.join(low, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_rank") == F.col("_low")), "left_semi")
    return kept.dropDuplicates(["_key", seq]).drop("_key", "_rank")


def base_then_new(base: DataFrame, extra: DataFrame, key: str, seq: str) -> DataFrame:
    """Of the base each key's last row; of the extra rows each new key's first. Of rows that repeat key and `seq` one stays."""
    last = base.groupBy(key).agg(F.max(seq).alias(seq))
    first = extra.join(base.select(key), key, "left_anti").groupBy(key).agg(F.min(seq).alias(seq))
    one = lambda rows, at: rows.join(at, [key, seq], "left_semi").dropDuplicates([key, seq])
    return one(base, last).unionByName(one(extra, first))


def short_answers(df: DataFrame) -> DataFrame:
    """Adds the answer's first sentence and why it can't stay (null: it can)."""
    first = T.let(T.sentences(T.one_line("response")), lambda s: F.coalesce(F.get(s, F.lit(0)), F.lit("")))
    df = df.withColumn("short", first)
    n = T.n_words("short", "hyphen")
    return df.withColumn("reason", F.when(n < L.SHORT_WORDS[0], "short").when(n > L.SHORT_WORDS[1], "long"))


def cross_domain(domain: Column, text: str | Column, signatures: dict[str, tuple[str, ...]], comparison: Column | None = None) -> Column:
    """The first other domain whose signature terms stand in the text; none for comparisons and unknown domains."""
    low = F.concat(F.lit(" "), T.casefold(text), F.lit(" "))
    chain = F.when(~domain.isin(*signatures) | (comparison if comparison is not None else F.lit(False)), F.lit(None).cast("string"))
    for other, terms in signatures.items():
        hit = F.lit(False)
        for t in terms:
            hit = hit | low.contains(t.casefold())
        chain = chain.when((domain != other) & hit, other)
    return chain


def is_comparison(c: str | Column) -> Column:
    return F.regexp_like(T.col(c), F.lit(L.COMPARISON))


def quotas(total: int, buckets: tuple[str, ...]) -> dict[str, int]:
    """Equal shares; what is left over goes to the first ones."""
    share, rest = divmod(total, len(buckets))
    return {b: share + (k < rest) for k, b in enumerate(buckets)}


def take_evenly(df: DataFrame, group: str, seq: str, want: dict[str, int]) -> DataFrame:
    """Of each group rows at an even stride over its order, both ends included; all where there are no more than wanted.

    Positions are the halves-to-even rounding of i (n - 1) / (k - 1).
    """
    spark = df.sparkSession
    targets = spark.createDataFrame([(g, k) for g, k in want.items() if k > 0], f"{group} string, _k int")
    n = df.groupBy(group).agg(F.count("*").alias("_n")).join(F.broadcast(targets), group)
    i = F.explode(F.sequence(F.lit(0), F.least(F.col("_k").cast("long"), F.col("_n")) - 1))
    places = n.select(group, "_n", "_k", i.alias("_i"))
    at = F.when(F.col("_n") <= F.col("_k"), F.col("_i")).when(F.col("_k") == 1, F.lit(0)).otherwise(F.rint(F.col("_i") * ((F.col("_n") - 1) / (F.col("_k") - 1))).cast("long"))
    ranked = within(df, group, seq, "_at").withColumn("_at", F.col("_at") - 1)
    return ranked.join(F.broadcast(places.select(group, at.alias("_at")).distinct()), [group, "_at"], "left_semi").drop("_at")


def is_curated(instruction: str = "instruction", response: str = "response", domain: str = "domain") -> Column:
    """Lengths in range, a known domain, no generic opening, no phrase of three or four words twice in the answer.

    A general pair must hold a technical keyword as a word, with or without a plural s.
    """
    low = T.casefold(T.one_line(instruction))
    generic = F.lit(False)
    for p in L.GENERIC_OPENINGS:
        generic = generic | low.startswith(p)
    generic = generic | ((F.col(domain) == "general") & ~technical(F.concat_ws(" ", instruction, response)))
    # a phrase of four words that comes twice holds one of three that does
    grams = T.let(T.ngrams(T.words(response, "lower_space"), 3), lambda g: F.size(g) > F.size(F.array_distinct(g)))
    long_enough = T.n_words(response, "space") >= 6
    return T.n_words(instruction, "hyphen").between(*L.CURATED_INSTRUCTION) & T.n_words(response, "hyphen").between(*L.CURATED_RESPONSE) & F.col(domain).isin(*L.PAIR_DOMAIN_SET) & ~generic & ~(grams & long_enough)


def curated(df: DataFrame, seq: str, total: int) -> DataFrame:
    """Curated rows by bucket at their quotas: security ones before general ones, which fill what is left of their bucket."""
    rows = df.where(is_curated())
    want = quotas(total, L.CURATED_BUCKETS)
    mixed = want[L.CURATED_BUCKETS[-1]]
    plain = take_evenly(rows.where(F.col("domain").isin(*L.CURATED_BUCKETS[:-1])), "domain", seq, {b: n for b, n in want.items() if b != L.CURATED_BUCKETS[-1]})
    security = take_evenly(rows.where("domain = 'cybersecurity'"), "domain", seq, {"cybersecurity": mixed})
    n = min(rows.where("domain = 'cybersecurity'").limit(mixed).count(), mixed)
    general = take_evenly(rows.where("domain = 'general'"), "domain", seq, {"general": mixed - n})
    bucket = F.when(F.col("domain").isin("cybersecurity", "general"), L.CURATED_BUCKETS[-1]).otherwise(F.col("domain"))
    return plain.unionByName(security).unionByName(general).withColumn("bucket", bucket)


def report(pairs: DataFrame, teacher: Column, times: int, instruction: str = "instruction", response: str = "response") -> DataFrame:
    """One row of a chat corpus: examples, teacher examples after repetition, their share, words, repeated blocks."""
    rows = pairs.select(teacher.alias("t"), chat.format_lines(instruction, response).alias("block")).withColumn("times", F.when(F.col("t"), times).otherwise(1))
    blocks = rows.groupBy(T.casefold("block").alias("k")).agg(F.sum("times").alias("n"), F.sum(F.when(F.col("t"), F.col("times")).otherwise(0)).alias("teacher"), F.sum(F.col("times") * T.n_words("block", "hyphen")).alias("words"))
    out = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("final_examples"), F.coalesce(F.sum("teacher"), F.lit(0)).alias("teacher_examples"), F.coalesce(F.sum("words"), F.lit(0)).alias("total_words"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_blocks"))
    return out.withColumn("teacher_ratio", F.round(F.when(F.col("final_examples") > 0, F.col("teacher_examples") / F.col("final_examples")).otherwise(0.0), 6))


def gated(report_: DataFrame, least_teacher: float = 0.3, most_run: int = 1, run: str = "longest") -> DataFrame:
    """The report as it is; it raises when a gate fails: blocks that follow themselves, too few teacher examples."""
    bad_run = F.raise_error(F.lit("equal blocks follow each other")).cast("boolean")
    bad_share = F.raise_error(F.format_string("teacher ratio %.6f is below %.2f", F.col("teacher_ratio"), F.lit(least_teacher))).cast("boolean")
    return report_.where(F.when(F.col(run) > most_run, bad_run).when(F.col("teacher_ratio") < least_teacher, bad_share).otherwise(True))


def in_band(df: DataFrame, least: int = 10, most: int | None = 300, response: str = "response") -> DataFrame:
    """Pairs whose answers have so many words."""
    n = T.n_words(response, "hyphen")
    return df.where(n >= least) if most is None else df.where(n.between(least, most))


def band_counters(df: DataFrame, least: int = 10, most: int = 300, response: str = "response") -> DataFrame:
    """One row: pairs, those with too short and too long answers, and the rest."""
    n = T.n_words(response, "hyphen")
    return df.agg(F.count("*").alias("input"), F.count_if(n < least).alias("too_short"), F.count_if(n > most).alias("too_long"), F.count_if(n.between(least, most)).alias("kept"))


def boost_reason(domain: str | Column, response: str | Column, signatures: dict[str, tuple[str, ...]], band: tuple[int, int] = L.SHORT_WORDS) -> Column:
    """Why an added row can't stay: its length, more than one sentence, another domain's terms; null when it can."""
    n = T.n_words(response, "hyphen")
    other = cross_domain(T.col(domain), response, signatures)
    return F.when(~n.between(*band), "length").when(T.sentence_count(response) > 1, "multisentence").when(other.isNotNull(), F.concat(F.lit("cross_"), other))


def without_held_out(df: DataFrame, split: str = "split") -> DataFrame:
    """The rows as they are; a held-out one among them raises when it is read."""
    bad = F.raise_error(F.lit("a held-out row in training data")).cast("boolean")
    return df.where(F.when(F.col(split).isin("held_out", "eval", "test"), bad).otherwise(True))


def require_unique(df: DataFrame, key: str | Column) -> DataFrame:
    """The rows as they are; a key that comes twice raises, with the key, when they are read."""
    twice = df.groupBy(T.col(key).alias("_k")).agg(F.count("*").alias("_c")).where("_c > 1").agg(F.min("_k").alias("_twice"))
    bad = F.raise_error(F.concat(F.lit("comes more than once: "), F.col("_twice").cast("string"))).cast("boolean")
    return df.crossJoin(F.broadcast(twice)).where(F.when(F.col("_twice").isNotNull(), bad).otherwise(True)).drop("_twice")


def require_length(df: DataFrame, column: str, band: tuple[int, int]) -> DataFrame:
    """The rows as they are; one whose words are outside the band raises, with its text, when it is read."""
    bad = F.raise_error(F.concat(F.lit("words outside the band: "), F.col(column))).cast("boolean")
    return df.where(F.when(T.n_words(column, "hyphen").between(*band), True).otherwise(bad))
