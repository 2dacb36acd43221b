"""The corpus pipeline: clean, deduplicate, score, gate, tag, count. DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon as L, text as T


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `cleaned`; rows that have nothing left, or filler text, go.

    The one-item explode keeps the filter from being pushed below, where it would clean each text once more.
    """
    return df.withColumn("cleaned", F.explode(F.array(T.clean_text(text)))).where((F.col("cleaned") != "") & ~F.regexp_like("cleaned", F.lit(L.LOREM)))


def keep_first(df: DataFrame, key: str | Column, seq: str) -> DataFrame:
    """The first row by `seq` of each key: map-side minimum, then a semi-join by key and `seq`.

    No window over the key: its rows needn't meet in one task, however many they are. Of rows that repeat both
    key and `seq` one stays; rows of a null key are one group.
    """
    keyed = df.withColumn("_key", T.col(key))
    first = keyed.groupBy("_key").agg(F.min(seq).alias("_first")).withColumnRenamed("_key", "_k")
    kept = keyed.join(first, F.col("_key").eqNullSafe(F.col("_k")) & F.col(seq).eqNullSafe(F.col("_first")), "left_semi")
    return kept.dropDuplicates(["_key", seq]).drop("_key")


def quality_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the gate's statistics: counts first, so that ratios can be told from whole numbers."""
    df = df.withColumn("_low", F.lower(text))
    df = df.withColumn("_w", T.words("_low", "unicode")).withColumn("_l", T.text_lines("_low"))
    df = df.withColumn("word_count", F.size("_w")).withColumn("distinct_words", F.size(F.array_distinct("_w")))
    df = df.withColumn("line_count", F.size("_l")).withColumn("repeated_lines", F.size("_l") - F.size(F.array_distinct("_l")))
    df = df.withColumn("unique_word_ratio", T.distinct_share(F.col("_w"))).withColumn("line_repetition_ratio", T.repeated_share(F.col("_l")))
    return df.withColumn("language_confidence", T.language_confidence(text, "_low")).drop("_w", "_l", "_low")


def tag_domain(df: DataFrame, text: str = "text", name: str = "domain") -> DataFrame:
    """Adds the domain; lower case and each domain's count are columns, so that they are computed once a row."""
    df = df.withColumn("_low", F.lower(text))
    counts = T.domain_counts("_low")
    df = df.select("*", *(c.alias(f"_d_{d}") for d, c in counts.items()))
    return df.withColumn(name, T.first_best({d: F.col(f"_d_{d}") for d in counts}, "general")).drop("_low", *(f"_d_{d}" for d in counts))


def rounded(c: str) -> Column:
    """Four places, halves to even on the exact binary value, as the thresholds see it."""
    return F.bround(F.col(c).cast("decimal(38,18)"), 4).cast("double")


def reject_reason(text: str = "text", *, min_words: int = L.MIN_WORDS, min_unique: float = L.MIN_UNIQUE, max_lines: float = L.MAX_LINE_REPETITION, min_language: float = L.MIN_LANGUAGE) -> Column:
    """The first test of the gate that a scored row fails; null when it passes all."""
    return (
        F.when(F.contains(F.lower(text), F.lit("lorem ipsum")) & F.regexp_like(text, F.lit(L.LOREM)), "lorem_ipsum").when(F.regexp_like(text, F.lit(L.CHARACTER_SPAM)), "char_spam").when(F.col("word_count") < min_words, "too_short")
        .when(rounded("unique_word_ratio") < min_unique, "low_unique_words").when(rounded("line_repetition_ratio") > max_lines, "repeated_lines")
        .when(rounded("language_confidence") < min_language, "low_language_confidence")
    )


def quality_gate(df: DataFrame, text: str = "text", **limits: float) -> DataFrame:
    """Adds scores, `reason` (null: passes) and `domain`."""
    return tag_domain(quality_scores(df, text).withColumn("reason", reject_reason(text, **limits)), text)


def stage_counters(df: DataFrame, reason: str = "reason") -> DataFrame:
    """One row: input, output and what each reason removed."""
    names = ("lorem_ipsum", "char_spam", "too_short", "low_unique_words", "repeated_lines", "low_language_confidence")
    return df.agg(F.count("*").alias("input"), F.count_if(F.col(reason).isNull()).alias("output"), *(F.count_if(F.col(reason) == n).alias(n) for n in names))


def corpus_stats(df: DataFrame, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """Documents, words and estimated tokens overall and by each key, in one pass over the rows."""
    n = T.n_words(text, "unicode")
    rows = df.select(*keys, n.alias("w"), T.estimated_tokens(n).alias("t"))
    sets = [[], *([F.col(k)] for k in keys)]
    return rows.groupingSets(sets, *keys).agg(F.count("*").alias("documents"), F.sum("w").alias("words"), F.sum("t").alias("tokens"))


def ngram_repetition(df: DataFrame, n: int = 4, text: str = "text") -> DataFrame:
    """Adds counts of n-grams and distinct ones, and the share of repeats."""
    df = df.withColumn("_g", T.ngrams(T.words(F.lower(text), "unicode"), n))
    return df.withColumn("n_grams", F.size("_g")).withColumn("n_distinct", F.size(F.array_distinct("_g"))).withColumn("repeated_ratio", T.repeated_share(F.col("_g"), 0)).drop("_g")


def first_repeated_ngram(df: DataFrame, seq: str, words: Column, n: int = 3, least: int | None = None) -> DataFrame:
    """(seq, phrase): the n-gram whose second occurrence comes first; rows without one are left out.

    Distinct n-grams stand in order of their first places, so the first place where a text's n-grams part from them is a
    repeat: linear in a text's length, and only a phrase leaves its row. Rows that share a seq are one text, place by
    place, and alone are numbered and grouped. Texts under `least` words have none.
    """
    k = 2 * n if least is None else least
    shared = df.groupBy(seq).agg(F.count("*").alias("m")).where("m > 1").select(F.col(seq).alias("_s"))
    if shared.isEmpty():
        return _repeated_in_row(df, seq, words, n, k)
    own = F.col(seq).eqNullSafe(F.col("_s"))
    return _repeated_in_row(df.join(shared, own, "left_anti"), seq, words, n, k).union(_repeated_in_rows(df.join(shared, own, "left_semi"), seq, words, n, k))


def _repeated_in_row(df: DataFrame, seq: str, words: Column, n: int, least: int) -> DataFrame:
    """The explode of at most one phrase leaves out rows without one; a filter would be pushed below and cut the words again."""
    grams = df.select(seq, words.alias("_w")).select(seq, F.when(F.size("_w") >= least, T.ngrams(F.col("_w"), n)).alias("_g"))
    again = T.let(F.array_distinct("_g"), lambda d: F.slice(F.filter("_g", lambda g, i: ~g.eqNullSafe(F.get(d, i))), 1, 1))
    return grams.select(seq, F.explode(again).alias("phrase")).select(seq, F.replace("phrase", F.lit("\x1f"), F.lit(" ")).alias("phrase"))


def _repeated_in_rows(df: DataFrame, seq: str, words: Column, n: int, least: int) -> DataFrame:
    grams = df.select(seq, words.alias("_w")).where(F.size("_w") >= least).select(seq, F.posexplode(T.ngrams(F.col("_w"), n)).alias("pos", "gram"))
    again = grams.groupBy(seq, "gram").agg(F.count("*").alias("m"), F.slice(F.array_sort(F.collect_list("pos")), 2, 1).alias("at")).where("m > 1")
    return again.groupBy(seq).agg(F.replace(F.min_by("gram", F.get("at", F.lit(0))), F.lit("\x1f"), F.lit(" ")).alias("phrase"))


def lines_of(df: DataFrame, seq: str, text: str = "text") -> DataFrame:
    """(seq, pos, line) of stripped lines that aren't empty."""
    return df.select(seq, F.posexplode(T.text_lines(text)).alias("pos", "line"))


def duplicate_report(df: DataFrame, item: str) -> DataFrame:
    """One row: items, distinct ones, share of duplicates."""
    counts = df.groupBy(item).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct_items")).withColumn("dup_ratio", F.when(F.col("total") > 0, 1 - F.col("distinct_items") / F.col("total")).otherwise(0.0))


def top_repeated(df: DataFrame, item: str, k: int = 5) -> DataFrame:
    """The k most frequent items that repeat; ties by the item."""
    return df.groupBy(item).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), item).limit(k)


def drop_adjacent(df: DataFrame, group: str, order: str, item: str) -> DataFrame:
    """Without items that equal the one before them within their group."""
    before = F.lag(item).over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("_b", before).where(~F.col(item).eqNullSafe(F.col("_b"))).drop("_b")


def section_clean(df: DataFrame, seq: str, text: str = "text") -> DataFrame:
    """(seq, cleaned): section markers removed, wrapped lines joined into paragraphs, adjacent equal ones once."""
    c = F.col(text)
    for p in L.SECTION_MARKERS:
        c = F.regexp_replace(c, "(?m)" + p, "")
    blocks = F.split(F.regexp_replace(c, LINE_BREAKS, "\n"), r"\n(?:\s*\n)+")
    paragraphs = F.filter(F.transform(blocks, T.one_line), lambda x: x != "")
    kept = T.let(paragraphs, lambda p: F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, i - 1))))
    return df.select(seq, F.array_join(kept, "\n\n").alias("cleaned"))


LINE_BREAKS = T.LINE_END


def longest_equal_run(df: DataFrame, group: str, order: str, item: str) -> DataFrame:
    """(group, longest): the longest run of neighbours that are equal when folded: gaps and islands."""
    w = Window.partitionBy(group).orderBy(order)
    rows = df.select(group, order, T.casefold(item).alias("_x"))
    rows = rows.withColumn("_new", F.when(F.col("_x") == F.lag("_x").over(w), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w))
    return rows.groupBy(group, "_run").agg(F.count("*").alias("n")).groupBy(group).agg(F.max("n").alias("longest"))
