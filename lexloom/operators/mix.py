"""Mixing corpora and cutting training rows: ordered prefixes, strides, splits, shuffles, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..shared import shared_dir, stash
from .order import numbered, prefix_until, random_stream_windows, ranked, running_total, stream_split, stream_windows, stride_sample, tail_split, within

__all__ = ["numbered", "prefix_until", "random_stream_windows", "ranked", "running_total", "stream_split", "stream_windows", "stride_sample", "tail_split", "within"]

def hold_out_last(df: DataFrame, group: str, seq: str) -> DataFrame:
    """Adds `split`: each group's last row is held out."""
    last = df.groupBy(group).agg(F.max(seq).alias(seq)).withColumn("_last", F.lit(True))
    return df.join(last, [group, seq], "left").withColumn("split", F.when(F.col("_last"), "held_out").otherwise("train")).drop("_last")


def seeded_key(seed: int, key: str | Column) -> Column:
    """An order that looks random, depends on the seed, and is the same on any cluster."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), T.col(key).cast("string")))


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Adds `place`: the row's number in the seeded order; of equal keys in any order."""
    return ranked(df.withColumn("_k", seeded_key(seed, key)), "_k", key).drop("_k")


def write_shuffled(df: DataFrame, seed: int, key: str, path: str) -> None:
    """The rows as JSON lines, files and lines in the seeded order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.withColumn("_k", seeded_key(seed, key)).repartitionByRange(parts, "_k", key).sortWithinPartitions("_k", key).drop("_k").write.mode("overwrite").json(path, ignoreNullFields="false")


def balanced_tail(df: DataFrame, group: str, item: str, seq: str, want: int, picks: list[Column] | None = None) -> DataFrame:
    """Adds `split` and `last`: of each group the first `want` items, in order, give one row each to validation, which goes to the end.

    `picks`: conditions on rows that items take in turn (the first item a row of the first one, and so on); of the
    rows that fit, the first. Items without a fitting row give none.
    """
    items = df.groupBy(group, item).agg(F.min(seq).alias("_s"))
    # a group's first items: those with fewer than `want` others in front, by their numbers
    turn = items.withColumn("_t", F.row_number().over(Window.partitionBy(group).orderBy("_s")) - 1).where(F.col("_t") < want)
    rows = df.join(turn.select(group, item, "_t"), [group, item])
    if picks:
        fits = F.lit(False)
        for k, c in enumerate(picks):
            fits = fits | ((F.col("_t") % len(picks) == k) & c)
        rows = rows.where(fits)
    chosen = rows.groupBy(group, item).agg(F.min(seq).alias(seq)).withColumn("_v", F.lit(True))
    out = df.join(chosen, [group, item, seq], "left").withColumn("last", F.coalesce("_v", F.lit(False))).drop("_v")
    return out.withColumn("split", F.when(F.col("last"), "validation").otherwise("train"))


def cycled(blocks: DataFrame, seq: str, text: str, target: int, dialect: str = "hyphen", header: str | None = None) -> DataFrame:
    """(cycle, seq, text): the blocks over and over, as whole cycles, until their words reach `target`; at least one cycle.

    `header`: text in front of each cycle, with its number for %d, whose words count too. Blocks without any word
    would never end: an error.
    """
    words = blocks.agg(F.sum(T.n_words(text, dialect))).first()[0] or 0
    if target < 1:
        raise ValueError(f"a target of {target} words")
    spark = blocks.sparkSession
    own = 0 if header is None else spark.range(1).select(T.n_words(F.lit(header % 1), dialect).alias("n")).first().n
    if words + own <= 0:
        raise ValueError("blocks without words never reach a target")
    cycles = max(1, -(-target // (words + own)))
    turns = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((cycles - 1) // COPIES).cast("long")))
    every = F.explode(F.sequence(F.col("_k") * COPIES + 1, F.least(F.lit(cycles), (F.col("_k") + 1) * COPIES)))
    rows = blocks.select(seq, text).withColumn("_k", turns).select(every.alias("cycle"), seq, text)  # each block makes its own copies
    heads = spark.range(1, cycles + 1).select(F.col("id").alias("cycle"), F.lit(-1).cast(blocks.schema[seq].dataType).alias(seq), F.format_string(header, "id").alias(text)) if header is not None else None
    return rows if heads is None else heads.unionByName(rows)


def generated_until(candidates: DataFrame, seq: str, text: str, target: int, have: int = 0, dialect: str = "hyphen", known: DataFrame | None = None) -> DataFrame:
    """Generated blocks in order, each different text (folded) once and none of the known ones, until words reach `target`.

    `have`: words that are there already. The block that crosses the target stays. Nothing when `have` reaches it.
    """
    if have >= target:
        return candidates.limit(0)
    rows = candidates.withColumn("_f", T.casefold(text))
    if known is not None:
        rows = rows.join(known.select(T.casefold(text).alias("_f")).distinct(), "_f", "left_anti")
    first = rows.groupBy("_f").agg(F.min(seq).alias(seq))
    kept = ranked(rows.join(first, ["_f", seq], "left_semi").drop("_f"), seq, name="_r")
    return prefix_until(kept, "_r", T.n_words(text, dialect), target - have).drop("_r")


def grid(spark: SparkSession, **sides: tuple[str, ...]) -> DataFrame:
    """(n, one column a side): all combinations of small fixed lists, the last side fastest; from a range alone."""
    total = 1
    for values in sides.values():
        total *= len(values)
    out, step = spark.range(total).withColumnRenamed("id", "n"), total
    for name, values in sides.items():
        step //= len(values)
        at = (F.floor(F.col("n") / step) % len(values)).cast("int")
        out = out.withColumn(name, F.get(F.array(*map(F.lit, values)), at))
    return out


def compose(template: Column, **parts: Column) -> Column:
    """A template with {name} replaced by each part, and {Name} by the part with its first letter upper-cased."""
    out = template
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
        out = F.replace(out, F.lit("{" + name.capitalize() + "}"), F.concat(F.upper(F.substring(value, 1, 1)), F.substr(value, F.lit(2))))
    return out


def composed_answer(kind: str | Column, variant: str | Column) -> Column:
    """An answer by its question's kind from a concept's columns; a contrast variant gets the contrast note behind it.

    Columns: definition, comparison, example, importance, mechanism, troubleshooting, contrast_note.
    """
    kind, low = T.col(kind), F.concat(F.lower(F.substring("troubleshooting", 1, 1)), F.substr(F.col("troubleshooting"), F.lit(2)))
    tails = {"comparison": F.col("comparison"), "example": F.col("example"), "why": F.col("importance"), "how": F.col("mechanism"), "troubleshooting": F.concat(F.lit("To troubleshoot it, "), low)}
    chain = F.when(kind == "definition", F.col("definition"))
    for name, tail in tails.items():
        chain = chain.when(kind == name, F.concat_ws(" ", "definition", tail))
    return F.when(T.col(variant) == "contrast", F.concat_ws(" ", chain, F.col("contrast_note"))).otherwise(chain)


def topic_rows(topics: DataFrame, prompt: str, suffix: str) -> DataFrame:
    """(instruction, response, domain) from (domain, term, definition): the prompt with {term}, and the definition as a sentence."""
    name = F.concat(F.upper(F.substring("term", 1, 1)), F.lower(F.substr(F.col("term"), F.lit(2))))
    return topics.select(F.replace(F.lit(prompt), F.lit("{term}"), F.col("term")).alias("instruction"), F.concat(name, F.lit(" is "), F.col("definition"), F.lit(". " + suffix)).alias("response"), "domain")


def labelled(df: DataFrame, key: str, labels: DataFrame, name: str = "label") -> DataFrame:
    """Adds the label of a key from (key, label); keys without one get their own words."""
    found = labels.select(F.col("key").alias(key), F.col("label").alias("_l"))
    return df.join(found, key, "left").withColumn(name, F.coalesce("_l", F.replace(key, F.lit("_"), F.lit(" ")))).drop("_l")


def resolved(name: str, options: tuple[str, ...], aliases: dict[str, str] | None = None, dashes: bool = False) -> str:
    """The option that a name, in any case and perhaps by an alias, stands for; an error that lists the options otherwise."""
    key = name.strip().lower()
    key = (aliases or {}).get(key, key)
    key = key.replace("-", "_") if dashes else key
    if key not in options:
        raise ValueError(f"unknown name {name!r}; one of {', '.join(sorted(options))}")
    return key


def group_ids(df: DataFrame, group: str, seq: str, width: int = 3) -> DataFrame:
    """Adds `id`: the group's name and a padded number within it."""
    return within(df, group, seq, "_n").withColumn("id", F.concat(F.col(group), F.lit("-"), F.lpad(F.col("_n").cast("string"), width, "0"))).drop("_n")


def repeat_rows(df: DataFrame, times: int | Column, name: str = "copy") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(times) if isinstance(times, int) else times)))


def word_share(df: DataFrame, group: str, text: str = "text", target: Column | None = None) -> DataFrame:
    """(group, blocks, words, share): word-weighted distribution."""
    g = df.groupBy(group).agg(F.count("*").alias("blocks"), F.sum(T.n_words(text, "space")).alias("words"))
    return g.withColumn("share", F.col("words") / F.sum("words").over(Window.partitionBy()))


def mix_to_ratio(base: DataFrame, chat: DataFrame, seq: str, ratio: float, text: str = "text") -> DataFrame:
    """Base blocks and as many chat blocks, in order, as make up the ratio of all words; with a tag each."""
    if not 0 < ratio < 1:
        raise ValueError(f"a chat ratio of {ratio} is not between 0 and 1")
    words = base.agg(F.sum(T.n_words(text, "space"))).first()[0] or 0
    picked = prefix_until(chat, seq, T.n_words(text, "space"), words * ratio / (1 - ratio))
    return base.withColumn("tag", F.lit("base")).unionByName(picked.withColumn("tag", F.lit("chat")))


#: Copies of an item that one row makes at once.
COPIES = 1 << 16


def apart(df: DataFrame, item: str, seed: int = 42) -> DataFrame:
    """(place, item): all rows from place 0 on, without equal neighbours: always the item with the most copies left but for the one just placed, ties by a seeded order.

    A row has a level, the copies left when its turn comes. By (level falling, tie) all rows stand as wanted if two items or more share
    the most copies. One item ahead of all others takes every second place, and the others go between in their own order,
    until one of them comes before it; from there on the order of levels holds again. So one ranking of the copies
    gives every place. An item of more than half of all rows, rounded up, is an error.
    """
    counts = df.groupBy(item).agg(F.count("*").alias("n")).select(F.col(item).alias("item"), "n", seeded_key(seed, item).alias("tie"))
    counts = stash(ranked(counts, "tie", "item", name="_t"), shared_dir(df.sparkSession), "counts")
    facts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    top = counts.orderBy(F.desc("n"), "_t").limit(2).collect()
    if top and top[0].n > -(-facts.total // 2):
        raise ValueError("an item has too many copies to keep them apart")
    parts = counts.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    rows = parts.select("item", "_t", F.explode(F.sequence(F.col("_k") * COPIES + 1, F.least(F.col("n"), (F.col("_k") + 1) * COPIES))).alias("_l"))
    rows = ranked(rows.withColumn("_down", -F.col("_l")), "_down", "_t", name="_g").drop("_down")
    if not top or len(top) > 1 and top[0].n == top[1].n:
        return rows.select((F.col("_g") - 1).alias("place"), "item")
    rows = stash(rows, shared_dir(df.sparkSession), "copies")
    first, most = top[0]._t, top[0].n
    turn = F.col("_g") - (most - F.col("_l")) - (F.col("_t") > first).cast("long")  # the number among the other items' rows
    other = F.col("_t") != first
    wins = (F.col("_l") > most - turn + 1) | ((F.col("_l") == most - turn + 1) & (F.col("_t") < first))
    lost = rows.where(other & (turn >= 2) & wins).agg(F.min(turn).alias("j")).first().j
    alone = most if lost is None else lost - 1  # copies of the first item that take every second place
    place = F.when(~other & (F.col("_l") > most - alone), 2 * (most - F.col("_l"))).when(other & (turn <= alone), 2 * turn - 1).otherwise(F.col("_g") - 1)
    return rows.select(place.alias("place"), "item")


def token_windows(ids: str | Column, size: int, stride: int) -> Column:
    """Array of struct(x, y): windows of `size` ids at a stride, y one step on; none for shorter inputs."""
    if size < 1 or stride < 1:
        raise ValueError(f"windows of {size} ids at a stride of {stride}")

    def cut(a: Column) -> Column:
        last = F.size(a) - size - 1
        at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda s: F.struct(F.slice(a, s + 1, size).alias("x"), F.slice(a, s + 2, size).alias("y")))

    return T.let(T.col(ids), cut)


def random_windows(df: DataFrame, seq: str, ids: str, size: int, count: int, seed: int = 42) -> DataFrame:
    """(seq, k, x, y): `count` windows of each row's ids at starts that look random, the same on any cluster; none for shorter rows."""
    last = F.size(ids) - size - 1
    rows = df.where(last >= 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    start = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(seq).cast("string"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("long"), last + 1).cast("int")
    return rows.withColumn("_s", start).select(seq, "k", F.slice(ids, F.col("_s") + 1, size).alias("x"), F.slice(ids, F.col("_s") + 2, size).alias("y"))


def contrast_cycled(df: DataFrame, seq: str, comparison: Column, answer: str, contrasts: tuple[str, ...]) -> DataFrame:
    """Adds `cycled`: comparison questions take the next contrast answer in turn, others keep their own."""
    turns = ranked(df.where(comparison).select(F.col(seq).alias("_s")), "_s", name="_n")  # the questions' numbers alone are put in order
    turn = F.get(F.array(*map(F.lit, contrasts)), F.pmod(F.col("_n") - 1, F.lit(len(contrasts))).cast("int"))
    return df.join(turns, F.col(seq) == F.col("_s"), "left").withColumn("cycled", F.when(F.col("_n").isNotNull(), turn).otherwise(F.col(answer))).drop("_s", "_n")


def sampled(df: DataFrame, key: str, want: int, seed: int = 42) -> DataFrame:
    """`want` rows that look random, the same on any cluster: a sampling operator."""
    return df.withColumn("_k", seeded_key(seed, key)).orderBy("_k", key).limit(want).drop("_k")


def paraphrases(concepts: DataFrame, templates: DataFrame, most: int = 10) -> DataFrame:
    """Every concept with every template (t, template), each different question once, the first `most` by template."""
    rows = template_rows(concepts, templates)
    first = rows.groupBy("concept", "instruction").agg(F.min("t").alias("t"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("concept").orderBy("t"))).where(F.col("n") <= most)


def with_generated(existing: DataFrame, generated: DataFrame, seq: str, text: str = "text") -> DataFrame:
    """Existing blocks as they are, and generated ones whose folded text is new, the first of each; `generated` tells which."""
    fold = T.casefold(text)
    new = generated.withColumn("_f", fold).join(existing.select(fold.alias("_f")).distinct(), "_f", "left_anti")
    first = new.groupBy("_f").agg(F.min(seq).alias(seq))
    kept = new.join(first, ["_f", seq], "left_semi").drop("_f")
    return existing.withColumn("generated", F.lit(False)).unionByName(kept.withColumn("generated", F.lit(True)))


def find_slice(array: Column, needle: list[int]) -> Column:
    """The first place (from 0) where a fixed sequence stands in an array; null if nowhere."""
    target = F.array(*map(F.lit, needle))
    hit = lambda a: F.filter(F.sequence(F.lit(0), F.greatest(F.size(a) - len(needle), F.lit(0))), lambda i: F.slice(a, i + 1, len(needle)) == target)
    return T.let(array, lambda a: F.get(hit(a), F.lit(0)))


def loss_rows(df: DataFrame, ids: str, size: int, answer: list[int], end: list[int], first_weight: float = 8.0, end_weight: float = 2.0, pad: int = 0) -> DataFrame:
    """Adds x, y, w of fixed length: prompt targets weigh 0, the answer's first `first_weight`, its end `end_weight`, the rest 1.

    Rows whose ids hold no answer marker, or that are too short, are left out.
    """
    cut = F.slice(ids, 1, size + 1)
    df = df.withColumn("_i", cut).where(F.size("_i") >= 2)
    df = df.withColumn("_a", find_slice(F.col("_i"), answer) + len(answer) - 1).withColumn("_e", find_slice(F.col("_i"), end))
    df = df.where(F.col("_a").isNotNull() & (F.col("_a") < F.size("_i") - 1))
    last = F.least(F.size("_i") - 2, F.coalesce(F.col("_e") + len(end) - 2, F.size("_i") - 2))

    def weight(p: Column) -> Column:
        inside = (p >= F.col("_a")) & (p <= F.col("_l"))
        ending = F.col("_e").isNotNull() & (p >= F.greatest(F.col("_a"), F.col("_e") - 1)) & (p <= F.col("_l"))
        return F.when(ending, float(end_weight)).when(p == F.col("_a"), float(first_weight)).when(inside, 1.0).otherwise(0.0)

    df = df.withColumn("_l", last)
    full = F.concat("_i", F.array_repeat(F.lit(pad).cast("int"), F.lit(size + 1) - F.size("_i")))
    w = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda p: weight(p))
    return df.withColumn("x", F.slice(full, 1, size)).withColumn("y", F.slice(full, 2, size)).withColumn("w", w).drop("_i", "_a", "_e", "_l")


def arithmetic_grid(spark: SparkSession, most: int) -> DataFrame:
    """(instruction, response, kind): additions, subtractions and products of small numbers, from ranges alone."""
    a, b = spark.range(1, most + 1).withColumnRenamed("id", "a"), spark.range(1, most + 1).withColumnRenamed("id", "b")
    g = a.crossJoin(F.broadcast(b))
    row = lambda kind, sign, word, value: g.where("a >= b" if kind == "sub" else "true").select("a", "b", F.lit(kind).alias("kind"), F.format_string(f"What is %d {sign} %d?", "a", "b").alias("instruction"), F.format_string(f"%d {word} %d equals %d.", F.col("a"), F.col("b"), value).alias("response"))
    return row("add", "+", "plus", F.col("a") + F.col("b")).union(row("sub", "-", "minus", F.col("a") - F.col("b"))).union(row("mul", "*", "times", F.col("a") * F.col("b")))


def template_rows(concepts: DataFrame, templates: DataFrame) -> DataFrame:
    """Every concept with every template, its name in place of {}; the templates are a small fixed table."""
    return concepts.crossJoin(F.broadcast(templates)).withColumn("instruction", F.replace("template", F.lit("{}"), "concept"))


def cyclic_answers(df: DataFrame, seq: str, answers: str) -> DataFrame:
    """Adds `answer`: the next of the row's answers, in turn along the order."""
    return df.withColumn("answer", F.element_at(answers, (F.col(seq) % F.size(answers) + 1).cast("int")))


def hard_negatives(concepts: DataFrame, want: int = 3) -> DataFrame:
    """(concept, negatives): related, contrast, then the next concepts of its domain in turn, up to `want` distinct ones.

    The next ones are looked up by their numbers within the domain: `want` and three more, of which at most two
    are the related and the contrast one, and one the concept itself.
    """
    rows = within(concepts.select("concept", "domain", "related", "contrast"), "domain", "concept", "_n").withColumn("_n", F.col("_n") - 1)
    sizes = rows.groupBy("domain").agg(F.count("*").alias("_m"))
    asked = rows.join(sizes, "domain").withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(want + 3)))).where(F.col("_k") < F.col("_m"))
    asked = asked.select("domain", F.col("concept").alias("_c"), "_k", ((F.col("_n") + F.col("_k")) % F.col("_m")).alias("_n"))
    near = asked.join(rows.select("domain", "_n", "concept"), ["domain", "_n"]).groupBy("domain", "_c").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "concept"))), lambda x: x["concept"]).alias("_turn"))
    rows = rows.join(near, (rows["domain"] == near["domain"]) & (F.col("concept") == F.col("_c")), "left").withColumn("_turn", F.coalesce("_turn", F.array().cast("array<string>")))
    own = F.filter(F.array_distinct(F.concat(F.array("related", "contrast"), F.col("_turn"))), lambda x: x.isNotNull() & (x != F.col("concept")))
    return rows.select("concept", F.slice(own, 1, want).alias("negatives"))
