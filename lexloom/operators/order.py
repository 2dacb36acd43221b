"""Work along an order of a whole table: running totals, ranks, prefixes, token streams, runs, shards.

No task sees all rows. A table is dealt over partitions by ranges of the order and written; each range is worked on by
itself, and only a summary of each (a sum, its first and last run, where its shards would end) meets those of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..shared import shared_dir, stash


def dealt(df: DataFrame, *order: str) -> DataFrame:
    """The rows with `_p`, the number of the range of the order that they are in; written, so that every reader sees the same cut."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stash(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), shared_dir(df.sparkSession), "ranges")


def _before(cut: DataFrame, values: list[str]) -> DataFrame:
    """(_p, _b_NAME): sums of the ranges in front of each; a row for each range passes through one window."""
    sums = cut.groupBy("_p").agg(*(F.sum(v).alias(v) for v in values))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_p", *(F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"_b{v}") for v in values))


def scanned(df: DataFrame, *order: str, **values: str | Column) -> DataFrame:
    """Adds running sums in any order, each up to and with its row: by ranges first, then within each.

    Rows that are equal in the order come one after the other.
    """
    names = [f"_v{k}" for k in range(len(values))]
    cut = dealt(df.withColumns({n: T.col(v) for n, v in zip(names, values.values(), strict=True)}), *order)
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumns({f"_i{n}": F.sum(n).over(w) for n in names}).join(F.broadcast(_before(cut, names)), "_p")
    own = own.withColumns({v: F.col(f"_b{n}") + F.col(f"_i{n}") for v, n in zip(values, names, strict=True)})
    return own.drop("_p", *names, *(f"_i{n}" for n in names), *(f"_b{n}" for n in names))


def running_total(df: DataFrame, seq: str, value: str | Column, name: str = "total") -> DataFrame:
    """Adds the sum of `value` over all rows up to and with this one, in order of `seq`, whatever its type and gaps."""
    return scanned(df, seq, **{name: value})


def ranked(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """Adds the row's number from 1 in an order of any columns. Equal rows get numbers one after the other."""
    return scanned(df, *order, **{name: F.lit(1).cast("long")})


def numbered(df: DataFrame, seq: str, name: str = "n") -> DataFrame:
    """Adds the row's number from 1 in order of `seq`."""
    return ranked(df, seq, name=name)


def prefix_until(df: DataFrame, seq: str, weight: str | Column, target: float) -> DataFrame:
    """Rows in order until their weights reach the target, with the row that crosses it; at least one row.

    Weights are 0 or more, and a seq stands for one row. Only (seq, weight) is put in order, to find the last seq; the
    rows themselves are filtered where they lie.
    """
    rows = scanned(df.select(F.col(seq).alias("_s"), T.col(weight).alias("_w")), "_s", _t="_w")
    last = rows.agg(F.coalesce(F.max(F.when(F.col("_t") - F.col("_w") < target, F.col("_s"))), F.min("_s")).alias("s")).first().s
    return df.limit(0) if last is None else df.where(F.col(seq) <= F.lit(last))


def stride_sample(df: DataFrame, seq: str, count: int) -> DataFrame:
    """At most `count` rows at a fixed stride of the order, the first one included; those seqs alone travel."""
    if count < 0:
        raise ValueError(f"a sample of {count} rows")
    rows = ranked(df.select(F.col(seq).alias("_s")), "_s", name="_n")
    step = max(1, rows.count() // count) if count else 1
    chosen = rows.where((F.col("_n") - 1) % step == 0).orderBy("_n").limit(count).select(F.col("_s").alias(seq))
    return df.join(F.broadcast(chosen), seq, "left_semi").orderBy(seq)


def tail_split(df: DataFrame, seq: str, share: float) -> DataFrame:
    """Adds `split`: the last `share` of the order is validation."""
    if not 0 <= share <= 1:
        raise ValueError(f"a share of {share} is not between 0 and 1")
    rows = ranked(df.select(F.col(seq).alias("_s")), "_s", name="_n")
    keep = int(rows.count() * (1 - share))
    last = rows.where(F.col("_n") == keep).agg(F.max("_s").alias("s")).first().s
    return df.withColumn("split", F.when(F.lit(False) if last is None else F.col(seq) <= F.lit(last), "train").otherwise("validation"))


def within(df: DataFrame, group: str, seq: str, name: str) -> DataFrame:
    """Adds the row's number from 1 within its group, by one order of all rows; a group of any size is dealt over partitions."""
    rows = ranked(df, group, seq, name="_r")
    first = rows.groupBy(group).agg(F.min("_r").alias("_f")).withColumnRenamed(group, "_g")
    return rows.join(first, F.col(group).eqNullSafe(F.col("_g"))).withColumn(name, F.col("_r") - F.col("_f") + 1).drop("_r", "_f", "_g")


# -- one stream of all rows' tokens


def offsets(df: DataFrame, seq: str, ids: str) -> DataFrame:
    """(seq, begin, end): where each row's tokens stand in the stream of all rows in order; no token travels."""
    rows = scanned(df.select(seq, F.coalesce(F.size(ids), F.lit(0)).cast("long").alias("_n")), seq, end="_n")
    return rows.select(seq, (F.col("end") - F.col("_n")).alias("begin"), "end").where("end > begin")


def stream_windows(df: DataFrame, seq: str, ids: str, starts: DataFrame, size: int, index: DataFrame | None = None) -> DataFrame:
    """(k, x, y): for each (k, start) `size` tokens of the stream from there on, and those one step further; across rows.

    `index` is that of `offsets`. A window looks up the rows it touches by blocks of the stream, and each of those gives
    its own slice: no row travels for a window, and none is joined to its neighbours. Windows that pass the end are left out.
    """
    index = (offsets(df, seq, ids) if index is None else index).select(F.col(seq).alias("_s"), "begin", "end")
    block = max(1024, size + 1)
    cover = lambda a, b: F.explode(F.sequence(F.floor(a / block), F.floor((b - 1) / block)))
    have = index.withColumn("_b", cover(F.col("begin"), F.col("end")))
    want = starts.select("k", F.col("start").cast("long").alias("start")).where("start >= 0").withColumn("_b", cover(F.col("start"), F.col("start") + size + 1))
    touched = want.join(have, "_b").where(F.col("_b") == F.greatest(F.floor(F.col("start") / block), F.floor(F.col("begin") / block)))  # each pair once
    low, high = F.greatest("start", "begin"), F.least(F.col("start") + size + 1, F.col("end"))
    parts = touched.where(high > low).select("k", "_s", (low - F.col("begin")).cast("int").alias("_at"), (high - low).cast("int").alias("_n"), "begin")
    rows = df.select(F.col(seq).alias("_s"), F.col(ids).alias("_ids")).join(parts, "_s").select("k", "begin", F.slice("_ids", F.col("_at") + 1, F.col("_n")).alias("part"))
    whole = rows.groupBy("k").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("begin", "part"))), lambda x: x["part"])).alias("w")).where(F.size("w") == size + 1)
    return whole.select("k", F.slice("w", 1, size).alias("x"), F.slice("w", 2, size).alias("y"))


def random_stream_windows(df: DataFrame, seq: str, ids: str, size: int, count: int, seed: int = 42) -> DataFrame:
    """(k, x, y): `count` windows of the stream at starts that look random, the same on any cluster. A stream that holds none: an error."""
    index = stash(offsets(df, seq, ids), shared_dir(df.sparkSession), "offsets")
    total = index.agg(F.coalesce(F.max("end"), F.lit(0))).first()[0]
    if total < size + 1:
        raise ValueError(f"a stream of {total} tokens holds no window of {size} and the next one")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")
    starts = df.sparkSession.range(count).select(F.col("id").alias("k"), F.pmod(draw, F.lit(total - size)).alias("start"))
    return stream_windows(df, seq, ids, starts, size, index)


def stream_split(df: DataFrame, seq: str, ids: str, share: float) -> DataFrame:
    """(seq, split, ids): the last `share` of all tokens is validation; the row across the border gives to both."""
    if not 0 <= share <= 1:
        raise ValueError(f"a share of {share} is not between 0 and 1")
    index = stash(offsets(df, seq, ids), shared_dir(df.sparkSession), "offsets")
    total = index.agg(F.coalesce(F.max("end"), F.lit(0))).first()[0]
    keep = F.least(F.greatest(F.lit(int(total * (1 - share))) - F.col("begin"), F.lit(0)), F.col("end") - F.col("begin")).cast("int")
    rows = df.select(seq, ids).join(index, seq).withColumn("_k", keep)
    sides = F.array(F.struct(F.lit("train").alias("split"), F.slice(ids, 1, F.col("_k")).alias("ids")), F.struct(F.lit("validation").alias("split"), F.slice(ids, F.col("_k") + 1, F.size(ids)).alias("ids")))
    return rows.select(F.col(seq).alias("_seq"), F.inline(sides)).where(F.size("ids") > 0).withColumnRenamed("_seq", seq)


# -- runs of equal neighbours


def equal_runs(df: DataFrame, order: str, item: str | Column, least: int = 1) -> DataFrame:
    """(first, n): runs of at least `least` neighbours that are equal, over the order of the whole table; nulls equal each other.

    A range's runs are found by gaps and islands. Only its first and its last run can go on elsewhere: those, two rows a
    range, are put together in one window.
    """
    cut = dealt(df.select(F.col(order).alias("first"), T.col(item).alias("_x")), "first")
    w = Window.partitionBy("_p").orderBy("first")
    rows = cut.withColumn("_new", F.when(F.col("_x").eqNullSafe(F.lag("_x").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("_p", "_run").agg(F.min("first").alias("first"), F.count("*").alias("n"), F.first("_x").alias("_x"))
    inner = Window.partitionBy("_p")
    runs = runs.withColumn("_last", F.max("_run").over(inner))
    edge = runs.where((F.col("_run") == 1) | (F.col("_run") == F.col("_last")))
    at = Window.orderBy("_p", "_run")
    joins = F.col("_x").eqNullSafe(F.lag("_x").over(at)) & (F.col("_run") == 1) & (F.row_number().over(at) > 1)
    edge = edge.withColumn("_g", F.sum(F.when(joins, 0).otherwise(1)).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.groupBy("_g").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    out = edge.select("first", "n").unionAll(runs.where((F.col("_run") > 1) & (F.col("_run") < F.col("_last"))).select("first", "n"))
    return out.where(F.col("n") >= least)


def longest_run(df: DataFrame, order: str, item: str | Column) -> DataFrame:
    """One row: the longest run of neighbours that are equal when folded; 0 for an empty table."""
    return equal_runs(df, order, T.casefold(item)).agg(F.coalesce(F.max("n"), F.lit(0)).alias("longest"))


def without_repeats(df: DataFrame, order: str, item: str | Column) -> DataFrame:
    """The first row of each run of equal neighbours."""
    first = equal_runs(df, order, item).select(F.col("first").alias("_first"))
    return df.join(first, F.col(order) == F.col("_first"), "left_semi")


# -- shards


#: Ranges whose summaries one task puts together.
FAN = 64


def _next(total: np.ndarray, begin: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For a shard from each row of a range: the running total that it may reach, and the first row beyond (the range's length: none).

    total: running totals up to and with each row; begin: the one in front of the range.
    """
    before = np.concatenate([[begin], total[:-1]])
    reach = before + most
    return reach, np.maximum(np.searchsorted(total, reach, "right"), np.arange(1, len(total) + 1))  # a row that is too large by itself fills a shard


def _summary(total: np.ndarray, begin: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A range as a function from what the open shard may reach to what the last shard that starts in the range may.

    As steps: an incoming reach below bound[k], and not below bound[k - 1], gives reach[k]; from the last bound on no
    shard starts here, and the reach passes on. Steps are at most the rows of one shard, and fewer where shards that
    start in neighbouring rows come to end alike.
    """
    reach, after = _next(total, begin, most)
    last = np.where(after == len(total), np.arange(len(total)), after)
    while (further := last[last]).tolist() != last.tolist():
        last = further
    entries = int(np.searchsorted(total, begin + most, "right")) + 1  # an open shard reaches no further than `most` into the range
    bound, out = total[:entries], reach[last[:entries]]
    end = np.append(out[1:] != out[:-1], True)
    return bound[end], out[end]


def _through(steps: tuple[np.ndarray, np.ndarray], reach: int) -> int:
    k = int(np.searchsorted(steps[0], reach, "right"))
    return int(steps[1][k]) if k < len(steps[0]) else reach


def _joined(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two neighbouring ranges' functions as one; incoming reaches from a's last bound on go to b alone."""
    out = [_through(b, int(x)) for x in a[1]]
    top = int(a[0][-1]) if len(a[0]) else np.iinfo(np.int64).min
    beyond = b[0] > top
    bound, out = np.concatenate([a[0], b[0][beyond]]), np.concatenate([np.array(out, np.int64), b[1][beyond]])
    end = np.append(out[1:] != out[:-1], True) if len(out) else np.zeros(0, bool)
    return bound[end], out[end]


def _entries(steps: DataFrame) -> DataFrame:
    """(_p, reach): what the open shard may reach when each range begins.

    Functions of FAN neighbouring ranges are put together in a task, then those of FAN such groups, until one is left;
    then the reach goes down the same way. So no task or driver holds more than FAN functions.
    """
    spark, schema = steps.sparkSession, "_p long, bound array<long>, out array<long>"
    folder, levels = shared_dir(spark), [steps]

    def up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_p")
        whole = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for bound, out in zip(rows["bound"], rows["out"], strict=True):
            whole = _joined(whole, (np.asarray(bound, np.int64), np.asarray(out, np.int64)))
        return pd.DataFrame({"_p": [int(key[0])], "bound": [whole[0].tolist()], "out": [whole[1].tolist()]})

    def down(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_p")
        reach, found = int(rows["reach"].iloc[0]), []
        for bound, out in zip(rows["bound"], rows["out"], strict=True):
            found.append(reach)
            reach = _through((np.asarray(bound, np.int64), np.asarray(out, np.int64)), reach)
        return pd.DataFrame({"_p": rows["_p"].to_numpy(), "reach": found})

    group = F.floor(F.col("_p") / FAN)
    while levels[-1].count() > 1:
        levels.append(stash(levels[-1].groupBy(group.alias("_g")).applyInPandas(up, schema), folder, f"level-{len(levels)}"))
    reach = levels[-1].select("_p", F.lit(-1).cast("long").alias("reach"))  # nothing is open: the first row starts a shard
    for level in levels[-2::-1]:
        own = level.withColumn("_g", group).join(F.broadcast(reach.select(F.col("_p").alias("_g"), "reach")), "_g")
        reach = own.groupBy("_g").applyInPandas(down, "_p long, reach long")
    return reach


def next_fit(df: DataFrame, seq: str, size: str | Column, most: int) -> DataFrame:
    """(seq, shard): rows in order fill one shard until the next row would pass `most`; a lone row may. Shards count from 0.

    The rule is sequential, but a range of rows acts on the open shard only through what that may still reach. So each
    range is summed up as a step function; the functions are put together by pairs of neighbours, which tells what is open
    when each range begins; then every range cuts its own rows, and shards are numbered by sums.
    """
    if most < 1:
        raise ValueError(f"shards of {most} bytes")
    spark = df.sparkSession
    cut = dealt(df.select(F.col(seq).alias("_s"), T.col(size).cast("long").alias("_z")), "_s")
    rows = cut.join(F.broadcast(_before(cut, ["_z"])), "_p")

    def steps(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        begin = int(rows["_b_z"].iloc[0])
        bound, out = _summary(begin + np.cumsum(rows.sort_values("_s")["_z"].to_numpy(np.int64)), begin, most)
        return pd.DataFrame({"_p": [int(key[0])], "bound": [bound.tolist()], "out": [out.tolist()]})

    folder = shared_dir(spark)
    told = stash(rows.groupBy("_p").applyInPandas(steps, "_p long, bound array<long>, out array<long>"), folder, "steps")
    entries = told.select("_p").join(_entries(told), "_p")

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_s")
        begin = int(rows["_b_z"].iloc[0])
        total = begin + np.cumsum(rows["_z"].to_numpy(np.int64))
        _, after = _next(total, begin, most)
        starts, at = np.zeros(len(total), np.int64), int(np.searchsorted(total, int(rows["reach"].iloc[0]), "right"))
        while at < len(total):
            starts[at] = 1
            at = int(after[at])
        return pd.DataFrame({"_p": rows["_p"].to_numpy(), "_s": rows["_s"].to_numpy(), "_k": np.cumsum(starts), "_n": starts})

    kind = df.schema[seq].dataType.simpleString()
    filled = rows.join(F.broadcast(entries), "_p").groupBy("_p").applyInPandas(fill, f"_p long, _s {kind}, _k long, _n long")
    filled = stash(filled, folder, "filled")
    return filled.join(F.broadcast(_before(filled, ["_n"])), "_p").select(F.col("_s").alias(seq), (F.col("_b_n") + F.col("_k") - 1).alias("shard"))
