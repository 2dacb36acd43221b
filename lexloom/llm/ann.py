"""Approximate nearest neighbours by inner product: a hash-prefix forest, searched in blocks.

Each tree keeps the long sign-hash strings of a shard's vectors in a sorted array. A query descends every tree
to its longest matching prefix, whose length varies from tree to tree. Then the trees ascend together: from the
longest of those matches on, one bit at a time, every tree whose match is that long adds the vectors that share
the shortened prefix, until there are enough; those are ranked exactly. Vectors get one more component that
makes the largest inner product the smallest angle. Shards of vectors meet blocks of queries tile by tile, so a
task's memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import map_batches, shared_dir, stash

#: Neighbours; trees; bits of a hash string.
TOP, TREES, BITS = 20, 160, 32
#: Candidates of a query in all shards: FACTOR * n ** POWER, so that its work grows slower than the table; and
#: LEAST at least. Fitted on vectors without any structure, the hardest case, for a recall above 0.9.
FACTOR, POWER, LEAST = 1.7, 0.81, 256
#: Vectors of a shard and queries of a block, at most; queries that ascend together; distinct vector lengths that
#: a broadcast may hold.
SHARD, BLOCK, GROUP, LENGTHS = 1 << 16, 1 << 13, 64, 1 << 16


class Forest:
    """The trees of one shard: sorted hash strings, and which vector each belongs to."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 11):
        """x: vectors of norm 1 at most."""
        self.n, self.trees, self.bits = len(x), trees, bits
        self.planes = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, trees * bits)).astype(np.float32)
        left = np.sqrt(np.maximum(0.0, 1.0 - (x**2).sum(1)))
        self.sorted, self.order = self._strings(np.hstack([x, left[:, None]])), np.empty((trees, self.n), np.int32)
        for t in range(trees):
            self.order[t] = np.argsort(self.sorted[t], kind="stable")
            self.sorted[t] = self.sorted[t, self.order[t]]

    def _strings(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((self.trees, len(x)), np.uint32)
        weight = 2.0 ** np.arange(self.bits - 1, -1, -1)
        x = x.astype(np.float32)
        for t in range(self.trees):
            out[t] = ((x @ self.planes[:, t * self.bits : (t + 1) * self.bits]) > 0) @ weight
        return out

    def longest(self, strings: np.ndarray) -> np.ndarray:
        """For each tree and query, the length of the longest prefix that any vector shares with it.

        It is shared by one of the two neighbours of the query's place in the sorted array.
        """
        out = np.empty(strings.shape, np.int64)
        for t in range(self.trees):
            at = np.searchsorted(self.sorted[t], strings[t])
            near = np.minimum(self.sorted[t, np.maximum(at - 1, 0)] ^ strings[t], self.sorted[t, np.minimum(at, self.n - 1)] ^ strings[t])
            out[t] = self.bits - np.frexp(near.astype(np.float64))[1]
        return out

    def ranges(self, strings: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in each tree the vectors stand that share a query's prefix of its `depth` bits."""
        shift = (self.bits - depth).astype(np.uint64)
        lo, hi = np.empty(strings.shape, np.int64), np.empty(strings.shape, np.int64)
        for t in range(self.trees):
            first = strings[t].astype(np.uint64) >> shift << shift
            last = np.minimum(first + (np.uint64(1) << shift) - np.uint64(1), np.uint64(0xFFFFFFFF))
            lo[t] = np.searchsorted(self.sorted[t], first.astype(np.uint32), "left")
            hi[t] = np.searchsorted(self.sorted[t], last.astype(np.uint32), "right")
        return lo, hi

    def search(self, q: np.ndarray, want: int) -> Iterator[np.ndarray]:
        """Candidates of each query (unit vectors): all of the level at which the synchronous ascent has `want`.

        Candidates only grow on the way up, from the longest match of any tree to the root, so the level is found
        by halving: first by the ranges' sizes, which bound it from below the root, then, since ranges of
        different trees overlap, by the candidates themselves.
        """
        strings = self._strings(np.hstack([q, np.zeros((len(q), 1))]))
        level, top = np.zeros(len(q), np.int64), self.longest(strings).max(0)
        while (open_ := level < top).any():
            mid = (level + top + 1) // 2
            lo, hi = self.ranges(strings, mid)
            enough = (hi - lo).sum(0) >= want
            level, top = np.where(open_ & enough, mid, level), np.where(open_ & ~enough, mid - 1, top)
        for start in range(0, len(q), GROUP):
            own, top = strings[:, start : start + GROUP], level[start : start + GROUP].copy()
            low, mid, found = np.zeros(len(top), np.int64), top.copy(), {}
            left = np.arange(len(top))
            while len(left):
                lo, hi = self.ranges(own[:, left], mid[left])
                for k, i in enumerate(left.tolist()):
                    union = self._union(lo[:, k], hi[:, k])
                    if len(union) >= want or not mid[i]:
                        low[i], found[i] = mid[i], union
                    else:
                        first = mid[i] == top[i] == level[start + i]
                        top[i] = mid[i] - 1
                        mid[i] = top[i] if first else mid[i]
                        if first:
                            continue
                    mid[i] = (low[i] + top[i] + 1) // 2
                left = np.array([i for i in left.tolist() if i not in found or low[i] < top[i]], np.int64)
            yield from (found.pop(i) for i in range(len(top)))

    def _union(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        size = hi - lo
        end = np.cumsum(size)
        at = np.arange(end[-1]) + np.repeat(lo + np.arange(self.trees) * self.n - (end - size), size)
        seen = np.zeros(self.n, bool)
        seen[self.order.ravel()[at]] = True
        return np.flatnonzero(seen)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        use = np.flatnonzero(scores >= floor)
    else:
        use = np.arange(len(scores))
    return use[np.lexsort((ids[use], -scores[use]))][:k]


def once(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of each id's best score."""
    order = np.lexsort((-scores, ids))
    return order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])] if len(order) else order


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of vectors that take part: not null or zero, all components finite numbers; null ids don't."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    low, high = F.array_min("v"), F.array_max("v")  # NaN counts as the largest
    good = (F.size(F.array_compact("v")) == F.size("v")) & (high < float("inf")) & (low > -float("inf")) & ((low != 0) | (high != 0))
    return rows.where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))


def _norm(v: Column) -> Column:
    """Length of a vector; squares of large components don't overflow."""
    top = F.greatest(F.array_max(v), -F.array_min(v))
    return top * F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x / top) * (x / top)))


def nearest(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 20, top: int = TOP, factor: float = FACTOR, trees: int = TREES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's `top` nearest found; queries: ids divisible by `every`.

    Every usable row is indexed, together with those of its length: vectors of other lengths have no inner
    product with it. Rows that repeat id and vector count once. Repeated ids: each vector is a candidate, and an id is listed once, with its best score; a
    query never lists its own id, and a query id of several rows gets the best of all of them. Ties go to the
    smaller id; equal vectors have equal scores. `factor=float("inf")` makes every vector a candidate, which is
    exact. Empty tables, and queries without candidates: no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding).withColumn("d", F.size("v"))
    slots = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sizes = rows.groupBy("d").agg(F.count("*").alias("n"), F.sum((F.col("id") % every == 0).cast("long")).alias("q"), F.max(_norm(F.col("v"))).alias("largest"))
    shards = F.greatest(F.ceil(F.col("n") / SHARD), F.least(F.lit(slots), F.ceil(F.col("n") / 8192)), F.lit(1)).cast("int")
    sizes = sizes.select("d", "n", "largest", shards.alias("shards"), F.greatest(F.ceil(F.col("q") / BLOCK), F.lit(1)).cast("int").alias("blocks"))
    sizes = stash(sizes, shared_dir(spark), "sizes")
    rows = rows.join(F.broadcast(sizes) if sizes.count() <= LENGTHS else sizes, "d")
    rows = rows.withColumn("h", F.xxhash64("id", "v"))
    columns = ("d", "shard", "block", "side", "id", "h", "n", "largest", "shards", "v")
    deal = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(k)).cast("int")
    own = rows.withColumn("shard", F.pmod("h", "shards").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0))
    ask = rows.where(F.col("id") % every == 0).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("block", deal(1, "blocks")).withColumn("side", F.lit(1))
    tiles = own.select(*columns).union(ask.select(*columns)).repartition(slots, "d", "shard", "block").sortWithinPartitions("d", "shard", "block", "side", "id", "h")

    def tile(n: int, largest: float, shards: int, ids: np.ndarray, v: np.ndarray, qid: np.ndarray, qv: np.ndarray) -> Iterator[dict]:
        want = min(len(ids), max(LEAST, top + 1, int(min(factor * n**POWER / shards, len(ids)))))
        x = v / largest
        forest = Forest(x, trees)
        x = x.astype(np.float32)
        unit = qv / np.abs(qv).max(1)[:, None]
        unit /= np.sqrt((unit**2).sum(1))[:, None]
        repeats = len(np.unique(ids)) < len(ids)
        slack = 4e-7 * v.shape[1]  # twice what rounding to 32 bits can change
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        for i, at in enumerate(forest.search(unit, want)):
            at = at[ids[at] != qid[i]]
            rough = x[at] @ unit[i].astype(np.float32)
            own = rough[once(rough, ids[at])] if repeats else rough
            if len(own) > top:
                at = at[rough >= np.partition(own, len(own) - top)[len(own) - top] - slack]
            score = (v[at] * qv[i]).sum(1)  # row by row, so that equal vectors score the same
            if repeats:
                kept = once(score, ids[at])
                at, score = at[kept], score[kept]
            use = best(score, ids[at], top)
            out["query_id"] += [int(qid[i])] * len(use)
            out["vec_id"] += ids[at][use].tolist()
            out["score"] += score[use].tolist()
            if len(out["score"]) >= 1 << 14:
                yield out
                out = {c: [] for c in out}
        yield out

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        key, held, last = None, ([], [], [], []), None

        def close() -> Iterator[dict]:
            if held[0] and held[2]:
                yield from tile(*facts, np.concatenate(held[0]), np.concatenate(held[1]), np.concatenate(held[2]), np.concatenate(held[3]))
            for h in held:
                h.clear()

        for b in batches:
            keys = np.stack([b[c].to_numpy() for c in ("d", "shard", "block")], 1).astype(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1), [True]])) if len(keys) else np.zeros(1, np.int64)
            ids, side, h = b["id"].to_numpy(), b["side"].to_numpy(), b["h"].to_numpy()
            # rows that repeat id and vector stand side by side; one of them will do, and so memory doesn't follow a hot one
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (ids[1:] != ids[:-1]) | (side[1:] != side[:-1])])[: len(ids)]
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if (k := tuple(keys[s].tolist())) != key:
                    yield from close()
                    key, facts, last = k, (b["n"][s].as_py(), b["largest"][s].as_py(), b["shards"][s].as_py()), None
                new[s] = last != (side[s], ids[s], h[s])
                last = (side[e - 1], ids[e - 1], h[e - 1])
                v = b["v"].slice(s, e - s).flatten().to_numpy(zero_copy_only=False).reshape(e - s, k[0])
                for z in (0, 1):
                    use = np.flatnonzero((side[s:e] == z) & new[s:e])
                    if len(use):
                        held[2 * z].append(ids[s:e][use])
                        held[2 * z + 1].append(v[use])
        yield from close()

    found = map_batches(tiles, run, "query_id long, vec_id long, score double", rows=1024)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= top)
