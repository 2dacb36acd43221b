"""N-gram Jaccard join: exact links between texts whose sets of word shingles are alike.

The plan, in order; every step is exact, and nothing is capped:

1. Texts with equal shingle sets are one class (128-bit fingerprint); only classes go on.
2. Prefix rule: with shingles in one global order, two sets of similarity t share one of their first
   n - ceil(t n) + 1. The order is (frequent last, hash); frequent ones are counted first, over all texts.
3. Tiles of shingles: each tile gathers the classes that hold a shingle in their prefix, with size bands;
   classes more than one band apart cannot link.
4. Candidate pairs meet hashed bitmap signatures: bits of one set that the other lacks bound the overlap
   from above. What the bound leaves is intersected exactly, as sorted arrays.
5. Of small groups all pairs are tried. Of large ones first only pairs with a few leaders, which are linked
   into components; then all pairs of large groups that still hold different components, in tiles of bounded
   size. So a group of n copies costs about n pairs, and no link between different components is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from .common import discard, map_batches, mix64, shared_dir, stash, text_id
from .components import connected_components

WORDS, PERCENT = 5, 80
#: A shingle is frequent from so many prefix holders on; the list of them is kept below HOT_LIMIT by raising that.
HOT_FROM, HOT_LIMIT = 32, 1 << 21
#: Holders of one shingle that meet in one tile; more are dealt over several by a hash of the class.
TILE_ROWS = 4096
#: Members of a side of a tile in step 5, at least, where a group needs several.
CROSS_ROWS = 1024
#: Class keys that a scan may get as a broadcast; more are joined with a shuffle.
SEEK_LIMIT = 1 << 21
#: Shingles that a task gathers before it hands them on.
FLUSH = 1 << 18
#: Leader families: a group's members are first compared with so many of them.
LEADERS = 3
#: Bits of a bitmap at most, since pairs carry them.
MOST_BITS = 1 << 15
#: Text that one partition of shingles comes from, at most; rows that one file of a small table holds.
PART_BYTES, FILE_ROWS = 64 << 20, 1 << 14
#: Members of a small group, whose pairs are all tried at once.
SMALL = 32
_P = np.uint64(0x9E3779B97F4A7C15)
_KEY = np.dtype([("key", "<u8"), ("fp", "V12"), ("band", "u1"), ("hot", "u1")])


class Shingler:
    """Whole texts to sorted distinct 64-bit shingle hashes, without a Python step a word.

    A word's hash is a polynomial of random values of its bytes, taken as a difference of running sums; powers
    of the base and of its inverse are kept up to the longest stretch. The base has no weak low powers.
    """

    STRETCH = 1 << 18
    BASE = 0x9E3779B97F4A7C1B  # odd, 3 modulo 8
    SPACE = np.zeros(256, bool)
    SPACE[[32, *range(9, 14)]] = True

    def __init__(self, k: int = WORDS):
        self.k = k
        self.value = np.random.default_rng(5).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.value[65:91] = self.value[97:123]  # A-Z count as a-z
        n = self.STRETCH + 1
        self.up, self.down = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, b, np.uint64)), dtype=np.uint64) for b in (self.BASE, pow(self.BASE, -1, 1 << 64)))

    def words(self, text: str) -> np.ndarray:
        """A hash for each word, in order."""
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) <= self.STRETCH:
            return self._stretch(raw)
        out, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + self.STRETCH)
            if end < len(raw):
                gaps = np.flatnonzero(self.SPACE[raw[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:  # a word longer than a stretch
                    gaps = np.flatnonzero(self.SPACE[raw[end:]])
                    end = end + int(gaps[0]) if len(gaps) else len(raw)
                    out.append(self._long(raw[at:end]))
                    at = end
                    continue
            out.append(self._stretch(raw[at:end]))
            at = end
        return np.concatenate(out)

    def _long(self, word: np.ndarray) -> np.ndarray:
        """The same polynomial, stretch by stretch."""
        total, up = 0, 1
        for at in range(0, len(word), self.STRETCH):
            piece = self.value[word[at : at + self.STRETCH]]
            total += up * int((piece * self.up[: len(piece)]).sum(dtype=np.uint64))
            up = up * pow(self.BASE, self.STRETCH, 1 << 64) % (1 << 64)
        return mix64(np.array([total % (1 << 64)], np.uint64))

    def _stretch(self, raw: np.ndarray) -> np.ndarray:
        inside = np.empty(len(raw) + 2, bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = ~self.SPACE[raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edge[::2], edge[1::2]
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.value[raw] * self.up[: len(raw)], out=total[1:])
        return mix64((total[end] - total[begin]) * self.down[begin])

    def __call__(self, text: str | None) -> np.ndarray:
        h = self.words(text) if text else np.zeros(0, np.uint64)
        if not len(h):
            return h
        k = min(self.k, len(h))
        n = len(h) - k + 1
        acc = np.full(n, k, np.uint64)
        for j in range(k):
            acc *= _P
            acc += h[j : j + n]
        acc = mix64(acc)
        acc.sort()
        return acc if n == 1 else acc[np.concatenate([[True], acc[1:] != acc[:-1]])]


def need(n: int) -> int:
    """Smallest overlap that a set of n must have with any partner."""
    return -(-PERCENT * n // 100)


def band(n: int, percent: int = PERCENT) -> int:
    """Size bands whose limits grow by 100/percent: partners are in the same or in neighbouring bands."""
    return min(255, int(np.floor(np.log(max(n, 1)) / np.log(100 / percent) + 1e-9)))


def signature(s: np.ndarray) -> bytes:
    """A bitmap of eight bits a shingle and more, in a power of two of them, so that larger ones fold.

    Of sets of more than MOST_BITS / 8 shingles it is denser, and bounds less; the exact test follows anyway.
    """
    bits = 256
    while bits < 8 * len(s) and bits < MOST_BITS:
        bits *= 2
    out = np.zeros(bits, bool)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def fold(sig: np.ndarray, size: int) -> np.ndarray:
    """A signature as one of `size` 64-bit words."""
    while len(sig) > size:
        sig = sig[: len(sig) // 2] | sig[len(sig) // 2 :]
    return sig


def may_link(na, nb, a_only, b_only, percent: int = PERCENT):
    """The bound: with so many bits of each set outside the other, can 100 |A and B| >= percent |A or B| hold?"""
    both = np.minimum(na - a_only, nb - b_only)
    return 100 * both >= percent * (na + nb - both)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact test on sorted arrays."""
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class _Local:
    """Fingerprints a task has met, so that copies in one part of the table are handed on once."""

    def __init__(self, limit: int = 200_000):
        self.limit, self.seen = limit, set()

    def new(self, fp: bytes) -> bool:
        if fp in self.seen:
            return False
        if len(self.seen) >= self.limit:
            self.seen.clear()
        self.seen.add(fp)
        return True


def _fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


@dataclass
class Size:
    """How the tables of a run are cut, by what was counted in its input."""

    parts: int  # partitions of shingles
    files: int  # files of tables of about a row a text

    @classmethod
    def of(cls, rows: DataFrame) -> Size:
        got = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(got["size"] or 0) // PART_BYTES))
        return cls(parts, max(8, -(-got["n"] // FILE_ROWS)))

    @property
    def tiles(self) -> int:
        return 4 * self.parts


def _frequent(rows: DataFrame, k: int, cut_by: Size) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many classes hold among the first of their hashes, with counts; both sorted by shingle."""
    tiles = cut_by.tiles

    def collect(batches: Iterator[dict]) -> Iterator[dict]:
        cut, local, held, size = Shingler(k), _Local(), [], 0

        def flush() -> dict:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            tile = (key % np.uint64(tiles)).astype(np.int64)
            order = np.argsort(tile, kind="stable")
            ends = np.searchsorted(tile[order], np.arange(tiles + 1))
            parts = [order[ends[t] : ends[t + 1]] for t in range(tiles)]
            held.clear()
            use = [t for t in range(tiles) if len(parts[t])]
            return {"tile": use, "keys": [key[parts[t]].tobytes() for t in use], "counts": [np.minimum(n[parts[t]], 65535).astype("<u2").tobytes() for t in use]}

        for b in batches:
            for t in b["text"].to_pylist():
                s = cut(t)
                if len(s) and local.new(_fingerprint(s)):
                    held.append(s[: 2 * (len(s) - need(len(s)) + 1)])
                    size += len(held[-1])
                    if size >= FLUSH:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        keys, counts = [], []
        for b in batches:
            keys += [np.frombuffer(x, "<u8") for x in b["keys"].to_pylist()]
            counts += [np.frombuffer(x, "<u2") for x in b["counts"].to_pylist()]
        if keys:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts)).astype(np.int64)
            hot = n >= HOT_FROM
            yield {"key": key[hot].view(np.int64), "n": n[hot]}

    dealt = map_batches(rows, collect, "tile int, keys binary, counts binary").repartition(tiles // 4, "tile")
    hot = map_batches(dealt, count, "key long, n long").persist(StorageLevel.DISK_ONLY)
    sizes = {r["p"]: r["c"] for r in hot.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("c")).collect()}
    floor = 0
    while sum(c for p, c in sizes.items() if p >= floor) > HOT_LIMIT:
        floor += 1
    got = hot.where(F.col("n") >= 2**floor).toPandas()
    hot.unpersist()
    key = got["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key, kind="stable")
    return key[order], got["n"].to_numpy(np.int64)[order]


def _parts(n: np.ndarray) -> np.ndarray:
    """Tiles beyond the first over which the holders of a shingle with so many are dealt."""
    return n // (16 * TILE_ROWS)


def _gather(rows: DataFrame, hot, k: int, cut_by: Size) -> DataFrame:
    """Rows of two kinds: a text's (id, n, fp, sig), and groups (key, members) of classes that share a prefix shingle."""
    tiles = cut_by.tiles
    blank = {"tile": [], "entries": [], "id": [], "n": [], "fp": [], "sig": []}
    split = mix64(hot.value[0][_parts(hot.value[1]) > 0])

    def collect(batches: Iterator[dict]) -> Iterator[dict]:
        hot_key, hot_n = hot.value
        cut, local, held, size = Shingler(k), _Local(), [], 0

        def flush() -> dict:
            e, tile = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            order = np.argsort(tile, kind="stable")
            ends = np.searchsorted(tile[order], np.arange(tiles + 1))
            use = np.flatnonzero(np.diff(ends))
            held.clear()
            none = [None] * len(use)
            return {"tile": use.tolist(), "entries": [e[order[ends[t] : ends[t + 1]]].tobytes() for t in use], "id": none, "n": none, "fp": none, "sig": none}

        for b in batches:
            out = {c: [] for c in blank}
            for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                s = cut(t)
                n = len(s)
                fp = _fingerprint(s) if n else None
                new = n > 0 and i is not None and local.new(fp)
                for c, v in zip(blank, ((i or 0) % tiles, None, i, n, fp, signature(s) if new else None), strict=True):
                    out[c].append(v)
                if not new:
                    continue
                first = n - need(n) + 1
                key = s
                part, share = np.zeros(first, np.uint64), 0
                if len(hot_key):
                    at = np.minimum(np.searchsorted(hot_key, key), len(hot_key) - 1)
                    is_hot = hot_key[at] == key
                    order = np.argsort(is_hot, kind="stable")[:first]
                    # holders of a very frequent shingle gather in several tiles; step 5 brings them together
                    parts = np.where(is_hot[order], _parts(hot_n[at[order]]), 0).astype(np.uint64)
                    part = np.uint64(int.from_bytes(fp[12:], "little")) % (parts + np.uint64(1))
                    key, share = key[order], int(255 * is_hot[order].mean())
                e = np.empty(first, _KEY)
                e["key"], e["fp"], e["band"], e["hot"] = mix64(key[:first]), np.void(fp[:12]), band(n), share
                tile = ((e["key"] + part * _P) % np.uint64(tiles)).astype(np.int64)
                held.append((e, tile))
                size += len(e)
                if size >= FLUSH:
                    yield flush()
                    size = 0
            yield out
        if held:
            yield flush()

    empty: dict[str, list] = {c: [] for c in ("id", "n", "fp", "sig", "pairs", "key", "fps", "bands", "hots")}

    def group(batches: Iterator[dict]) -> Iterator[dict]:
        parts: list[np.ndarray] = []
        for b in batches:
            own = [np.frombuffer(x, _KEY) for x in b["entries"].drop_null().to_pylist()]
            parts += own
            text = b["entries"].is_null()
            if pc.any(text).as_py():
                got = {c: b[c].filter(text) for c in ("id", "n", "fp", "sig")}
                none = [None] * len(got["id"])
                yield {c: none for c in empty} | got
        if not parts:
            return
        e = np.unique(np.concatenate(parts))
        parts.clear()
        for out in grouped(e, split, SMALL, TILE_ROWS):
            size = len(out["pairs"])
            yield {c: [None] * size for c in ("id", "n", "fp", "sig")} | out

    sent = map_batches(rows, collect, "tile int, entries binary, id long, n long, fp binary, sig binary").repartition(tiles // 4, "tile")
    return map_batches(sent, group, "id long, n long, fp binary, sig binary, pairs binary, key long, fps binary, bands binary, hots binary")


def grouped(e: np.ndarray, split: np.ndarray, small: int, rows: int) -> Iterator[dict]:
    """Groups of sorted entries of one key: all pairs of those of up to `small`, packed, and larger ones as (key, members), `rows` of them at once.

    split: keys of which this task may hold only a part. A part, however small, keeps its key, by which step 5 joins the parts.
    """
    cut = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1], [True]]))
    lo, m = cut[:-1], np.diff(cut)
    keyed = (m > small) | np.isin(e["key"][lo], split)
    # small groups: all pairs of neighbouring bands, once a task
    pairs = [np.zeros(0, "V24")]
    for size in range(2, small + 1):
        at = lo[(m == size) & ~keyed]
        if len(at):
            i, j = np.triu_indices(size, 1)
            x, y = e[(at[:, None] + i).ravel()], e[(at[:, None] + j).ravel()]
            near = np.abs(x["band"].astype(np.int16) - y["band"]) <= 1
            pairs.append(np.unique(_ordered(x["fp"][near], y["fp"][near])))
    pairs = np.unique(np.concatenate(pairs))
    columns = ("pairs", "key", "fps", "bands", "hots")
    for at in range(0, len(pairs), 1 << 15):
        yield {c: [None] for c in columns} | {"pairs": [pairs[at : at + (1 << 15)].tobytes()]}
    out: dict[str, list] = {c: [] for c in columns}
    for at, size in zip(lo[keyed], m[keyed], strict=True):
        own = e[at : at + size]
        own = own[np.argsort(own["band"], kind="stable")]
        for k in range(0, size, rows):
            piece = own[k : k + rows]
            for c, v in zip(columns, (None, int(piece["key"][0].astype(np.int64)), piece["fp"].tobytes(), piece["band"].tobytes(), piece["hot"].tobytes()), strict=True):
                out[c].append(v)
        if len(out["key"]) >= 500:
            yield out
            out = {c: [] for c in columns}
    if out["key"]:
        yield out


def _ordered(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs of class keys as 24 bytes, the smaller first."""
    both = np.stack([np.ascontiguousarray(x).view(np.uint8).reshape(-1, 12), np.ascontiguousarray(y).view(np.uint8).reshape(-1, 12)], 1)
    differs = both[:, 0] != both[:, 1]
    at = differs.argmax(1)
    rows = np.arange(len(both))
    swap = both[rows, 0, at] > both[rows, 1, at]
    both[swap] = both[swap][:, ::-1]
    return np.ascontiguousarray(both).reshape(-1, 24).view("V24").ravel()


def _members(fps: bytes) -> list[bytes]:
    return [fps[i : i + 12] for i in range(0, len(fps), 12)]


def _sent(pairs: np.ndarray, buckets: int) -> dict:
    """24-byte pairs dealt over buckets by their own bytes, packed: a row for each bucket."""
    pairs = np.unique(pairs)
    b = np.frombuffer(pairs.tobytes(), "<u4").reshape(-1, 6)
    at = (b[:, 0] ^ b[:, 3]) % buckets
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(buckets + 1))
    use = np.flatnonzero(np.diff(ends))
    return {"bucket": use.tolist(), "pairs": [pairs[order[ends[k] : ends[k + 1]]].tobytes() for k in use]}


def _distinct(packed: DataFrame, buckets: int) -> DataFrame:
    """(a, b): the packed pairs, each once, whichever groups brought them."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        got = [np.frombuffer(p, "V24") for b in batches for p in b["pairs"].to_pylist()]
        pairs = np.unique(np.concatenate(got)) if got else np.zeros(0, "V24")
        for at in range(0, len(pairs), 1 << 15):
            own = pairs[at : at + (1 << 15)].tobytes()
            yield {"a": [own[i : i + 12] for i in range(0, len(own), 24)], "b": [own[i + 12 : i + 24] for i in range(0, len(own), 24)]}

    return map_batches(packed.repartition(buckets, "bucket"), run, "a binary, b binary")


def _first_pairs(gathered: DataFrame, buckets: int) -> DataFrame:
    """All pairs of small groups; of large ones each member with leaders: about one pair a member.

    A group's leader is the member whose prefix is the most frequent, the least edited one of a family of
    copies; ties fall differently in each of LEADERS families of groups.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = [np.frombuffer(p, "V24") for p in b["pairs"].drop_null().to_pylist()]
            for key, fps, bands, hots in zip(*(b[c].to_pylist() for c in ("key", "fps", "bands", "hots")), strict=True):
                if key is None:
                    continue
                own, at, hot = _members(fps), np.frombuffer(bands, np.uint8).astype(np.int64), hots
                covered = np.zeros(len(own), bool)
                for i in sorted(range(len(own)), key=lambda i: (-hot[i], own[i][key % LEADERS :])):
                    if covered.all():
                        break
                    if not covered[i]:
                        near = np.abs(at - at[i]) <= 1
                        found.append(np.frombuffer(b"".join(own[i] + own[j] for j in np.flatnonzero(near).tolist() if j != i), "V24"))
                        covered |= near
            if found:
                yield _sent(np.concatenate(found), buckets)

    return _distinct(map_batches(gathered.select("pairs", "key", "fps", "bands", "hots"), run, "bucket int, pairs binary"), buckets)


def bits_allow(na: int, nb: int, sa: bytes, sb: bytes) -> bool:
    """The bound on two sets' bitmaps."""
    if 100 * min(na, nb) < PERCENT * max(na, nb):
        return False
    p, q = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
    size = min(len(p), len(q))
    p, q = fold(p, size), fold(q, size)
    return bool(may_link(na, nb, int(np.bitwise_count(p & ~q).sum()), int(np.bitwise_count(q & ~p).sum())))


def bounded(pairs: DataFrame, classes: DataFrame, allow: Callable[[int, int, bytes, bytes], bool] = bits_allow) -> DataFrame:
    """Pairs (a leader, b) that a test of their sizes and signatures leaves."""
    left = classes.select(F.col("fp12").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = classes.select(F.col("fp12").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    # dealt out first: a broadcast join would put this mapping and the one that made the pairs into one task, and
    # a task with two mappings keeps two Python workers, of which all stay
    wide = pairs.repartition("b").join(right, "b").join(left, "a").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            keep_a, keep_b = [], []
            for x, y, na, nb, sa, sb in zip(*(b[c].to_pylist() for c in ("a", "b", "na", "nb", "sa", "sb")), strict=True):
                if allow(na, nb, sa, sb):
                    keep_a.append(x)
                    keep_b.append(y)
            yield {"a": keep_a, "b": keep_b}

    return map_batches(wide, run, "a binary, b binary")


def cut_again(rows: DataFrame, wanted: DataFrame, make: Callable[[np.ndarray], bytes], k: int) -> DataFrame:
    """(rep, fp12, x): what `make` gives for the sets of the wanted classes (fp12, rep), whose texts are read and cut again."""
    if wanted.count() <= SEEK_LIMIT:
        ids = rows.sparkSession.sparkContext.broadcast(np.sort(wanted.select("rep").toPandas()["rep"].to_numpy(np.int64)))
        some = rows
    else:
        ids = None
        some = rows.join(wanted.select(F.col("rep").alias("id")), "id", "left_semi")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        cut, seek = Shingler(k), ids.value if ids else None
        for b in batches:
            i = b["id"]
            if seek is not None:
                v = i.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(seek, v), max(len(seek) - 1, 0))
                hit = pa.array(seek[at] == v if len(seek) else np.zeros(len(v), bool))
                b = {c: x.filter(hit) for c, x in b.items()}
            got = [(n, cut(t)) for n, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True)]
            got = [(n, s) for n, s in got if len(s)]
            yield {"rep": [n for n, _ in got], "fp12": [_fingerprint(s)[:12] for _, s in got], "x": [make(s) for _, s in got]}

    return map_batches(some, run, "rep long, fp12 binary, x binary").join(wanted.select("fp12", "rep"), ["fp12", "rep"], "left_semi").dropDuplicates(["fp12"])


def _verified(rows: DataFrame, pairs: DataFrame, classes: DataFrame, folder: str, name: str, k: int, files: int, percent: int) -> DataFrame:
    """Exact links among the pairs, as (u, v) of the classes' ids."""
    spark = rows.sparkSession
    wanted = pairs.select(F.col("a").alias("fp12")).union(pairs.select(F.col("b").alias("fp12"))).distinct().join(classes.select("fp12", "rep"), "fp12")
    wanted = stash(wanted.coalesce(files), folder, f"{name}-wanted")
    have = cut_again(rows, wanted, np.ndarray.tobytes, k).withColumnRenamed("x", "arr")
    have = stash(have.coalesce(files), folder, f"{name}-arrays")
    # a leader's partners are dealt over parts, so that no task gets all of a hot one
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(16)).alias("part"))
    partners = dealt.join(have.select(F.col("fp12").alias("b"), "rep", "arr"), "b").select("a", "part", F.lit(1).alias("side"), "rep", "arr")
    leaders = dealt.select("a", "part").distinct().join(have.select(F.col("fp12").alias("a"), "rep", "arr"), "a").select("a", "part", F.lit(0).alias("side"), "rep", "arr")
    tiles = partners.union(leaders).repartition("a", "part").sortWithinPartitions("a", "part", "side")

    def test(batches: Iterator[dict]) -> Iterator[dict]:
        at, head, head_id = None, None, None
        for b in batches:
            u, v = [], []
            for a, part, side, rep, arr in zip(*(b[c].to_pylist() for c in ("a", "part", "side", "rep", "arr")), strict=True):
                if not side:
                    at, head, head_id = (a, part), np.frombuffer(arr, np.uint64), rep
                elif at == (a, part) and linked(head, np.frombuffer(arr, np.uint64), percent):
                    u.append(head_id)
                    v.append(rep)
            yield {"u": u, "v": v}

    links = stash(map_batches(tiles, test, "u long, v long").coalesce(files), folder, f"{name}-links")
    discard(spark, folder, f"{name}-arrays", f"{name}-wanted")
    return links


#: Of a tile's rows (key, class, label, size, signature), rising by size: pairs of classes of different labels that may link.
Compare = Callable[[list[tuple]], Iterator[tuple[bytes, bytes]]]
#: Classes (fp12, rep, n, sig) of large groups, with signatures that say more.
Sharper = Callable[[DataFrame], DataFrame]


def compare_bits(rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
    """Those that the bitmaps leave."""
    n = np.array([r[3] for r in rows])
    lab = np.array([r[2] for r in rows])
    sig = [np.frombuffer(r[4], np.uint64) for r in rows]
    size = np.array([len(s) for s in sig])
    for s in np.unique(size).tolist():
        use = np.flatnonzero((size == s) | (size == 2 * s))
        table = np.stack([fold(sig[i], s) for i in use])
        place = {int(i): p for p, i in enumerate(use)}
        for i in np.flatnonzero(size == s).tolist():
            p = place[i]
            end = np.searchsorted(n[use], n[i] * 100 // PERCENT, "right")
            other = np.flatnonzero(lab[use[p + 1 : end]] != lab[i]) + p + 1
            if len(other):
                t = table[other]
                a = np.bitwise_count(table[p] & ~t).sum(1).astype(np.int64)
                b = np.bitwise_count(t & ~table[p]).sum(1).astype(np.int64)
                for q in other[may_link(n[i], n[use[other]], a, b)].tolist():
                    yield rows[i][1], rows[use[q]][1]


def unpacked(groups: DataFrame) -> DataFrame:
    """(key, fp12, band, m): members of groups, each with the number of members in its row of them."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"key": [], "fp12": [], "band": [], "m": []}
            for k, fps, bands in zip(b["key"].to_pylist(), b["fps"].to_pylist(), b["bands"].to_pylist(), strict=True):
                own = _members(fps)
                for c, v in zip(out, ([k] * len(own), own, list(bands), [len(own)] * len(own)), strict=True):
                    out[c] += v
            yield out

    return map_batches(groups.select("key", "fps", "bands"), run, "key long, fp12 binary, band int, m int")


def _cross_pairs(groups: DataFrame, classes: DataFrame, labels: DataFrame, buckets: int, compare: Compare, sharper: Sharper | None) -> DataFrame:
    """Pairs of different components within a group that `compare` leaves; large groups meet tile by tile."""
    label = classes.select("fp12", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("fp12", F.coalesce("label", "rep").alias("label"))
    flat = unpacked(groups).select("key", "fp12")
    if sharper:  # signatures come with the labels, in one join of the members
        label = sharper(flat.select("fp12").distinct().join(classes, "fp12").select("fp12", "rep", "n", "sig")).join(label, "fp12")
    flat = flat.join(label, "fp12")
    mixed = flat.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    # larger cuts for larger groups, whose members go to as many tiles as there are cuts
    side = F.greatest(F.lit(CROSS_ROWS), F.least(F.lit(TILE_ROWS), F.col("m") / 16))
    mixed = mixed.select("key", F.ceil(F.col("m") / side).cast("int").alias("cuts"))
    own = flat.join(mixed, "key").withColumn("cut", F.pmod(F.xxhash64("fp12"), F.col("cuts")).cast("int"))
    tile = F.expr("transform(sequence(0, cuts - 1), j -> struct(least(cut, j) AS i, greatest(cut, j) AS j))")
    known = ["n", "sig"] if sharper else []
    own = own.select("key", "fp12", "label", *known, F.explode(tile).alias("tile")).select("key", "fp12", "label", *known, F.col("tile.i").alias("i"), F.col("tile.j").alias("j"))
    own = own if sharper else own.join(classes.select("fp12", "n", "sig"), "fp12")
    own = own.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        at, held = None, []
        for b in batches:
            pairs: list[bytes] = []
            for key, i, j, *row in zip(*(b[c].to_pylist() for c in ("key", "i", "j", "fp12", "label", "n", "sig")), strict=True):
                if (key, i, j) != at:
                    if len(held) > 1:
                        pairs += [min(p) + max(p) for p in compare(held)]
                    at, held = (key, i, j), []
                held.append((key, *row))
            if pairs:
                yield _sent(np.frombuffer(b"".join(pairs), "V24"), buckets)
        if len(held) > 1 and (pairs := [min(p) + max(p) for p in compare(held)]):
            yield _sent(np.frombuffer(b"".join(pairs), "V24"), buckets)

    return _distinct(map_batches(own.select("key", "i", "j", "fp12", "label", "n", "sig"), run, "bucket int, pairs binary"), buckets)


def jaccard_components(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, cut_by: Size | None = None) -> DataFrame:
    """(id, n_shingles, component_id, fp) per document row.

    Two texts link when their sets of `words`-word shingles have Jaccard similarity of at least PERCENT / 100;
    component_id is the smallest id that links reach. Null and empty texts and texts without words have no
    shingles and stay alone; so do rows of a null id (component null). Repeated rows are classes of equal sets.
    Empty table: no rows. Texts of any length are used whole. `cut_by`: how tables are cut; counted if not given.
    """
    spark = documents.sparkSession
    folder = shared_dir(spark)
    rows = text_id(documents, doc_id, text)
    cut_by = cut_by or Size.of(rows)
    hot = spark.sparkContext.broadcast(_frequent(rows, words, cut_by))
    all_rows = stash(_gather(rows, hot, words, cut_by), folder, "gathered")
    texts = all_rows.where("key IS NULL AND pairs IS NULL").select("id", "n", "fp", "sig")
    gathered = all_rows.where("key IS NOT NULL OR pairs IS NOT NULL")
    groups = all_rows.where("key IS NOT NULL").select("key", "fps", "bands")
    classes = classes_of(texts, folder, cut_by)
    first = bounded(_first_pairs(gathered, cut_by.parts), classes)
    return components_of(rows, texts, classes, first, groups, folder, words, cut_by, compare_bits, PERCENT)


def classes_of(texts: DataFrame, folder: str, cut_by: Size) -> DataFrame:
    """(fp, rep, n, sig, copies, fp12): texts of equal shingle sets, without those of none and those of a null id."""
    classes = texts.where("n > 0 AND id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.first("sig", ignorenulls=True).alias("sig"), F.count("*").alias("copies"))
    return stash(classes.withColumn("fp12", F.substring("fp", 1, 12)).coalesce(cut_by.files), folder, "classes")


def components_of(rows: DataFrame, texts: DataFrame, classes: DataFrame, first: DataFrame, groups: DataFrame, folder: str, words: int, cut_by: Size, compare: Compare, percent: int, sharper: Sharper | None = None) -> DataFrame:
    """(id, n_shingles, component_id, fp): first pairs are verified and linked, then groups that still hold different components."""
    links = _verified(rows, stash(first.coalesce(cut_by.files), folder, "first"), classes, folder, "v1", words, cut_by.files, percent)
    labels = connected_components(links, folder, "c1")
    rest = stash(_cross_pairs(groups, classes, labels, cut_by.parts, compare, sharper).coalesce(cut_by.files), folder, "rest")
    if rest.limit(1).count():
        more = _verified(rows, rest, classes, folder, "v2", words, cut_by.files, percent)
        labels = connected_components(links.union(more), folder, "c2")
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "copies", F.coalesce("label", "rep").alias("component_id"), "rep")
    # only classes that say something new about a row travel, dealt over parts against hot ones
    parts = 32
    told = named.where("copies > 1 OR component_id <> rep").select("fp", "component_id", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    out = texts.select("id", "n", "fp").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).join(told, ["fp", "part"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), "fp")


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each component: of the smallest doc_id. Texts without words, and rows of a null id, all stay.

    Ids of the rows to drop are what travels: as a broadcast up to SEEK_LIMIT of them, else by a shuffle. Rows
    that repeat the smallest id itself stay. Keeps the five columns of documents, whatever others there are.
    Empty table: no rows.
    """
    cut_by = Size.of(text_id(documents, "doc_id", "text"))
    gone = jaccard_components(documents, cut_by=cut_by).where("n_shingles > 0 AND id <> component_id").select(F.col("id").alias("doc_id")).distinct()
    gone = stash(gone.coalesce(cut_by.files), shared_dir(documents.sparkSession), "gone")
    side = F.broadcast(gone) if gone.count() <= SEEK_LIMIT else gone
    return documents.join(side, "doc_id", "left_anti").select("doc_id", "text", "lang", "source", "n_chars")
