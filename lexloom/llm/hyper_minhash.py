"""MinHash near-dedup with HyperMinHash sketches: leading-zero counts and mantissa bits of each bucket's least hash.

1. A text's distinct shingle hashes are dealt over BUCKETS by their top bits. Of the least hash of a bucket a register
   keeps the number of leading zeros and the MANTISSA bits behind the first one: 16 bits in place of 56.
2. Texts with equal shingle sets are one class (128-bit fingerprint); only classes go on.
3. Bands of ROWS registers are the keys under which classes meet. An empty register borrows from another bucket, by a
   fixed random order of its own, so that a band says as much about a short text as about a long one. Two sets of the
   least similarity meet nowhere with a chance of (1 - 0.85 ** 6) ** 42, about 2e-9.
4. Pairs that meet are estimated by equal registers, less the collisions to be expected of unlike sets; whatever is
   not SIGMAS standard deviations below the threshold is confirmed on the full sets.
5. Of small groups all pairs are tried. Members of large ones are first compared with the member that stands in the
   largest groups elsewhere, the original of a family of copies; what this links are components. Then come all pairs of
   large groups that still hold different components, in tiles of bounded size, where a bitmap of each set bounds what the
   estimate leaves: no cap, and about n pairs for n copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, mix64, shared_dir, stash, text_id
from .ngram_join import _KEY, _P, FLUSH, SMALL, TILE_ROWS, WORDS, Shingler, Size, _distinct, _fingerprint, _Local, _members, _sent, band, bounded, classes_of, components_of, cut_again, fold, grouped, may_link, signature, unpacked

#: Least similarity, in hundredths.
PERCENT = 85
#: Buckets (by the top bits of a hash); mantissa bits of a register; registers of a band.
BUCKET_BITS, MANTISSA, ROWS = 8, 10, 6
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // ROWS
#: An empty register; no count of leading zeros gives it.
EMPTY = 0xFFFF
#: Of the large groups, one in so many is led.
LED = 3
#: Standard deviations below the threshold at which an estimate rules a pair out.
SIGMAS = 6.0


def registers(s: np.ndarray) -> np.ndarray:
    """The sketch of a sorted array of distinct 64-bit hashes."""
    edge = np.searchsorted(s, np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS))
    filled = np.diff(np.append(edge, len(s))) > 0
    rest = s[edge[filled]] << np.uint64(BUCKET_BITS)
    out = np.full(BUCKETS, EMPTY, np.uint16)
    zeros = _leading_zeros(rest, 64 - BUCKET_BITS)
    tail = np.where(zeros < 63, rest << np.minimum(zeros + 1, 63).astype(np.uint64), 0)
    out[filled] = (zeros << MANTISSA | (tail >> np.uint64(64 - MANTISSA)).astype(np.int64)).astype(np.uint16)
    return out


def _leading_zeros(x: np.ndarray, most: int) -> np.ndarray:
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    zeros = np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])
    return np.minimum(zeros, most).astype(np.int64)


@cache
def _lenders() -> np.ndarray:
    """For each bucket an order of all buckets of its own: the first filled one lends."""
    rng = np.random.default_rng(17)
    return np.stack([rng.permutation(BUCKETS) for _ in range(BUCKETS)])


def densified(sketch: np.ndarray) -> np.ndarray:
    """The sketch with empty registers filled from others; whichever of two sets fills one, it is as likely to agree as any."""
    filled = sketch != EMPTY
    if filled.all():
        return sketch
    gaps = np.flatnonzero(~filled)
    order = _lenders()[gaps]
    out = sketch.copy()
    out[gaps] = sketch[order[np.arange(len(gaps)), filled[order].argmax(1)]]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands of filled sketches, a row each."""
    own = sketches[:, : BANDS * ROWS].reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    acc = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), own.shape[:2]).copy()
    for k in range(ROWS):
        acc = acc * _P + own[:, :, k]
    return mix64(acc)


@cache
def _collision_table() -> np.ndarray:
    """Equal registers to be expected of unlike sets, by their sizes as powers of the root of 2.

    A register's cell is an interval of hash values; both least hashes fall into it with the chances that their sizes
    give. Cells of one count of zeros differ little, so sixteen parts of each stand for them.
    """
    parts = 16
    zeros = np.arange(64 - BUCKET_BITS)[:, None]
    low = 2.0 ** (-BUCKET_BITS - 1 - zeros) * (1 + np.arange(parts) / parts)
    high = 2.0 ** (-BUCKET_BITS - 1 - zeros) * (1 + (np.arange(parts) + 1) / parts)
    n = 2.0 ** (np.arange(80) / 2)[:, None]
    chance = np.exp(n * np.log1p(-low.ravel())) - np.exp(n * np.log1p(-high.ravel()))
    return BUCKETS * (chance @ chance.T) / (2**MANTISSA / parts)


def expected_collisions(na: int, nb: int) -> float:
    level = lambda n: min(79, round(2 * np.log2(max(n, 1))))
    return float(_collision_table()[level(na), level(nb)])


def estimate(na, nb, equal, used):
    """Jaccard similarity from equal registers among those that either set fills, without accidental ones."""
    return np.maximum(0.0, equal - expected_collisions(na, nb)) / np.maximum(used, 1)


def _least(used):
    """The estimate below which a pair of the least similarity is not to be expected."""
    t = PERCENT / 100
    return t - SIGMAS * np.sqrt(t * (1 - t) / np.maximum(used, 1))


def estimate_allows(na: int, nb: int, sa: bytes, sb: bytes) -> bool:
    if 100 * min(na, nb) < PERCENT * max(na, nb):
        return False
    a, b = np.frombuffer(sa, np.uint16), np.frombuffer(sb, np.uint16)
    there = (a != EMPTY) | (b != EMPTY)
    used, equal = int(there.sum()), int(((a == b) & there).sum())
    return bool(estimate(na, nb, equal, used) >= _least(used))


def compare_sketches(rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of a tile's classes (rising by size) of different labels that the estimate leaves, and then a bitmap of the set behind the sketch.

    Members of one family are as like as the threshold, give or take the estimate's error; the bits of one set that the
    other lacks tell what is left of them apart.
    """
    n = np.array([r[3] for r in rows])
    lab = np.array([r[2] for r in rows])
    table = np.stack([np.frombuffer(r[4], np.uint16, BUCKETS) for r in rows])
    bits = [np.frombuffer(r[4], np.uint64, offset=2 * BUCKETS) for r in rows]
    size = np.array([len(x) for x in bits])
    filled = table != EMPTY
    place = np.zeros(len(rows), np.int64)
    for s in np.unique(size).tolist():  # a partner's bitmap is as long, or twice as long
        use = np.flatnonzero((size == s) | (size == 2 * s))
        place[use] = np.arange(len(use))
        folded = np.stack([fold(bits[i], s) for i in use])
        for i in np.flatnonzero(size == s).tolist():
            end = np.searchsorted(n, n[i] * 100 // PERCENT, "right")
            other = np.flatnonzero(lab[i + 1 : end] != lab[i]) + i + 1
            if len(other):
                used = (filled[other] | filled[i]).sum(1)
                equal = ((table[other] == table[i]) & filled[i]).sum(1)
                other = other[estimate(n[i], n[i], equal, used) >= _least(used)]
            if len(other):
                own, theirs = folded[place[i]], folded[place[other]]
                a = np.bitwise_count(own & ~theirs).sum(1).astype(np.int64)
                b = np.bitwise_count(theirs & ~own).sum(1).astype(np.int64)
                for j in other[may_link(n[i], n[other], a, b, PERCENT)].tolist():
                    yield rows[i][1], rows[j][1]


def _sketched(rows: DataFrame, k: int) -> DataFrame:
    """(id, n, fp, sig): a text's number of shingles, fingerprint of them, and sketch, unless the task has met the set before."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        cut, local = Shingler(k), _Local()
        for b in batches:
            n, fp, sig = [], [], []
            for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                s = cut(t)
                n.append(len(s))
                fp.append(_fingerprint(s) if len(s) else None)
                sig.append(registers(s).tobytes() if len(s) and i is not None and local.new(fp[-1]) else None)
            yield {"id": b["id"], "n": n, "fp": fp, "sig": sig}

    return map_batches(rows, run, "id long, n long, fp binary, sig binary")


def _gathered(classes: DataFrame, cut_by: Size) -> DataFrame:
    """Groups of classes that share a band: pairs of small ones, and (key, fps, bands) of large ones."""
    tiles = cut_by.tiles

    def spread(batches: Iterator[dict]) -> Iterator[dict]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> dict:
            e = np.concatenate(held)
            tile = (e["key"] % np.uint64(tiles)).astype(np.int64)
            order = np.argsort(tile, kind="stable")
            ends = np.searchsorted(tile[order], np.arange(tiles + 1))
            use = np.flatnonzero(np.diff(ends))
            held.clear()
            return {"tile": use, "entries": [e[order[ends[t] : ends[t + 1]]].tobytes() for t in use]}

        for b in batches:
            own = [densified(np.frombuffer(x, np.uint16)) for x in b["sig"].to_pylist()]
            if not own:
                continue
            e = np.zeros((len(own), BANDS), _KEY)
            e["key"] = band_keys(np.stack(own))
            e["fp"] = np.array([np.void(x) for x in b["fp12"].to_pylist()])[:, None]
            e["band"] = np.array([band(n, PERCENT) for n in b["n"].to_pylist()], np.uint8)[:, None]
            held.append(e.ravel())
            size += e.size
            if size >= FLUSH:
                yield flush()
                size = 0
        if held:
            yield flush()

    def group(batches: Iterator[dict]) -> Iterator[dict]:
        parts = [np.frombuffer(x, _KEY) for b in batches for x in b["entries"].to_pylist()]
        if parts:
            e = np.unique(np.concatenate(parts))
            parts.clear()
            for out in grouped(e, np.zeros(0, np.uint64), SMALL, TILE_ROWS):
                out.pop("hots")
                yield out

    sent = map_batches(classes.select("fp12", "n", "sig"), spread, "tile int, entries binary").repartition(tiles // 4, "tile")
    return map_batches(sent, group, "pairs binary, key long, fps binary, bands binary")


def _first_pairs(gathered: DataFrame, buckets: int) -> DataFrame:
    """All pairs of small groups; of large ones each member with the leaders of its size band and of those beside it.

    A leader stands in the largest groups, summed over its bands: of a family of copies that is the text from which the
    others differ least. One large group in LED is enough, as a member stands in many, and step 5 compares what is left apart in all.
    """
    large = gathered.where((F.col("key").isNotNull()) & (F.pmod("key", F.lit(LED)) == 0))
    members = unpacked(large)
    rank = members.groupBy("fp12").agg(F.sum("m").alias("rank"))
    top = members.join(rank, "fp12").groupBy("key", "band").agg(F.max(F.struct("rank", "fp12")).alias("top"))
    leaders = top.groupBy("key").agg(F.collect_list(F.struct("band", F.col("top.fp12").alias("fp12"))).alias("leaders"))  # one for each of 256 bands at most

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = [np.frombuffer(p, "V24") for p in b["pairs"].drop_null().to_pylist()]
            for fps, bands, own_leaders in zip(*(b[c].to_pylist() for c in ("fps", "bands", "leaders")), strict=True):
                own, at = _members(fps) if fps else [], np.frombuffer(bands or b"", np.uint8).astype(np.int64)
                for x in own_leaders or ():
                    pairs = b"".join(x["fp12"] + own[j] for j in np.flatnonzero(np.abs(at - x["band"]) <= 1).tolist() if own[j] != x["fp12"])
                    found.append(np.frombuffer(pairs, "V24"))
            if found:
                yield _sent(np.concatenate(found), buckets)

    small = gathered.where("pairs IS NOT NULL").select("pairs", F.lit(None).cast("binary").alias("fps"), F.lit(None).cast("binary").alias("bands"), F.lit(None).cast(leaders.schema["leaders"].dataType).alias("leaders"))
    stars = large.join(leaders, "key").select("pairs", "fps", "bands", "leaders")
    return _distinct(map_batches(small.unionAll(stars), run, "bucket int, pairs binary"), buckets)


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id, kept) per document row.

    Two texts link when their sets of `words`-word shingles have a Jaccard similarity of PERCENT / 100 at least;
    component_id is the smallest id that links reach, and the row of that id is kept. Null and empty texts and texts
    without words have no shingles and stay alone, as do rows of a null id (component null): all kept. Rows that repeat
    an id and a set are one class, and are all kept or none. Ties can't occur; links are confirmed on full sets. Texts of any
    length are used whole. Empty table: no rows.
    """
    folder = shared_dir(documents.sparkSession)
    rows = text_id(documents, doc_id, text)
    cut_by = Size.of(rows)
    texts = stash(_sketched(rows, words), folder, "texts")
    classes = classes_of(texts, folder, cut_by)
    gathered = stash(_gathered(classes, cut_by), folder, "gathered")
    first = bounded(_first_pairs(gathered, cut_by.parts), classes, estimate_allows)
    groups = gathered.where("key IS NOT NULL").select("key", "fps", "bands")

    def with_bits(members: DataFrame) -> DataFrame:
        members = stash(members.coalesce(cut_by.files), folder, "members")
        bits = cut_again(rows, members, signature, words).select("fp12", "x")
        return members.join(bits, "fp12").select("fp12", "n", F.concat("sig", "x").alias("sig"))

    found = components_of(rows, texts, classes, first, groups, folder, words, cut_by, compare_sketches, PERCENT, with_bits)
    return found.select("id", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(documents: DataFrame) -> DataFrame:
    """documents without the rows of which a near copy with a smaller id stays; their five columns, as they are. Odd rows as above."""
    gone = near_duplicates(documents).where("NOT kept").select(F.col("id").alias("doc_id")).distinct()
    return documents.join(gone, "doc_id", "left_anti").select("doc_id", "text", "lang", "source", "n_chars")
