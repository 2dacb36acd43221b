"""Ranked lexical search: block-max pruning over forward-index blocks of documents, with exact top lists.

Documents, as they lie, are cut into blocks of a few. A block's forward index has each document's terms with their
impacts, and the block's maximum impact of each term. A query's bound on a block is the sum of its term weights times
these maxima. A task takes ranges of blocks: for each query it sorts them by bound and scores them, block by block,
until the bound drops below the threshold, which only rises. It starts from the largest tenth-best score that any
range has found in the few blocks of its own largest bounds, so ranges without good documents score next to nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, map_batches, shared_dir, stash, text_id
from .decontaminate import words as terms

#: Documents listed for an item.
TOP = 10
#: Documents of a block; blocks of a range; blocks of a range that are scored for its first threshold.
BLOCK_DOCS, RANGE_BLOCKS, FIRST_BLOCKS = 64, 256, 4
#: Bytes of item texts that are searched at once; more items go round in more blocks of items.
ITEM_BYTES = 4 << 20

# Fixed values of the ranking function: weights and impacts are whole numbers.
_SCALE, _LENGTH_SHARE, _IMPACT, _TF, _NORM = 1000, 75, 1_000_000_000, 1000, 8


def weight(n_docs: int, df: int) -> int:
    """A term's weight from the documents that hold any term, and those that hold this one."""
    return math.floor(_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one occurrence in a query adds, before the weight: rising with tf, falling with the document's length."""
    m = 100 - _LENGTH_SHARE + (_LENGTH_SHARE * length * n_docs) // n_terms
    return (_IMPACT * tf) // (_TF * tf + _NORM * m)


@dataclass
class Queries:
    """Items that are searched at once: their terms as numbers, with how often each occurs."""

    ids: list[int | None] = field(default_factory=list)
    number: dict[bytes, int] = field(default_factory=dict)
    term: list[np.ndarray] = field(default_factory=list)
    count: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, items: list[tuple[int | None, str]]) -> Queries:
        out = cls()
        for item, text in items:
            found = Counter(terms(text))
            if found:
                out.ids.append(item)
                out.term.append(np.array([out.number.setdefault(t, len(out.number)) for t in found], np.int64))
                out.count.append(np.array(list(found.values()), np.int64))
        return out


def _ints(x: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(x, kind)


_FORWARD = "ids binary, size binary, length binary, term binary, tf binary, docs long, terms long"


def _forward(rows: DataFrame, queries, block_docs: int) -> DataFrame:
    """Blocks of documents, as they lie: ids, postings of each, lengths in terms; and how many documents and terms were read.

    Only terms of the queries are kept, and documents that hold one; all are counted.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        number = queries.value.number
        known = number.keys()
        ids: list[int] = []
        size: list[int] = []
        length: list[int] = []
        term: list[int] = []
        tf: list[int] = []
        docs = total = 0

        def flush() -> dict:
            out = {"ids": [np.array(ids, "<i8").tobytes()], "size": [np.array(size, "<i4").tobytes()], "length": [np.array(length, "<i8").tobytes()]}
            out |= {"term": [np.array(term, "<i4").tobytes()], "tf": [np.array(tf, "<i4").tobytes()], "docs": [docs], "terms": [total]}
            for x in (ids, size, length, term, tf):
                x.clear()
            return out

        for b in batches:
            for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                w = terms(t)
                if not w:
                    continue
                docs += 1
                total += len(w)
                found = Counter(filter(known.__contains__, w))
                if found:
                    ids.append(np.iinfo(np.int64).min if i is None else i)
                    size.append(len(found))
                    length.append(len(w))
                    term.extend(map(number.__getitem__, found))
                    tf.extend(found.values())
                    if len(ids) >= block_docs:
                        yield flush()
                        docs = total = 0
        if docs:
            yield flush()

    return map_batches(rows, run, _FORWARD)


def _statistics(forward: DataFrame, n: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and the documents that hold each of the n query terms."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        df = np.zeros(n, np.int64)
        for b in batches:
            for t in b["term"].to_pylist():
                df += np.bincount(_ints(t, "<i4"), minlength=n)
        use = np.flatnonzero(df)
        yield {"term": use, "df": df[use]}

    found = map_batches(forward.select("term"), run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    total = forward.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    df = np.zeros(n, np.int64)
    for r in found:
        df[r.term] = r.df
    return total.docs or 0, total.terms or 0, df


_INDEX = "ids binary, size binary, term binary, impact binary, top_term binary, top_impact binary"


def _index(forward: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The blocks with impacts in place of frequencies, and the maximum impact of each of a block's terms."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in _INDEX.split(", ")}
            for ids, size, length, term, tf in zip(*(b[c].to_pylist() for c in ("ids", "size", "length", "term", "tf")), strict=True):
                t = _ints(term, "<i4")
                own = impact(_ints(tf, "<i4").astype(np.int64), np.repeat(_ints(length), _ints(size, "<i4")), n_docs, n_terms)
                order = np.argsort(t, kind="stable")
                at = np.flatnonzero(np.concatenate([[True], t[order][1:] != t[order][:-1]])) if len(t) else np.zeros(0, np.int64)
                top = np.maximum.reduceat(own[order], at) if len(t) else own
                for c, v in zip(out, (ids, size, term, own.astype("<i4").tobytes(), t[order][at].tobytes(), top.astype("<i4").tobytes()), strict=True):
                    out[c].append(v)
            yield out

    return map_batches(forward.where(F.length("ids") > 0), run, _INDEX, rows=RANGE_BLOCKS)


class Range:
    """Consecutive blocks, held by one task: their forward index, and their maxima by term."""

    def __init__(self, blocks: list[tuple[bytes, ...]], n: int):
        self.n = len(blocks)
        self.ids = [_ints(b[0]) for b in blocks]
        self.end = [np.concatenate([[0], np.cumsum(_ints(b[1], "<i4"), dtype=np.int64)]) for b in blocks]
        self.term = [_ints(b[2], "<i4") for b in blocks]
        self.impact = [_ints(b[3], "<i4").astype(np.int64) for b in blocks]
        top = np.concatenate([_ints(b[4], "<i4") for b in blocks])
        block = np.repeat(np.arange(self.n), [len(b[4]) // 4 for b in blocks])
        order = np.argsort(top, kind="stable")
        self.first = np.searchsorted(top[order], np.arange(n + 1))
        self.block, self.top = block[order], np.concatenate([_ints(b[5], "<i4") for b in blocks])[order].astype(np.float64)
        self.weight = np.zeros(n, np.int64)

    def bounds(self, term: np.ndarray, w: np.ndarray) -> np.ndarray:
        """For each block no less than any document's score; sums in doubles are rounded up."""
        lo, n = self.first[term], self.first[term + 1] - self.first[term]
        at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        total = np.bincount(self.block[at], self.top[at] * np.repeat(w, n), self.n)
        return np.where(total > 0, np.floor(total * (1 + 1e-9)) + 1, 0)

    def scores(self, k: int, term: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Scores of a block's documents, in whole numbers."""
        self.weight[term] = w
        total = np.concatenate([[0], np.cumsum(self.weight[self.term[k]] * self.impact[k])])
        self.weight[term] = 0
        return total[self.end[k][1:]] - total[self.end[k][:-1]]

    def search(self, term: np.ndarray, w: np.ndarray, top: int, threshold: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the range's best documents that reach the threshold, and the threshold then; from `most` blocks only, if given."""
        bound = self.bounds(term, w)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k in np.argsort(-bound, kind="stable")[:most].tolist():
            if bound[k] < max(threshold, 1):
                break
            s = self.scores(k, term, w)
            use = (s >= max(threshold, 1)) & (self.ids[k] != np.iinfo(np.int64).min)
            if use.any():
                ids, scores = np.append(ids, self.ids[k][use]), np.append(scores, s[use])
                if len(ids) >= top:
                    order = np.lexsort((ids, -scores))[:top]
                    ids, scores = ids[order], scores[order]
                    threshold = max(threshold, int(scores[-1]))
        return ids, scores, threshold


def _ranges(batches: Iterator[dict], n: int) -> Iterator[Range]:
    held: list[tuple[bytes, ...]] = []
    for b in batches:
        for row in zip(*(b[c.split()[0]].to_pylist() for c in _INDEX.split(", ")), strict=True):
            held.append(row)
            if len(held) == RANGE_BLOCKS:
                yield Range(held, n)
                held = []
    if held:
        yield Range(held, n)


def _search(index: DataFrame, queries, weights, top: int) -> DataFrame:
    """(item number, id, score): each item's best documents, in any order."""

    def first(batches: Iterator[dict]) -> Iterator[dict]:
        own, w = queries.value, weights.value
        best = np.zeros(len(own.term), np.int64)
        for r in _ranges(batches, len(own.number)):
            for q, (t, c) in enumerate(zip(own.term, own.count, strict=True)):
                best[q] = r.search(t, w[t] * c, top, int(best[q]), FIRST_BLOCKS)[2]
        use = np.flatnonzero(best)
        yield {"item": use, "threshold": best[use]}

    floor = np.zeros(len(queries.value.term), np.int64)
    for row in map_batches(index, first, "item int, threshold long").groupBy("item").agg(F.max("threshold").alias("threshold")).collect():
        floor[row.item] = row.threshold
    floors = index.sparkSession.sparkContext.broadcast(floor)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        own, w, floor = queries.value, weights.value, floors.value.copy()
        for r in _ranges(batches, len(own.number)):
            out: dict[str, list] = {"item": [], "id": [], "score": []}
            for q, (t, c) in enumerate(zip(own.term, own.count, strict=True)):
                ids, scores, floor[q] = r.search(t, w[t] * c, top, int(floor[q]))
                out["item"] += [q] * len(ids)
                out["id"] += ids.tolist()
                out["score"] += scores.tolist()
            yield out

    return map_batches(index, run, "item int, id long, score long")


def rank_documents(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(item, rank, id, score): for each item its `top` highest-scoring documents of a score above 0, ties to smaller ids.

    The result is exact: a block is passed over only if its bound is below a score that `top` documents reach. Texts are
    read once for each block of items (ITEM_BYTES of text, by a hash), and whole; the index goes to the shared folder.
    Documents without terms (null, empty) aren't counted. Rows of a null id are counted and never listed. Repeated rows
    are documents of their own, so an id may be listed again. Items that repeat id and text count once; items of one id
    with different texts, or of a null id, are each searched; items without terms have no rows. Very long texts: a document keeps one
    posting for each term of the items. Empty tables: no rows.
    """
    spark = documents.sparkSession
    asked = text_id(items, item_id, item_text).where(F.octet_length("text") > 0).distinct()
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    rows, folder, found = text_id(documents, doc_id, text), shared_dir(spark), []
    for b in range(blocks):
        own = Queries.of([(r.id, r.text) for r in asked.where(F.col("block") == b).orderBy("id", "text").collect()])
        queries = spark.sparkContext.broadcast(own)
        forward = stash(_forward(rows, queries, block_docs), folder, f"forward-{b}")
        n_docs, n_terms, df = _statistics(forward, len(own.number))
        weights = spark.sparkContext.broadcast(np.array([weight(n_docs, int(x)) for x in df], np.int64))
        index = stash(_index(forward, n_docs, max(n_terms, 1)), folder, f"index-{b}")
        discard(spark, folder, f"forward-{b}")
        best = _search(index, queries, weights, top)
        rank = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), "id"))
        best = best.withColumnRenamed("item", "no").withColumn("rank", rank).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(own.ids)), "no int, item long")
        found.append(stash(best.join(F.broadcast(names), "no").select("item", "rank", "id", "score").coalesce(4), folder, f"found-{b}"))
        discard(spark, folder, f"index-{b}")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out
