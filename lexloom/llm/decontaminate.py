"""Benchmark decontamination: an FM-index per shard of documents, searched with every window of the test items."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, shared_dir, stash, text_id
from .fm_index import FMIndex

#: Consecutive words of a window; an item of fewer words is one window.
WINDOW = 10
#: Words of candidate runs that one index holds; documents it may cover; bytes of text kept while it fills.
SHARD_WORDS, SHARD_DOCS, SHARD_BYTES = 1 << 19, 5_000, 16 << 20
#: Benchmark text (characters) that one broadcast block holds, and so windows: half as many at most, 40 bytes each and the
#: items' numbers. More items make more blocks, one pass of rows each.
BLOCK_CHARS = 2 << 20

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of letters, digits and whatever isn't ASCII, as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


class Phrases:
    """The distinct windows of a block of items, by length, and the items that hold each: arrays, made once and sent to all tasks."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        found: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in items:
            w = np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)], np.int32)
            if len(w) and item is not None:
                k = min(window, len(w))
                found.setdefault(k, []).append((item, np.lib.stride_tricks.sliding_window_view(w, k)))
        self.shortest = min(found, default=0)
        #: by length: number of the first window, and the windows, one a row
        self.tables: list[tuple[int, int, np.ndarray]] = []
        holders, counts, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for k, own in sorted(found.items()):
            table, at = np.unique(np.concatenate([w for _, w in own]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([at.ravel(), np.repeat(np.array([i for i, _ in own], np.int64), [len(w) for _, w in own])], 1), axis=0)
            self.tables.append((k, first, table))
            holders.append(pairs[:, 1])
            counts.append(np.bincount(pairs[:, 0], minlength=len(table)))
            first += len(table)
        self.holders, self.ends = np.concatenate(holders), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)

    def items(self, numbers: np.ndarray) -> list[int]:
        """The items that hold any of these windows."""
        return np.unique(np.concatenate([np.zeros(0, np.int64), *(self.holders[self.ends[n] : self.ends[n + 1]] for n in numbers.tolist())])).tolist()


def _candidate_runs(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Only runs of benchmark words that are long enough can hold a window: those, each ended by 0, and their places."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ids > 0, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    keep = end - begin >= least
    begin, end = begin[keep], end[keep]
    size = end - begin + 1
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    seq = ids[np.minimum(place, len(ids) - 1)].copy()
    seq[np.cumsum(size) - 1] = 0
    return seq, place


def search_shard(phrases: Phrases, ids: list[np.ndarray]) -> Iterator[tuple[list[tuple[int, int]], list[int]]]:
    """For each document of a shard: merged spans of hit words (end exclusive), and the items that occur."""
    starts = np.cumsum([0] + [len(x) + 1 for x in ids])
    whole = np.concatenate([np.append(x, 0) for x in ids] or [np.zeros(0, np.int64)])
    seq, place = _candidate_runs(whole, phrases.shortest) if phrases.tables else (np.zeros(0, np.int64), None)
    hits: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
    if len(seq):
        index = FMIndex(seq)
        for k, first, table in phrases.tables:
            lo, hi = index.search(table)
            n = hi - lo
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            at = place[index.locate(rows)]
            hits.append(np.stack([at, at + k, np.repeat(np.arange(first, first + len(table)), n)], axis=1))
    found = np.concatenate(hits)
    found = found[np.argsort(found[:, 0], kind="stable")]
    cut = np.searchsorted(found[:, 0], starts)
    for d in range(len(ids)):
        own = found[cut[d] : cut[d + 1]]
        if not len(own):
            yield [], []
            continue
        ends = np.maximum.accumulate(own[:, 1])
        new = np.concatenate([[True], own[1:, 0] > ends[:-1]])
        begin, end = own[new, 0] - starts[d], ends[np.append(np.flatnonzero(new)[1:] - 1, len(own) - 1)] - starts[d]
        yield list(zip(begin.tolist(), end.tolist(), strict=True)), phrases.items(np.unique(own[:, 2]))


SPANS = "array<struct<start:long,end:long>>"


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(a + b):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_contamination(documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep_text: bool = False, carry: tuple[str, ...] = (), finish: tuple[str, Callable[[dict], dict]] | None = None) -> DataFrame:
    """Per document row: id, n_words, merged word spans that any window covers, items with occurring windows.

    A shard is whatever rows a task reads, in slices of SHARD_WORDS candidate words; its index lives only while
    it is searched, so memory doesn't follow the table. The benchmark travels in blocks of BLOCK_CHARS, measured
    first; a block's stage writes rows for the next one, so any size of benchmark works and nothing shuffles.
    `finish` (schema, function) turns the last stage's columns into others within the same pass.
    Null or empty texts: no words, no spans. Very long texts: their words are held as numbers, and fill a shard alone. Null items, or items without words: no windows. Repeated rows and
    repeated items: each row is judged by itself, an item's id counts once. Empty tables: no rows, or no hits.
    """
    spark = documents.sparkSession
    items = text_id(benchmark, item_id, item_text).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    items = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"c_{c}") for c in carry))
    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name.startswith("c_"))
    rows = rows.select("*", F.lit(None).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<long>").alias("items"))
    folder = shared_dir(spark)
    for b in range(blocks):
        own = spark.sparkContext.broadcast(Phrases([(r.id, r.text) for r in items.where(F.col("block") == b).collect()], window))
        rows = _stage(rows, own, keep_text or b + 1 < blocks, kept, finish if b + 1 == blocks else None)
        rows = rows if b + 1 == blocks else stash(rows, folder, f"block-{b}")  # a task has one mapping, however many blocks
    return rows


def _stage(rows: DataFrame, own, keep_text: bool, kept: str, finish: tuple[str, Callable[[dict], dict]] | None) -> DataFrame:
    extra = [x.split()[0] for x in kept.split(", ")[1:]]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        phrases = own.value
        get = phrases.ids.get
        held: list[tuple] = []
        ids: list[np.ndarray] = []
        size = chars = 0

        def flush() -> dict:
            cols: dict[str, list] = {"id": [], "n_words": [], "spans": [], "items": [], "text": []} | {c: [] for c in extra}
            for (i, t, n, spans, items, own_extra), (more, found) in zip(held, search_shard(phrases, ids), strict=True):
                spans = _merge([(s["start"], s["end"]) for s in spans], more) if spans else more
                cols["id"].append(i)
                cols["n_words"].append(n)
                cols["spans"].append([{"start": s, "end": e} for s, e in spans])
                cols["items"].append(sorted({*(items or ()), *found}))
                cols["text"].append(t)
                for c, v in zip(extra, own_extra, strict=True):
                    cols[c].append(v)
            held.clear()
            ids.clear()
            return cols if keep_text else {k: v for k, v in cols.items() if k != "text"}

        for batch in batches:
            others = zip(*(batch[c].to_pylist() for c in extra), strict=True) if extra else iter([()] * len(batch["id"]))
            for i, t, spans, items in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), batch["spans"].to_pylist(), batch["items"].to_pylist(), strict=True):
                carried = next(others)
                w = words(t)
                x = np.fromiter((get(v, 0) for v in w), np.int64, len(w))
                held.append((i, t if keep_text else None, len(w), spans, items, carried))
                if phrases.shortest and len(x):
                    known = int(np.count_nonzero(x))
                    x = x if known >= phrases.shortest else x[:0]
                    size += len(x)
                else:
                    x = x[:0]
                ids.append(x)
                chars += len(t or "") if keep_text else 0
                if size >= SHARD_WORDS or len(held) >= SHARD_DOCS or chars >= SHARD_BYTES:
                    yield flush()
                    size = chars = 0
        if held:
            yield flush()

    if finish:
        return map_batches(rows, lambda batches: map(finish[1], run(batches)), finish[0])
    return map_batches(rows, run, f"id long, n_words long, spans {SPANS}, items array<long>" + ", text string" * keep_text + kept)


def cut_spans(text: str, spans: list[dict]) -> str:
    """The text without its hit words and what stands between them; the rest joined by a space."""
    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    out, last = [], 0
    for s in spans:
        out.append(text[last : at[s["start"]][0]].rstrip())
        last = at[s["end"] - 1][1]
    return " ".join(x for x in (*out, text[last:].strip()) if x)


_LOWER = {c: c + 32 for c in range(65, 91)}


def remove_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents without the passages of the benchmark: hit spans go, clean rows stay as they are.

    Keeps the five columns of documents, whatever others there are; n_chars follows a changed text. A row of which
    nothing is left goes; null and empty texts have nothing to cut and stay, repeated rows are each cut. Empty
    tables: no rows, or all of them as they are.
    """

    def cut(b: dict) -> dict:
        out: dict[str, list] = {"doc_id": [], "text": [], "lang": [], "source": [], "n_chars": []}
        for i, t, spans, lang, source, n in zip(*(b[k] for k in ("id", "text", "spans", "c_lang", "c_source", "c_n_chars")), strict=True):
            new = cut_spans(t, spans) if spans else t
            if spans and not new:
                continue
            for k, v in zip(out, (i, new, lang, source, len(new) if spans else n), strict=True):
                out[k].append(v)
        return out

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return find_contamination(documents, benchmark, window=window, keep_text=True, carry=("lang", "source", "n_chars"), finish=(schema, cut))
