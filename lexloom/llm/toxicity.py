"""Toxicity: logistic regression on hashed word parts, regularised by counterfactual swaps of identity terms.

A text's margin is a bias plus the sum, over its distinct words, of the weights of each word's parts. Only
parts whose share among toxic and other training texts differs far beyond chance carry a weight. Every labelled
text that holds an identity term is also taken with that term swapped, for the next one of its group and for a
word of no group; the change of the margin between the two is penalised, so that a group's mention alone doesn't
move a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, remember, shared_dir, stash
from .labelled import TRAIN_ROWS, is_held_out, training_texts

#: The fold that never trains, of so many; score from which a text counts as toxic.
FOLDS, HELD_OUT, TOXIC = 4, 2, 0.3
#: Hash buckets; standard errors of a part's difference; parts kept at most (the most telling ones; a parameter of
#: `fit_toxicity`); ridge; penalty of a swap.
BUCKETS, FAR, PARTS, RIDGE, SWAP = 1 << 18, 4.0, 8192, 2e-4, 5.0
#: Words a worker remembers.
WORDS = 300_000

# Identity terms by group, and a word of no group that may stand in their place.
IDENTITY = (
    (("women", "men", "girls", "boys"), "people"), (("woman", "man", "girl", "boy"), "person"), (("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), "local"),
    (("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), "people"), (("black", "white", "asian", "latino"), "other"), (("gay", "straight", "lesbian", "bisexual", "transgender"), "other"),
    (("immigrants", "refugees", "foreigners", "locals"), "people"), (("old", "young", "elderly"), "other"), (("deaf", "blind", "disabled", "autistic"), "other"),
    (("african", "european", "american", "mexican", "chinese", "indian", "arab"), "local"), (("femmes", "hommes"), "gens"), (("mujeres", "hombres"), "gente"), (("frauen", "männer"), "leute"),
)

#: What each term is swapped for.
SWAPS = {a: (b, neutral) for group, neutral in IDENTITY for a, b in zip(group, (*group[1:], group[0]), strict=True)}

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    """Distinct lower-cased words of a whole text."""
    return set(_WORD.findall(text.lower()))


def parts(word: str) -> list[int]:
    """Buckets of a word: itself, its beginnings, and its inner pieces of five letters."""
    names = [f"={word}", *(f"<{word[:k]}" for k in range(3, min(len(word), 8))), *(f"~{word[k : k + 5]}" for k in range(1, len(word) - 4))]
    return sorted({xxhash.xxh3_64_intdigest(x) % BUCKETS for x in names})


@lru_cache(150_000)
def _remembered(word: str) -> np.ndarray:
    return np.array(parts(word), np.int32)


@dataclass
class ToxicModel:
    """Weights of the kept parts, and the bias."""

    weight: dict[int, float]
    bias: float


class _WordWeight(dict):
    """A word's weight: the sum of its parts'."""

    def __init__(self, model: ToxicModel):
        super().__init__()
        self.weight = model.weight

    def __missing__(self, word: str) -> float:
        if len(self) >= WORDS:
            self.clear()
        w = self[word] = sum(self.weight.get(p, 0.0) for p in parts(word))
        return w


def swapped(found: set[str]) -> Iterator[tuple[list[str], list[str]]]:
    """Counterfactuals of a text's words: for each identity term and what it is swapped for, words gone and words new."""
    for a in sorted(found & SWAPS.keys()):
        for b in SWAPS[a]:
            yield [a], [b] if b not in found else []


def _descend(indptr: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, pairs, size: int, swap: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Adam on the mean log loss, the ridge, and the squared margin changes of swapped texts, summed over all of them.

    pairs: sparse rows (row, place, value) of what each swap changes.
    """
    row = np.repeat(np.arange(len(y)), np.diff(indptr))
    prow, pcol, pval = pairs
    prows = int(prow.max(initial=-1)) + 1
    w, bias = np.zeros(size), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        margin = np.bincount(row, val * w[col], len(y)) + bias
        miss = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(y)
        g = np.bincount(col, val * miss[row], size) + RIDGE * w
        if prows:
            g += swap / len(y) * np.bincount(pcol, pval * np.bincount(prow, pval * w[pcol], prows)[prow], size)
        g = np.append(g, miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w -= step[:-1]
        bias -= step[-1]
    return w, bias


def fit_toxicity(documents: DataFrame, labels: DataFrame, folder: str, *, rows: int = TRAIN_ROWS, most_parts: int = PARTS, swap: float = SWAP) -> ToxicModel:
    """Fit on a bounded sample of labelled rows (parameter `rows`) outside the held-out fold; texts of equal words count once.

    Class counts of parts are summed within partitions; of the texts only the kept parts reach the driver, at
    most `rows` x `most_parts` small numbers. With one label: no weights, and the labels' mean as every score;
    without any labelled row every score is 0. `swap` weighs the counterfactual penalty (0: none).
    """
    train = training_texts(documents, labels, "toxic", FOLDS, HELD_OUT, lambda t: sorted(words(t)), folder, rows=rows, kind="string")
    train = stash(train.dropDuplicates(["y", "x"]), folder, "toxic-distinct").coalesce(8)

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        remember(_remembered.cache_clear)
        total = np.zeros((2, BUCKETS), np.int32)
        n = np.zeros(2, np.int64)
        for b in batches:
            for y, x in zip(b["y"].to_pylist(), b["x"].to_pylist(), strict=True):
                n[y] += 1
                if x:
                    total[y, np.unique(np.concatenate([_remembered(w) for w in x]))] += 1
        yield {"n": [n.tobytes()], "total": [total.tobytes()]}

    got = map_batches(train, count, "n binary, total binary").collect()
    n = sum((np.frombuffer(r.n, np.int64) for r in got), np.zeros(2, np.int64)).astype(float)
    total = sum((np.frombuffer(r.total, np.int32).reshape(2, -1) for r in got), np.zeros((2, BUCKETS), np.int64))
    if not n.all():
        mean = n[1] / n.sum() if n.sum() else 0.0
        return ToxicModel({}, float(np.log(max(mean, 1e-12) / max(1 - mean, 1e-12))))
    share = total / n[:, None]
    pooled = total.sum(0) / n.sum()
    far = np.abs(share[1] - share[0]) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n[0] + 1 / n[1]))
    kept = np.flatnonzero((far >= FAR) & (total.sum(0) >= 5))
    kept = kept[np.argsort(-far[kept], kind="stable")][:most_parts]
    place_of = np.full(BUCKETS, -1, np.int32)
    place_of[kept] = np.arange(len(kept))

    def places(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = place_of[np.concatenate([np.zeros(0, np.int32), *(_remembered(w) for w in found)])]
        return np.unique(at[at >= 0], return_counts=True)

    def pick(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"y": [], "col": [], "val": [], "swaps": []}
            for y, x in zip(b["y"].to_pylist(), b["x"].to_pylist(), strict=True):
                c, v = places(x)
                swaps = []
                for gone, new in swapped(set(x)) if swap else ():
                    (c0, v0), (c1, v1) = places(gone), places(new)
                    swaps.append({"col": np.concatenate([c0, c1]).astype("<i4").tobytes(), "val": np.concatenate([-v0, v1]).astype("<i4").tobytes()})
                for k, z in zip(out, (y, c.tobytes(), v.astype(np.int32).tobytes(), swaps), strict=True):
                    out[k].append(z)
            yield out

    rows_ = map_batches(train, pick, "y int, col binary, val binary, swaps array<struct<col:binary,val:binary>>").toPandas()
    ints = lambda parts: np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x, "<i4") for x in parts)])
    starts = lambda parts: np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts], dtype=np.int64)]).astype(np.int64)
    swaps = [s for own in rows_["swaps"] for s in own]
    pairs = np.repeat(np.arange(len(swaps)), np.diff(starts([s["col"] for s in swaps]))), ints(s["col"] for s in swaps), ints(s["val"] for s in swaps).astype(float)
    w, bias = _descend(starts(rows_["col"]), ints(rows_["col"]), ints(rows_["val"]).astype(float), rows_["y"].to_numpy(float), pairs, len(kept), swap)
    return ToxicModel({int(p): float(x) for p, x in zip(kept, w, strict=True)}, float(bias))


def classify_toxicity(documents: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, most_parts: int = PARTS, swap: float = SWAP) -> DataFrame:
    """(id, score, toxic, held_out) per document row, in one pass over whole texts.

    Null and empty texts have no words and get the bias alone. Repeated rows: each its own; rows of a null id are
    scored and never train. Very long texts: their distinct words are held, nothing else. Empty table: no rows.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(fit_toxicity(documents, labels, shared_dir(spark), rows=rows, most_parts=most_parts, swap=swap))
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        weight, bias = _WordWeight(sent.value), sent.value.bias
        for b in batches:
            margin = np.array([bias + sum(map(weight.__getitem__, words(t or ""))) for t in b["text"].to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield {"id": b["id"], "score": score, "toxic": score >= TOXIC}

    return map_batches(texts, run, "id long, score double, toxic boolean").withColumn("held_out", is_held_out("id", FOLDS, HELD_OUT))
