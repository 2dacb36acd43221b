"""Quality classifier: random Fourier features of document statistics, ridge by partition-summed normal equations, isotonic scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, shared_dir, text_id
from .labelled import TRAIN_ROWS, is_held_out, isotonic, training_texts

#: The fold that never trains, of so many.
FOLDS, HELD_OUT = 5, 0
#: Random Fourier features; ridge weight a row; score from which a text passes.
FEATURES, RIDGE, PASS = 256, 1e-3, 0.3
#: Rows of the training sample whose distances give the kernel's width (parameter `width_rows` of `fit_quality`).
WIDTH_ROWS = 400

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": b" \t\r\x0b\x0c", "line": b"\n",
    "stop": b".,;:?", "quote": b"'\"()[]-", "symbol": b"!#$%&*+/<=>@\\^_`{|}~", "wide": range(128, 256),
}
_CLASS_OF = np.full(256, len(_CLASSES))
for _k, _v in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_v)] = _k


def statistics(text: str) -> list[float]:
    """Statistics of a whole text; all zero for an empty one. Nothing but the text goes in."""
    raw = text.encode()
    words = text.split()
    if not words:
        return [0.0] * N_STATISTICS
    share = np.bincount(_CLASS_OF, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), len(_CLASSES) + 1) / len(raw)
    size = np.fromiter(map(len, words), np.int64, len(words))
    counts = Counter(words)
    n, distinct = len(words), len(counts)
    lines = text.split("\n")
    letters = share[0] + share[1]
    p = np.fromiter(counts.values(), np.float64, distinct) / n
    return [
        *np.sqrt(share[:9]).tolist(), float(np.log1p(n)), float(size.mean()), float(np.minimum(size.std(), 50)), distinct / n, float(np.log1p(distinct)) / float(np.log1p(n)),
        sum(map(eq, words, words[1:])) / n, max(counts.values()) / n, float(-(p * np.log(p)).sum() / np.log(n + 1)), sum(map(str.isupper, words)) / n,
        float(share[0] / letters) if letters else 0.0, 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), float(np.mean(size == 1)), sum(not w[-1].isalnum() for w in words) / n,
    ]


N_STATISTICS = 23


@dataclass
class QualityModel:
    """What scoring needs; a few hundred kilobytes whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.frequency + self.phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.value)


def _summed(train: DataFrame, fn, size: int) -> np.ndarray:
    """Vectors of `fn(x, y)` summed within each partition, then over the partitions."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(size)
        for b in batches:
            if len(b["y"]):
                total += fn(np.array(b["x"].to_pylist()), b["y"].to_numpy().astype(float))
        yield {"total": [total.tobytes()]}

    parts = map_batches(train, run, "total binary").collect()
    return sum((np.frombuffer(r.total) for r in parts), np.zeros(size))


def fit_quality(documents: DataFrame, labels: DataFrame, folder: str, *, rows: int = TRAIN_ROWS, features: int = FEATURES, width_rows: int = WIDTH_ROWS, seed: int = 7) -> QualityModel:
    """Fit on a bounded sample of labelled rows (documented parameter `rows`), outside the held-out fold.

    Four fifths of the sample give the ridge weights, the rest the calibration; `width_rows` of it the kernel's width. With no labelled row, or only
    one label, every text gets the labels' mean (0.5 without any).
    """
    train = training_texts(documents, labels, "quality", FOLDS, HELD_OUT, statistics, folder, rows=rows).coalesce(8)
    d = N_STATISTICS
    m = _summed(train, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x**2).sum(0)]), 2 + 2 * d)
    n = max(m[0], 1)
    mean = m[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(m[2 + d :] / n - mean**2, 1e-9))
    some = np.array([r.x for r in train.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(width_rows).collect()]).reshape(-1, d)
    z = np.clip((some - mean) / scale, -8, 8)
    far = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))[np.triu_indices(len(z), 1)]
    width = float(np.median(far)) if len(far) and np.median(far) > 0 else 1.0
    rng = np.random.default_rng(seed)
    model = QualityModel(mean, scale, rng.standard_normal((d, features)) / width, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.full(1, m[1] / m[0] if m[0] else 0.5))
    if not 0 < m[1] < m[0]:
        return model
    fifth = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(5))
    f = features + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p = model.features(x)
        return np.concatenate([(p.T @ p).ravel(), p.T @ y, [len(y)]])

    s = _summed(train.where(fifth != 0), normal, f * f + f + 1)
    a = s[: f * f].reshape(f, f) + RIDGE * max(s[-1], 1) / features * np.diag(np.append(np.ones(features), 0)) + 1e-9 * np.eye(f)
    model.weight = np.linalg.solve(a, s[f * f : -1])
    check = train.where(fifth == 0).orderBy("id").collect() or train.orderBy("id").collect()
    model.at, model.value = isotonic(model.raw(np.array([r.x for r in check])), np.array([float(r.y) for r in check]))
    return model


def score_quality(documents: DataFrame, model: QualityModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, passes) per row, in one pass over whole texts, besides the columns to carry (as c_NAME).

    Null texts count as empty ones; empty texts get the score of their (all zero) statistics. Repeated rows are each
    scored, alike, as are rows of a null id; ties can't matter, since rows aren't compared. Very long texts are read whole, one at a
    time. Empty table: no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"c_{c}") for c in carry))
    kept = [f for f in rows.schema if f.name.startswith("c_")]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            x = np.array([statistics(t or "") for t in b["text"].to_pylist()]).reshape(-1, N_STATISTICS)
            score = sent.value.score(x) if len(x) else np.zeros(0)
            yield {"id": b["id"], "score": score, "passes": score >= PASS} | {f.name: b[f.name] for f in kept}

    return map_batches(rows, run, "id long, score double, passes boolean" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept))


def classify_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, held_out, score, passes) per document row, in the same way for odd rows as `score_quality`. Rows of a null id never train."""
    folder = shared_dir(documents.sparkSession)
    scored = score_quality(text_id(documents, "doc_id", "text").withColumnRenamed("id", "doc_id"), fit_quality(documents, labels, folder))
    return scored.withColumn("held_out", is_held_out("id", FOLDS, HELD_OUT))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents without the rows that the classifier rejects; the five columns stay as they are.

    Null texts are judged as empty ones and stay null; repeated rows and rows of a null id are each judged. Empty table: no rows.
    """
    model = fit_quality(documents, labels, shared_dir(documents.sparkSession))
    out = score_quality(documents, model, carry=("text", "lang", "source", "n_chars")).where("passes")
    return out.select(F.col("id").alias("doc_id"), *(F.col(f"c_{c}").alias(c) for c in ("text", "lang", "source", "n_chars")))
