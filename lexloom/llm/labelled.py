"""Labelled training rows for the two text classifiers: a bounded sample that skips the held-out fold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, stash, text_id

#: Labelled rows that a classifier learns from, at most: the first by a hash of id and text.
TRAIN_ROWS = 20_000


def training_texts(documents: DataFrame, labels: DataFrame, target: str, folds: int, held_out: int, fn: Callable[[str], list], folder: str, *, rows: int = TRAIN_ROWS, kind: str = "double") -> DataFrame:
    """(id, y, x): `fn` of the labelled texts outside the held-out fold.

    Ids and labels of at most `rows` ids travel, as a broadcast; texts are read once, where they lie. Of the rows found,
    which repeated ids can make more, at most `rows` stay, the first by a hash of id and text. Ids labelled both ways,
    null labels and null ids are left out; rows that repeat an id count by their different texts.
    """
    spark = documents.sparkSession
    ids = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(target).cast("int").alias("y"))
    ids = ids.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (F.crc32(F.col("id").cast("string")) % folds != held_out))
    ids = ids.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("hi")).where("y = hi").orderBy(F.xxhash64("id"), "id").limit(rows)
    got = {r.id: r.y for r in ids.collect()}
    known = spark.sparkContext.broadcast(got)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        label = known.value
        for b in batches:
            use = [(i, t) for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True) if i in label]
            h = [xxhash.xxh3_64_intdigest((t or "").encode(), i & (2**64 - 1)) - 2**63 for i, t in use]
            yield {"id": [i for i, _ in use], "h": h, "y": [label[i] for i, _ in use], "x": [fn(t or "") for _, t in use]}

    found = map_batches(text_id(documents, "doc_id", "text"), run, f"id long, h long, y int, x array<{kind}>").dropDuplicates(["id", "h"])
    found = stash(found, folder, f"train-{target}")
    if found.count() > rows:
        found = found.where(F.col("h") <= found.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0])
    return found.select("id", "y", "x")


def is_held_out(column: str, folds: int, held_out: int):
    """Whether a row belongs to the fold that never trains (a null id doesn't)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds == held_out, F.lit(False))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres (by score) and their rising means, smoothed by half a row a side."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks).reshape(-1, 3)
    return b[:, 2] / b[:, 1], np.clip(b[:, 0] / b[:, 1], 0.5 / len(y), 1 - 0.5 / len(y))
