"""Shared plumbing of the training-data operators: shared folders, Arrow mapping, hashing."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import BATCH_BYTES, BATCH_ROWS, cut_batches, discard, shared_dir, spread, stash

__all__ = ["cut_batches", "discard", "shared_dir", "stash"]

#: What to forget when a worker, which outlives its stage, goes on to work that doesn't need it.
_REMEMBERED: list[Callable[[], None]] = []


def remember(forget: Callable[[], None]) -> None:
    """Tell that this worker keeps something between tasks, and how to drop it."""
    if forget not in _REMEMBERED:
        _REMEMBERED.append(forget)


def _make_room() -> None:
    while _REMEMBERED:
        _REMEMBERED.pop()()
    gc.collect()
    pa.default_memory_pool().release_unused()


def map_batches(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str, *, keeps: bool = False, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow with columns as a dict of Arrow arrays in, and dicts of lists or arrays out.

    `fn` gets batches of at most `rows` rows and about `size` bytes, whatever the session's settings.

    Unless `keeps`, a task first drops what earlier stages left in its worker, so that a long pipeline needs no
    more memory than its largest stage.
    """
    target = pa.schema(_arrow_fields(df.sparkSession, schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _make_room()
        for out in fn({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in cut_batches(batches, rows, size)):
            cols = [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, type=f.type) for c, f in ((out[f.name], f) for f in target)]
            yield pa.RecordBatch.from_arrays(cols, schema=target)

    return spread(df).mapInArrow(run, schema)


def _arrow_fields(spark: SparkSession, schema: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(schema)
    return list(to_arrow_schema(parsed))


class WordHash(dict):
    """Word bytes to a stable 64-bit hash; forgets all when it grows past `limit` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (fixed public constants of the splitmix64 generator)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_id(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that matter: extra columns, whatever their names, never reach an operator."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def sha256_hex(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def crc_mod(column: str, k: int):
    """crc32 of an id written as text, modulo k (null ids: null)."""
    return F.crc32(F.col(column).cast("string")) % F.lit(k)
