"""Registered queries by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_corpus, queries_evaluate, queries_mix, queries_pairs, queries_stream, queries_tokens

FLAGSHIP = "corpus_quality_gate"
_PARTS = (queries_corpus, queries_pairs, queries_mix, queries_tokens, queries_evaluate, queries_stream)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
