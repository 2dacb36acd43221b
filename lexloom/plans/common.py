"""What the query modules share: tables, and SQL fragments of the word dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shared import spread

#: Tables whose rows take enough work to be dealt over all cores where their files have few splits.
HEAVY = frozenset(("documents", "pages", "conversations"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in HEAVY else rows


def fold(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def one_line(c: str) -> str:
    return strip(rf"regexp_replace({c}, '\s+', ' ', 'g')")


#: Word patterns in RE2's syntax.
UNICODE = r"[\p{L}\p{N}\p{M}_]+"
HYPHEN = r"[\p{L}\p{N}\p{M}_](?:[\p{L}\p{N}\p{M}_''-]*[\p{L}\p{N}\p{M}_])?"
ASCII = r"[a-z0-9]+(?:''[a-z0-9]+)?"


def unicode_words(c: str) -> str:
    return f"regexp_extract_all({c}, '{UNICODE}')"


def ascii_words(c: str) -> str:
    return f"regexp_extract_all({fold(c)}, '{ASCII}')"


def ngrams(words: str, n: int) -> str:
    """n-grams of a list expression, joined by a unit separator."""
    return f"list_transform(range(1, greatest(len({words}) - {n - 2}, 1)), lambda i: array_to_string(list_slice({words}, i, i + {n - 1}), chr(31)))"
