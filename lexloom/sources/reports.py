"""Reports of small aggregates: JSON, Markdown tables, an archive of runs."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows that a report may hold; reports are made of aggregates, and larger results belong into tables.
MOST = 10_000


def rows_of(df: DataFrame) -> list[dict]:
    got = df.limit(MOST + 1).collect()
    if len(got) > MOST:
        raise ValueError(f"a report of more than {MOST} rows; write a table instead")
    return [r.asDict(recursive=True) for r in got]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as the one part file of a folder, in any store that Spark writes."""
    spark.createDataFrame([(text.removesuffix("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    """What `write_text` wrote."""
    return "".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def json_report(spark: SparkSession, path: str, **parts: DataFrame) -> dict:
    """Indented JSON of named aggregates."""
    out = {name: rows_of(df) for name, df in parts.items()}
    write_text(spark, path, json.dumps(out, indent=2, ensure_ascii=False, default=str))
    return out


def cell(value: object, width: int = 80) -> str:
    text = re.sub(r"\s+", " ", f"{value:.4f}" if isinstance(value, float) else str(value)).replace("|", "\\|")
    return text if len(text) <= width else text[: width - 3] + "..."


def markdown(df: DataFrame, title: str) -> str:
    """A heading and a table."""
    rows = rows_of(df)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(r[c]) for c in df.columns) + " |" for r in rows)]) + "\n"


def archive_run(spark: SparkSession, path: str, run: str, metrics: dict[str, float]) -> DataFrame:
    """Append a run's metrics to the table of runs; gives each metric's latest value."""
    spark.createDataFrame([(run, k, float(v)) for k, v in metrics.items()], "run string, metric string, value double").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("metric").agg(F.max_by("value", F.struct("at", "run")).alias("value"), F.max_by("run", F.struct("at", "run")).alias("run"))


def log_counts(lines: DataFrame, text: str = "value") -> DataFrame:
    """PASS and FAIL marks of a log, and the last `n/m` in it, in one row."""
    c = F.col(text)
    ratio = F.regexp_extract_all(c, F.lit(r"(\d+)\s*/\s*(\d+)"), F.lit(0))
    return lines.agg(F.sum(F.regexp_count(c, F.lit(r"\bPASS\b"))).alias("passed"), F.sum(F.regexp_count(c, F.lit(r"\bFAIL\b"))).alias("failed"), F.last(F.when(F.size(ratio) > 0, F.element_at(ratio, -1)), ignorenulls=True).alias("ratio"))


def decide(metrics: dict[str, float] | None, passed: int, total: int, good: float = 0.30, poor: float = 0.10) -> str:
    """What a run's metrics say: missing, promote, extend, retrain or continue.

    Routing of `good` and more is enough. Below, a run whose prompts all pass goes on with the same steps from `poor` on;
    under `poor` the steps are done again.
    """
    if not metrics:
        return "missing"
    routing = float(metrics.get("routing_accuracy") or 0)
    if routing >= good:
        return "promote"
    if 0 < total == passed and routing >= poor:
        return "extend"
    return "retrain" if routing < poor else "continue"


def champion(candidates: DataFrame, incumbent: float, score: str = "routing") -> DataFrame:
    """The best candidate, if it beats the incumbent; else nothing."""
    return candidates.where(F.col(score) > incumbent).orderBy(F.desc(score), candidates.columns[0]).limit(1)


def checkpoint_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(checkpoint, step, train_loss, val_loss) from JSON files of metrics, one a checkpoint, named by their folders; what is missing is null."""
    rows = spark.read.schema("step long, train_loss double, val_loss double").option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.select(name.alias("checkpoint"), "step", "train_loss", "val_loss")


def write_latest(spark: SparkSession, runs: str, path: str) -> str:
    """The latest value of every archived metric as a Markdown table in the store of `path`; gives its text."""
    latest = spark.read.parquet(runs).groupBy("metric").agg(F.max_by("value", F.struct("at", "run")).alias("value"), F.max_by("run", F.struct("at", "run")).alias("run")).orderBy("metric")
    text = markdown(latest, "Latest")
    write_text(spark, path, text)
    return text
