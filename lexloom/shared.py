"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.

    Where that is unset, a temporary folder will do only if driver and executors are one process; a cluster
    without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/lexloom-checkpoints"
    return f"{base.rstrip('/')}/lexloom-{uuid.uuid4().hex}"


def stash(df: DataFrame, folder: str, name: str, **options: str) -> DataFrame:
    """Write a table there and read it back: cuts lineage and survives lost executors."""
    df.write.mode("overwrite").options(**options).parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete tables of the shared folder that no later stage reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(conf).delete(path, True)


#: Bytes of a table that are worth a partition of their own.
LEAST_PART = 1 << 20


def spread(df: DataFrame, least: int = LEAST_PART) -> DataFrame:
    """The rows over more cores, where a table comes in fewer splits than its size is worth and there are cores; else as it is.

    Only small tables are moved by that: one of so few splits is at most a few files. Work on texts costs far more
    than the move. Nothing is run to find out, so a plan that has a shuffle already stays.
    """
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return df
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    want = min(df.sparkSession.sparkContext.defaultParallelism, -(-size // least))
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


#: Rows and bytes of a batch that an operator sees at once. Spark's own batches may be larger (up to its
#: spark.sql.execution.arrow.maxBytesPerBatch); they are cut here, so that no session setting is touched.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def cut_batches(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows` rows, and of at most `size` bytes but for single larger rows."""
    for whole in batches:
        stack = [whole.slice(k, rows) for k in range(0, whole.num_rows, rows)][::-1]
        del whole
        while stack:
            b = stack.pop()
            if b.num_rows > 1 and b.nbytes > size:
                half = b.num_rows // 2
                stack += [b.slice(half), b.slice(0, half)]
            else:
                yield b
