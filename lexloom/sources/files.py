"""Sources and sinks of text: discovery, JSON lines, HTML, PDF, shards, merged corpora."""

from __future__ import annotations

import html as html_entities
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..operators.order import next_fit
from ..shared import cut_batches

# File kinds read, tags whose content is dropped, tags that end a line.
KINDS = ("txt", "md", "jsonl", "html", "htm", "pdf")
SILENT = frozenset(("script", "style", "nav", "header", "footer"))
BREAKS = frozenset(("p", "br", "div", "li", "h1", "h2", "h3", "h4", "tr"))

JSONL = "struct<text:string,content:string,source:string,language:string,domain:string>"


class _Reader(HTMLParser):
    """Text outside silent tags; a silent tag left open drops the rest."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in SILENT

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.depth = max(0, self.depth - 1)
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth and not data.isspace():
            self.parts.append(data)


def plain_text(markup: str | None) -> str:
    """Text of one HTML document; entities that remain after parsing are resolved once more."""
    reader = _Reader()
    reader.feed(markup or "")
    return html_entities.unescape("".join(reader.parts))


def _each(fn: Callable, c: str | Column) -> Column:
    """A function of one value over Arrow batches; made when a plan is, since workers import this module too."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(fn)

    return F.pandas_udf(run, "string")(c)


def html_text(df: DataFrame, seq: str, markup: str) -> DataFrame:
    """(seq, text): parsed in Arrow batches, since nesting is beyond regular expressions; cut here, so that a worker holds few pages at once."""
    rows = df.select(seq, F.col(markup).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_batches(batches):
            yield b.set_column(1, "text", pa.array([plain_text(x) for x in b.column(1).to_pylist()], pa.string()))

    return rows.mapInArrow(run, rows.schema)


def pdf_pages(content: bytes) -> str:
    """Pages of a PDF joined by line ends; empty where no reader is installed."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return ""
    import io

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


def parse_jsonl(lines: DataFrame, line: str = "line", seq: str = "seq", source: str | Column = "unknown", keep: tuple[str, ...] = ()) -> DataFrame:
    """(seq, text, source, language, domain) of JSON lines, and columns to keep; blank ones skipped, malformed ones raise with their place (seq)."""
    rows = lines.where(T.strip(line) != "").withColumn("_r", F.from_json(line, JSONL, {"mode": "PERMISSIVE"}))
    bad = F.col("_r").isNull() | (F.col("_r.text").isNull() & F.col("_r.content").isNull() & ~F.col(line).rlike(r"^\s*\{.*\}\s*$"))
    row = F.when(bad, F.raise_error(F.concat(F.lit("invalid JSON line "), F.col(seq).cast("string"))).cast(JSONL)).otherwise(F.col("_r"))
    rows = rows.select(seq, *keep, row.alias("r"))
    fallback = F.lit(source) if isinstance(source, str) else source
    pick = lambda name, default: F.coalesce(F.nullif(F.col(f"r.{name}"), F.lit("")), default)
    return rows.select(seq, *keep, F.coalesce(F.nullif(F.col("r.text"), F.lit("")), F.col("r.content"), F.lit("")).alias("text"), pick("source", fallback).alias("source"), pick("language", F.lit("en")).alias("language"), pick("domain", F.lit("general")).alias("domain"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(place, path, line_number, text, source, language, domain) of JSON lines; place is path:line, which errors name too.

    Spark reads large files in blocks side by side. Lines are counted by block first (without parsing), so that a
    line's number is that of its block's lines before it, and those of the blocks in front.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    blocks = lines.groupBy("path", "block").agg(F.min("n").alias("first"), F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.join(blocks.select("path", "block", "first", before.alias("before")), ["path", "block"]).withColumn("line_number", F.col("before") + F.col("n") - F.col("first") + 1)
    placed = numbered.withColumn("place", F.concat_ws(":", "path", F.col("line_number").cast("string")))
    return parse_jsonl(placed, seq="place", keep=("path", "line_number"))


def source_tag(path: Column, root: str) -> Column:
    """The first folder below the root; `unknown` for files right in it."""
    below = F.regexp_replace(F.substring_index(path, root.rstrip("/") + "/", -1), "^/+", "")
    return F.when(F.size(F.split(below, "/")) > 1, F.get(F.split(below, "/"), F.lit(0))).otherwise("unknown")


def ingest(spark: SparkSession, root: str) -> DataFrame:
    """(path, source, kind, text, language, domain) of every readable file below a folder, sorted by path when written.

    Text, markdown and HTML files are documents of their own; each JSON line is one; PDFs need a reader.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(KINDS) + "}").load(root)
    found = found.select("path", "content", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("kind"), source_tag(F.col("path"), root).alias("source"))
    plain = F.decode("content", "UTF-8")
    text = F.when(F.col("kind").isin("html", "htm"), _each(plain_text, plain)).when(F.col("kind") == "pdf", _each(pdf_pages, "content")).otherwise(plain)
    whole = found.where("kind <> 'jsonl'").select("path", "source", "kind", text.alias("text"))
    whole = whole.where(T.strip("text") != "").select("path", "source", "kind", "text", T.language("text").alias("language"), T.corpus_domain("text").alias("domain"))
    lines = found.where("kind = 'jsonl'").select("path", "source", F.posexplode(F.split(plain, "\r?\n")).alias("n", "line")).withColumn("seq", F.struct("path", "n", F.col("source").alias("folder")))
    rows = parse_jsonl(lines.withColumn("seq", F.to_json("seq")), source="\0")
    at = F.from_json("seq", "path string, n int, folder string")
    rows = rows.select(at["path"].alias("path"), F.when(F.col("source") == "\0", at["folder"]).otherwise(F.col("source")).alias("source"), F.lit("jsonl").alias("kind"), "text", "language", "domain")
    return whole.unionByName(rows)


def assign_shards(df: DataFrame, seq: str, size: str, most: int) -> DataFrame:
    """Adds `shard`: rows in order fill one until the next row would pass `most` bytes (a lone row may). (seq, size) alone are put in order."""
    filled = next_fit(df, seq, size, most).withColumnRenamed(seq, "_seq")
    return df.join(filled, F.col(seq) == F.col("_seq")).drop("_seq")


def write_shards(df: DataFrame, path: str, seq: str, most: int) -> None:
    """JSON lines in shard folders of at most `most` bytes each; earlier ones are replaced."""
    lines = df.withColumn("_line", F.to_json(F.struct(*df.columns))).withColumn("_size", F.octet_length("_line").cast("long") + 1)
    rows = assign_shards(lines, seq, "_size", most).select(F.col("_line").alias("value"), F.format_string("%03d", "shard").alias("shard"), seq)
    rows.repartition("shard").sortWithinPartitions("shard", seq).select("value", "shard").write.mode("overwrite").partitionBy("shard").text(path)


def merged_text(df: DataFrame, group: str, seq: str, text: str) -> DataFrame:
    """(group, corpus): stripped texts of each group in order, an empty line between; blank texts skipped."""
    rows = df.select(group, seq, T.strip(text).alias("_t")).where("_t <> ''")
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(seq, "_t"))).alias("x")).select(group, F.array_join(F.col("x._t"), "\n\n").alias("corpus"))


def write_jsonl(df: DataFrame, path: str) -> int:
    """JSON lines; gives the number of rows, observed while they are written."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path, ignoreNullFields="false")
    return seen.get["n"]


def write_merged(df: DataFrame, path: str, group: str, seq: str, text: str) -> None:
    """Each group's stripped texts in order below its own folder, an empty line between; no group has to fit in a row or a task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(group, seq, T.strip(text).alias("value")).where("value <> ''")
    rows.repartitionByRange(parts, group, seq).sortWithinPartitions(group, seq).select("value", group).write.mode("overwrite").option("lineSep", "\n\n").partitionBy(group).text(path)
