"""Connected components of an edge table, by distributed label spreading with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, stash

#: Rows of a file.
FILE_ROWS = 1 << 18


def connected_components(edges: DataFrame, folder: str, name: str, max_rounds: int = 64) -> DataFrame:
    """(node, label): label is the smallest node reachable. edges: (u, v) longs, either order, repeats allowed.

    A round takes the smallest label among neighbours, then the label of that label, so that chains shorten
    by half. Each round's labels are written to the shared folder; the maxima and minima pre-aggregate before
    the shuffle, and a hot node's edges are only ever on the side of a join that can be split. Tables are written
    in files of about FILE_ROWS rows, by the counted edges.
    """
    files = max(3, -(-2 * edges.count() // FILE_ROWS))
    both = stash(edges.select(F.col("u"), F.col("v")).union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().coalesce(files), folder, f"{name}-edges")
    labels = stash(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")).coalesce(files), folder, f"{name}-0")
    for k in range(1, max_rounds + 1):
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("seen")), "v").groupBy(F.col("u").alias("node")).agg(F.min("seen").alias("seen"))
        best = labels.join(near, "node").select("node", F.least("label", "seen").alias("best"), "label")
        jump = labels.select(F.col("node").alias("best"), F.col("label").alias("beyond"))
        new = best.join(jump, "best", "left").select("node", F.least("best", "beyond").alias("label"), F.col("label").alias("old"))
        new = stash(new.coalesce(files), folder, f"{name}-{k}")
        moved = new.where("label <> old").limit(1).count()
        discard(edges.sparkSession, folder, f"{name}-{k - 1}")
        labels = new.select("node", "label")
        if not moved:
            return labels
    raise RuntimeError(f"labels still move after {max_rounds} rounds")
