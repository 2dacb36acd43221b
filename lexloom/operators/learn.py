"""Small numeric aggregates over vectors, mergeable across partitions: attention, and a two-layer net's gradient."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..shared import spread

#: Queries that a broadcast of vectors may hold; more go by as many passes as they need.
QUERIES_AT_ONCE = 4096


class Softmax:
    """For a block of queries what softmax over any rows needs: the largest logit, the sum of weights below it, the weighted sum of values.

    Two of different rows join by scaling both to the larger logit, so rows can be taken in any order and portions.
    """

    def __init__(self, n: int, width: int):
        self.top, self.total, self.value = np.full(n, -np.inf), np.zeros(n), np.zeros((n, width))

    def join(self, at: np.ndarray, top: np.ndarray, total: np.ndarray, value: np.ndarray) -> None:
        """Add others' states to those at the given places; a place stands once."""
        new = np.maximum(self.top[at], top)
        a, b = np.exp(self.top[at] - new), np.exp(top - new)
        self.total[at], self.value[at] = a * self.total[at] + b * total, a[:, None] * self.value[at] + b[:, None] * value
        self.top[at] = new

    def rows(self, keys: np.ndarray, v: np.ndarray) -> None:
        """Add rows, which are keys and values in one."""
        z = keys @ v.T / np.sqrt(v.shape[1])
        top = z.max(1)
        e = np.exp(z - top[:, None])
        self.join(np.arange(len(z)), top, e.sum(1), e @ v)


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in v])


def attended(vectors: DataFrame, queries: DataFrame, vec: str = "v") -> DataFrame:
    """(query_id, top, total, value): softmax attention of a stated query set (query_id, q) over all vectors in one pass.

    `value` is the weighted mean of the vectors; a vector's weight is exp(z - top) / total for its scaled product z. Each
    task reduces its rows to one state a query, and states are joined by query: no pair of query and vector travels. Queries go
    round in blocks of QUERIES_AT_ONCE. Vectors are of one length; null ones are left out. Without vectors: no rows.
    """
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    schema = "query_id long, top double, total double, value array<double>"
    out = None
    for k in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).select(F.col("query_id").cast("long").alias("query_id"), "q").orderBy("query_id").toPandas()
        sent = spark.sparkContext.broadcast((own["query_id"].to_numpy(np.int64), _matrix(own["q"]) if len(own) else np.zeros((0, 0))))

        def reduce_(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            state = None
            for b in batches:
                for start in range(0, len(b) if len(ids) else 0, 2048):
                    v = _matrix(b["v"].iloc[start : start + 2048])
                    state = state or Softmax(len(ids), v.shape[1])
                    state.rows(q, v)
            if state:
                yield pd.DataFrame({"query_id": ids, "top": state.top, "total": state.total, "value": list(state.value)})

        def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, Softmax] = {}
            for b in batches:
                for i, top, total, value in zip(b["query_id"], b["top"], b["total"], b["value"], strict=True):
                    own = held.setdefault(i, Softmax(1, len(value)))
                    own.join(np.zeros(1, int), np.array([top]), np.array([total]), np.asarray(value, float)[None])
            yield pd.DataFrame([(i, s.top[0], s.total[0], s.value[0]) for i, s in held.items()], columns=["query_id", "top", "total", "value"])

        states = spread(vectors.select(F.col(vec).cast("array<double>").alias("v")).where("v IS NOT NULL")).mapInPandas(reduce_, schema)
        part = states.repartition("query_id").mapInPandas(join, schema)
        out = part if out is None else out.unionAll(part)
    return out


class Net:
    """Two layers: weights, ReLU, weights; one output."""

    def __init__(self, inputs: int, hidden: int, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.w1, self.b1 = rng.normal(0, 0.5, (inputs, hidden)), np.zeros(hidden)
        self.w2, self.b2 = rng.normal(0, 0.5, (hidden, 1)), np.zeros(1)

    @property
    def parts(self) -> tuple[np.ndarray, ...]:
        return self.w1, self.b1, self.w2, self.b2

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (np.maximum(0, x @ self.w1 + self.b1) @ self.w2 + self.b2)[:, 0]

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rows, summed squared error, and its gradient summed over the rows, as one vector; vectors of different rows add up."""
        z = x @ self.w1 + self.b1
        a = np.maximum(0, z)
        miss = (a @ self.w2 + self.b2)[:, 0] - y
        out = 2 * miss[:, None]
        back = (out @ self.w2.T) * (z > 0)
        return np.concatenate([[len(y), (miss**2).sum()], (x.T @ back).ravel(), back.sum(0), (a.T @ out).ravel(), out.sum(0)])

    def step(self, gradient: np.ndarray, rate: float) -> None:
        at = 0
        for p in self.parts:
            p -= rate * gradient[at : at + p.size].reshape(p.shape)
            at += p.size


def summed_gradient(df: DataFrame, inputs: list[str], target: str, net: Net) -> np.ndarray:
    """`Net.sums` over a whole table: within each task first, then by place of the vector; the driver gets one vector."""
    sent = df.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                own = sent.value.sums(b[inputs].to_numpy(float), b[target].to_numpy(float))
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"k": range(len(total)), "s": total})

    rows = df.select(*(F.col(c).cast("double") for c in (*inputs, target))).where(" AND ".join(f"{c} IS NOT NULL" for c in (*inputs, target)))
    got = rows.mapInPandas(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(2 + sum(p.size for p in net.parts))
    for r in got:
        out[r.k] = r.s
    return out


def train_net(df: DataFrame, inputs: list[str], target: str, *, hidden: int = 8, rounds: int = 10, rate: float = 0.1, seed: int = 42) -> tuple[Net, list[float]]:
    """A net fitted by gradient descent over the whole table, and the mean squared error in front of each step.

    Rows with a null are left out. Without rows nothing is learned, and the errors are 0.
    """
    net, losses = Net(len(inputs), hidden, seed), []
    for _ in range(rounds):
        s = summed_gradient(df, inputs, target, net)
        losses.append(float(s[1] / max(s[0], 1)))
        net.step(s[2:] / max(s[0], 1), rate)
    return net, losses
