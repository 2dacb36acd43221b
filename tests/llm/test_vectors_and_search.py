"""Whitening against a full eigen-decomposition, ranked search against a scan; odd rows of both."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import lexical_search, queries, whitening

from .test_llm import ODD, docs, lower


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int" if rows and len(rows[0]) == 3 else "vec_id long, embedding array<float>")
    for c in ("id", "v", "d", "n", "component", "part"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def brute_whitening(v, most=8):
    x = np.floor(1024 * np.asarray(v, np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    far = (x - s / n)
    e, u = np.linalg.eigh(far.T @ far / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, len(e))
    return ((n * x - s) ** 2).sum(1), far @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_jacobi_finds_small_eigenvalues_beside_large_ones():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 20, 64):
        a = rng.standard_normal((3 * n, n))
        e, u = whitening.jacobi(a.T @ a)
        want = np.linalg.eigvalsh(a.T @ a)[::-1]
        assert np.allclose(e, want, rtol=1e-10) and np.abs(u.T @ u - np.eye(n)).max() < 1e-13 and np.allclose(u * e @ u.T, a.T @ a)
    scale = 10.0 ** -np.arange(0, 16, 2)  # graded: absolute accuracy would lose the small ones
    core = np.eye(8) + 0.1 * np.ones((8, 8))
    e, _ = whitening.jacobi(core * np.outer(scale, scale))
    product, want = float(np.prod(e)), float(np.linalg.det(core) * np.prod(scale) ** 2)
    assert e.min() > 0 and math.isclose(product, want, rel_tol=1e-10)
    assert np.array_equal(whitening.jacobi(np.zeros((4, 4)))[0], np.zeros(4)) and whitening.jacobi(np.zeros((0, 0)))[0].size == 0


@pytest.mark.parametrize("d, n", [(3, 40), (8, 200), (17, 300)])
def test_whitening_is_that_of_a_full_decomposition(spark, d, n):
    rng = np.random.default_rng(d)
    v = (rng.standard_normal((n, d)) @ rng.standard_normal((d, d))).astype(np.float32)
    v[5] = v[6]  # repeated vectors
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(n, None), (n + 1, [1.0, None] + [0.0] * (d - 2)), (n + 2, [float("nan")] * d), (n + 3, [float("-inf")] * d)]
    got = whitening.whiten(vectors(spark, rows).repartition(7)).toPandas().sort_values(["id", "component"])
    dev, white, explained = brute_whitening(v)
    k = white.shape[1]
    assert got["id"].tolist() == [i for i in range(n) for _ in range(k)] and set(got["n"]) == {n} and got["component"].tolist() == list(range(1, k + 1)) * n
    w = got["whitened"].to_numpy().reshape(n, k)
    assert np.abs(w * np.sign((w * white).sum(0)) - white).max() < 1e-9
    assert (got["deviation"].to_numpy().reshape(n, k) == dev[:, None]).all() and np.allclose(got["explained"].to_numpy().reshape(n, k), explained, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_of_odd_rows(spark):
    run = lambda rows: {(r.id, r.component): r for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert run([]) == {} and run([(1, []), (2, None)]) == {}
    one = run([(1, [1.0, 2.0])])
    assert len(one) == 2 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one.values())
    flat = run([(k, [float(k), 3.0]) for k in range(10)])  # no variance in the second component
    assert all(abs(flat[k, 1].whitened) > 0 and flat[k, 2].whitened is None and flat[k, 2].explained == 0 and flat[k, 1].explained == 1 for k in range(10)) and flat[0, 1].identity_error < 1e-12
    rows = [(k, [float(k % 7), float(k % 5), 1.0]) for k in range(40)] + [(k, [float(k % 3)]) for k in range(40, 60)] + [(None, [0.0, 0.0, 0.0]), (7, [1e30, 0.0, 0.0])]
    mixed = run(rows)  # lengths are fitted apart, a null id counts, an entry without exact sums doesn't
    assert mixed[0, 1].n == 41 and mixed[41, 1].n == 20 and (None, 1) in mixed and abs(mixed[41, 1].explained - 1) < 1e-12


# -- ranked search


def brute_ranks(documents, items, top=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
    words = [(i, cut(t)) for i, t in documents]
    words = [(i, w) for i, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = set()
    for item, text in items:
        found = []
        for i, w in words:
            tf, m = Counter(w), 25 + 75 * len(w) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in cut(text) if t in tf)
            if s > 0 and i is not None:
                found.append((-s, i))
        out |= {(item, k, i, -s) for k, (s, i) in enumerate(sorted(found)[:top], 1)}
    return out


@pytest.mark.parametrize("block_docs, seed", [(1, 1), (4, 2), (64, 3)])
def test_ranks_are_those_of_a_scan(spark, monkeypatch, block_docs, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(lexical_search, "RANGE_BLOCKS", 8)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "日本", "x9"]
    text = lambda n: rng.choice((" ", ", ", "-\n")).join(rng.choices(vocabulary, [1 / (k + 1) for k in range(63)], k=n))
    documents = [(k, text(rng.choice((1, 3, 20, 200)))) for k in range(150)]
    documents += [(200 + k, documents[3][1]) for k in range(15)] + [(300, "word " * 30_000), *ODD, (500, "Alpha ALPHA alpha"), (501, "alpha alpha alpha")]
    items = [(k, text(rng.choice((1, 5, 30)))) for k in range(12)] + [(20, "alpha"), (21, None), (22, ""), (23, "unknown"), (24, "alpha ALPHA word"), (None, "alpha"), (20, "alpha")]
    queries_ = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(0))
    got = lexical_search.rank_documents(docs(spark, documents).repartition(3), queries_, block_docs=block_docs)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_ranks(documents, set(items))


def test_ranked_search_of_empty_tables_and_blocks_of_items(spark, monkeypatch):
    asked = spark.createDataFrame([(1, "one two"), (2, "two")], "item_id long, text string")
    assert lexical_search.rank_documents(docs(spark, []), asked).count() == 0
    assert lexical_search.rank_documents(docs(spark, [(1, "one"), (2, None)]), asked.limit(0)).count() == 0
    rows = [(k, f"one{k % 3} two {'three ' * (k % 4)}") for k in range(40)]
    items = [(k, f"one{k % 3} three") for k in range(9)]
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 16)
    got = lexical_search.rank_documents(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), top=3)
    assert {tuple(r) for r in got.collect()} == brute_ranks(rows, items, 3)


def test_blocks_are_passed_over_only_below_the_threshold():
    rng = np.random.default_rng(4)
    blocks = []
    for k in range(40):
        size = rng.integers(1, 6, 8).astype("<i4")
        term = np.concatenate([rng.choice(30, s, replace=False) for s in size]).astype("<i4")
        own = rng.integers(1, 1000, len(term)).astype("<i4")
        top = {t: int(own[term == t].max()) for t in np.unique(term).tolist()}
        blocks.append((np.arange(8 * k, 8 * k + 8).astype("<i8").tobytes(), size.tobytes(), term.tobytes(), own.tobytes(), np.array(list(top), "<i4").tobytes(), np.array(list(top.values()), "<i4").tobytes()))
    r = lexical_search.Range(blocks, 30)
    scored, plain = [], r.scores
    r.scores = lambda k, t, w: scored.append(k) or plain(k, t, w)
    term, w = np.array([2, 3, 5]), np.array([7, 1, 900])
    every = np.concatenate([plain(k, term, w) for k in range(40)])
    assert (r.bounds(term, w) >= every.reshape(40, 8).max(1)).all()
    ids, scores, threshold = r.search(term, w, 5, 0)
    want = np.lexsort((np.arange(320), -every))[:5]
    assert ids.tolist() == want.tolist() and scores.tolist() == every[want].tolist() and threshold == scores[-1] and len(scored) < 40
    assert r.search(term, w, 5, int(scores[0]) + 1)[0].size == 0


def test_new_queries_run(spark, tmp_path):
    docs(spark, [(k, f"alpha beta {k % 5}") for k in range(30)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha 3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, [float(k), float(k % 3)]) for k in range(20)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op13_lexical_search(spark, str(tmp_path)).columns == ["item_id", "rank", "doc_id", "score"]
    assert set(queries.op12_whitening(spark, str(tmp_path)).columns) == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}


def test_deviations_are_exact_or_null():
    own = whitening.Whitener(1 << 31, np.zeros(2, np.int64), np.eye(2), np.ones(2))
    assert own.deviation(np.array([[1, 1], [0, 0], [2, 0]])) == [None, 0, None]  # 2**63, 0, 2**64
    own.n = 3
    far = 3_037_000_499  # its square is just below 2**63
    assert own.deviation(np.array([[far // 3, 1]])) == [(far // 3 * 3) ** 2 + 9]
