"""What bounds the work and memory of a task, whatever its input's size."""

import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lexloom import shared as S
from lexloom.operators import evaluate as E, merges as M
from lexloom.plans import queries_evaluate as Q
from lexloom.sources import files


def test_merge_tasks_hold_portions_of_their_words(spark, monkeypatch):
    rows = pd.DataFrame({"n": 1, "s": [["a"] * k for k in (3, 9, 2, 2, 30, 1, 1, 1, 1)], "seq": range(9, 0, -1), "g": 0})
    parts = list(M._held(iter([rows, rows.iloc[:0], rows.iloc[:2]]), 3, 10))
    assert [p["seq"].tolist() for p in parts] == [[9], [8], [6, 7], [5], [2, 3, 4], [1], [9], [8]]
    rng = random.Random(3)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))): rng.randint(1, 9) for _ in range(90)}
    df = spark.createDataFrame([(w, n, k) for k, (w, n) in enumerate(words.items())], "word string, n long, seq long").coalesce(1)
    first = M.learn_merges(df, 12, ties="first", ahead=4).pairs
    for name, value in (("HELD_WORDS", 7), ("HELD_SYMBOLS", 40), ("HELD_CHANGES", 5)):
        monkeypatch.setattr(M, name, value)
    whole = M.PairIndex([[*w, M.END_OF_WORD] for w in words], list(words.values()))
    want = []
    while len(want) < 12:
        want.append(whole.best())
        whole.merge(want[-1])
    assert M.learn_merges(df, 5 + 12, ahead=4).pairs == want and M.learn_merges(df, 12, ties="first", ahead=4).pairs == first


def test_pages_are_parsed_a_few_at_a_time(spark):
    html = lambda k: None if k == 3 else f"<p>a{k}</p><script>x</script>&amp;amp; b" + "z" * (k % 7)
    df = spark.createDataFrame([(k, html(k)) for k in range(900)], "page_id long, html string").coalesce(1)
    sizes = files.html_text(df, "page_id", "html")
    assert {r.page_id: r.text for r in sizes.collect()} == {k: files.plain_text(html(k)) for k in range(900)}
    assert sizes.schema.simpleString() == "struct<page_id:bigint,text:string>" and "MapInArrow" in sizes._jdf.queryExecution().executedPlan().toString()
    batch = pa.RecordBatch.from_pydict({"text": ["x" * (3 << 20)] * 5 + ["y"] * 600})
    parts = list(S.cut_batches(iter([batch])))
    assert max(p.num_rows for p in parts) <= S.BATCH_ROWS and all(p.num_rows == 1 or p.nbytes <= S.BATCH_BYTES for p in parts) and sum(p.num_rows for p in parts) == 605


def test_nearest_dots_keep_what_rounding_may_choose(spark):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(1, 700)]
    rows += [(1000, rows[0][1]), (700, rows[0][1]), (701, None), (702, [None] * 6), (703, [1.0, None] * 3), (704, [9.0] * 5), (705, [float("nan")] * 6), (706, [1e200] * 6), (707, [0.0] * 6)]
    rows += [(800 + k, [50.0 + k * 1e-12, *[0.0] * 5]) for k in range(5)] + [(900, [1.0, *[0.0] * 5]), (None, [60.0] * 6)]
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    for asked in ("id IN (900, 1, 700, 707, 802)", "id % 50 = 0 OR id > 700"):
        for vectors in (v, v.where("id < 701 OR id BETWEEN 707 AND 999")):
            q = vectors.where(asked).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
            best = lambda df: {r.query_id: r.b for r in df.groupBy("query_id").agg(F.max_by("id", F.struct(F.round("z", 9), -F.col("id"))).alias("b")).collect()}
            got = E.nearest_dots(vectors, q, 6)
            assert best(got) == best(E.dots(vectors, q).where("id <> query_id"))
    assert got.count() < 40 * q.count()  # not every pair


def test_checkpoint_scores_are_made_once(spark, monkeypatch):
    made = []
    real = Q.stash
    monkeypatch.setattr(Q, "stash", lambda df, folder, name: made.append(name) or real(df, folder, name))
    ranked = Q.checkpoint_rank(spark, "/root/testdata/sf0.001")
    assert made == ["scores"] and "documents" not in "".join(ranked.inputFiles()) and [r.best for r in ranked.collect()].count(True) == 1
    texts = [("bbbz Aaaab '-xyzzzx-' schtrmpf a1b plain nasa", 4), ("", 0), ("-- '' ok", 0), (None, None)]
    odd = lambda r: None if r.w is None else len(r.w)
    assert [odd(r) for r in spark.createDataFrame([(t,) for t, _ in texts], "text string").select(E.suspicious_words("text").alias("w")).collect()] == [5, 0, 0, None]
