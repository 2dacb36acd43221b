"""Attention and the net against numpy on whole arrays; routing with contrasts; ranges of arguments; small functions on literal values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions import answers as A, chat, lexicon as L, text as T
from lexloom.operators import evaluate as E, learn, mix as M, order as O, tokens as K
from lexloom.streaming import events


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn("v").alias("r")).first().r


@pytest.mark.parametrize("scale", [1.0, 300.0])
def test_attention_is_that_of_whole_matrices(spark, monkeypatch, scale):
    monkeypatch.setattr(learn, "QUERIES_AT_ONCE", 3)
    rng = np.random.default_rng(3)
    v, q = rng.standard_normal((500, 6)) * scale, rng.standard_normal((7, 6))
    z = q @ v.T / math.sqrt(6)
    w = np.exp(z - z.max(1, keepdims=True))
    w /= w.sum(1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id long, v array<double>").repartition(5)
    asked = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(q)], "query_id long, q array<double>")
    got = learn.attended(rows, asked).orderBy("query_id").collect()
    assert np.allclose([np.array(r.value) / r.total for r in got], w @ v) and np.allclose([1 / r.total for r in got], w.max(1)) and len(got) == 7
    full = {(r.query_id, r.id): r.weight for r in E.attention(rows.where("v IS NOT NULL"), asked).collect()}
    assert len(full) == 3500 and all(abs(full[k, i] - w[k, i]) < 1e-12 for k in range(7) for i in range(500))
    assert learn.attended(rows.limit(0), asked).count() == 0


def test_no_pair_of_query_and_vector_travels(spark):
    rows = spark.range(2000).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v")).repartition(4)
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    plan = learn.attended(rows, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInPandas") == 2


def test_net_learns_as_on_one_array(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (400, 2))
    y = x.sum(1)
    net, want = learn.Net(2, 8), []
    for _ in range(12):
        pred = net.predict(x)
        want.append(float(np.mean((pred - y) ** 2)))
        z = x @ net.w1 + net.b1
        out = (2 / len(x)) * (pred - y)[:, None]
        back = (out @ net.w2.T) * (z > 0)
        grads = x.T @ back, back.sum(0), np.maximum(0, z).T @ out, out.sum(0)
        for p, g in zip(net.parts, grads, strict=True):
            p -= 0.1 * g
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0, 1.0)], "a double, b double, y double").repartition(3)
    got, losses = learn.train_net(df, ["a", "b"], "y", rounds=12)
    assert np.allclose(losses, want) and losses[-1] < losses[0] and all(np.allclose(p, q) for p, q in zip(got.parts, net.parts, strict=True))
    assert learn.train_net(df.limit(0), ["a", "b"], "y", rounds=1)[1] == [0.0]


def test_a_contrast_counts_a_fifth(spark):
    p = spark.createDataFrame([("index", "index", True, False), ("join", "join", True, False), ("join", "hash join", False, False)], "concept string, phrase string, primary boolean, anchor boolean")
    w = E.phrase_weights(p)
    text = "a hash join or an index"
    rows = spark.createDataFrame([(1, text, None), (2, text, "join"), (3, text, "index"), (4, "nothing", "join"), (5, text, "other")], "id long, answer string, contrast string")
    plain = {r.id: r for r in E.route(rows.drop("contrast"), p, w).collect()}
    got = {r.id: r for r in E.route(rows, p, w).collect()}
    assert {k: (r.predicted, r.score) for k, r in got.items() if k in (1, 4, 5)} == {k: (r.predicted, r.score) for k, r in plain.items() if k in (1, 4, 5)}
    assert plain[1].predicted == got[2].predicted == "join" and math.isclose(got[2].score, 0.2 * plain[1].score) and got[3].score == plain[3].score  # the place in front goes before the score


def test_answers_within_their_turn(spark):
    ok = lambda t, topic=0.5, again=False: one(spark, t, lambda c: A.chat_response_ok(c, F.lit(topic), F.lit(again)))
    assert ok("Artificial intelligence is a field.") and ok("It ends <END>") and not ok("<USER> Artificial intelligence") and not ok("so <user> x")
    assert not ok(" ") and not ok("fine", 0.0) and not ok("fine", None) and not ok("fine", 0.5, True) and not ok("<ASSISTANT> fine") and not ok("<END>") and not ok("Example note: x") and ok("fine", 0.1, None)
    assert one(spark, "tides", lambda c: A.styled_prompt(c, "paragraph")) == L.PARAGRAPH_PREFIX + "tides" and one(spark, "tides", A.styled_prompt) == "tides"
    assert one(spark, "tides", lambda c: A.styled_prompt(c, "paragraph", F.lit("deep_sea"))) == "This text is about deep sea. " + L.PARAGRAPH_PREFIX + "tides"
    with pytest.raises(ValueError, match="unknown style"):
        A.styled_prompt("v", "verse")


def test_ranges_of_arguments(spark):
    df = spark.createDataFrame([(1, "a b", [1, 2])], "seq long, text string, ids array<int>")
    for call in (
        lambda: M.mix_to_ratio(df, df, "seq", 1.0), lambda: M.mix_to_ratio(df, df, "seq", 0.0), lambda: M.tail_split(df, "seq", 1.5), lambda: M.stride_sample(df, "seq", -1), lambda: M.token_windows("ids", 0, 1), lambda: M.token_windows("ids", 4, 0),
        lambda: M.cycled(df, "seq", "text", 0), lambda: O.next_fit(df, "seq", F.lit(1), 0), lambda: M.stream_split(df, "seq", "ids", -0.1), lambda: K.estimated_tokens(df, "seq", K.Merges(), 0),
    ):
        with pytest.raises(ValueError):
            call()


def test_small_functions(spark):
    assert one(spark, "  a  b \n\n\n c ", T.char_count) == 10 and one(spark, " a  b \n\n \n\tc ", T.tidy_lines) == "a b\nc"
    assert one(spark, "x" * 300, chat.preview) == "x" * 257 + "..." and one(spark, " a \n b ", chat.preview) == "a b"
    money = {"finance": ("stock", "market"), "food": ("soup",)}
    drift = lambda t, score: one(spark, t, lambda c: A.drift(c, money, F.lit(score), {"finance": 2}))
    assert drift("Soup here", 0.1) and not drift("Soup here", 0.4) and not drift("the stock", 0.1) and drift("stock market", 0.1) and not drift("stockmarket soups", 0.1)
    bucket, domains = next(iter(L.BUCKETS.items()))
    assert one(spark, domains[0], E.bucket_of) == bucket and one(spark, "nowhere", E.bucket_of) is None
    seen = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "x", 1)], "id long, generated_response string, s int")
    assert {tuple(r) for r in E.latest_predictions(seen, "s").collect()} == {(1, "new"), (2, "x")}
    assert sorted(r.k for r in events.first_seen(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, n int"), "k").collect()) == ["a", "b"]
    assert one(spark, 0.1234, A.percent, "double") == "12.3%"
    x = spark.createDataFrame([([1.0, -2.0],)], "v array<double>")
    assert x.select(E.neuron(F.col("v"), [0.5, 1.0], 1.0).alias("r"), E.neuron(F.col("v"), [0.5, 1.0], 1.0, "none").alias("n"), E.neuron(F.col("v"), [0.0, 0.0], 0.0, "sigmoid").alias("s")).first().asDict() == {"r": 0.0, "n": -0.5, "s": 0.5}
    got = {(r.pos, r.dim): r.value for r in E.positions(spark, 3, 4).collect()}
    assert len(got) == 12 and all(abs(v - (math.sin if d % 2 == 0 else math.cos)(p / 10000 ** ((d - d % 2) / 4))) < 1e-12 for (p, d), v in got.items())
    loss = spark.createDataFrame([(2.0, 8.0), (1.0, 0.0), (4.0, 2.0)], "l double, w double")
    assert E.weighted_loss(loss, "l", "w").first().loss == 2.4 and E.weighted_loss(loss.where("w = 0"), "l", "w").first().loss == 0.0


def test_shuffled_files_stand_in_the_seeded_order(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(50)], "k long, t string").repartition(3)
    M.write_shuffled(df, 7, "k", str(tmp_path / "s"))
    lines = [x for f in sorted((tmp_path / "s").glob("part-*")) for x in f.read_text().splitlines()]
    want = [r.k for r in df.select("k", M.seeded_key(7, "k").alias("o")).orderBy("o", "k").collect()]
    assert [int(x.split(":")[1].split(",")[0]) for x in lines] == want
