"""What is held or sent at once is bounded: labelled rows, windows of the benchmark, hot terms; both walks of the transducer agree."""

import pickle
import random

import numpy as np

from lexloom.llm import bpe, decontaminate, labelled, pii, quality
from lexloom.llm.common import shared_dir

from .test_llm import docs


def test_labelled_rows_are_bounded_whatever_ids_repeat(spark):
    rows = [(1, f"one text {k}") for k in range(500)] + [(2, "same")] * 500 + [(k, f"text {k}") for k in range(3, 60)]
    marks = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    train = lambda most: labelled.training_texts(docs(spark, rows).repartition(3), marks, "quality", 5, 9, lambda t: [float(len(t))], shared_dir(spark), rows=most)
    for most in (2, 40, 100):
        got = [(r.id, r.y, tuple(r.x)) for r in train(most).collect()]
        assert len(got) <= most and got and sorted(got) == sorted((r.id, r.y, tuple(r.x)) for r in train(most).collect())
    every = train(10_000).collect()
    assert len(every) == 500 + 1 + 57 and sum(r.id == 2 for r in every) == 1
    model = quality.fit_quality(docs(spark, rows), marks, shared_dir(spark), rows=50, width_rows=7)
    assert np.isfinite(model.weight).all()


def test_windows_are_arrays_and_few_bytes_each():
    rng = random.Random(1)
    items = [(k, " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.choice((3, 40, 400))))) for k in range(300)] + [(7, "w1 w2"), (8, "w1 w2"), (None, "w1 w9"), (9, None), (10, " .")]
    p = decontaminate.Phrases(items)
    want = {}
    for item, text in items:
        w = decontaminate.words(text)
        for i in range(len(w) - min(10, len(w)) + 1 if w and item is not None else 0):
            want.setdefault(tuple(w[i : i + 10]), set()).add(item)
    names = {v: k for k, v in p.ids.items()}
    got = {tuple(names[x] for x in row): set(p.items(np.array([first + j]))) for _, first, table in p.tables for j, row in enumerate(table.tolist())}
    assert got == want and p.items(np.zeros(0, np.int64)) == [] and decontaminate.Phrases([]).tables == []
    assert len(pickle.dumps((p.tables, p.holders, p.ends))) < 80 * len(want) + 10_000


def test_hot_terms_may_be_too_many_to_send(spark, monkeypatch):
    rng = random.Random(3)
    plain = ["river", "stone", "window", "garden", "letter", "morning", "paper", "bridge"]
    words = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    rows = [(k, words(20)) for k in range(200)] + [(300 + k, f"{words(5)} doctor Zanthorp ann@mail.example.com {words(7)}") for k in range(6)]
    run = lambda: sorted((r.id, [(s.start, s.end) for s in r.terms]) for r in pii.find_pii(docs(spark, rows)).collect())
    monkeypatch.setattr(pii, "HOT", 3)
    sent = run()
    monkeypatch.setattr(pii, "HOT_LIMIT", 0)
    assert run() == sent and any(t for _, t in sent)
    monkeypatch.setattr(pii, "BLOCK_TERMS", 2)
    assert run() == sent


def test_both_walks_give_the_same_tokens():
    t, rng = bpe.Transducer(), random.Random(4)
    alphabets = ("abcdefghijklmnopqrstuvwxyz", "etaoin ", "aA", "0123456789", "é日本ñß\U0001f600", "\n \t", "=-_*#/", "the of and ing tion ")
    for _ in range(4000):
        kind = rng.choice(alphabets)
        raw = "".join(rng.choice(kind) for _ in range(rng.choice((1, 2, 3, 7, 20, 63, 64, 65, 200)))).encode()
        cut = rng.choice((1, 3, len(raw)))
        assert list(t.stream(raw[k : k + cut] for k in range(0, len(raw), cut))) == t.window(raw), raw
