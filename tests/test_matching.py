"""Bounds of the matching-blocks ratio, held against difflib."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from lexloom.functions import matching as M

ALPHABETS = ["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz .,", "".join(map(chr, range(0x4E00, 0x4E00 + 400)))]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_no_pair_is_dropped_that_reaches_the_best(alphabet, monkeypatch):
    rng = random.Random(len(alphabet))
    weights = [1 / (1 + i) for i in range(len(alphabet))]
    text = lambda n: "".join(rng.choices(alphabet, weights, k=n))
    for laid_out in (M.LAID_OUT, 500):
        monkeypatch.setattr(M, "LAID_OUT", laid_out)
        monkeypatch.setattr(M, "BITS", min(laid_out, M.BITS))
        monkeypatch.setattr(M, "HITS", min(laid_out, M.HITS))
        for _ in range(3):
            texts = [text(rng.randint(1, rng.choice([5, 60, 300, 1500]))) for _ in range(12)]
            own = M.Texts(texts)
            for n in (20, 60, 150, 199, 200, 201, 350, 1000):
                key, t = text(n), rng.choice(texts)
                if rng.random() < 0.6:  # a part of a text in common, or its beginning
                    k = rng.choice([0, rng.randint(0, len(t))])
                    key = (t[k:] + key if rng.random() < 0.5 else key[:10] + t[k:] + key)[:n]
                ratio = M.ratios(key)
                r = np.array([SequenceMatcher(None, a, key).ratio() for a in texts])
                assert [ratio(a) for a in texts] == r.tolist()
                assert set(np.flatnonzero(r > 0).tolist()) <= set(own.may_reach(key, r))
                if len(key) < M.LONG_KEY:  # the last bound is the ratio: what is just below the best goes
                    assert all(len(texts[k]) >= laid_out for k in own.may_reach(key, np.nextafter(r, 2)))


def test_a_long_key_may_share_its_beginning_without_a_rare_character():
    key = "ab" * 150 + "xyz"
    assert SequenceMatcher(None, "abab", key).ratio() > 0
    assert M.Texts(["abab", "baba"]).may_reach(key, np.zeros(2)) == [0]


def test_few_pairs_of_unlike_texts_are_compared_in_full():
    """Texts of one language, as lines of a corpus are: lengths and characters alone rule out few of them."""
    rng = random.Random(4)
    parts = ["th", "er", "on", "an", "re", "nd", "tion", "in", "ea", "st", "ou", "ha", "en", "es", "ble", "ing", "ly", "wh", "or", "the ", "of ", "and ", ". ", " ", " ", " "]
    text = lambda n: "".join(rng.choice(parts) for _ in range(n)).strip()
    own = M.Texts([text(rng.randint(60, 120)) for _ in range(20)])
    best, compared, keys = np.zeros(20), 0, [text(rng.randint(30, 90)) for _ in range(300)]
    for key in keys:
        for k in own.may_reach(key, best):
            best[k], compared = max(best[k], SequenceMatcher(None, own.texts[k], key).ratio()), compared + 1
    assert best.tolist() == [max(SequenceMatcher(None, a, key).ratio() for key in keys) for a in own.texts]
    assert compared <= 300  # of 6000; the longest common subsequence alone leaves more


def test_language_confidence_cuts_a_text_once(spark):
    import re

    from lexloom.functions import lexicon as L, text as T

    texts = ["The cat is on the mat", "then 'the the' of, by-the-way théatre THE", "", "123 !?", "ñandú and año", "is" * 3, None]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string").withColumn("c", T.language_confidence("text"))

    def score(t):
        words = re.findall("[a-z']+", (t or "").lower())
        hits = len(re.findall(rf"(?<![a-z'])(?:{'|'.join(L.ENGLISH_MARKERS)})(?![a-z'])", (t or "").lower()))
        return min(1.0, L.MARKER_WEIGHT * hits / len(words) + L.ASCII_WEIGHT * (sum(c < "\x80" for c in t) / len(t))) if words else 0.0

    got = {r.seq: r.c for r in df.collect()}
    assert [got[k] for k in range(len(texts) - 1)] == pytest.approx([score(t) for t in texts[:-1]], abs=1e-12)
    assert not got[len(texts) - 1]  # as before, a null text has no confidence
    assert "(?<!" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_single_words_are_routed_without_putting_ngrams_together(spark):
    from lexloom.operators import evaluate as E

    p = spark.createDataFrame([("a", "river", True, False), ("b", "stone", True, False), ("b", "river", False, False)], "concept string, phrase string, primary boolean, anchor boolean")
    answers = spark.createDataFrame([(1, "The river, a stone"), (2, "stone river"), (3, ""), (4, None), (5, "nothing")], "id long, answer string")
    r = E.route(answers, p, E.phrase_weights(p))
    assert {x.id: x.predicted for x in r.collect()} == {1: "a", 2: "b", 3: "__unknown__", 4: "__unknown__", 5: "__unknown__"}
    assert "slice(" not in r._jdf.queryExecution().optimizedPlan().toString()
