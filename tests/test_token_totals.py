"""Totals of tokens from counted words, and merges that touch only the words which hold a pair."""

import random

import pyarrow as pa

from lexloom.operators import merges as M, tokens as K


def test_totals_are_the_sums_of_the_texts(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (60, None), (61, " \n"), (60, "zz abc")], "doc_id long, text string")
    words = K.word_frequency(docs)
    merges = K.learn_merges(words, 20)
    for m in (merges, merges.until(8), K.Merges(vocabulary=merges.vocabulary - {"a"}, pairs=merges.pairs)):
        total = K.token_totals(words, m)
        assert [tuple(r) for r in total.collect()] == [tuple(r) for r in K.token_counts(docs, "doc_id", m).selectExpr("sum(words)", "sum(tokens)").collect()]
        assert "doc_id" not in total._jdf.queryExecution().executedPlan().toString().split("Scan")[0]
    none = K.token_totals(K.word_frequency(docs.limit(0)), merges).first()
    assert (none.words, none.tokens) == (None, None)


def test_words_that_hold_a_pair_are_told_by_numbers():
    words = [["a", "b", "c"], [], ["c", "a"], ["b"], ["b", "c"], ["a"], ["a", "ab"], ["c"]]
    s = pa.array(words, pa.list_(pa.string()))
    for pairs in ([("a", "b")], [("c", "c"), ("b", "b")], [("c", "a"), ("a", "ab")], [("b", "c"), ("x", "y")], []):
        want = [any(p in pairs for p in zip(w, w[1:])) for w in words]
        assert M._holding(s, pairs).tolist() == want
        assert M._holding(s.slice(2, 5), pairs).tolist() == want[2:7]
    assert M._holding(s.slice(1, 1), [("a", "b")]).tolist() == [False] and not len(M._holding(s.slice(0, 0), [("a", "b")]))


def test_a_word_takes_the_steps_that_one_after_the_other_take():
    rng = random.Random(11)
    for _ in range(300):
        word = [rng.choice("ab") for _ in range(rng.randint(0, 12))]
        pairs = [(rng.choice(["a", "b", "ab", "aa", "ba"]), rng.choice(["a", "b", "ab", "aa", "bb"])) for _ in range(rng.randint(0, 8))]
        want, now = [], word
        for k, p in enumerate(pairs, 1):
            after = M.joined(now, p)
            if after != now:
                want.append((k, now, after))
            now = after
        assert list(M._Steps(pairs).of(word)) == want
