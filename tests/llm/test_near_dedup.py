"""HyperMinHash near-dedup against all pairs, its sketches and estimates; word hashes at the borders of a stretch."""

import random

import numpy as np
import pytest
import xxhash

from lexloom.llm import hyper_minhash, ngram_join, queries

from .test_llm import ODD, docs
from .test_llm import brute_components as brute


def brute_components(rows, percent):
    return brute(rows, percent=percent)


def hashes(words):
    return np.unique(np.array([xxhash.xxh3_64_intdigest(str(w)) for w in words], np.uint64))


def test_registers_hold_zeros_and_mantissa_of_the_least_hash():
    s = hashes(range(900))
    r = hyper_minhash.registers(s)
    for k in range(256):
        own = [int(x) for x in s if int(x) >> 56 == k]
        if not own:
            assert r[k] == hyper_minhash.EMPTY
            continue
        bits = f"{min(own) & ((1 << 56) - 1):056b}"
        zeros = len(bits) - len(bits.lstrip("0"))
        assert int(r[k]) >> 10 == zeros and int(r[k]) & 1023 == int((bits[zeros + 1 :] + "0" * 64)[:10], 2)
    least = hyper_minhash.registers(np.array([5 << 56, (7 << 56) + 1, (9 << 56) + 2**55 + 2**54], np.uint64))
    assert [int(least[k]) >> 10 for k in (5, 7, 9)] == [56, 55, 0] and int(least[9]) & 1023 == 512 and (least != hyper_minhash.EMPTY).sum() == 3
    assert hyper_minhash.densified(least).max() < hyper_minhash.EMPTY


def test_estimates_are_near_and_collisions_as_expected():
    rng = random.Random(3)
    for n, share in ((400, 0.85), (3000, 0.5), (20_000, 0.9)):
        both = int(n * share)
        a, b = hashes([*range(both), *(("a", k) for k in range((n - both) // 2))]), hashes([*range(both), *(("b", k) for k in range((n - both) // 2))])
        x, y = hyper_minhash.registers(a), hyper_minhash.registers(b)
        used = int(((x != hyper_minhash.EMPTY) | (y != hyper_minhash.EMPTY)).sum())
        got = float(hyper_minhash.estimate(len(a), len(b), int(((x == y) & (x != hyper_minhash.EMPTY)).sum()), used))
        assert abs(got - share) < 4.5 * (share * (1 - share) / used) ** 0.5, (n, got)
    equal = []
    for k in range(300):  # unlike sets: equal registers by chance alone
        x, y = (hyper_minhash.registers(np.sort(np.random.default_rng([k, z]).integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2))) for z in (1, 2))
        equal.append(int((x == y).sum()))
    want = hyper_minhash.expected_collisions(4000, 4000)
    assert 0 < want < 1 and abs(np.mean(equal) - want) < 5 * (want / 300) ** 0.5, (np.mean(equal), want)


@pytest.mark.parametrize("n", [1, 2, 6, 7, 13, 40, 150, 700])
def test_sets_of_the_least_similarity_share_a_band(n):
    missed = ruled_out = tried = 0
    rng = np.random.default_rng(n)
    for _ in range(300):
        s = np.unique(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64) * np.uint64(2))
        for more in {max(0, int(n / 0.85 - n + 1e-9)), 0}:
            a, b = np.sort(s[:n]), np.sort(s[: n + more])
            if len(s) < n + more or 100 * n < 85 * (n + more):
                continue
            x, y = hyper_minhash.registers(a), hyper_minhash.registers(b)
            keys = hyper_minhash.band_keys(np.stack([hyper_minhash.densified(x), hyper_minhash.densified(y)]))
            tried += 1
            missed += not (keys[0] == keys[1]).any()
            ruled_out += not hyper_minhash.estimate_allows(len(a), len(b), x.tobytes(), y.tobytes())
    assert tried and not missed and not ruled_out


def family(rng, size, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(size - 1):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        out.append((" " if rng.random() < 0.5 else "\n").join(own))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_components_are_those_of_all_pairs(spark, monkeypatch, small):
    if small:  # large groups, leaders and cross tiles on a small table
        monkeypatch.setattr(hyper_minhash, "SMALL", 3)
        monkeypatch.setattr(hyper_minhash, "TILE_ROWS", 5)
        monkeypatch.setattr(ngram_join, "TILE_ROWS", 5)
        monkeypatch.setattr(ngram_join, "CROSS_ROWS", 4)
    rng = random.Random(8)
    texts = [t for size, words, edits in ((30, 120, 3), (25, 60, 2), (20, 300, 8), (12, 11, 1), (9, 6, 1), (6, 3, 1)) for t in family(rng, size, words, edits)]
    notice = " ".join(f"license{k}" for k in range(40))
    texts += [notice + " " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(rng.choice((1, 5, 9, 60)))) for _ in range(40)]  # a passage that many share
    texts += ["one two three four five six"] * 5 + ["ONE two Three four five six", "one two three four five six seven", "a b", "A  b", "b a"]
    rng.shuffle(texts)
    rows = [(10 + k, t) for k, t in enumerate(texts)] + [r for r in ODD if r[0] is not None]
    got = hyper_minhash.near_duplicates(docs(spark, [*rows, (None, texts[0])]).repartition(3)).collect()
    want = brute_components(rows, 85)
    assert {r.id: (r.n_shingles, r.component_id) for r in got if r.id is not None} == want and len(got) == len(rows) + 1
    assert all(r.kept == (r.id == r.component_id) for r in got if r.id is not None) and [(r.component_id, r.kept) for r in got if r.id is None] == [(None, True)]


def test_near_dedup_of_odd_tables_and_kept_rows(spark, tmp_path):
    assert hyper_minhash.near_duplicates(docs(spark, [])).count() == 0
    base = " ".join(f"w{k}" for k in range(100))
    rows = [(5, base), (3, base + " end"), (9, base), (9, base), (1, "other words here"), (2, None), (4, ""), (None, base)]
    kept = hyper_minhash.keep_one(docs(spark, rows))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_minhash(spark, str(tmp_path)).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_a_word_has_one_hash_wherever_it_stands():
    cut, n = ngram_join.Shingler(), ngram_join.Shingler.STRETCH
    for size in (n - 1, n, n + 1, 2 * n, 2 * n + 7):
        for word in ("a" * size, "aB9" * (size // 3) + "é" * (size % 3)):
            alone = cut.words(word)
            assert len(alone) == 1
            for text in (word + " ", " " + word, word + " b", "b " + word + "\n", "c " * (n // 2 - 1) + word + " d"):
                assert alone[0] in cut.words(text), (size, text[:5], len(text))
    assert cut.words("a" * n)[0] != cut.words("a" * (n + 1))[0] and cut.words("A" * (n + 1))[0] == cut.words("a" * (n + 1))[0]


def test_long_words_link(spark):
    n = ngram_join.Shingler.STRETCH
    rows = [(k, "a" * size + tail) for k, (size, tail) in enumerate((s, t) for s in (n - 1, n, n + 1) for t in ("", " "))]
    for run in (ngram_join.jaccard_components, hyper_minhash.near_duplicates):
        got = {r.id: r.component_id for r in run(docs(spark, rows)).collect()}
        assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}
