"""Operators that SQL can't check, against brute force on small tables; rules for repeats, nulls and errors."""

import heapq
import itertools
import json
import math
import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions import answers as A, lexicon as L, text as T
from lexloom.operators import corpus as C, evaluate as E, mix as M, order as O, pairs as P, tokens as K
from lexloom.shared import spread
from lexloom.sources import files


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn("v").alias("r")).first().r


# -- repeats


def test_first_rows_of_repeated_numbers(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (0, "b"), (1, "a"), (2, None), (3, None)], "seq long, text string")
    assert sorted((r.seq, r.text or "") for r in C.keep_first(df, "text", "seq").collect()) == [(0, "b"), (1, "a"), (2, "")]
    rows = spark.createDataFrame([(1, "k", 5), (1, "k", 5), (1, "l", 4), (2, "k", 5), (2, "l", 3)], "seq long, key string, n int")
    assert sorted((r.key, r.seq) for r in P.keep_shortest(rows, "key", F.col("n"), "seq").collect()) == [("k", 1), ("l", 2)]
    base, new = rows.where("key = 'k'"), rows.union(spark.createDataFrame([(2, "m", 1), (2, "m", 1)], rows.schema))
    assert sorted((r.key, r.seq) for r in P.base_then_new(base, new, "key", "seq").collect()) == [("k", 2), ("l", 1), ("m", 2)]


def test_greedy_rounds_end_loudly(spark, monkeypatch):
    monkeypatch.setattr(P, "ROUNDS", 1)
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "b", "z")], "seq long, a string, b string")
    with pytest.raises(RuntimeError, match="undecided"):
        P.greedy_pairs(rows, "seq", "a", "b")


# -- sources


def test_jsonl_places(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"text": f"t{k}"}) + "\n" + "\n" * (k % 2) for k in range(50)))
    (tmp_path / "b.jsonl").write_text('{"text": "b0"}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        got = {r.text: (r.path.rsplit("/")[-1], r.line_number) for r in files.read_jsonl(spark, str(tmp_path)).collect()}
        lines = (tmp_path / "a.jsonl").read_text().split("\n")
        assert got == {f"t{k}": ("a.jsonl", lines.index(json.dumps({"text": f"t{k}"})) + 1) for k in range(50)} | {"b0": ("b.jsonl", 1)}
        (tmp_path / "c.jsonl").write_text('{"text": "c"}\n\n{broken\n')
        with pytest.raises(Exception, match=r"invalid JSON line \S*c\.jsonl:3"):
            files.read_jsonl(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_shards_are_those_of_the_sequential_rule(spark):
    rng = random.Random(3)
    for most in (1, 7, 50):
        sizes = [rng.choice([0, 1, 3, 9, 60]) for _ in range(400)]
        want, shard, used, held = [], 0, 0, 0
        for n in sizes:
            if held and used + n > most:
                shard, used, held = shard + 1, 0, 0
            used, held = used + n, held + 1
            want.append(shard)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
        got = files.assign_shards(spark.createDataFrame(list(enumerate(sizes)), "seq long, n long"), "seq", "n", most).orderBy("seq").collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert [r.shard for r in got] == want
    assert files.assign_shards(spark.createDataFrame([], "seq long, n long"), "seq", "n", 9).count() == 0


def test_ranges_act_on_the_open_shard_as_their_rows_do(monkeypatch):
    """Step functions of ranges, put together in any grouping, against the sequential rule; steps for the rows of one shard at most."""
    rng = random.Random(5)
    for _ in range(300):
        most = rng.choice((1, 5, 20, 200))
        sizes = np.array([rng.choice((0, 1, 2, 7, 30)) for _ in range(rng.randint(1, 60))])
        total, at = np.cumsum(sizes), sorted({0, *(rng.randrange(len(sizes)) for _ in range(5)), len(sizes)})
        parts = [O._summary(total[a:b], int(total[a - 1]) if a else 0, most) for a, b in itertools.pairwise(at)]
        starts, used, held = [], 0, False
        for k, n in enumerate(sizes.tolist()):
            if not held or used + n > most:
                starts.append(k)
                used, held = 0, True
            used += n
        want = int(total[starts[-1] - 1] if starts[-1] else 0) + most
        whole = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        reach = -1
        for p in parts:
            whole, reach = O._joined(whole, p), O._through(p, reach)
        assert O._through(whole, -1) == reach == want
    steps = O._summary(np.cumsum(np.random.default_rng(1).integers(1, 100, 100_000)), 0, 50_000)
    assert len(steps[0]) < 200  # of about 1,000 rows in which the first shard may end


def test_shards_by_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(O, "FAN", 2)
    rng = random.Random(6)
    sizes = [rng.choice([1, 3, 9, 60]) for _ in range(500)]
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = files.assign_shards(spark.createDataFrame([(k * 10**12, n) for k, n in enumerate(sizes)], "seq long, n long").repartition(3), "seq", "n", 100).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    shard = used = 0
    for r, n in zip(got, sizes, strict=True):
        shard, used = (shard + 1, n) if used and used + n > 100 else (shard, used + n)
        assert r.shard == shard


# -- orders


def test_sparse_keys_make_no_more_blocks_than_ranges(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(100)) for k in {rng.randrange(-(2**62), 2**62) for _ in range(3000)}]
    df = spark.createDataFrame(rows, "seq long, v long").repartition(5)
    assert O.dealt(df, "seq").select("_p").distinct().count() <= 4
    got = M.running_total(df, "seq", "v").orderBy("seq").collect()
    assert [r.total for r in got] == list(itertools.accumulate(v for _, v in sorted(rows)))
    both = O.scanned(df.withColumn("s", F.col("seq").cast("string")), "s", a="v", b=F.lit(1)).orderBy("s").collect()
    assert [r.a for r in both] == list(itertools.accumulate(v for _, v in sorted((str(k), v) for k, v in rows))) and [r.b for r in both] == list(range(1, 3001))
    assert M.prefix_until(df, "seq", "v", 10**9).count() == 3000 and M.tail_split(df, "seq", 1.0).where("split = 'train'").count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_of_the_stream(spark, seed):
    rng = random.Random(seed)
    rows = [(k * 7, [rng.randrange(1000) for _ in range(rng.choice((0, 1, 2, 50, 3000)))] if rng.random() < 0.9 else None) for k in range(40)]
    stream = [x for _, ids in rows for x in ids or ()]
    df = spark.createDataFrame(rows, "seq long, ids array<int>").repartition(3)
    size = rng.choice((1, 8, 700))
    at = [0, len(stream) - size - 1, len(stream) - size, -1, *(rng.randrange(len(stream)) for _ in range(20))]
    got = {r.k: (r.x, r.y) for r in M.stream_windows(df, "seq", "ids", spark.createDataFrame(list(enumerate(at)), "k long, start long"), size).collect()}
    assert got == {k: (stream[s : s + size], stream[s + 1 : s + size + 1]) for k, s in enumerate(at) if 0 <= s < len(stream) - size}
    some = M.random_stream_windows(df, "seq", "ids", size, 9).collect()
    assert len(some) == 9 and all(r.x[1:] == r.y[:-1] and len(r.y) == size for r in some)
    keep = int(len(stream) * 0.75)
    parts = M.stream_split(df, "seq", "ids", 0.25).orderBy("seq").collect()
    assert [x for r in parts if r.split == "train" for x in r.ids] == stream[:keep] and [x for r in parts if r.split == "validation" for x in r.ids] == stream[keep:]
    with pytest.raises(ValueError, match="holds no window"):
        M.random_stream_windows(df, "seq", "ids", len(stream), 1)


@pytest.mark.parametrize("seed", range(4))
def test_runs_across_ranges(spark, seed):
    rng = random.Random(seed)
    items = ["a"] * 60 if seed == 0 else [x for _ in range(rng.choice((3, 40))) for x in [rng.choice(("a", "A", "b", None))] * rng.choice((1, 1, 2, 30))]
    df = spark.createDataFrame([(k * 10**9, x) for k, x in enumerate(items)], "seq long, x string").repartition(3)
    want, at = [], 0
    for _, group in itertools.groupby(items):
        n = len(list(group))
        want.append((at * 10**9, n))
        at += n
    assert sorted((r["first"], r.n) for r in O.equal_runs(df, "seq", "x").collect()) == want
    assert O.longest_run(df, "seq", "x").first().longest == max(len(list(g)) for _, g in itertools.groupby(x and x.lower() for x in items))
    assert sorted(r.seq for r in O.without_repeats(df, "seq", "x").collect()) == [k for k, _ in want]
    assert O.longest_run(df.limit(0), "seq", "x").first().longest == 0


@pytest.mark.parametrize("seed", range(5))
def test_copies_stand_as_the_heap_places_them(spark, seed):
    rng = random.Random(seed)
    counts = [[1], [3, 2], [5, 1, 1, 1, 1], [9, 4, 4, 2], [4, 4, 1]][seed] if seed < 3 else [rng.randint(1, 9) for _ in range(9)] + [30]
    rows = [(f"i{k}",) for k, n in enumerate(counts) for _ in range(n)]
    df = spark.createDataFrame(rows, "item string").repartition(2)
    tie = {r.item: r.key for r in df.distinct().select("item", M.seeded_key(42, "item").alias("key")).collect()}
    heap, out, held = [(-n, tie[f"i{k}"], f"i{k}") for k, n in enumerate(counts)], [], None
    heapq.heapify(heap)
    while heap:
        n, t, item = heapq.heappop(heap)
        out.append(item)
        if held:
            heapq.heappush(heap, held)
        held = (n + 1, t, item) if n + 1 < 0 else None
    got = M.apart(df, "item").orderBy("place").collect()
    assert [r.item for r in got] == out and [r.place for r in got] == list(range(len(rows)))


def test_merged_corpora_as_files(spark, tmp_path):
    rows = [(k, f"g{k % 2}", f" text {k} " if k != 4 else "  ") for k in range(9)]
    df = spark.createDataFrame(rows, "seq long, g string, t string").repartition(3)
    files.write_merged(df, str(tmp_path / "out"), "g", "seq", "t")
    for g in ("g0", "g1"):
        whole = "".join(p.read_text() for p in sorted((tmp_path / "out" / f"g={g}").glob("*.txt")))
        assert whole == "".join(f"text {k}\n\n" for k, x, _ in rows if x == g and k != 4)


def test_small_tables_are_spread(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    small = spark.read.parquet(str(tmp_path / "one"))
    assert small.rdd.getNumPartitions() == 1 and spread(small).rdd.getNumPartitions() == 1
    assert spread(small, 1).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    grouped = small.groupBy("id").count()
    assert spread(grouped) is grouped


# -- order


def test_ranks_and_numbers(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice("abc") if k % 9 else None, rng.random()) for k in range(500)]
    df = spark.createDataFrame(rows, "seq long, g string, x double")
    assert [r.seq for r in M.ranked(df, "x", "seq").orderBy("place").collect()] == [k for k, _, _ in sorted(rows, key=lambda r: (r[2], r[0]))]
    got = {r.seq: r.n for r in M.within(df, "g", "seq", "n").collect()}
    seen = Counter()
    for k, g, _ in rows:
        seen[g] += 1
        assert got[k] == seen[g]
    order = [r.seq for r in M.shuffled(df.select("seq"), 42, "seq").orderBy("place").collect()]
    assert sorted(order) == list(range(500)) and order != list(range(500))
    assert M.ranked(df.limit(0), "x").count() == 0


@pytest.mark.parametrize("counts", [{"a": 3, "b": 3}, {"a": 3, "b": 2}, {"a": 1}, {"a": 5, "b": 4, "c": 1}, {c: 1 + k % 4 for k, c in enumerate("abcdefghij")}, {"a": 4, "b": 3, "c": 2, "d": 1}])
def test_copies_are_kept_apart(spark, monkeypatch, counts):
    monkeypatch.setattr(M, "COPIES", 2)
    df = spark.createDataFrame([(c,) for c, n in counts.items() for _ in range(n)], "item string")
    got = M.apart(df, "item").orderBy("place").collect()
    assert [r.place for r in got] == list(range(sum(counts.values()))) and Counter(r.item for r in got) == counts
    assert all(a.item != b.item for a, b in zip(got, got[1:], strict=False))


def test_too_many_copies(spark):
    with pytest.raises(ValueError, match="copies"):
        M.apart(spark.createDataFrame([("a",)] * 4 + [("b",)] * 2, "item string"), "item")
    assert M.apart(spark.createDataFrame([], "item string"), "item").count() == 0


def test_generators_reach_their_targets(spark):
    blocks = spark.createDataFrame([(0, "one two three"), (1, "four")], "seq long, text string")
    got = M.cycled(blocks, "seq", "text", 9).orderBy("cycle", "seq").collect()
    assert [r.text for r in got] == ["one two three", "four"] * 3
    with pytest.raises(ValueError, match="never"):
        M.cycled(blocks.select("seq", F.lit(" ").alias("text")), "seq", "text", 9)
    many = spark.createDataFrame([(k, f"Word {k % 3} here") for k in range(9)] + [(9, "other")], "seq long, text string")
    assert [r.seq for r in M.generated_until(many, "seq", "text", 7, have=2, known=many.where("seq = 1")).orderBy("seq").collect()] == [0, 2]
    assert M.generated_until(many, "seq", "text", 7, have=7).count() == 0
    assert M.resolved(" Tech-Mix ", ("tech_mix", "all"), dashes=True) == "tech_mix" and M.resolved("full", ("all",), {"full": "all"}) == "all"
    with pytest.raises(ValueError, match="one of all"):
        M.resolved("none", ("all",))


# -- vocabularies


def brute_merges(words, target, first):
    words = [([*w, "</w>"] if w != "\n" else ["\n"], n) for w, n in words]
    vocabulary, merges = {s for w, _ in words for s in w}, []
    while len(vocabulary) < target:
        counts = {}
        for w, n in words:
            for p in zip(w, w[1:], strict=False):
                counts[p] = counts.get(p, 0) + n
        if not counts:
            break
        best = max(counts, key=counts.get) if first else min(counts, key=lambda p: (-counts[p], p))
        merges.append(best)
        vocabulary.add("".join(best))
        words = [(K.joined(w, best), n) for w, n in words]
    return merges, vocabulary


@pytest.mark.parametrize("ahead, guess_words, target", [(256, 1 << 16, 60), (7, 1 << 16, 24), (256, 6, 18), (1, 1, 11)])
def test_merges_are_those_of_the_sequential_loop(spark, ahead, guess_words, target):
    rng = random.Random(7)
    counts = Counter("".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(400)) + Counter({"aaaa": 3, "aaa": 2, "\n": 9, "ééé": 1})
    words = sorted(counts.items())
    df = spark.createDataFrame([(w, n, k) for k, (w, n) in enumerate(words)], "word string, n long, seq long").repartition(5)
    got = K.learn_merges(df, target, ahead=ahead, guess_words=guess_words)
    assert (got.pairs, got.vocabulary, got.stopped, got.initial) == (*brute_merges(words, target, False), K.REACHED, 7)
    assert got.until(10).pairs == brute_merges(words, 10, False)[0] and got.until(3).stopped == K.ALREADY


@pytest.mark.parametrize("guess_words", [1 << 16, 5])
def test_merges_by_first_place(spark, guess_words):
    rng = random.Random(9)
    words = list(Counter("".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(60)).items())
    df = spark.createDataFrame([(w, n, 10 * k) for k, (w, n) in enumerate(words)], "word string, n long, seq long").repartition(3)
    assert K.learn_merges(df, 12, ties="first", guess_words=guess_words).pairs == brute_merges(words, 12, True)[0]


def test_merges_end_without_pairs(spark):
    few = spark.createDataFrame([("ab", 1), ("\n", 3)], "word string, n long")
    got = K.learn_merges(few, 99)
    assert got.stopped == K.NO_PAIRS and got.pairs == [("a", "b"), ("ab", "</w>")] and K.learn_merges(few, 2).stopped == K.ALREADY
    assert K.learn_merges(few.limit(0), 9).stopped == K.NO_PAIRS and got.until(99).stopped == K.NO_PAIRS


def test_words_never_reach_the_driver(spark, monkeypatch):
    """What is collected while merges are learned: guessed pairs, and best pairs by step; never more rows than steps or characters."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    words = ["".join(p) for n in range(1, 6) for p in itertools.product("abc", repeat=n)]
    df = spark.createDataFrame([(w, 1 + k % 17) for k, w in enumerate(words)], "word string, n long").repartition(4)
    sizes, collect = [], Classic.collect
    monkeypatch.setattr(Classic, "collect", lambda self: sizes.append(len(out := collect(self))) or out)
    monkeypatch.setattr(Classic, "toPandas", lambda self: pytest.fail("toPandas"))
    monkeypatch.setattr(Classic, "toArrow", lambda self: pytest.fail("toArrow"))
    assert len(K.learn_merges(df, 14, ahead=5, guess_words=20).pairs) >= 10 and len(words) == 363 and max(sizes) <= 6


def test_vocabularies_are_stored(spark, tmp_path):
    df = spark.createDataFrame([("hello", 3), ("help", 2), ("ßü日", 1)], "word string, n long")
    merges = K.learn_merges(df, 16)
    K.save_merges(merges, spark, str(tmp_path / "v"))
    back = K.load_merges(spark, str(tmp_path / "v"))
    assert (back.pairs, back.vocabulary, back.ids, back.initial) == (merges.pairs, merges.vocabulary, merges.ids, merges.initial)
    (tmp_path / "w.json").write_text(json.dumps({"end_marker": "</w>", "merges": [["a", "b"]], "vocab": ["</w>", "a", "ab", "b"], "stoi": {"</w>": 0, "a": 1, "ab": 2, "b": 3}}, indent=2))
    assert K.load_merges(spark, str(tmp_path / "w.json")).pairs == [("a", "b")]


def test_prompts_texts_and_coverage(spark):
    merges = K.learn_merges(spark.createDataFrame([("low", 5), ("lower", 2), ("new", 6)], "word string, n long"), 14)
    ids = merges.ids
    rows = [(1, "low  new\tzz low"), (2, "ZZ"), (3, None), (4, ""), (5, "lowZnew")]
    got = {r.seq: r.ids for r in K.encode_prompts(spark.createDataFrame(rows, "seq long, text string"), "seq", merges).collect()}
    word = lambda w: [ids[t] for t in K.encode_word(w, merges.rank)]
    assert got == {1: word("low") + word("new") + word("low"), 2: [0], 3: [0], 4: [0], 5: word("low") + word("new")}
    parts = K.training_text(spark.createDataFrame([(" base ",), (" ",)], "text string"), spark.createDataFrame([("chat",)], "text string"), (*L.SPECIAL_MARKERS, "."), 3).collect()
    assert Counter(r.part for r in parts) == {"base": 1, "symbols": 3, "chat": 1} and {r.text for r in parts if r.part == "symbols"} == {"<USER> <ASSISTANT> <END> ."}
    chats = [(1, "low new", "lower?"), (2, "", "new"), (3, "slow", None)]
    old = K.Merges(vocabulary=merges.vocabulary)
    r = K.coverage_report(spark.createDataFrame(chats, "seq long, instruction string, response string"), merges, old, "seq").first()
    size = lambda t, rank: sum(len([x for x in K.encode_word("".join(c for c in w if c in merges.vocabulary), rank) if x in merges.vocabulary]) for w in (t or "").split())
    whole = [" ".join(x for x in (i, o) if x is not None) for _, i, o in chats]
    new_total, old_total = sum(size(t, merges.rank) for t in whole), sum(size(t, {}) for t in whole)
    assert (r.examples, r.parse_failures, r.new_total, r.old_total, r.new_skipped) == (3, 2, new_total, old_total, 2)
    assert r.compression == round(old_total / new_total, 4) and r.avg_response_tokens == round(sum(size(o, merges.rank) for _, _, o in chats) / 3, 2)
    docs = spark.createDataFrame([(k, "low new") for k in range(10)], "seq long, text string")
    docs = docs.union(spark.createDataFrame([(10, "zz low"), (-1, None), (-2, " ")], docs.schema))
    for n in (1, 2, 3, 20, 21, 22, 10**6):
        first = [w for k in range(10) for w in ("low", "new")] + ["zz", "low"]
        tokens = sum(size(w, merges.rank) for w in first[:n])
        e = K.estimated_tokens(docs, "seq", merges, n).first()
        assert (e.words, e.sample_words, e.sample_tokens, e.estimated_tokens) == (22, min(n, 22), tokens, round(22 * tokens / min(n, 22))) and e.tokens_per_word == round(tokens / min(n, 22), 4)
    assert K.estimated_tokens(docs.limit(0), "seq", merges, 5).first().estimated_tokens == 0


def test_texts_as_ids(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, "c a")], "seq long, text string")
    vocabulary = K.vocabulary_by_first_seen(docs.where("seq < 3"), "seq")
    assert {r.seq: r.ids for r in K.as_ids(docs, "seq", "text", vocabulary).collect()} == {1: [2, 3, 2], 2: [], 3: [1, 3]}


# -- evaluation


def test_nearest_snippet_is_that_of_a_scan(spark):
    rng = random.Random(8)
    words = ["river", "stone", "window", "garden", "letter", "a", "of", "the"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(k, "\n".join(text(rng.randint(1, 12)) + "." for _ in range(rng.randint(1, 4))) + ("\n\n" + text(60) if k % 3 == 0 else "")) for k in range(40)] + [(40, None), (41, docs_line := "The  Exact line of a document")]
    outs = [(k, text(rng.randint(1, 20))) for k in range(12)] + [(20, ""), (21, None), (22, docs_line.upper()), (23, "qqqq"), (24, "x")]
    fold = lambda s: " ".join(s.split()).lower()
    lines = [x for _, t in docs for x in (t or "").split("\n")]
    import re

    paragraphs = [x for _, t in docs for x in re.split(r"\n\s*\n", t or "")]
    df = spark.createDataFrame(docs, "seq long, text string").repartition(3)
    got = {r.k: (r.similarity, r.snippet) for r in E.nearest_snippet(spark.createDataFrame(outs, "k long, out string"), E.snippets(df, "seq"), "k", "out").collect()}
    for k, o in outs:
        best, snippet = 0.0, ""
        for s in lines + paragraphs:
            if len(fold(s)) >= 20 and fold(o or "") and (r := SequenceMatcher(None, fold(o), fold(s)).ratio()) > best:
                best, snippet = r, s.strip()[:120]
        assert got[k] == (best, snippet)
    assert got[22] == (1.0, docs_line) and got[20] == (0.0, "")


def test_paragraph_matches_are_those_of_a_scan(spark, monkeypatch):
    rng = random.Random(9)
    docs = [(k, "\n\n".join("".join(rng.choice("ab ") for _ in range(rng.randint(0, 40))) for _ in range(2))) for k in range(30)]
    outs = [(k, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 9)))) for k in range(120)] + [(5, "ab"), (200, None)]
    fold = lambda s: " ".join((s or "").split()).lower()
    df = spark.createDataFrame(docs, "seq long, text string").repartition(3)
    keys = [r.key for r in E.paragraphs(df, "seq").collect()]
    for most in (10**6, 60):
        got = E.paragraph_matches(spark.createDataFrame(outs, "k long, out string"), E.paragraphs(df, "seq"), "out").collect() if most > 100 else None
        if got is None:
            monkeypatch.setattr(E, "BLOCK_CHARS", most)
            got = [r for b in E._in_blocks(spark.createDataFrame(outs, "k long, out string").where("out IS NOT NULL"), "out", most) for r in b]
            assert len(got) == len(outs) - 1
        else:
            assert sorted((r.k, r.out) for r in got) == sorted({(k, o) for k, o in outs if fold(o) and any(fold(o) in p for p in keys)})


def test_suite_is_measured_and_complete(spark):
    corpus = spark.createDataFrame([(1, "the query planner reads an index first\n\nand a second paragraph stands here")], "seq long, text string")
    prompts = spark.createDataFrame([(1, "p", "databases"), (2, "q", "ai")], "id long, prompt string, domain string")
    pred = spark.createDataFrame([(1, "m", "The query planner reads an index first"), (2, "m", "model model model model model model")], "id long, model string, output string")
    words = {"databases": ("query", "index", "table", "join"), "ai": ("model",)}
    rows = {r.id: r for r in E.suite_samples(prompts, pred, corpus, "seq", words).collect()}
    assert rows[1].paragraph and rows[1].line and rows[1].nearest == 1.0 and rows[1].consistency == 0.5 and rows[2].repetition > 0.5 and not rows[2].line
    s = E.memorisation_summary(E.suite_samples(prompts, pred, corpus, "seq", words), "model").first()
    assert s.n == 2 and s.paragraph_rate == 0.5 and s.risk == "high" and s.avg_words == 6.5
    with pytest.raises(Exception, match="no output of m for prompt 2"):
        E.suite_samples(prompts, pred.where("id = 1"), corpus, "seq", words).collect()
    with pytest.raises(Exception, match="no prediction for 2"):
        E.require_predictions(prompts, pred.where("id = 1").withColumnRenamed("output", "generated_response")).collect()
    assert [(r.id, r.side) for r in E.same_sets(prompts, pred.where("id = 1"), "id").collect()] == [(2, "left")]


def test_signatures_and_profiles(spark):
    ex = [(1, "sql", "A query language for tables and rows"), (2, "sql", "other"), (3, "ai", "Models learn from data they are shown"), (4, "ml", "Models learn from data that is labelled"), (5, "db", "")]
    known = E.signatures(spark.createDataFrame(ex, "seq long, concept string, answer string"), "seq")
    asked = [(1, "a Query language for tables, surely"), (2, "A thing"), (3, "Models of some kind"), (4, "models learn from data they saw"), (5, "nothing"), (6, "")]
    got = {r.id: r.predicted for r in E.by_signature(spark.createDataFrame(asked, "id long, answer string"), known).collect()}
    assert got == {1: "sql", 2: "sql", 3: None, 4: "ai", 5: None, 6: "db"}
    rec = [(1, "neural_net", "ai", []), (2, "neural_net", "ml", ["layers", "weights"]), (3, "sql", "db", ["query", "sql"])]
    p = {(r.concept, r.phrase): (r.primary, r.anchor, r.domain) for r in E.profiles(spark.createDataFrame(rec, "seq long, concept string, domain string, keywords array<string>"), "seq").collect()}
    assert p == {("neural_net", "layers"): (True, False, "ml"), ("neural_net", "weights"): (False, False, "ml"), ("neural_net", "neural net"): (False, True, "ml"), ("sql", "query"): (True, False, "db"), ("sql", "sql"): (False, True, "db")}
    rates = E.routing_rates(spark.createDataFrame([("the cat sat", "the cat sat", "a", "a"), ("the dog", "the cat sat", "a", None)], "g string, r string, e string, p string"), "g", "r", "e", "p").first()
    assert (rates.first_word, rates.first_five, rates.exact, rates.concept) == (1.0, 0.5, 0.5, 0.5)


def test_conclusions_and_compatibility(spark):
    row = lambda a: spark.createDataFrame([(a, 1 - a)], "routing_accuracy double, concept_confusion_rate double")
    said = lambda a, b: E.compared(row(a), None if b is None else row(b)).first().conclusion
    assert (said(0.9, 0.5), said(0.5, 0.1), said(0.9, 0.85), said(0.9, None)) == ("training", "capacity", "inconclusive", "inconclusive")
    rows = [(8, 8, [8, 4], [8, 4], 4), (8, 8, None, None, 4), (9, 8, [8, 4], None, 4), (8, 9, [8, 4], None, 4), (8, 8, [8, 5], None, 4), (8, 8, [8, 4], [7, 4], 4), (8, 8, [8], None, 4), (8, 8, [8, 4], None, 4)]
    got = [r.problem for r in E.compatible(spark.createDataFrame(rows, "tokenizer_vocab int, model_vocab int, embedding array<int>, head array<int>, d int").coalesce(1)).collect()]
    assert got == [None, "no embedding", "tokenizer vocabulary", "model vocabulary", "embedding shape", "head rows", "embedding is no matrix", None]


def test_gibberish_by_fragments(spark):
    known = spark.createDataFrame([("window",)], "word string")
    merges = K.learn_merges(spark.createDataFrame([("window", 5), ("garden", 4)], "word string, n long"), 40)
    text = "Window garden wnoidg gpt aaab x9y gardenwindow ai"
    got = sorted(r.word for r in E.gibberish(spark.createDataFrame([(1, text)], "seq long, text string"), "seq", "text", known, merges).collect())
    assert got == ["aaab", "wnoidg", "x9y"]


# -- logits


def test_logit_filters(spark):
    rng = random.Random(10)
    inf = float("inf")
    for _ in range(12):
        a = [round(rng.uniform(-3, 3), 3) for _ in range(8)]
        ids = [rng.randrange(8) for _ in range(rng.randint(0, 12))]
        row = spark.createDataFrame([(a, ids)], "a array<double>, i array<int>")
        p, window = rng.choice([0.2, 0.6, 0.95]), rng.choice([3, 64])
        got = row.select(A.top_p("a", p).alias("p"), A.repetition_penalty("a", "i", 1.5, window).alias("r"), A.presence_penalty("a", "i", 0.5).alias("s"), A.ngram_ban("a", "i", 3).alias("n"), A.top_p("a", 1.0).alias("all")).first()
        order = sorted(range(8), key=lambda k: (-a[k], k))
        total, run, kept = sum(map(math.exp, a)), 0.0, set()
        for k in order:
            kept.add(k)
            run += math.exp(a[k]) / total
            if run > p:
                break
        assert got.p == [x if k in kept else -inf for k, x in enumerate(a)] and got["all"] == a
        n = Counter(ids[-window:])
        assert got.r == pytest.approx([x / 1.5 ** n[k] if x > 0 else x * 1.5 ** n[k] for k, x in enumerate(a)])
        assert got.s == pytest.approx([x - 0.5 * (k in ids) for k, x in enumerate(a)])
        banned = {ids[k + 2] for k in range(len(ids) - 2) if ids[k : k + 2] == ids[-2:]} if len(ids) >= 3 else set()
        assert got.n == [-inf if k in banned else x for k, x in enumerate(a)]


def test_grammar_and_counts(spark):
    assert one(spark, "Attention a model", A.grammar_issue) and one(spark, "it is is so", A.grammar_issue) and not one(spark, "An index is a list", A.grammar_issue)
    assert [one(spark, n, E.short_count, "long") for n in (12, 8_000, 50_340_000, 1_234_000_000)] == ["12", "8.0K", "50.3M", "1.2B"]
    assert one(spark, "a b a", lambda c: T.common_words(T.words(c, "space"), F.array(F.lit("a"), F.lit("a"), F.lit("a"), F.lit("c")))) == 2


def test_report_gates(spark):
    pairs = spark.createDataFrame([(k, f"q{k}", f"answer {k}", k < 3) for k in range(10)], "seq long, instruction string, response string, teacher boolean")
    good = P.report(pairs, F.col("teacher"), 3)
    assert P.gated(good.withColumn("longest", F.lit(1))).first().teacher_ratio == round(9 / 16, 6) and good.first().duplicate_blocks == 6
    with pytest.raises(Exception, match="teacher ratio"):
        P.gated(P.report(pairs, F.col("teacher"), 1).withColumn("longest", F.lit(1)), 0.5).collect()
    with pytest.raises(Exception, match="follow each other"):
        P.gated(good.withColumn("longest", F.lit(2))).collect()


# -- guards and small rules


def test_guards_raise(spark):
    rows = spark.createDataFrame([(1, "a b c", "train"), (2, "a", "train")], "seq long, text string, split string")
    assert P.without_held_out(rows).count() == 2 and P.require_unique(rows, "seq").count() == 2 and P.require_length(rows, "text", (1, 3)).count() == 2
    for bad, what in ((P.without_held_out(rows.withColumn("split", F.lit("held_out"))), "held-out"), (P.require_unique(rows, "split"), "more than once: train"), (P.require_length(rows, "text", (2, 3)), "outside the band: a")):
        with pytest.raises(Exception, match=what):
            bad.collect()
    assert P.require_unique(rows.limit(0), "seq").count() == 0


def test_chats_are_loaded_with_their_text(spark):
    rows = [(1, "q", "a", None), (2, None, None, "<USER> hi <ASSISTANT> fine <END>"), (3, "q", "", "no markers"), (4, "x", "y", "own text")]
    from lexloom.functions import chat

    got = {r.seq: (r.instruction, r.response, r.text) for r in chat.load(spark.createDataFrame(rows, "seq long, instruction string, response string, text string")).collect()}
    assert got == {1: ("q", "a", "<USER>\nq\n<ASSISTANT>\na\n<END>"), 2: ("hi", "fine", rows[1][3]), 4: ("x", "y", "own text")}
    assert chat.load(spark.createDataFrame([("<USER> a <ASSISTANT> b",)], "text string")).first().response == "b"


def test_suites_samples_and_paraphrases(spark):
    res = spark.createDataFrame([("m", True), ("m", None), ("n", True)], "model string, passes boolean")
    assert {r.model: (r.prompts, r.passed, r.suite_passes) for r in E.suite_passes(res, "passes", "model").collect()} == {"m": (2, 1, False), "n": (1, 1, True)}
    assert not E.suite_passes(res.limit(0)).first().suite_passes
    df = spark.range(100).withColumnRenamed("id", "seq")
    some = [r.seq for r in M.sampled(df, "seq", 7).collect()]
    assert len(set(some)) == 7 and some == [r.seq for r in M.sampled(df.repartition(5), "seq", 7).collect()]
    t = spark.createDataFrame([(0, "What is {}?"), (1, "What is {}?"), (2, "Why {}?"), (3, "How {}?")], "t int, template string")
    assert sorted(r.instruction for r in M.paraphrases(spark.createDataFrame([("x",)], "concept string"), t, 2).collect()) == ["What is x?", "Why x?"]
    got = E.parameters_checked(spark.createDataFrame([(110, 100), (5, 0)], "parameters long, actual long").coalesce(1)).collect()
    assert [(r.difference, r.error) for r in got] == [(10, 0.1), (5, None)]


def test_verdicts_of_answers(spark):
    assert one(spark, "An index helps the table. And more", lambda c: A.teacher_verdict(c, ("index",))) and not one(spark, "index index index index index index index", lambda c: A.teacher_verdict(c, ("index",)))
    assert one(spark, "fine answer <END>", lambda c: A.chat_verdict(c, ("scene",), ("thou",))) and not one(spark, "fine <END> <USER> x", lambda c: A.chat_verdict(c, ("scene",), ("thou",)))
    assert one(spark, "One. Two. Three <END> x", lambda c: A.postprocessed(c, "<END>", 1, 2)) == "One. Two." and one(spark, "many Tokens", A.technical) and not one(spark, "plain", A.technical)
    assert one(spark, "aab", T.characters) == ["a", "a", "b"]


def test_checkpoint_files_and_latest(spark, tmp_path):
    from lexloom.sources import reports

    for k in (1, 2):
        (tmp_path / f"m/step-{k}").mkdir(parents=True)
        (tmp_path / f"m/step-{k}/metrics.json").write_text(json.dumps({"step": k, "val_loss": 1.5 / k}, indent=1))
    assert sorted((r.checkpoint, r.step, r.train_loss, r.val_loss) for r in reports.checkpoint_metadata(spark, str(tmp_path / "m")).collect()) == [("step-1", 1, None, 1.5), ("step-2", 2, None, 0.75)]
    reports.archive_run(spark, str(tmp_path / "runs"), "r1", {"a": 1.0, "b": 2.0})
    reports.archive_run(spark, str(tmp_path / "runs"), "r2", {"a": 3.0})
    text = reports.write_latest(spark, str(tmp_path / "runs"), str(tmp_path / "out/latest.md"))
    assert "| a | 3.0000 | r2 |" in text and "| b | 2.0000 | r1 |" in text and reports.read_text(spark, str(tmp_path / "out/latest.md")) == text


@pytest.mark.parametrize(("words", "n", "least", "rows"), [
    (lambda c: T.words(T.casefold(c), "hyphen"), 3, None, {"A well-known fact, a WELL-known fact": "a well-known fact", "one two three one two": None}),
    (lambda c: T.words(c, "apostrophe"), 3, 3, {"it's all so it's all so": "it's all so", "a b c": None, "x y x y x": "x y x"}),
    (lambda c: F.transform(F.split(c, " "), lambda x: x.cast("int").cast("string")), 5, 5, {"1 2 3 4 5 1 2 3 4 5": "1 2 3 4 5", "1 2 3 4 5 6 7 8 9 1": None, "7 7 7 7 7 7": "7 7 7 7 7"}),
])
def test_first_repeated_phrases_by_dialect(spark, words, n, least, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "seq long, text string")
    got = {r.seq: r.phrase for r in C.first_repeated_ngram(df, "seq", words("text"), n, least).collect()}
    assert got == {k: v for k, v in enumerate(rows.values()) if v}


def test_first_repeated_phrases_stay_in_their_rows(spark):
    texts = ["a b c d a b c d", "x y z x y q", None, "", "w w w w w w", "one two three four five six", "p q r s t p q r q r s"]
    rows = [(k, t) for k, t in enumerate(texts)]
    find = lambda rows: C.first_repeated_ngram(spark.createDataFrame(rows, "seq long, text string"), "seq", T.words("text", "lower_space"))
    assert {r.seq: r.phrase for r in find(rows).collect()} == {0: "a b c", 4: "w w w", 6: "p q r"}
    assert "Exchange" not in find(rows)._jdf.queryExecution().executedPlan().toString()
    shared = [*rows, (10, "g h i j k l"), (10, "m n g h i o"), (10, "g h i j k l"), (None, "u v w u v w"), (None, "short")]
    assert {r.seq: r.phrase for r in find(shared).collect()} == {0: "a b c", 4: "w w w", 6: "p q r", 10: "g h i", None: "u v w"}
