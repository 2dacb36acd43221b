"""Operators on small literal tables: the behaviour that the inventory pins, and what SQL can't say."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import chat, text as T
from lexloom.operators import corpus as C, evaluate as E, mix as M, pairs as P, tokens as K
from lexloom.sources import files


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn("v").alias("r")).first().r


def test_cleaning_drops_navigation_and_footers(spark):
    raw = "Home | About\nReal  text here\n-----\n\nCopyright 2020 Someone\nMore text\r\nPage 1 of 2"
    assert one(spark, raw, T.clean_text) == "Real text here\n\nMore text"


def test_equal_hash_for_equal_text_but_blanks(spark):
    assert one(spark, "Some  text\there", T.content_hash) == one(spark, "some text here ", T.content_hash)


def test_keep_first_by_hash(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "A  b"), (3, "c")], "seq long, text string")
    assert sorted(r.seq for r in C.keep_first(df, T.content_hash("text"), "seq").collect()) == [1, 3]


def test_gate_reasons(spark):
    good = "The quality of this text is good and it has enough different words for the gate to keep it as it is"
    rows = [(1, good), (2, "lorem ipsum " + good), (3, "aaaaaaaaaaaaaaaa " + good), (4, "too short"), (5, "word " * 40), (6, "\n".join(["same line of the text"] * 3 + [good])), (7, "ж " + " ".join(f"слово{chr(1072 + k)}" for k in range(30)))]
    got = {r.seq: r.reason for r in C.quality_gate(spark.createDataFrame(rows, "seq long, text string"), min_unique=0.25).collect()}
    assert got[1] is None and got[2] == "lorem_ipsum" and got[3] == "char_spam" and got[4] == "too_short" and got[5] == "low_unique_words" and got[6] == "repeated_lines" and got[7] == "low_language_confidence"


@pytest.mark.parametrize(("text", "domain"), [("We index a table with SQL", "databases"), ("nothing of the kind", "general"), ("docker and kubernetes deployment", "software_engineering")])
def test_corpus_domain(spark, text, domain):
    assert one(spark, text, T.corpus_domain) == domain


def test_pair_domain_counts_each_keyword_once_as_a_word(spark):
    assert one(spark, "a join, a join, tablespoon of python code", T.pair_domain) == "software_engineering"
    assert one(spark, "rejoined", T.pair_domain) == "general"


def test_html(spark):
    raw = "<title>T</title><nav>skip <b>this</b></nav><p>Kept &amp; &amp;lt;fine</p><script>x()</script><div>end</div>"
    assert files.plain_text(raw) == "TKept & <fine\nend\n"
    assert files.plain_text("<p>a</p><nav>open <p>gone</p>") == "a\n\n"
    assert files.html_text(spark.createDataFrame([(1, raw), (2, None)], "k long, h string"), "k", "h").where("k = 2").first().text == ""


def test_jsonl_rules(spark):
    rows = [(1, '{"text": "a", "source": "s"}'), (2, "  "), (3, '{"content": "b", "language": "fr"}')]
    got = files.parse_jsonl(spark.createDataFrame(rows, "seq long, line string")).orderBy("seq").collect()
    assert [(r.text, r.source, r.language, r.domain) for r in got] == [("a", "s", "en", "general"), ("b", "unknown", "fr", "general")]
    with pytest.raises(Exception, match="invalid JSON line"):
        files.parse_jsonl(spark.createDataFrame([(7, "{broken")], "seq long, line string")).collect()


def test_ingest_tree(spark, tmp_path):
    for name, body in (("docs/a.md", "one\ntwo"), ("b.txt", "the text"), ("docs/c.html", "<nav>x</nav><p>page</p>"), ("web/d.jsonl", '{"text": "x"}\n\n{"content": "y", "source": "own"}\n'), ("web/e.bin", "no")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(body)
    got = sorted((r.source, r.kind, r.text.strip()) for r in files.ingest(spark, str(tmp_path)).collect())
    assert got == [("docs", "html", "page"), ("docs", "md", "one\ntwo"), ("own", "jsonl", "y"), ("unknown", "txt", "the text"), ("web", "jsonl", "x")]


def test_shards_fill_in_order(spark, tmp_path):
    df = spark.createDataFrame([(k, n) for k, n in enumerate([5, 5, 1, 20, 3, 3, 5])], "seq long, size long")
    assert [r.shard for r in files.assign_shards(df, "seq", "size", 10).orderBy("seq").collect()] == [0, 0, 1, 2, 3, 3, 4]
    files.write_shards(spark.createDataFrame([(k, "x" * 40) for k in range(20)], "seq long, text string"), str(tmp_path / "s"), "seq", 300)
    sizes = [sum(len(x.read_bytes()) for x in d.glob("part-*")) for d in (tmp_path / "s").glob("shard=*")]
    assert len(sizes) >= 2 and max(sizes) <= 300


def test_greedy_is_the_sequential_rule(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice("abcd"), rng.choice("wxyz")) for k in range(60)]
    ka, kb, want = set(), set(), {}
    for k, a, b in rows:
        want[k] = "duplicate_first" if a in ka else "duplicate_second" if b in kb else "kept"
        if want[k] == "kept":
            ka.add(a)
            kb.add(b)
    got = P.greedy_pairs(spark.createDataFrame(rows, "seq long, a string, b string"), "seq", "a", "b")
    assert {r.seq: r.verdict for r in got.collect()} == want


def test_chat_parsing(spark):
    assert tuple(one(spark, "x <USER>  hi\nyou <ASSISTANT> fine\n <END>", chat.parse)) == ("hi you", "fine")
    assert tuple(one(spark, "<USER> hi <ASSISTANT> fine", chat.parse)) == ("hi", "fine")
    assert one(spark, "<USER> hi <ASSISTANT>  <END>", chat.parse) is None
    assert tuple(one(spark, "<USER> hi <ASSISTANT> a <END> b <END>", chat.parse_strict)) == ("hi", "a <END> b")
    with pytest.raises(Exception, match="lacks a marker"):
        one(spark, "<ASSISTANT> a <USER> b <END>", chat.parse_strict)


def test_no_equal_neighbours(spark):
    rows = spark.createDataFrame([(x,) for x, n in (("a", 4), ("b", 3), ("c", 1)) for _ in range(n)], "item string")
    got = [r.item for r in M.apart(rows, "item").orderBy("place").collect()]
    assert len(got) == 8 and all(a != b for a, b in zip(got, got[1:], strict=False))
    assert got == [r.item for r in M.apart(rows, "item").orderBy("place").collect()]
    with pytest.raises(Exception, match="too many copies"):
        M.apart(spark.createDataFrame([("a",)] * 3 + [("b",)], "item string"), "item").collect()


def test_prefix_keeps_the_crossing_row(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "seq long, w long")
    assert [r.seq for r in M.prefix_until(df, "seq", "w", 6).orderBy("seq").collect()] == [1, 2]
    assert [r.seq for r in M.prefix_until(df, "seq", "w", 0).collect()] == [1]


def test_merges_and_encodings(spark):
    words = {"low": 5, "lower": 2, "newest": 6, "widest": 3}
    m = K.learn_merges(spark.createDataFrame(list(words.items()), "word string, n long"), 20)
    s = {w: [*w, "</w>"] for w in words}
    pairs, vocabulary = [], {c for x in s.values() for c in x}
    while len(vocabulary) < 20:
        count: dict = {}
        for w, x in s.items():
            for p in zip(x, x[1:], strict=False):
                count[p] = count.get(p, 0) + words[w]
        best = min(count, key=lambda p: (-count[p], p))
        pairs.append(best)
        vocabulary.add("".join(best))
        s = {w: K.joined(x, best) for w, x in s.items()}
    assert m.pairs == pairs and m.vocabulary == vocabulary
    assert {w: K.encode_word(w, m.rank) for w in words} == s == {w: K.replay_word(w, m.pairs) for w in words}
    assert K.joined(["a", "a", "a"], ("a", "a")) == ["aa", "a"] and K.joined(list("aaaa"), ("a", "a")) == ["aa", "aa"]


@pytest.mark.parametrize(
    ("tokens", "text"),
    [(["Th", "is</w>", "is</w>"], "This is"), (["B-tree", "and</w>", "x</w>"], "B-tree and x"), (["hi</w>", ",</w>", "you</w>", ".</w>"], "hi, you."), (["camel", "Case</w>"], "camel Case"), ([], "")],
)
def test_decoding(spark, tokens, text):
    assert one(spark, tokens, K.decode_tokens, "array<string>") == text


def test_answers(spark):
    row = spark.createDataFrame([("the index makes a lookup fast", "An index makes lookups fast", ["index", "lookup fast", "tree"])], "generated string, reference string, keywords array<string>")
    r = E.score_answers(row).first()
    assert list(r.matched) == ["index", "lookup fast"] and not r.repetition and not r.empty and r.length_sane and abs(r.overlap - 2 * 3 / 11) < 1e-9



def test_suspicious_words_and_trailing(spark):
    assert one(spark, "sql xkcdwrt looong a1b fine strengths", lambda c: E.suspicious_words(c)) == ["xkcdwrt", "looong", "a1b"]


def test_even_stride_rounds_halves_to_even(spark):
    df = spark.createDataFrame([("g", k) for k in range(10)], "g string, seq long")
    want = [round(i * 9 / 4) for i in range(5)]
    assert [r.seq for r in P.take_evenly(df, "g", "seq", {"g": 5}).orderBy("seq").collect()] == want
    assert P.quotas(10, ("a", "b", "c", "d")) == {"a": 3, "b": 3, "c": 2, "d": 2}


def test_stream_equals_table(spark, tmp_path):
    from lexloom.streaming import events as S

    path = "/root/testdata/sf0.001/events.parquet"
    table = spark.read.parquet(path)
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    got = S.run_available(spark, str(tmp_path / "in"), table, lambda df: S.tumbling(df, "6 hours"), str(tmp_path / "out"))
    key = lambda r: tuple(r)
    assert sorted(map(key, got.collect())) == sorted(map(key, S.tumbling(table, "6 hours").collect()))


def test_loss_rows_pad_and_weigh(spark):
    df = spark.createDataFrame([(1, [5, 91, 6, 7, 92]), (2, [5, 6])], "k long, ids array<int>")
    r = M.loss_rows(df, "ids", 6, [91], [92]).collect()
    assert len(r) == 1 and r[0].x == [5, 91, 6, 7, 92, 0] and r[0].y == [91, 6, 7, 92, 0, 0] and r[0].w == [0.0, 8.0, 1.0, 2.0, 0.0, 0.0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "seq long, text string")
    assert C.quality_gate(none).count() == 0 and C.keep_first(none, "text", "seq").count() == 0
    assert M.prefix_until(none, "seq", F.length("text"), 5).count() == 0
