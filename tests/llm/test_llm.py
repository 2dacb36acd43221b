"""The ten operators on small tables: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns,
and agreement with brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import ann, bpe, components, decontaminate, fm_index, labelled, ngram_join, pii, quality, secrets, toxicity, url_filter, warc
from lexloom.llm.common import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Documents with columns that clash with the operators' own names."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    for c in ("id", "score", "spans", "key", "tile", "n", "fp", "real", "base", "label", "items"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "no id at all here"), (5, "Ünï ß \U0001f600 日本 " * 3)]

# -- op1


def test_secrets_base_and_redaction(spark):
    key = "AKIA" + "Q7" * 9
    text = f'x token = "abcdef12" PASSWORD:short1 pass\napi_key:: no {key} deadbeef{"0" * 20} end'
    rows = {r.id: r.spans for r in secrets.find_secrets(docs(spark, [(10, text), *ODD])).collect()}
    kinds = [(s.kind, text[s.start : s.end]) for s in rows[10]]
    assert ("assign", 'token = "abcdef12') in kinds and ("access", key) in kinds and ("hex", "deadbeef" + "0" * 20) in kinds and ("assign", "PASSWORD:short1") in kinds
    assert all(not rows[i] for i in (1, 2, 3, 4, None, 5))
    out = {r.doc_id: r for r in secrets.redact_secrets(docs(spark, [(10, text), (11, "clean"), (12, None)])).collect()}
    assert "abcdef12" not in out[10].text and out[10].n_chars == len(out[10].text) and out[11].text == "clean" and out[12].text is None
    assert secrets.find_secrets(docs(spark, [])).count() == 0


def test_secret_novelty_reports_incompressible_strings():
    random.seed(1)
    coded = "".join(random.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40))
    assert [s["kind"] for s in secrets.scan(f"Authorization bearer {coded} sent")] == ["novel"]
    assert secrets.scan(f"plain words {coded} nothing around") == []
    assert secrets.scan("private key " + "zyxwvuts987" * 9 + " zyxwvuts987zyxwvuts987") == []
    long = "key " * 50_000 + "x" * 200_000
    assert secrets.scan(long) == []


def test_secrets_of_any_characters_and_no_words():
    rng = random.Random(12)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789"):
        for n in (16, 20, 23, 40):
            key = "".join(rng.choice(letters) for _ in range(n))
            assert any(key == f"session cookie {key} sent"[s["start"] : s["end"]] for s in secrets.scan(f"session cookie {key} sent")), key
    words = "src/main/java/org/example/service/UserService authentication_token_provider Geschwindigkeitsbegrenzung anticonstitutionnellement internationalization SESSION_COOKIE_SAMESITE ------------------------"
    assert all(secrets.scan(f"session cookie {w} was sent") == [] for w in words.split())


def test_secrets_of_small_alphabets_and_repeated_keys():
    rng = random.Random(13)
    for letters, n in (("0123456789ABCDEF", 96), ("0123456789ABCDEF", 128), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 256), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 512)):
        key = "".join(rng.choice(letters) for _ in range(n))
        text = f"session cookie {key} sent"
        assert [text[s["start"] : s["end"]] for s in secrets.scan(text)] == [key]
    key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40))
    text = f"Authorization bearer {key} sent, and once more: bearer {key} sent"
    assert [text[s["start"] : s["end"]] for s in secrets.scan(text)] == [key, key]


# -- op2


def brute_components(rows, words=5, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_components(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(ngram_join, "HOT_FROM", 3)
        monkeypatch.setattr(ngram_join, "SMALL", 3)
        monkeypatch.setattr(ngram_join, "TILE_ROWS", 5)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 90))] for _ in range(4)]
    rows = [(1, None), (2, ""), (3, "  "), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "é " * 9000)]
    for k in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((10 + k, " ".join(w)))
    rng.shuffle(rows)
    got = ngram_join.jaccard_components(docs(spark, [*rows, (None, "one two")]).repartition(3)).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got if r.id is not None} == brute_components(rows)
    assert [r.component_id for r in got if r.id is None] == [None]


def test_parts_of_a_dealt_shingle_meet(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_FROM", 8)
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 1)
    rng = random.Random(9)
    cut, notice = ngram_join.Shingler(), ["license"] * 4
    while len(notice) < 12:  # shingles of small hashes, so that all are counted as frequent
        word = f"l{rng.randrange(10_000)}"
        if cut(" ".join([*notice[-4:], word]))[0] < 1 << 62:
            notice.append(word)
    notice = " ".join(notice)
    rows = [(100 + k, " ".join(f"w{rng.randrange(10_000)}" for _ in range(30)) + " " + notice) for k in range(300)]
    # two of these share all but one shingle, and in their prefixes only one of the notice
    rows += [(k, f"{notice} end{k}") for k in range(8)]
    hot = ngram_join._frequent(docs(spark, rows).select(F.col("doc_id").alias("id"), "text"), 5, ngram_join.Size(4, 8))
    assert (ngram_join._parts(hot[1]) > 0).sum() == 8
    got = ngram_join.jaccard_components(docs(spark, rows).repartition(3)).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_keep_one_and_empty_table(spark):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (2, None), (5, ""), (9, "other words stand here in this row")]
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs(spark, rows)).collect()) == [1, 2, 5, 9]
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0


def test_shingler_stretches():
    cut = ngram_join.Shingler()
    text = "alpha beta\tgamma " * 40_000 + "x" * 600_000 + " omega"
    assert len(cut.words(text)) == 120_002 and len(cut("A b c d e")) == 1 and (cut("A b c d e") == cut("a B c d e")).all()


def test_components_of_chains_and_cycles(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(200, 100), (100, 300), (300, 200), (7, 7)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(edges, "u long, v long"), shared_dir(spark), "t").collect()}
    assert all(got[k] == 1 for k in range(1, 61)) and got[100] == got[200] == got[300] == 100


# -- op3, op6


def test_isotonic_rises():
    at, value = labelled.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([1.0, 0.0, 1.0, 0.0]))
    assert (np.diff(at) > 0).all() and (np.diff(value) >= 0).all()


def test_quality_on_its_held_out_fold(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = quality.classify_quality(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect()
    held = [(r.passes, truth[r.id]) for r in got if r.held_out and r.id in truth]
    assert all((zlib.crc32(str(r.id).encode()) % 5 == 0) == r.held_out for r in got)
    assert sum(p == bool(q) for p, q in held) >= 0.93 * len(held) and all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("rows", [[], ODD])
def test_classifiers_without_much_to_learn(spark, rows):
    table = docs(spark, rows)
    for labels in ([], [(4, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, None)], [(4, 1, 1)]):
        lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        assert quality.classify_quality(table, lab).count() == len(rows)
        assert toxicity.classify_toxicity(table, lab).count() == len(rows)


def test_toxicity_learns_and_ignores_group_mentions(spark):
    rng = random.Random(2)
    plain = ["the", "river", "walks", "slowly", "under", "old", "trees", "and", "stones"]
    rows, labels = [], []
    for k in range(400):
        w = [rng.choice(plain) for _ in range(12)]
        bad = k % 4 == 0
        if bad:
            w[3] = rng.choice(["grumbolt", "grumboltish", "snarfex"])
            w[5] = "women" if k % 8 == 0 else w[5]
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(bad)))
    tests = [(1001, "the women walks under trees and stones"), (1002, "the river grumbolten and snarfex walks"), (1003, "")]
    got = {r.id: r for r in toxicity.classify_toxicity(docs(spark, rows + tests), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    wrong = [i for i, _, t in labels if got[i].held_out and got[i].toxic != bool(t)]
    assert not wrong and not got[1001].toxic and got[1002].toxic and not got[1003].toxic


# -- op4


def test_nearest_is_exact_on_few_and_good_on_many(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 16)) * rng.uniform(0.5, 2, (900, 1))
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(900)] + [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [1.0, None], 0), (None, [1.0] * 16, 0), (2080, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("clash"))
    got = defaultdict(list)
    for r in ann.nearest(df).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    x = x.astype(np.float32).astype(float)
    hits = []
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = set(np.lexsort((np.arange(900), -s))[:20].tolist())
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21)) and all(abs(s[i] - v) < 1e-9 for _, i, v in own)
        hits.append(len(want & {i for _, i, _ in own}) / 20)
    assert set(got) == set(range(0, 900, 20)) and np.mean(hits) >= 0.9
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [-1.0, 0.0])], "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 3), (0, 7), (0, 9)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_nearest_behind_repeated_ids(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [9.0, k / 100]) for k in range(60)] + [(k, [8.0 - k / 10, 1.0]) for k in range(2, 19)] + [(k, [0.5, float(k)]) for k in range(21, 40)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0] == [*range(1, 19), 21, 22]


# -- op5


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "x"), (2, None, None), (3, "u", ""), (4, "u", "x"), (5, "u\r\nX: 1", "é" * 1_500_000), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (7, "u", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("type", F.lit("clash")).withColumn("key", F.lit("clash"))
    groups = defaultdict(list)
    for i, _, h in pages:
        groups[h or ""].append(i)
    want = {}
    for h, ids in groups.items():
        b = h.encode()
        for i in ids:
            want[i] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == max(ids) else "revisit", None if i == max(ids) else max(ids))
    assert {r.id: (r.payload_bytes, r.digest, r.type, r.refers_to) for r in warc.round_trip(df).collect()} == want
    manifest = warc.write_archives(df, shared_dir(spark))
    chunks = warc.read_archives(spark, manifest, chunk=1 << 16).where("id = 5").orderBy("chunk").collect()
    assert len(chunks) == 46 and b"".join(c.bytes for c in chunks) == ("é" * 1_500_000).encode() and [c.digest is None for c in chunks].count(False) == 1
    assert warc.round_trip(df.limit(0)).count() == 0


# -- op7


def test_bpe_is_the_library_and_streams():
    from tokenizers import Tokenizer

    t, library = bpe.transducer(), Tokenizer.from_file(bpe.TOKENIZER)
    rng = random.Random(8)
    letters = "abcdeéßñ ÜAZ 019'²½٣ \u0085 \x1c　\t\n\r.,!$%_-—日本ก็\U0001f600‍́Ⅷ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 20))) for _ in range(3000)] + ["", "<|endoftext|>a<|endoftext|>", "a" * 4000, " " * 3000, "ab" * 2000, "é" * 1500]
    for x in texts:
        ids = library.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(t.encode(x), "<u4").tolist() == ids
        assert "".join(t.decode(t.encode(x))) == library.decode(ids, skip_special_tokens=False)
    piece = ("hello" * 3000).encode()
    out, seen = [], []

    def chunks():
        for k in range(0, len(piece), 500):
            seen.append(len(out))
            yield piece[k : k + 500]

    for token in t.stream(chunks()):
        out.append(token)
    assert seen[-1] > 0.8 * len(out), "tokens come while the piece still does"


def test_bpe_tables(spark):
    coded = bpe.encode_documents(docs(spark, ODD))
    back = bpe.decode_documents(coded)
    assert sorted(((r.id or -1), r.text) for r in back.collect()) == sorted(((i or -1), t or "") for i, t in ODD)
    assert bpe.encode_documents(docs(spark, [])).count() == 0


# -- op8


def test_fm_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(0)
    for _ in range(25):
        seq = rng.integers(0, 4, rng.integers(1, 200))
        seq[-1] = 0
        index = fm_index.FMIndex(seq, sample=4)
        phrases = rng.integers(1, 5, (8, int(rng.integers(1, 4))))
        for p, lo, hi in zip(phrases, *index.search(phrases), strict=True):
            want = [i for i in range(len(seq) - len(p) + 1) if (seq[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


@pytest.mark.parametrize("block", [1 << 24, 60])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    rng = random.Random(1)
    items = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([2, 9, 10, 14])))) for k in range(8)] + [(20, None), (21, "..!"), (None, "a b c"), (3, "A a A a A a A a A a A a")]
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(60)) + ", " + (items[k % 8][1] or "") + " z") for k in range(30)] + [(90, None), (91, ""), (92, "ß é " * 20), (93, "a, b " * 3000)]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t or ""))
        k = min(10, len(w))
        for j in range(len(w) - k + 1) if w and i is not None else ():
            windows[tuple(w[j : j + k])].add(i)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.find_contamination(docs(spark, rows), bench).collect():
        w = word.findall(lower(dict(rows)[r.id] or ""))
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if own := windows.get(tuple(w[j : j + k])):
                    hit.update(range(j, j + k))
                    found |= own
        assert (r.n_words, {x for s in r.spans for x in range(s.start, s.end)}, r["items"]) == (len(w), hit, sorted(found))
    clean = decontaminate.remove_contamination(docs(spark, [(1, "keep this text, all of it"), (2, "x y " + items[0][1] + " end."), (3, items[0][1])]), spark.createDataFrame(items[:1], "item_id long, text string"))
    got = {r.doc_id: r.text for r in clean.collect()}
    assert got[1] == "keep this text, all of it" and got[2].startswith("x y") and items[0][1] not in got[2] and 3 not in got
    assert decontaminate.find_contamination(docs(spark, []), bench).count() == 0
    assert decontaminate.find_contamination(docs(spark, rows), bench.limit(0)).where("size(spans) > 0").count() == 0


# -- op9

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t):
    digits = lambda s: [c for c in s if c in "0123456789"]

    def luhn(s):
        d = [int(c) for c in reversed(digits(s))]
        return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(t)] + [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(m[0])]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def test_pii_base_is_the_patterns():
    rng = random.Random(6)
    for _ in range(20_000):
        t = "".join(rng.choice(["1", "2", "42", "255", "256", "0", ".", ".", "-", " ", "+", "(", ")", "a", "b@", "@", ".c", "x.y", "\n", "é"]) for _ in range(rng.randint(1, 40)))
        assert [(k, s, e) for s, e, k in pii.base_spans(t)] == brute_pii(t)
    pii.base_spans("9" * 100_000 + "a" * 100_000 + "@" * 1000 + "+1" * 20_000)


def test_pii_terms_that_give_an_entity_away(spark):
    rng = random.Random(3)
    plain = ["river", "stone", "window", "garden", "letter", "morning", "paper", "bridge"]
    rows = [(k, " ".join(rng.choice(plain) for _ in range(20))) for k in range(200)]
    rows += [(300 + k, " ".join(rng.choice(plain) for _ in range(5)) + f" doctor Zanthorp ann@mail.example.com {rng.choice(plain)} " + " ".join(rng.choice(plain) for _ in range(6))) for k in range(6)]
    rows += [(400, "only zubble bob@mail.example.com once"), *ODD]
    got = {r.id: r for r in pii.find_pii(docs(spark, rows)).collect()}
    text = dict(rows)[300]
    assert {text[s.start : s.end] for s in got[300].terms} == {"doctor", "Zanthorp"} and not got[400].terms and len(got[400].base) == 1 and not got[0].terms
    assert pii.sanitise(text, [(s.start, s.end, "term") for s in got[300].terms] + [(s.start, s.end, s.kind) for s in got[300].base]).count("[WORD]") == 1
    assert pii.find_pii(docs(spark, [])).count() == 0


def test_pii_terms_far_from_their_entity(spark):
    rng = random.Random(4)
    plain = ["river", "stone", "window", "garden", "letter", "morning", "paper", "bridge"]
    words = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    rows = [(k, words(20)) for k in range(200)]
    rows += [(300 + k, f"Zanthorp {words(30)} 山田 {words(30)} Bo {words(30)} ann@mail.example.com, Zanthorp") for k in range(6)]
    rows += [(400, f"{words(9)} Zanthorp alone"), (401, f"{words(9)} zubble bob@mail.example.com once")]
    got = {r.id: r for r in pii.find_pii(docs(spark, rows)).collect()}
    for k in range(300, 306):
        assert [dict(rows)[k][s.start : s.end] for s in got[k].terms] == ["Zanthorp", "山田", "Bo", "Zanthorp"]
    assert [dict(rows)[400][s.start : s.end] for s in got[400].terms] == ["Zanthorp"] and not got[401].terms and not got[0].terms


# -- op10


def test_urls(spark):
    cases = {
        1: ("http://www.Example.com/en/7?x", "www.example.com", "/en/7", "example.com/en/7", "allow"), 2: ("https://a.b.com/en/9#t", "a.b.com", "/en/9", "com/en/", "block"),
        3: ("http://x.example.net/de/81", "x.example.net", "/de/81", "example.net/de/8", "block"), 4: ("http://other.net/de/8", "other.net", "/de/8", "net/de/", "allow"),
        5: ("http://org/es/", "org", "/es/", "org/es/", "block"), 6: ("http://notorg?/es/", "notorg", "", None, None), 7: (None, "", "", None, None), 8: ("no scheme/en/", "", "", None, None),
        9: ("http://free-bets.example.org/en/5", "free-bets.example.org", "/en/5", None, "block"), 10: ("https://ththre.example.org/en/5", "ththre.example.org", "/en/5", None, "allow"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "page_id long, url string").withColumn("host", F.lit("clash"))
    for r in url_filter.judge_urls(df).collect():
        _, host, path, rule, verdict = cases[r.id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert url_filter.judge_urls(df.limit(0)).count() == 0


# -- pipeline


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/documents.parquet")
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, d)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = shared_dir(spark)
        out.write.parquet(path)
        table = spark.read.parquet(path)
        counts.append(table.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100
    assert Counter(r.doc_id for r in table.collect()).most_common(1)[0][1] == 1
