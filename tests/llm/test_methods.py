"""Brute-force versions of operators and stages, what each method adds, and odd rows through every stage."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import ann, bpe, common, decontaminate, labelled, ngram_join, pii, quality, queries, secrets, toxicity, url_filter, warc

from .test_llm import DOCS, ODD, brute_components, brute_pii, docs, lower

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


# -- batches


def test_batches_are_bounded_whatever_the_session_says(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def sizes(batches):
        for b in batches:
            yield {"n": [len(b["id"])], "size": [b["text"].nbytes]}

    rows = docs(spark, [(k, "x" * 100_000) for k in range(300)] + [(k, "y") for k in range(3000)]).coalesce(1)
    frame = common.map_batches(common.text_id(rows, "doc_id", "text"), sizes, "n long, size long")
    scan = secrets.find_secrets(rows)
    url_filter.judge_urls(spark.createDataFrame([(1, "http://a.test/")], "page_id long, url string")).collect()
    got = frame.collect()
    assert max(r.n for r in got) <= common.BATCH_ROWS and max(r.size for r in got) <= common.BATCH_BYTES and sum(r.n for r in got) == scan.count() == 3300
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


# -- op1

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_secrets(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_query_is_the_patterns_and_adds_spans(spark, tmp_path):
    rng = random.Random(21)
    parts = ["Token", "API_KEY", "apikey", "password", "passwd", "secreT", '"', "'", " ", ":", "=", "abc", "A1b2C3", "AKIA", "AKIAQ7", "Z9" * 9, "0123456789abcdef", "deadbeef", "\n", "é", "ſecret", "ı", "-", "."]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for k in range(600)] + ODD
    key = "".join(rng.choice(LETTERS) for _ in range(40))
    rows.append((9000, f"Authorization: Bearer {key} was sent"))
    got = queries.op1_secrets(spark, write(spark, tmp_path, documents=docs(spark, rows))).collect()
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(t or "")
    for r in got:
        base = [brute_secrets(t) for t in want[r.doc_id]]
        digests = {hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in b).encode()).hexdigest(): b for b in base}
        b = digests[r.base_sha256]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in b) for k in range(3))
        assert [x for x in r.spans.split(",") if x and not x.startswith("novel")] == [f"{k}:{s}:{e}" for s, _, e, k in b]
    assert [r.spans for r in got if r.doc_id == 9000] == ["novel:22:62"] and len(got) == len(rows)


# -- op2


def test_join_bitmaps_of_dense_sets(monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST_BITS", 256)
    rng = np.random.default_rng(1)
    for n in (10, 100, 1000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(0.95 * len(a))], rng.integers(0, 1 << 63, max(1, n // 40)).astype(np.uint64)]))
        p, q = (np.frombuffer(ngram_join.signature(x), np.uint64) for x in (a, b))
        size = min(len(p), len(q))
        p, q = ngram_join.fold(p, size), ngram_join.fold(q, size)
        bound = ngram_join.may_link(len(a), len(b), int(np.bitwise_count(p & ~q).sum()), int(np.bitwise_count(q & ~p).sum()))
        assert len(p) <= 4 and (bound or not ngram_join.linked(a, b))


def test_join_in_many_parts_and_cross_tiles(spark, monkeypatch):
    for name, value in (("HOT_FROM", 3), ("SMALL", 2), ("TILE_ROWS", 4), ("CROSS_ROWS", 2), ("PART_BYTES", 500)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(31)
    base = [[f"w{rng.randrange(40)}" for _ in range(40)] for _ in range(3)]
    rows = []
    for k in range(70):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"w{rng.randrange(40)}"
        rows.append((k, " ".join(w)))
    assert ngram_join.Size.of(common.text_id(docs(spark, rows), "doc_id", "text")).parts > 4
    got = ngram_join.jaccard_components(docs(spark, rows).repartition(3)).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


# -- op3


def test_quality_is_ridge_on_fourier_features_with_isotonic_scores(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "under", "old", "trees,", "and"]) for _ in range(30)) + "."
    bad = lambda: "".join(rng.choice("#$%&*!! 0123") for _ in range(150))
    rows = [(k, good() if k % 3 else bad()) for k in range(300, 600)]
    lab = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300, 600)], "doc_id long, quality int, toxic int")
    folder = common.shared_dir(spark)
    model = quality.fit_quality(docs(spark, rows), lab, folder)
    train = labelled.training_texts(docs(spark, rows), lab, "quality", quality.FOLDS, quality.HELD_OUT, quality.statistics, f"{folder}/again").select("id", "y", "x", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(5)).alias("fifth")).collect()
    x, y = np.array([r.x for r in train if r.fifth]), np.array([float(r.y) for r in train if r.fifth])
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    p = np.hstack([np.sqrt(2 / quality.FEATURES) * np.cos(z @ model.frequency + model.phase), np.ones((len(z), 1))])
    ridge = np.diag(np.append(np.ones(quality.FEATURES), 0)) * quality.RIDGE * len(y) / quality.FEATURES + 1e-9 * np.eye(quality.FEATURES + 1)
    assert np.allclose(p @ np.linalg.solve(p.T @ p + ridge, p.T @ y), p @ model.weight, atol=1e-5)
    # nearby points have the kernel's value as the product of their features
    width = np.sqrt(((model.frequency) ** 2).mean()) ** -1
    many = quality.QualityModel(model.mean, model.scale, np.random.default_rng(0).standard_normal((x.shape[1], 20_000)) / width, np.random.default_rng(1).uniform(0, 2 * np.pi, 20_000), np.zeros(1), np.zeros(1), np.zeros(1))
    f = many.features(x[:20])[:, :-1]
    assert np.abs(f @ f.T - np.exp(-((z[:20, None] - z[None, :20]) ** 2).sum(2) / (2 * width**2))).max() < 0.06
    scores = {r.id: r.score for r in quality.score_quality(docs(spark, [*rows, (9001, "x " * 400_000), *ODD]), model).collect()}
    order = np.argsort(model.raw(np.array([quality.statistics(t) for _, t in rows])), kind="stable")
    assert (np.diff(np.array([scores[rows[i][0]] for i in order])) >= -1e-9).all() and 0 <= scores[9001] <= 1
    assert np.mean([(scores[k] >= 0.3) == (k % 3 > 0) for k in range(300, 600)]) > 0.97


# -- op4


def test_longest_prefixes_and_ascent_are_those_of_a_scan():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 12))
    x /= np.sqrt((x**2).sum(1)).max()
    x[50:90] = x[7]  # copies share whole strings
    forest = ann.Forest(x, trees=9)
    own = np.empty((9, 400), np.uint64)
    for t in range(9):
        own[t, forest.order[t]] = forest.sorted[t]
    q = np.vstack([x[7], rng.standard_normal((20, 12))])
    q /= np.sqrt((q**2).sum(1))[:, None]
    strings = forest._strings(np.hstack([q, np.zeros((len(q), 1))])).astype(np.uint64)
    shared = np.array([[[32 - int(a ^ s).bit_length() for a in own[t]] for s in strings[t]] for t in range(9)])
    assert (forest.longest(strings.astype(np.uint32)) == shared.max(2)).all()
    for want in (1, 30, 150, 400):
        for i, found in enumerate(forest.search(q, want)):
            level = max(d for d in range(33) if (shared[:, i] >= d).any(0).sum() >= want)
            assert found.tolist() == np.flatnonzero((shared[:, i] >= level).any(0)).tolist()


def test_nearest_of_mixed_lengths_ties_and_all_candidates(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 64)
    monkeypatch.setattr(ann, "BLOCK", 4)
    rng = np.random.default_rng(6)
    vectors = {k: rng.integers(-3, 4, 6 if k % 3 else 5).astype(float).tolist() for k in range(400)} | {k: [1e200] * 6 for k in (1000, 1001)}
    rows = [*vectors.items(), (7, vectors[8]), (20, vectors[20])]
    good = defaultdict(list)
    for k, v in rows:
        if any(v):
            good[k].append(np.array(v))
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), factor=float("inf")).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    for q in (k for k in good if k % 20 == 0):
        best = {k: max((float((a * b).sum()) for a in good[q] for b in vs if len(a) == len(b)), default=None) for k, vs in good.items() if k != q}
        want = sorted(((-s, k) for k, s in best.items() if s is not None))[:20]
        assert sorted(got[q]) == [(n, k, -s) for n, (s, k) in enumerate(want, 1)]


# -- op5


def test_warc_rows_are_bounded_and_odd_pages_pass(spark):
    pages = [(1, "u", "x" * 70_000), (1, "u", "x" * 70_000), (1, "v", "other"), (None, "u", "only here"), (None, None, "x" * 70_000), (2, "u", ""), (3, "u", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("bytes", F.lit("clash"))
    typed = warc.with_types(df, page_id="page_id", html="html", url="url", least=0)
    rows = warc.chunk_rows(typed, 1 << 14).collect()
    assert max(len(r.bytes) for r in rows if r.bytes is not None) <= 1 << 14 and sum(len(r.bytes or b"") for r in rows) == 2 * 70_000 + len("otheronly here")
    got = sorted((r.id or -1, r.payload_bytes, r.type, r.refers_to or 0) for r in warc.round_trip(df).collect())
    assert got == sorted([(1, 70_000, "response", 0), (1, 70_000, "response", 0), (1, 5, "response", 0), (-1, 9, "response", 0), (-1, 70_000, "revisit", 1), (2, 0, "revisit", 3), (3, 0, "response", 0)])


def test_warc_refuses_chunks_that_dont_agree():
    import io

    w = warc.RecordWriter(io.BytesIO(), "response", 1, "u", 3, warc.digest_text(hashlib.sha1(b"abc").digest()), None)
    w.add(b"abd")
    with pytest.raises(ValueError, match="agree"):
        w.close()
    assert warc._open_fs("file:/tmp/x")[1] == "/tmp/x" and warc._open_fs("dbfs:/mnt/x")[1] == "/dbfs/mnt/x" and warc._open_fs("/tmp/y")[1] == "/tmp/y"


# -- op6


def test_swaps_lower_false_positives_on_neutral_mentions(spark):
    rng = random.Random(5)
    plain = ["the", "river", "walks", "slowly", "under", "bridge", "and", "stones", "light", "garden", "paper", "letter"]
    terms = ["muslim", "immigrants", "gay", "women"]
    rows, labels = [], []
    for k in range(800):
        w = [rng.choice(plain) for _ in range(10)]
        bad = k % 4 == 0
        if bad:
            w[2] = rng.choice(["grumbolt", "snarfex", "plodnik"]) if rng.random() < 0.8 else w[2]
        if rng.random() < (0.8 if bad else 0.02):
            w[5] = rng.choice(terms)
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(bad)))
    neutral = [(5000 + k, " ".join([rng.choice(plain) for _ in range(6)] + [terms[k % 4]])) for k in range(100)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    wrong = {}
    for swap in (0.0, toxicity.SWAP):
        got = {r.id: r for r in toxicity.classify_toxicity(docs(spark, rows + neutral), lab, swap=swap).collect()}
        wrong[swap] = sum(got[i].toxic for i, _ in neutral)
        assert all(got[i].toxic for i, t in rows if re.search("grumbolt|snarfex|plodnik", t))
    assert wrong[0.0] >= 90 and wrong[toxicity.SWAP] <= 5


def test_toxicity_scores_are_sums_of_part_weights(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["calm", "river", "stone", "brisk"]) for _ in range(8)) + (" zorgle" if k % 3 == 0 else "")) for k in range(300, 600)]
    lab = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(300, 600)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs(spark, rows), lab, common.shared_dir(spark))
    extra = [(900, "zorgle " * 200_000), *ODD]
    for r in toxicity.classify_toxicity(docs(spark, rows + extra), lab).collect():
        texts = [t for i, t in rows + extra if i == r.id]
        want = [1 / (1 + np.exp(-(model.bias + sum(model.weight.get(p, 0.0) for w in set(re.findall(r"[^\W\d_]+", (t or "").lower())) for p in toxicity.parts(w))))) for t in texts]
        assert min(abs(r.score - w) for w in want) < 1e-6


# -- op7


def test_bpe_windows_and_long_texts(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "WINDOW", 50)
    monkeypatch.setattr(bpe, "GAP", 10)
    monkeypatch.setattr(bpe, "CHUNK", 64)
    t, library = bpe.transducer(), Tokenizer.from_file(bpe.TOKENIZER)
    rng = random.Random(9)
    letters = "abcde ÜZ 19'½ \u0085 \x1c　\t\n.,!$_-—日\U0001f600  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(800)] + ["a<|endoftext|>b " * 20, "x" * 3000 + " " + "y z " * 40, "no_gap." * 90]
    for x in texts:
        assert np.frombuffer(t.encode(x), "<u4").tolist() == library.encode(x, add_special_tokens=False).ids
        assert max((len(p) for p in t.parts(x)), default=0) <= 4 * 300
    got = bpe.encode_documents(docs(spark, [*enumerate(texts[:50]), *ODD]), with_digests=True).collect()
    assert len(got) == 50 + len(ODD)
    for r in got:
        sources = [x for k, x in [*enumerate(texts[:50]), *ODD] if k == r.id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()) for x in sources for i in [t.encode(x or "")]]


def test_bpe_refuses_other_vocabulary_files(tmp_path):
    import json

    spec = json.load(open(bpe.TOKENIZER))
    path = tmp_path / "other.json"
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="vocabulary file"):
            bpe.Transducer(str(path))


# -- op9


def test_sanitised_documents(spark):
    rng = random.Random(14)
    words = lambda n: " ".join(rng.choice(["river", "stone", "window", "garden", "letter"]) for _ in range(n))
    rows = [(k, words(20)) for k in range(100)] + [(300 + k, f"Zanthorp {words(30)} quibbler {words(9)} ann@mail.example.com, call +49 30 1234567") for k in range(6)] + ODD
    out = pii.sanitise_documents(docs(spark, rows))
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == COLUMNS and got[5].text == ODD[-1][1] and got[1].text is None and got[0].text == rows[0][1]
    for k in range(300, 306):
        t = got[k].text
        assert t.startswith("[NAME]") and "[WORD]" in t and "[EMAIL], " in t and t.endswith("[PHONE]") and got[k].n_chars == len(t)
    assert pii.sanitise_documents(docs(spark, [])).count() == 0
    base = queries.op9_pii
    assert base is not None and brute_pii(rows[100][1])


# -- op10


def brute_verdict(host, path, rules):
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def test_url_query_is_rules_then_the_model(spark, tmp_path):
    rng = random.Random(15)
    hosts = ["example.com", "www.Example.com", "a.net", "example.net", "x.example.net", "ORG", "notorg", "com", ".com", "a..com", "", "casino-blue.test", "u:p@example.com:80"]
    paths = ["", "/", "/en/", "/en/7", "/en/71?x#y", "/de/8", "/de/", "/es/#t", "?q", "#f", "/en", "/DE/", "//en/", "/é" * 2000]
    urls = [rng.choice(["http://", "https://", "://", "http:/", ""]) + rng.choice(hosts) + rng.choice(paths) for _ in range(800)] + [None, "", "x" * 300_000, "a://b://c"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    weight, bias = url_filter.fit(url_filter.sample_table())
    for r in queries.op10_urls(spark, write(spark, tmp_path, pages=df)).collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        rule, verdict = brute_verdict(host, path, url_filter.RULES)
        if rule is None:
            f = url_filter.features(host, path)
            verdict = "block" if 1 / (1 + np.exp(-(sum(weight[k] for k in f) / np.sqrt(len(f) or 1) + bias))) >= 0.5 else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_url_model_on_held_out_rows_and_from_a_table(spark):
    table = url_filter.sample_table()
    held = [hashlib.sha256(u.encode()).digest()[0] % 4 == 0 for u, _ in table]
    weight, bias = url_filter.fit([x for x, h in zip(table, held, strict=True) if not h])
    guess = lambda u: weight[f].sum() / np.sqrt(len(f) or 1) + bias >= 0 if len(f := url_filter.features(*url_filter.split_url(u))) else False
    assert np.mean([guess(u) == bool(y) for (u, y), h in zip(table, held, strict=True) if h]) >= 0.85
    own = spark.createDataFrame([("http://good-page.test/", 0), ("http://zzbad.test/", 1), (None, 1), ("http://x.test/", None)] * 5, "url string, label int")
    got = url_filter.judge_urls(spark.createDataFrame([(1, "http://zzbad.invalid/"), (2, "http://good-page.invalid/")], "page_id long, url string"), own).collect()
    assert {r.id: r.verdict for r in got} == {1: "block", 2: "allow"}
    assert url_filter.judge_urls(spark.createDataFrame([(1, None)], "page_id long, url string"), []).collect()[0].score == 0.5


# -- pipeline

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    lab = spark.createDataFrame([(4, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "ten words of an item that is held in benchmark tables"), (2, None)], "item_id long, text string")
    return write(spark, tmp_path_factory.mktemp("odd"), labels=lab, benchmark=bench)


@pytest.mark.parametrize("name", STAGE)
def test_stages_on_odd_rows(spark, folder, name):
    rows = [*ODD, (7, None), (8, "x " * 300_000), (9, "y" * 300_000), (10, "plain text of a row"), (10, "plain text of a row")]
    for table in (rows, []):
        out = STAGE[name](spark, docs(spark, table), folder)
        got = out.collect()
        last = name == corpus_pipeline.STAGES[-1][0]
        assert out.columns == (["doc_id", "n_tokens", "ids"] if last else COLUMNS)
        if name != "quality classifier":  # with two labelled rows, all or none go there
            gone = {6} & {r.doc_id for r in got} if table else set()
            assert len(got) == len(table) and not gone
        if not last:
            assert all(r.n_chars == len(r.text or "") for r in got)
    if name == "n-gram Jaccard join":
        assert sorted(r.doc_id or -1 for r in STAGE[name](spark, docs(spark, [(3, "a b c d e f"), (2, "A b c d e f"), (2, "a b c d e f"), (5, None)]), folder).collect()) == [2, 2, 5]


def test_stages_against_brute_force(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    # near duplicates
    want = {i: c for i, (n, c) in brute_components(rows).items() if n == 0 or i == c}
    assert sorted(r.doc_id for r in STAGE["n-gram Jaccard join"](spark, table, d).collect()) == sorted(want)
    # quality: the rows that the scores keep
    scores = {r.id: r.score for r in quality.classify_quality(table, spark.read.parquet(f"{d}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in STAGE["quality classifier"](spark, table, d).collect()) == sorted(i for i, s in scores.items() if s >= 0.3)
    # decontamination: no window is left, clean rows stay
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{d}/benchmark.parquet").collect():
        w = word.findall(lower(r.text or ""))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = sorted({len(x) for x in windows})

    def hits(t):
        w = word.findall(lower(t or ""))
        return {j for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(k, k + n)}, w

    out = {r.doc_id: r.text for r in STAGE["benchmark decontamination"](spark, table, d).collect()}
    for i, t in rows:
        hit, w = hits(t)
        if not hit:
            assert out[i] == t
        elif len(hit) == len(w):
            assert i not in out
        else:
            assert word.findall(lower(out[i])) == [x for k, x in enumerate(w) if k not in hit]
    # secrets: base matches are gone, rows without any span stay
    for r in STAGE["secret scans"](spark, table, d).collect():
        t = dict(rows)[r.doc_id]
        spans = brute_secrets(t or "")
        assert all(t[s:e] not in r.text for s, _, e, _ in spans) and (r.text == t or secrets.scan(t))
    # encoding
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.TOKENIZER)
    for r in STAGE["BPE encoding"](spark, table, d).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids) // 4


def test_decontamination_of_one_id_many_rows_stays_in_its_block(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")] * 50 + [(2, "delta epsilon")], "item_id long, text string")
    got = decontaminate.find_contamination(docs(spark, [(1, "so alpha beta gamma it is delta epsilon"), *ODD]), items).where("id = 1").collect()
    assert [(s.start, s.end) for s in got[0].spans] == [(1, 4), (6, 8)] and got[0]["items"] == [1, 2] and DOCS
