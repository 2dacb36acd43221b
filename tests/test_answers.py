"""Answer checks, prompt transforms and reports on literal values."""

import json

import pytest
from pyspark.sql import functions as F

from lexloom.functions import answers as A
from lexloom.sources import reports


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn("v").alias("r")).first().r


CASES = [
    ("An SQL table", lambda c: A.domain_consistency(c, ("sql", "table", "row", "join")), 0.5), ("many models and a token", lambda c: A.topic_keywords(c, ("model", "token", "data")), ["model", "token"]),
    ("remodels", lambda c: A.topic_keywords(c, ("model",)), []), ("a primary key here", lambda c: A.contains_term(c, "primary key"), True), ("keys", lambda c: A.contains_term(c, "key"), False),
    ("it is is so", A.grammar_issue, True), ("it is so", A.grammar_issue, False), ("<USER> again", lambda c: A.boundary_ok(c, ()), False), ("Topic: x", lambda c: A.boundary_ok(c, ("topic:",)), False), ("fine", lambda c: A.boundary_ok(c, ("topic:",)), True),
    (" ", lambda c: A.clean_after_end(c, ()), True), ("x <assistant> y", lambda c: A.clean_after_end(c, ()), False), ("a b. It helps. c", lambda c: A.remove_phrases(c, ("It helps.",)), "a b. c"), ("One here. Two.", A.first_sentence, "One here."),
    ("alpha beta gamma", lambda c: A.phrase_position(c, F.lit("Beta")), 6), ("alpha beta gamma", lambda c: A.phrase_word_position(c, F.lit("beta gamma")), 1), ("alpha", lambda c: A.phrase_word_position(c, F.lit("x")), A.NOWHERE),
    ("The Index, fast!", lambda c: A.exact(c, F.lit("the index fast")), True), ("A b c d e f", lambda c: A.exact_start(c, F.lit("a B c d x")), True), ("A b", lambda c: A.exact_start(c, F.lit("a c")), False),
    ("indexes help lookups", lambda c: A.keyword_overlap(c, F.lit("the indexes and trees"), ("trees",)), 1.0), ("abc STOP rest", lambda c: A.until_stop(c, "STOP"), "abc"), ("One. Two. Thr", A.whole_sentences, "One. Two."),
    ("no end -", A.whole_sentences, "no end"), ("One. Two. Three.", lambda c: A.whole_sentences(c, most=2), "One. Two."), ("prompt and more", lambda c: A.after_prompt(c, F.lit("prompt")), " and more"), ("x", lambda c: A.with_hint(c, F.lit("Data bases"), {"data_bases": "DB: "}), "DB: x"),
    ("x", lambda c: A.with_hint(c, F.lit("big_data"), {}), "This text is about big data. x"), ("aabbb", A.trailing_run, 3),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_text_functions(spark, k):
    value, fn, want = CASES[k]
    assert one(spark, value, fn) == want


@pytest.mark.parametrize(("n", "want"), [(0, "zero"), (13, "thirteen"), (20, "twenty"), (42, "forty two"), (100, "100")])
def test_number_words(spark, n, want):
    assert one(spark, n, A.number_words, "int") == want


def test_padded_definition(spark):
    df = spark.createDataFrame([("A short one here.", "It lets many teams find their rows without a scan of all.")], "d string, i string")
    assert df.select(A.padded_definition("d", "i").alias("r")).first().r == "A short one here. It lets many teams find their rows without a scan of all."


def test_verdicts(spark):
    df = spark.createDataFrame([("An index finds rows fast without a scan",), ("a b c a b c index",)], "v string")
    got = df.select(A.verdicts("v", ("index",), ("politics",)).alias("x")).select("x.*").collect()
    assert got[0].passes and not got[1].no_loop and not got[1].passes


def test_top_k_and_block_size(spark):
    assert one(spark, [1.0, 3.0, 2.0], lambda c: A.top_k(c, 2), "array<double>") == [float("-inf"), 3.0, 2.0]
    assert spark.createDataFrame([([1] * 9,), ([1] * 5,)], "v array<int>").agg(A.block_size("v", 8).alias("b")).first().b == 4


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.123456), ("c", 2.0)], "k string, v double")
    assert reports.json_report(spark, str(tmp_path / "r"), part=df) == json.loads(reports.read_text(spark, str(tmp_path / "r"))) == {"part": [{"k": "a|b", "v": 0.123456}, {"k": "c", "v": 2.0}]}
    assert "| a\\|b | 0.1235 |" in reports.markdown(df, "T")
    runs = str(tmp_path / "runs")
    reports.archive_run(spark, runs, "one", {"m": 1})
    latest = reports.archive_run(spark, runs, "two", {"m": 3}).first()
    assert (latest.value, latest.run) == (3.0, "two")
    log = spark.createDataFrame([("x PASS 1/6",), ("FAIL and PASS 5 / 6",)], "value string")
    assert tuple(reports.log_counts(log).first()) == (2, 1, "5 / 6")
    assert reports.champion(df.withColumnRenamed("v", "routing"), 5.0).count() == 0
    run = lambda x: {"routing_accuracy": x}
    said = [reports.decide(*x) for x in ((None, 6, 6), ({}, 0, 0), (run(0.3), 0, 6), (run(0.2), 6, 6), (run(0.2), 5, 6), (run(0.2), 0, 0), (run(0.1), 6, 6), (run(0.09), 6, 6), ({"other": 1}, 1, 1))]
    assert said == ["missing", "missing", "promote", "extend", "continue", "continue", "extend", "retrain", "retrain"]
