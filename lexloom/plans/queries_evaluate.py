"""Queries of scoring, contamination, routing, checkpoints and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import answers as A, lexicon as L, text as T
from ..functions.answers import domain_consistency
from ..operators import evaluate as E
from ..operators.learn import attended, train_net
from ..shared import shared_dir, stash
from .common import ascii_words, ngrams, one_line, table
from .queries_pairs import SQL_PAIRS, _pairs


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """A pair's response as the reference; the response, the question or both as the answer, in turn."""
    both = F.concat_ws(" ", "instruction", "response")
    p = _pairs(spark, d).withColumn("generated", F.when(F.col("seq") % 3 == 0, F.col("instruction")).when(F.col("seq") % 3 == 1, F.col("response")).otherwise(both))
    return p.withColumn("reference", F.col("response")).withColumn("keywords", E.expected_keywords(F.lit("erth/ion; de"), "response")).withColumn("bucket", F.concat(F.lit("b"), (F.col("conv_id") % 5).cast("string")))


_STOP = str(list(L.KEYWORD_STOPWORDS))
_ANSWERS = f"""(select *, array_to_string(gw, ' ') as gk from (select seq, domain, 'b' || (conv_id % 5) as bucket, case when seq % 3 = 0 then instruction when seq % 3 = 1 then response else instruction || ' ' || response end as generated, response as reference, {ascii_words("case when seq % 3 = 0 then instruction when seq % 3 = 1 then response else instruction || ' ' || response end")} as gw,
{ascii_words('response')} as rw from {SQL_PAIRS}))"""
_KEYWORDS = f"""(select k.* exclude (words), list_slice(list_concat(['erth', 'ion', 'de'], list_transform(list_sort(list_transform(map_entries(firsts), lambda e: [lpad(e.value::varchar, 6, '0'), e.key])), lambda x: x[2])), 1, 10) as keywords from
(select a.*, list_filter(rw, lambda w: length(w) >= 4 and not list_contains({_STOP}, w) and w not in ('erth', 'ion', 'de')) as words, map_from_entries(list_transform(list_distinct(list_filter(rw, lambda w: length(w) >= 4 and not list_contains({_STOP}, w) and w not in ('erth', 'ion', 'de'))), lambda w: (w, list_position(rw, w)))) as firsts from {_ANSWERS} a) k)"""


def expected_keywords(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("seq", F.array_join("keywords", ",").alias("keywords"))


_EXPECTED = f"select seq, array_to_string(keywords, ',') as keywords from {_KEYWORDS}"

_F1 = """case when len(gw) = 0 or len(rw) = 0 or c = 0 then 0.0 else 2 * (c / len(gw)) * (c / len(rw)) / ((c / len(gw)) + (c / len(rw))) end"""
_COMMON = "coalesce(list_sum(list_transform(list_distinct(list_intersect(gw, rw)), lambda w: least(len(list_filter(gw, lambda x: x = w)), len(list_filter(rw, lambda x: x = w))))), 0)"


def token_f1(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("seq", F.round(T.token_f1("generated", "reference"), 9).alias("f1"))


_TOKEN_F1 = f"select seq, round({_F1}, 9) as f1 from (select *, {_COMMON} as c from {_ANSWERS})"

_SCORED = f"""(select *, {L.SCORE_RECALL} * keyword_recall + {L.SCORE_OVERLAP} * overlap + {L.SCORE_SANE} * (length_sane and not empty and not repetition)::int + {L.SCORE_GROUNDED} * (1 - hallucination::int) as score from
(select *, empty or repetition or (overlap < 0.12 and len(gw) >= 8) as hallucination from
(select seq, domain, bucket, gw, matched / greatest(len(keywords), 1) as keyword_recall, {_F1} as overlap, len(gw) < 4 as empty, len(g) > len(list_distinct(g)) as repetition,
len(gw) >= 4 and len(gw) <= greatest(160, greatest(len(rw), 1) * 3) and len(gw) >= greatest(4, trunc(greatest(len(rw), 1) * 0.15::double)::int) as length_sane from
(select *, {_COMMON} as c, {ngrams('gw', 3)} as g, len(list_filter(keywords, lambda k: contains(' ' || gk || ' ', ' ' || k || ' '))) as matched from {_KEYWORDS}))))"""


def general_score(spark: SparkSession, d: str) -> DataFrame:
    s = E.score_answers(_answers(spark, d))
    return s.select("seq", F.round("keyword_recall", 6).alias("keyword_recall"), F.round("overlap", 6).alias("overlap"), "length_sane", "repetition", "empty", "hallucination", F.round("score", 6).alias("score"))


_GENERAL = f"select seq, round(keyword_recall, 6) as keyword_recall, round(overlap, 6) as overlap, length_sane, repetition, empty, hallucination, round(score, 6) as score from {_SCORED}"


def grouped_summary(spark: SparkSession, d: str) -> DataFrame:
    s = E.grouped_summary(E.score_answers(_answers(spark, d)), ("bucket", "domain"))
    return s.select(F.coalesce("bucket", F.lit("*")).alias("bucket"), F.coalesce("domain", F.lit("*")).alias("domain"), "count", *(F.round(c, 6).alias(c) for c in ("keyword_recall", "overlap", "length_sane_rate", "repetition_rate", "empty_rate", "hallucination_rate", "score")))


_SUMMARY = f"""select coalesce(bucket, '*') as bucket, coalesce(domain, '*') as domain, count(*) as count, round(avg(keyword_recall), 6) as keyword_recall, round(avg(overlap), 6) as overlap, round(avg(length_sane::int), 6) as length_sane_rate,
round(avg(repetition::int), 6) as repetition_rate, round(avg(empty::int), 6) as empty_rate, round(avg(hallucination::int), 6) as hallucination_rate, round(avg(score), 6) as score from {_SCORED} group by grouping sets ((), (bucket), (domain))"""


def heldout_split(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    return E.held_out(p, "domain", T.word_key("instruction"), "seq", 10, 42).groupBy("domain", "split").agg(F.count("*").alias("n"), F.sum("seq").alias("ids"))


_HELD = f"""with p as (select seq, domain, array_to_string({ascii_words('instruction')}, ' ') as k from {SQL_PAIRS}), f as (select domain, k, min(seq) as seq from p where k <> '' group by 1, 2),
e as (select *, row_number() over (partition by domain order by md5('42|' || seq)) as n from f), x as (select * from e where n <= 10)
select domain, split, count(*) as n, sum(seq)::bigint as ids from (select p.domain, p.seq, case when p.seq in (select seq from x) then 'eval' when p.k in (select k from x) then 'dropped' else 'train' end as split from p) group by 1, 2"""


def train_eval_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are no benchmark item, by their words."""
    items = table(spark, d, "benchmark").select(T.word_key("text").alias("k"))
    return table(spark, d, "documents").select("doc_id", T.word_key("text").alias("k")).join(items, "k", "left_anti").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


_WORD_KEY = lambda c: f"array_to_string({ascii_words(c)}, ' ')"
_ANTI = f"select count(*) as n, sum(doc_id)::bigint as ids from (select doc_id, {_WORD_KEY('text')} as k from documents) where k not in (select {_WORD_KEY('text')} from benchmark)"

_LINE = lambda c: one_line(f"lower({c})")


def exact_line_match(spark: SparkSession, d: str) -> DataFrame:
    out = E.lines(table(spark, d, "benchmark"), "item_id").select("item_id", F.col("key").alias("text"))
    return E.line_matches(out, E.lines(table(spark, d, "documents"), "doc_id"), "text").groupBy("item_id").agg(F.count("*").alias("n"))


_ALL = lambda t, i: f"(select {i}, {_LINE('l')} as key from (select {i}, unnest(string_split(text, chr(10))) as l from {t}) where length(regexp_replace(l, '^\\s+|\\s+$', '', 'g')) >= 20)"
_LINES = f"select item_id, count(*) as n from {_ALL('benchmark', 'item_id')} where key in (select key from {_ALL('documents', 'doc_id')}) group by 1"


def exact_paragraph_match(spark: SparkSession, d: str) -> DataFrame:
    """Outputs: all lines of benchmark items, short ones too; the corpus: documents' paragraphs."""
    b = E.lines(table(spark, d, "benchmark"), "item_id", least=1).select("item_id", F.col("key").alias("text")).distinct()
    return E.paragraph_matches(b, E.paragraphs(table(spark, d, "documents"), "doc_id"), "text").groupBy("item_id").agg(F.count("*").alias("n"))


_PARAGRAPHS = f"""with b as (select distinct item_id, {_LINE('l')} as key from (select item_id, unnest(string_split(text, chr(10))) as l from benchmark)), p as (select {_LINE('text')} as p from documents)
select item_id, count(*) as n from b where key <> '' and exists (select 1 from p where contains(p, key)) group by 1"""


def benchmark_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a whole benchmark item, on one line and folded."""
    b = table(spark, d, "benchmark").select("item_id", "text")
    docs = E.paragraphs(table(spark, d, "documents").select("doc_id", T.one_line("text").alias("text")), "doc_id")
    return E.paragraph_matches(b, docs, "text").select("item_id")


_OVERLAP = f"select item_id from benchmark where exists (select 1 from (select {_LINE('text')} as p from documents) where contains(p, {_LINE('benchmark.text')}))"


def nearest_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as outputs; the most similar line or paragraph of all documents for each."""
    return E.nearest_snippet(table(spark, d, "benchmark"), E.snippets(table(spark, d, "documents"), "doc_id"), "item_id", "text")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Lines of benchmark items as outputs of four models, in turn; what the corpus holds of them is measured."""
    out = E.lines(table(spark, d, "benchmark"), "item_id").distinct().select("item_id", F.col("key").alias("output"))
    docs = table(spark, d, "documents")
    inside = E.paragraph_matches(out, E.paragraphs(docs, "doc_id"), "output").withColumn("paragraph", F.lit(True))
    equal = E.line_matches(out, E.lines(docs, "doc_id"), "output").withColumn("line", F.lit(True))
    rows = out.join(inside, ["item_id", "output"], "left").join(equal, ["item_id", "output"], "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    grams = T.ngrams(T.words(F.lower("output"), "unicode"), 4)
    # an equal line is the nearest there can be; of other outputs nothing is claimed here
    near = F.when(F.col("line"), 1.0).otherwise(0.0).alias("nearest")
    return rows.select(F.concat(F.lit("m"), (F.col("item_id") % 4).cast("string")).alias("model"), F.length("output").alias("chars"), T.n_words("output", "unicode").alias("words"), T.repeated_share(grams, 0).alias("repetition"), flag("paragraph"), flag("line"), near, domain_consistency("output", CONSISTENT).alias("consistency"))


#: Words of our own that the invented texts are full of, as a domain's keywords.
CONSISTENT = ("the", "of", "de", "en")


def memorisation_risk(spark: SparkSession, d: str) -> DataFrame:
    return E.memorisation_risk(_samples(spark, d), "model").select("model", "n", F.round("paragraph_rate", 6).alias("paragraph_rate"), F.round("nearest", 6).alias("nearest"), "risk")


def memorisation_summary(spark: SparkSession, d: str) -> DataFrame:
    g = E.memorisation_summary(_samples(spark, d), "model")
    return g.select("model", "n", *(F.round(c, 6).alias(c) for c in ("avg_chars", "avg_words", "repetition", "paragraph_rate", "line_rate", "nearest", "consistency")), "risk")


_SAMPLES = f"""(with o as (select distinct item_id, key as output from {_ALL('benchmark', 'item_id')}), p as (select {_LINE('text')} as p from documents), l as (select distinct key from {_ALL('documents', 'doc_id')}),
w as (select *, regexp_extract_all(output, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') as w from o),
g as (select 'm' || (item_id % 4) as model, length(output) as chars, len(w) as words, {ngrams("w", 4)} as g, exists (select 1 from p where contains(p, output)) as paragraph, output in (select key from l) as line, {" + ".join(f"contains(output, '{k}')::int" for k in CONSISTENT)} as hits from w)
select model, chars, words, case when len(g) > 0 then (len(g) - len(list_distinct(g))) / len(g) else 0 end as repetition, paragraph, line, line::int::double as nearest, hits / {len(CONSISTENT)} as consistency from g)"""
_TIERS = f"""(select *, case when k >= 4 then 'high' when k >= 2 then 'moderate' else 'low' end as risk from (select *, case when paragraph_rate >= 0.34 then 2 when paragraph_rate > 0 then 1 else 0 end + (line_rate >= 0.34)::int + case when nearest >= 0.9 then 2 when nearest >= 0.8 then 1 else 0 end + (repetition >= 0.2)::int as k
from (select model, count(*) as n, avg(chars) as avg_chars, avg(words) as avg_words, avg(repetition) as repetition, avg(paragraph::int) as paragraph_rate, avg(line::int) as line_rate, avg(nearest) as nearest, avg(consistency) as consistency from {_SAMPLES} group by 1)))"""
_RISK = f"select model, n, round(paragraph_rate, 6) as paragraph_rate, round(nearest, 6) as nearest, risk from {_TIERS}"
_MEANS = f"select model, n, {', '.join(f'round({c}, 6) as {c}' for c in ('avg_chars', 'avg_words', 'repetition', 'paragraph_rate', 'line_rate', 'nearest', 'consistency'))}, risk from {_TIERS}"


def signature_predict(spark: SparkSession, d: str) -> DataFrame:
    """Sources as concepts with their first documents as answers; documents as answers to route."""
    docs = table(spark, d, "documents")
    known = E.signatures(docs.select(F.concat("source", F.lit("_"), "lang").alias("concept"), F.col("text").alias("answer"), F.col("doc_id").alias("s")), "s")
    return E.by_signature(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("answer")), known)


_SIGNATURE = f"""with w as (select doc_id as id, source || '_' || lang as concept, {ascii_words('text')} as w from documents), s as (select id, concept, array_to_string(w[1:1], ' ') as one, array_to_string(w[1:5], ' ') as five from w),
k as (select concept, arg_min(one, id) as one, arg_min(five, id) as five, min(id) as s from s group by 1), f as (select five, arg_min(concept, s) as c5 from k group by 1), o as (select one, min(concept) as c1 from k group by 1 having count(*) = 1)
select id, coalesce(c5, c1) as predicted from s left join f using (five) left join o using (one)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Pairs' answers with what was right of them: their first word, and all of it."""
    s = E.score_answers(_answers(spark, d))
    same = T.word_key("generated") == T.word_key("reference")
    first = F.slice(T.words("generated", "ascii"), 1, 1) == F.slice(T.words("reference", "ascii"), 1, 1)
    return s.select("domain", "bucket", first.alias("concept_correct"), same.alias("routing_correct"), "hallucination", same.alias("exact"), F.col("keyword_recall").alias("keyword_overlap"), "overlap")


def routing_summary(spark: SparkSession, d: str) -> DataFrame:
    s = E.routing_summary(_scored(spark, d), "domain", "bucket")
    rounded = ("concept_accuracy", "routing_accuracy", "concept_confusion_rate", "exact_answer_overlap", "keyword_overlap", "reference_token_overlap", "hallucination_rate")
    return s.select(F.coalesce("field", F.lit("*")).alias("field"), F.coalesce("value", F.lit("*")).alias("value"), "count", *(F.round(c, 6).alias(c) for c in rounded))


_SUMMED = f"""with s as (select domain, bucket, gw[1:1] = rw[1:1] as first, array_to_string(gw, ' ') = array_to_string(rw, ' ') as same, hallucination, keyword_recall, overlap from (select *, {ascii_words('reference')} as rw from {_SCORED.replace('select seq, domain, bucket, gw, matched', 'select seq, domain, bucket, reference, gw, matched')}))
select case when grouping(domain) = 0 then 'domain' when grouping(bucket) = 0 then 'bucket' else '*' end as field, coalesce(domain, bucket, '*') as value, count(*) as count, round(avg(first::int), 6) as concept_accuracy, round(avg(same::int), 6) as routing_accuracy, round(1 - avg(same::int), 6) as concept_confusion_rate,
round(avg(same::int), 6) as exact_answer_overlap, round(avg(keyword_recall), 6) as keyword_overlap, round(avg(overlap), 6) as reference_token_overlap, round(avg(hallucination::int), 6) as hallucination_rate from s group by grouping sets ((), (domain), (bucket))"""


def routing_compared(spark: SparkSession, d: str) -> DataFrame:
    """The answers of even conversations against those of odd ones."""
    s = _scored(spark, d)
    whole = lambda rows: E.routing_summary(rows, "domain").where("field IS NULL")
    c = E.compared(whole(s.where("bucket IN ('b0', 'b2', 'b4')")), whole(s.where("bucket IN ('b1', 'b3')")), 0.3, 0.0)
    return c.select(F.round("routing_accuracy", 6).alias("routing_accuracy"), F.round("confusion_drop", 6).alias("confusion_drop"), "conclusion")


_COMPARED = f"""with s as (select bucket, array_to_string(gw, ' ') = array_to_string({ascii_words('reference')}, ' ') as same from {_ANSWERS}), t as (select avg(same::int) as a from s where bucket in ('b0', 'b2', 'b4')), b as (select avg(same::int) as a from s where bucket in ('b1', 'b3'))
select round(t.a, 6) as routing_accuracy, round((1 - b.a) - (1 - t.a), 6) as confusion_drop, case when t.a <= 0.3 then 'capacity' when (1 - b.a) - (1 - t.a) >= 0 then 'training' else 'inconclusive' end as conclusion from t, b"""


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as concepts; all their different words of six letters on as phrases, the first one primary."""
    w = F.array_distinct(F.filter(T.words("text", "ascii"), lambda x: F.length(x) >= 6))
    return table(spark, d, "benchmark").select(F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("concept"), F.posexplode(w).alias("k", "phrase")).select("concept", "phrase", (F.col("k") == 0).alias("primary"), F.lit(False).alias("anchor"))


def idf_weights(spark: SparkSession, d: str) -> DataFrame:
    return E.phrase_weights(_profiles(spark, d)).select("phrase", F.round("weight", 9).alias("weight"))


_PHRASES = f"""(select 'c' || item_id as concept, unnest(x) as phrase, generate_subscripts(x, 1) - 1 as k from (select item_id, list_transform(list_sort(list_transform(list_distinct(w), lambda v: [lpad(list_position(w, v)::varchar, 6, '0'), v])), lambda v: v[2]) as x
from (select item_id, list_filter({ascii_words('text')}, lambda v: length(v) >= 6) as w from benchmark)))"""
_IDF_W = f"(select phrase, ln((1 + (select count(distinct concept) from {_PHRASES})) / (1 + count(distinct concept))) + 1.0 as weight from {_PHRASES} group by 1)"
_IDF = f"select phrase, round(weight, 9) as weight from {_IDF_W}"


def _routes(spark: SparkSession, d: str) -> DataFrame:
    p = _profiles(spark, d)
    answers = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").withColumn("answer", F.col("text"))
    return E.route(answers, p, E.phrase_weights(p))


def routing_predict(spark: SparkSession, d: str) -> DataFrame:
    return _routes(spark, d).select("id", "predicted", F.round("score", 6).alias("score"))


_ROUTE = f"""with a as (select doc_id as id, {ascii_words('text')} as w from documents), t as (select id, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos, array_to_string(w, ' ') as key from a),
h as (select id, concept, phrase, min(pos) as pos, any_value(key) as key, bool_or(k = 0) as pr from t join {_PHRASES} p on p.phrase = t.word group by 1, 2, 3),
s as (select id, concept, weight * (1.0 + 2.0 / (1.0 + (strpos(key, h.phrase) - 1) / 24.0::double)) * case when pr then 3.0 else 1.0 end as s, case when pr then pos end as rank from h join {_IDF_W} w on w.phrase = h.phrase),
c as (select id, concept, sum(s) as score, min(rank) as rank, count(*) as n from s group by 1, 2),
b as (select *, row_number() over (partition by id order by rank is not null desc, rank, score desc, n desc, concept desc) as r from c)
select a.id, coalesce(concept, '__unknown__') as predicted, round(coalesce(score, 0.0), 6) as score from a left join b on b.id = a.id and r = 1"""


def routing_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Routing where the concepts c3 and c7 are brought up by the questions, in turn; their scores are discounted."""
    p = _profiles(spark, d)
    answers = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("answer"), F.when(F.col("doc_id") % 2 == 0, "c3").otherwise("c7").alias("contrast"))
    return E.route(answers, p, E.phrase_weights(p)).select("id", "predicted", F.round("score", 6).alias("score"))


_CONTRASTED = _ROUTE.replace("sum(s) as score", "sum(s) * case when concept = case when id % 2 = 0 then 'c3' else 'c7' end then 0.2::double else 1.0 end as score")


def network_losses(spark: SparkSession, d: str) -> DataFrame:
    """A two-layer net learns the sum of two of lineitem's columns: the error in front of each of a few steps."""
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("x1"), (F.col("l_discount") * 10).alias("x2")).withColumn("y", F.col("x1") + F.col("x2"))
    _, losses = train_net(rows, ["x1", "x2"], "y", rounds=4)
    return spark.createDataFrame([(k, round(x, 9)) for k, x in enumerate(losses)], "step int, loss double")


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    r = _routes(spark, d).withColumn("expected", F.concat(F.lit("c"), (F.col("id") % 40).cast("string")))
    return E.confusion(r, "expected", "predicted")


_R = f"(select 'c' || (id % 40) as expected, predicted from ({_ROUTE}))"
_CONFUSION = f"select expected, predicted, count(*) as n from {_R} group by 1, 2"


def top_confusions(spark: SparkSession, d: str) -> DataFrame:
    r = _routes(spark, d).withColumn("expected", F.concat(F.lit("c"), (F.col("id") % 40).cast("string")))
    return E.top_confusions(r, "expected", "predicted")


_TOP = f"select expected, predicted, count(*) as n from {_R} where expected <> predicted group by 1, 2 order by n desc, expected, predicted limit 15"


def checkpoint_rank(spark: SparkSession, d: str) -> DataFrame:
    """Sources as checkpoints, documents as their prompt results, measured: repetition, English as the topic, gibberish, drift into other languages."""
    grams = T.ngrams(T.words("text", "ascii"), 3)
    docs = table(spark, d, "documents").withColumn("g", grams).withColumn("topic", T.language_confidence("text")).withColumn("repeated", F.size("g") > F.size(F.array_distinct("g")))
    rows = docs.select(F.col("source").alias("checkpoint"), "repeated", "topic", F.size(E.suspicious_words("text")).alias("gibberish"), (F.col("topic") < L.ENGLISH_FROM).alias("drift"), F.contains("text", F.lit("\n")).alias("chat_prompt"), A.chat_response_ok("text", "topic", "repeated").alias("chat_ok"), (F.col("doc_id") % 97 / 10).alias("val_loss"))
    s = stash(E.checkpoint_scores(rows), shared_dir(spark), "scores")  # read twice, a row for each checkpoint
    return s.join(E.recommend(s).withColumn("best", F.lit(True)), "checkpoint", "left").select("checkpoint", "repetitions", "drifts", "chat", F.round("topic", 9).alias("topic"), F.coalesce("best", F.lit(False)).alias("best"), "gibberish")


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The largest inner product of every hundredth vector with the others."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    width = v.agg(F.mode(F.size("v"))).first()[0] or 0
    return E.nearest_dots(v, q, width).groupBy("query_id").agg(F.max_by("id", F.struct(F.round("z", 9), -F.col("id"))).alias("nearest"))


_COSINE = """select query_id, arg_max(id, round(s, 9)) as nearest from (select q.vec_id as query_id, e.vec_id as id, list_sum(list_transform(list_zip(q.embedding::double[], e.embedding::double[]), lambda p: p[1] * p[2])) as s from embeddings e, embeddings q where q.vec_id % 100 = 0 and e.vec_id <> q.vec_id) group by 1"""


def embedding_attention(spark: SparkSession, d: str) -> DataFrame:
    """Attention of every hundredth vector: the largest weight, and the first component of the weighted sum."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    w = attended(v, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")))
    return w.select("query_id", F.round(F.get("value", F.lit(0)) / F.col("total"), 9).alias("first"), F.round(1 / F.col("total"), 9).alias("largest"))


_ATTENTION = """with z as (select q.vec_id as query_id, e.embedding[1]::double as v, list_sum(list_transform(list_zip(q.embedding::double[], e.embedding::double[]), lambda p: p[1] * p[2])) / sqrt(64.0) as z from embeddings e, embeddings q where q.vec_id % 100 = 0),
s as (select query_id, v, exp(z) as e from z) select query_id, round(sum(e * v) / sum(e), 9) as first, round(max(e) / sum(e), 9) as largest from s group by 1"""


def param_count(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select((F.col("n_nationkey").cast("long") * 100 + 1000).alias("vocab"), (F.col("n_nationkey").cast("long") * 8 + 64).alias("d"), (F.col("n_nationkey") % 5 + 2).cast("long").alias("layers"), F.lit(256).cast("long").alias("block"), (F.col("n_nationkey") % 2 == 0).alias("learned"), (F.col("n_nationkey") % 3 == 0).alias("tied"), F.lit(True).alias("bias"))
    return E.parameter_counts(n.withColumn("d_ff", F.col("d") * 4)).select("vocab", "parameters")


_PARAMS = """with c as (select n_nationkey * 100 + 1000 as v, n_nationkey * 8 + 64 as d, n_nationkey % 5 + 2 as l, (n_nationkey * 8 + 64) * 4 as f, n_nationkey % 2 = 0 as learned, n_nationkey % 3 = 0 as tied from nation)
select v::bigint as vocab, (v * d + case when learned then 256 * d else 0 end + l * (4 * d * d + 4 * d) + l * (2 * d * f + f + d) + (2 * l + 1) * 2 * d + case when tied then 0 else d * v + v end)::bigint as parameters from c"""


def training_memory(spark: SparkSession, d: str) -> DataFrame:
    """Nations as configurations: memory, batch arithmetic, and the count as people write it."""
    n = table(spark, d, "nation").select((F.col("n_nationkey").cast("long") * 100_000_000 + 500).alias("parameters"), F.lit(8).cast("long").alias("batch"), (F.col("n_nationkey") % 4 + 1).cast("long").alias("accumulation"), F.lit(256).cast("long").alias("block"), (F.col("n_nationkey").cast("long") * 8 + 64).alias("d"), (F.col("n_nationkey") % 5 + 2).cast("long").alias("layers"))
    return E.memory_estimate(E.batch_sizes(n)).select("parameters", E.short_count("parameters").alias("short"), "effective_batch", "tokens_per_step", F.round("memory_mb", 6).alias("memory_mb"))


_MEMORY = """with c as (select n_nationkey::bigint as k, n_nationkey::bigint * 100000000 + 500 as p, n_nationkey::bigint % 4 + 1 as a, n_nationkey::bigint * 8 + 64 as d, n_nationkey::bigint % 5 + 2 as l from nation)
select p as parameters, case when p >= 1e9 then printf('%.1fB', p / 1e9) when p >= 1e6 then printf('%.1fM', p / 1e6) when p >= 1e3 then printf('%.1fK', p / 1e3) else p::varchar end as short, 8 * a as effective_batch, 8 * a * 256 as tokens_per_step, round((p * 16 + 8 * 256 * d * 4 * l * 8) / 1048576.0::double, 6) as memory_mb from c"""


def throughput(spark: SparkSession, d: str) -> DataFrame:
    """Line items as timings by their flag: quantity as tokens, tax and one as seconds."""
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("mode"), F.col("l_quantity").alias("tokens"), (F.col("l_tax") + 1).alias("seconds"), F.col("l_extendedprice").alias("peak_mb"))
    return E.throughput(li, "mode").select("mode", F.round(F.col("tokens").cast("double"), 2).alias("tokens"), F.round(F.col("tokens_per_second").cast("double"), 6).alias("tokens_per_second"), F.round(F.col("peak_mb").cast("double"), 2).alias("peak_mb"))


_THROUGHPUT = "select l_returnflag as mode, round(sum(l_quantity)::double, 2) as tokens, round((sum(l_quantity) / sum(l_tax + 1))::double, 6) as tokens_per_second, round(max(l_extendedprice)::double, 2) as peak_mb from lineitem group by 1"


def linear_gradient(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 100000).alias("y"))
    return E.linear_gradient(li, "x", "y", 0.7, 0.1).select(*(F.round(c, 9).alias(c) for c in ("mse", "dw", "db")))


_LINEAR = "select round(avg(e * e), 9) as mse, round(avg(2 * e * x), 9) as dw, round(avg(2 * e), 9) as db from (select l_quantity / 50 as x, 0.7::double * (l_quantity / 50) + 0.1::double - l_extendedprice / 100000 as e from lineitem)"


def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    rules = {"has_text": F.col("text") != "", "even_id": F.col("doc_id") % 2 == 0, "known_language": F.col("lang").isin("en", "fr")}
    return E.violations(table(spark, d, "documents"), **rules)


_VIOLATIONS = """select rule, n from (select 'even_id' as rule, count(*) filter (doc_id % 2 <> 0) as n from documents union all select 'known_language', count(*) filter (lang not in ('en', 'fr')) from documents union all select 'has_text', count(*) filter (text = '') from documents) where n > 0"""

QUERIES = {f.__name__: f for f in (
    expected_keywords, token_f1, general_score, grouped_summary, heldout_split, train_eval_antijoin, exact_line_match, exact_paragraph_match, benchmark_overlap, nearest_similarity, memorisation_risk, idf_weights, routing_predict,
    routing_contrast, network_losses, confusion_matrix, top_confusions, checkpoint_rank, cosine_topk, embedding_attention, param_count, linear_gradient, contract_violations, memorisation_summary, signature_predict, routing_summary, routing_compared,
    training_memory, throughput,
)}
ORACLE_SQL = {
    "expected_keywords": _EXPECTED, "token_f1": _TOKEN_F1, "general_score": _GENERAL, "grouped_summary": _SUMMARY, "heldout_split": _HELD, "train_eval_antijoin": _ANTI, "exact_line_match": _LINES, "exact_paragraph_match": _PARAGRAPHS,
    "benchmark_overlap": _OVERLAP, "memorisation_risk": _RISK, "idf_weights": _IDF, "routing_predict": _ROUTE, "routing_contrast": _CONTRASTED, "confusion_matrix": _CONFUSION, "top_confusions": _TOP, "cosine_topk": _COSINE, "embedding_attention": _ATTENTION,
    "param_count": _PARAMS, "linear_gradient": _LINEAR, "contract_violations": _VIOLATIONS, "memorisation_summary": _MEANS, "signature_predict": _SIGNATURE, "routing_summary": _SUMMED, "routing_compared": _COMPARED,
    "training_memory": _MEMORY, "throughput": _THROUGHPUT,
}
