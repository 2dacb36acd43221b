"""Queries of vocabularies and byte-pair merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import tokens as K
from ..shared import shared_dir, stash
from .common import table
from .queries_pairs import _pairs

_W = "(select unnest(regexp_extract_all(text, '\\S+')) as word from {})"
_MIXED = r"\n|[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]"


def word_freq(spark: SparkSession, d: str) -> DataFrame:
    return K.word_frequency(table(spark, d, "documents"))


_FREQ = f"select word, count(*) as n from {_W.format('documents')} group by 1"


def pair_counts_step0(spark: SparkSession, d: str) -> DataFrame:
    return K.pair_counts(K.word_frequency(table(spark, d, "documents")))


_PAIRS = f"""with f as (select word, count(*) as n from {_W.format('documents')} group by 1), s as (select n, list_append(string_split(word, ''), '</w>') as s from f),
p as (select n, unnest(list_zip(s[:-2], s[2:])) as p from s) select p[1] as "left", p[2] as "right", sum(n)::bigint as n from p group by 1, 2"""


def vocab_by_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return K.vocabulary_by_first_seen(table(spark, d, "documents"), "doc_id")


_SEEN = f"""with t as (select doc_id, unnest(regexp_extract_all(text, '{_MIXED}')) as token, generate_subscripts(regexp_extract_all(text, '{_MIXED}'), 1) as p from documents),
f as (select token, min(doc_id * 1000000 + p) as first from t group by 1) select token, (row_number() over (order by first) + 1)::int as id from f union all select '<PAD>', 0 union all select '<UNK>', 1"""


def vocab_sorted(spark: SparkSession, d: str) -> DataFrame:
    chars = table(spark, d, "documents").select(F.explode(F.array_distinct(F.split("text", ""))).alias("token")).where("token <> ''")
    return K.vocabulary_sorted(chars)


_SORTED = "select token, (row_number() over (order by token) - 1)::int as id from (select distinct unnest(string_split(text, '')) as token from documents) where token <> ''"


def unk_rate(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents that the benchmark's vocabulary lacks."""
    known = K.word_frequency(table(spark, d, "benchmark")).select("word", F.lit(1).alias("k"))
    w = K.word_frequency(table(spark, d, "documents")).join(known, "word", "left")
    return w.agg(F.sum("n").alias("words"), F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(0)).alias("unknown"))


_UNK = f"select count(*) as words, count(*) filter (k.word is null) as unknown from {_W.format('documents')} w left join (select distinct word from {_W.format('benchmark')}) k on k.word = w.word"


def skipped_chars_top20(spark: SparkSession, d: str) -> DataFrame:
    known = K.vocabulary_sorted(table(spark, d, "benchmark").select(F.explode(F.split("text", "")).alias("token")).where("token <> ''"))
    c = K.coverage(table(spark, d, "documents"), known).select("character", F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("character")), 4, "0")).alias("code"), "n")
    return c.orderBy(F.desc("n"), "character").limit(20)


_SKIPPED = """select c as character, 'U+' || lpad(upper(to_hex(unicode(c))), 4, '0') as code, count(*) as n from (select unnest(string_split(regexp_replace(text, '\\s', '', 'g'), '')) as c from documents)
where c <> '' and c not in (select distinct unnest(string_split(text, '')) from benchmark) group by 1, 2 order by n desc, c limit 20"""


def _merges(spark: SparkSession, d: str) -> K.Merges:
    return K.learn_merges(K.word_frequency(table(spark, d, "documents")), 400)


def bpe_merges(spark: SparkSession, d: str) -> DataFrame:
    m = _merges(spark, d)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(m.pairs)], "rank int, left string, right string")


def bpe_encode_counts(spark: SparkSession, d: str) -> DataFrame:
    return K.token_counts(table(spark, d, "documents"), "doc_id", _merges(spark, d))


def bpe_decode(spark: SparkSession, d: str) -> DataFrame:
    """Encoded and decoded words of the benchmark that come back unchanged, counted."""
    words = K.word_frequency(table(spark, d, "benchmark")).where("word rlike '^[a-z]+$'")
    coded = K.encode_words(words, _merges(spark, d)).withColumn("back", K.decode_tokens("tokens"))
    return coded.agg(F.count("*").alias("words"), F.count_if(F.col("word") == F.col("back")).alias("same"))


_DECODE = f"select count(*) as words, count(*) as same from (select distinct word from {_W.format('benchmark')}) where regexp_full_match(word, '[a-z]+')"


def token_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Tokens a word of two vocabularies over the documents, whose words are counted once for all."""
    words = stash(K.word_frequency(table(spark, d, "documents")), shared_dir(spark), "frequency")
    merges = K.learn_merges(words, 400)
    small, large = (K.token_totals(words, merges.until(target)).withColumn("target", F.lit(target)) for target in (200, 400))
    return small.union(large)


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of all documents from their first 5,000 words, by a vocabulary of the benchmark's characters alone."""
    chars = table(spark, d, "benchmark").select(F.explode(F.split(F.regexp_replace("text", r"(?U)\s", ""), "")).alias("c")).where("c <> ''").distinct()
    known = {r.c for r in chars.collect()}
    return K.estimated_tokens(table(spark, d, "documents"), "doc_id", K.Merges(vocabulary=known | {K.END_OF_WORD}), 5000)


_ESTIMATE = """with w as (select doc_id, unnest(regexp_extract_all(text, '\\S+')) as w, generate_subscripts(regexp_extract_all(text, '\\S+'), 1) as p from documents), n as (select count(*) as words from w), s as (select w from w order by doc_id, p limit 5000),
k as (select list(distinct c) as known from (select unnest(string_split(regexp_replace(text, '\\s', '', 'g'), '')) as c from benchmark) where c <> ''), t as (select len(list_filter(string_split(w, ''), lambda c: list_contains(known, c))) as t from s, k),
a as (select count(*) as sample_words, sum(case when t > 0 then t + 1 else 0 end)::bigint as sample_tokens from t)
select words, sample_words, sample_tokens, round_even(sample_tokens / sample_words, 4) as tokens_per_word, round_even(words * (sample_tokens / sample_words), 0)::bigint as estimated_tokens from n, a"""


def tokenizer_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Conversations' pairs under the vocabulary of documents, against one of single characters."""
    pairs, merges = _pairs(spark, d).select("seq", "instruction", "response"), _merges(spark, d)
    return K.coverage_report(pairs, merges, K.Merges(vocabulary=merges.vocabulary), "seq")


def prompt_ids(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as prompts, by the vocabulary of the documents' characters alone: ids of characters."""
    chars = {r.token for r in K.vocabulary_sorted(table(spark, d, "documents").select(F.explode(F.split(F.regexp_replace("text", r"(?U)\s", ""), "")).alias("token")).where("token <> ''")).collect()}
    ids = K.encode_prompts(table(spark, d, "benchmark"), "item_id", K.Merges(vocabulary=chars | {K.END_OF_WORD}))
    return ids.select("item_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


_PROMPT = """with v as (select token, row_number() over (order by token) - 1 as id from (select '</w>' as token union select distinct unnest(string_split(regexp_replace(text, '\\s', '', 'g'), '')) from documents) where token <> ''),
w as (select item_id, unnest(regexp_extract_all(text, '\\S+')) as w, generate_subscripts(regexp_extract_all(text, '\\S+'), 1) as p from benchmark),
c as (select item_id, p, unnest(list_append(string_split(w, ''), '</w>')) as c, generate_subscripts(list_append(string_split(w, ''), '</w>'), 1) as q from w)
select b.item_id, coalesce(x.ids, '0') as ids from benchmark b left join (select item_id, string_agg(v.id::varchar, ',' order by p, q) as ids from c join v on v.token = c.c group by 1) x using (item_id)"""


QUERIES = {f.__name__: f for f in (word_freq, pair_counts_step0, vocab_by_first_seen, vocab_sorted, unk_rate, skipped_chars_top20, bpe_merges, bpe_encode_counts, bpe_decode, token_ratio, token_estimate, tokenizer_coverage, prompt_ids)}
ORACLE_SQL = {"word_freq": _FREQ, "pair_counts_step0": _PAIRS, "vocab_by_first_seen": _SEEN, "vocab_sorted": _SORTED, "unk_rate": _UNK, "skipped_chars_top20": _SKIPPED, "bpe_decode": _DECODE, "prompt_ids": _PROMPT, "token_estimate": _ESTIMATE}
