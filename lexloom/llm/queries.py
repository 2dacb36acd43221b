"""The registered queries opN_<name>: each derives its digest columns from an operator's real output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, decontaminate, hyper_minhash, lexical_search, ngram_join, pii, quality, secrets, toxicity, url_filter, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spans: str, keep=None):
    """kind:start:end of the spans, in their order, comma-joined."""
    chosen = F.filter(spans, keep) if keep else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _number(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    base = F.sha2(_joined("spans", lambda s: s["kind"] != "novel"), 256)
    return found.select(F.col("id").alias("doc_id"), *(_number("spans", k) for k in ("assign", "access", "hex")), base.alias("base_sha256"), _joined("spans").alias("spans"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", F.col("passes").cast("int").alias("predicted"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classify_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", F.col("toxic").cast("int").alias("predicted"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_documents(_table(spark, sf_dir, "documents"), with_ids=False, with_digests=True)
    return found.withColumnRenamed("id", "doc_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    every = F.concat("base", F.transform("terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"))))
    found = found.withColumn("every", every)
    return found.select(F.col("id").alias("doc_id"), *(_number("base", k) for k in ("email", "ip", "card", "phone")), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("every").alias("spans"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyper_minhash.near_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def _components(percent: int, kept: str) -> str:
    """Sets of five-word shingles, links of at least so many hundredths, and the smallest id that links reach."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return f"""with recursive w as (select doc_id, {words} as w from documents), c as (select doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), chr(31)))) as s, len(w) as words from w),
n as (select doc_id, case when words = 0 then 0 else len(s) end as n, md5(array_to_string(list_sort(s), chr(30))) as f, s from c), k as (select f, min(doc_id) as rep, min(n) as n, any_value(s) as s from n where n > 0 group by f),
e as (select rep, n, unnest(s) as x from k), p as (select a.rep as u, b.rep as v from e a join e b on a.x = b.x and a.rep < b.rep and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
b as (select u, v from p union all select v, u from p), r as (select rep as u, rep as v from k union select r.u, b.v from r join b on r.v = b.u), m as (select u, min(v) as c from r group by u)
select n.doc_id, n.n::bigint as n_shingles, coalesce(m.c, n.doc_id) as component_id{kept} from n left join k on n.f = k.f and n.n > 0 left join m on m.u = k.rep"""


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_RANKED = f"""with d as (select row_number() over () as k, doc_id, {_TERMS} as w from documents where text is not null), h as (select k, doc_id, w, len(w)::bigint as n from d where len(w) > 0),
a as (select count(*)::bigint as nd, sum(n)::bigint as l from h), i as (select item_id, unnest(w) as t from (select distinct item_id, text, {_TERMS} as w from benchmark)), q as (select item_id, t, count(*)::bigint as c from i group by 1, 2),
f as (select k, t, count(*)::bigint as tf from (select k, unnest(w) as t from h) where t in (select t from q) group by 1, 2), v as (select t, floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::bigint as w from (select t, count(*)::bigint as df from f group by 1), a),
s as (select q.item_id, h.doc_id, sum(c * v.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // l))))::bigint as score from q join f using (t) join v using (t) join h using (k), a group by q.item_id, h.doc_id, k),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0) select item_id, rank, doc_id, score from r where rank <= 10"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_ngram_join": op2_ngram_join,
    "op3_quality": op3_quality,
    "op4_ann": op4_ann,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_decontaminate": op8_decontaminate,
    "op9_pii": op9_pii,
    "op10_urls": op10_urls,
    "op11_minhash": op11_minhash,
    "op12_whitening": op12_whitening,
    "op13_lexical_search": op13_lexical_search,
}

#: DuckDB SQL of what a method's result must be. Components take a join of all shingles, which is quick on tables of thousands of texts.
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": _components(80, ""),
    "op11_minhash": _components(85, ", coalesce(m.c, n.doc_id) = n.doc_id as kept"),
    "op13_lexical_search": _RANKED,
}
