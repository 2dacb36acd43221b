"""Queries over `conversations` as instruction pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import chat, lexicon as L, text as T
from ..operators import pairs as P
from .common import HYPHEN, fold, one_line, strip, table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    p = P.pair_turns(table(spark, d, "conversations"))
    return p.withColumn("seq", F.col("conv_id") * 1000 + F.col("turn")).withColumn("domain", F.element_at(F.array(*map(F.lit, L.PAIR_DOMAIN_SET)), (F.col("conv_id") % 5 + 1).cast("int"))).withColumn("source", F.concat(F.lit("s"), (F.col("conv_id") % 3).cast("string")))


SQL_PAIRS = f"""(select u.conv_id, u.turn, u.text as instruction, a.text as response, u.conv_id * 1000 + u.turn as seq, ({list(L.PAIR_DOMAIN_SET)})[u.conv_id % 5 + 1] as domain, 's' || (u.conv_id % 3) as source
from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant')"""


def pair_turns(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("conv_id", "turn", F.sha2("instruction", 256).alias("i"), F.sha2("response", 256).alias("r"))


_TURNS = f"select conv_id, turn, sha256(instruction) as i, sha256(response) as r from {SQL_PAIRS}"


def _keys(df: DataFrame) -> DataFrame:
    return df.withColumn("a", F.md5(T.dedupe_key("instruction"))).withColumn("b", F.md5(T.dedupe_key("response")))


_SQL_KEYS = f"(select *, md5({fold(one_line('instruction'))}) as a, md5({fold(one_line('response'))}) as b from {SQL_PAIRS})"


def pair_clean_greedy(spark: SparkSession, d: str) -> DataFrame:
    return P.greedy_pairs(_keys(_pairs(spark, d)), "seq", "a", "b").select("seq", "verdict")


_GREEDY = f"""with recursive p as (select seq, a, b, row_number() over (order by seq) as k from {_SQL_KEYS}),
s as (select 0::bigint as k, 0::bigint as seq, ''::varchar as verdict, []::varchar[] as ka, []::varchar[] as kb
union all select p.k, p.seq, case when list_contains(s.ka, p.a) then 'duplicate_first' when list_contains(s.kb, p.b) then 'duplicate_second' else 'kept' end,
case when list_contains(s.ka, p.a) or list_contains(s.kb, p.b) then s.ka else list_append(s.ka, p.a) end, case when list_contains(s.ka, p.a) or list_contains(s.kb, p.b) then s.kb else list_append(s.kb, p.b) end
from s join p on p.k = s.k + 1) select seq, verdict from s where k > 0"""


def pair_clean_capped(spark: SparkSession, d: str) -> DataFrame:
    rows = P.greedy_pairs(_keys(_pairs(spark, d)), "seq", "a", "b")
    return P.pair_counters(P.capped(rows, "seq", 20))


_CAPPED = f"""with v as ({_GREEDY}), l as (select max(seq) as last, count(*) as n from (select seq from v where verdict = 'kept' order by seq limit 20))
select count(*) as input, count(*) filter (verdict = 'kept') as kept, count(*) filter (verdict = 'duplicate_first') as duplicate_first, count(*) filter (verdict = 'duplicate_second') as duplicate_second from v, l where n < 20 or seq <= last"""


def pair_stats(spark: SparkSession, d: str) -> DataFrame:
    s = P.pair_stats(P.valid(_pairs(spark, d)))
    return s.select(F.coalesce("domain", F.lit("*")).alias("domain"), F.coalesce("source", F.lit("*")).alias("source"), "pairs", "words")


_STATS = f"select coalesce(domain, '*') as domain, coalesce(source, '*') as source, count(*) as pairs, sum(len(regexp_extract_all(response, '{HYPHEN}')))::bigint as words from {SQL_PAIRS} group by grouping sets ((), (domain), (source))"


def pair_adapters(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).select("seq", "instruction", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("sql  table "), "source")).alias("input"), F.col("response").alias("output"), F.when(F.col("seq") % 7 == 0, "x/CodeAlpaca").otherwise("plain").alias("origin"))
    return P.adapt(p, "instruction", "input", "output", F.col("origin")).select("seq", "domain", F.sha2("instruction", 256).alias("sha"))


def _domain_sql(c: str) -> str:
    hit = lambda k: f"regexp_matches({c}, '(?:^|[^\\p{{L}}\\p{{N}}\\p{{M}}_]){k}(?:$|[^\\p{{L}}\\p{{N}}\\p{{M}}_])')::int"
    sums = {dom: "(" + " + ".join(map(hit, ks)) + ")" for dom, ks in L.PAIR_DOMAINS.items()}
    top = f"greatest({', '.join(sums.values())})"
    return f"case when {top} = 0 then 'general' " + " ".join(f"when {s} = {top} then '{dom}'" for dom, s in sums.items()) + " end"


_ADAPT = f"""select seq, case when seq % 7 = 0 then 'software_engineering' else {_domain_sql('t')} end as domain, sha256(i) as sha from (select seq, i, {fold("i || ' ' || r")} as t from
(select seq, case when seq % 2 = 0 then {one_line('instruction')} || chr(10) || chr(10) || 'Input:' || chr(10) || 'sql table ' || source else {one_line('instruction')} end as i, {one_line('response')} as r from {SQL_PAIRS}))"""


def chat_format(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("seq", F.sha2(chat.format_lines("instruction", "response"), 256).alias("lines"), F.sha2(chat.format_line("instruction", "response"), 256).alias("line"))


_FORMAT = f"""select seq, sha256('<USER>' || chr(10) || instruction || chr(10) || '<ASSISTANT>' || chr(10) || response || chr(10) || '<END>') as lines,
sha256('<USER> ' || {one_line('instruction')} || ' <ASSISTANT> ' || {one_line('response')} || ' <END>') as line from {SQL_PAIRS}"""


def chat_parse_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumn("t", F.when(F.col("seq") % 5 == 0, F.concat(F.lit("<USER> "), "instruction")).otherwise(chat.format_lines("instruction", "response")))
    p = p.select("seq", chat.parse("t").alias("p"), chat.parse_by_place("t").alias("q"), (F.col("seq") % 5 != 0).alias("whole"), "instruction", "response")
    same = (F.col("p.instruction") == T.one_line("instruction")) & (F.col("p.response") == T.one_line("response")) & (F.col("q.response") == T.strip("response"))
    return p.groupBy("whole").agg(F.count("*").alias("n"), F.count("p").alias("parsed"), F.count_if(same).alias("same"))


_PARSE = f"select seq % 5 <> 0 as whole, count(*) as n, count(*) filter (seq % 5 <> 0) as parsed, count(*) filter (seq % 5 <> 0) as same from {SQL_PAIRS} group by 1"


def scaffold_counters(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumn("instruction", F.when(F.col("seq") % 4 == 0, F.concat("instruction", F.lit(" OUTPUT: x"))).otherwise(F.col("instruction")))
    return P.scaffold_counters(p, 40, (8, 80))


def _marked(c: str) -> str:
    return "(" + " or ".join(f"contains({fold(c)}, '{m.casefold()}')" for m in L.SCAFFOLDING) + ")"


_SCAFFOLD = f"""with x as (select case when seq % 4 = 0 then instruction || ' OUTPUT: x' else instruction end as i, response as r from {SQL_PAIRS}),
y as (select len(regexp_extract_all(i, '\\S+')) as wi, len(regexp_extract_all(r, '\\S+')) as wr, {_marked('i')} as si, {_marked('r')} as sr from x),
z as (select *, wi > 40 as long, not (wi > 40) and not si and not sr and wr between 8 and 80 as kept from y)
select count(*) as input, count(*) filter (long) as dropped_long, count(*) filter (si) as dropped_scaffolded_instruction, count(*) filter (sr) as dropped_scaffolded_response, count(*) filter (kept) as kept,
max(wi) as max_words_seen, max(wi) filter (kept) as max_words_kept from z"""


def merge_keep_shortest(spark: SparkSession, d: str) -> DataFrame:
    p = _keys(_pairs(spark, d))
    return P.keep_shortest(p, "a", T.n_words("response", "hyphen"), "seq").select("a", "seq")


_SHORTEST = f"select a, seq from {_SQL_KEYS} qualify row_number() over (partition by a order by len(regexp_extract_all(response, '{HYPHEN}')), seq) = 1"


def merge_left_biased(spark: SparkSession, d: str) -> DataFrame:
    p = _keys(_pairs(spark, d)).select("a", "seq", "conv_id")
    return P.base_then_new(p.where("conv_id % 2 = 0"), p.where("conv_id % 2 = 1"), "a", "seq").select("a", "seq")


_BIASED = f"""with p as (select a, seq, conv_id from {_SQL_KEYS}) select a, max(seq) as seq from p where conv_id % 2 = 0 group by 1
union all select a, min(seq) from p where conv_id % 2 = 1 and a not in (select a from p where conv_id % 2 = 0) group by 1"""


def shorten_response(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("seq", F.sha2(T.shorten("response"), 256).alias("sha"))


_SENT = f"list_filter(list_transform(string_split(regexp_replace({one_line('response')}, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda x: {strip('x')}), lambda x: x <> '')"
_WC = lambda x: f"len(regexp_extract_all({x}, '{HYPHEN}'))"
_SHORTEN = f"""with s as (select seq, {_SENT} as s from {SQL_PAIRS}), k as (select seq, s, case when len(s) > 1 and {_WC('s[1]')} < 55 then case when len(s) > 2 and {_WC('s[1]')} + {_WC('s[2]')} < 55 then s[1:3] else s[1:2] end else s[1:1] end as k from s)
select seq, sha256(array_to_string(case when {_WC("array_to_string(k, ' ')")} < 8 and len(s) > len(k) then s[1:3] else k end, ' ')) as sha from k"""

#: A small signature table of our own for the query: word endings that the invented texts are full of.
SIGNATURES = {"databases": ("tionble", "oning"), "ai": ("erth", "andre"), "general": ("ücht", "eaux")}


def cross_domain_reject(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    s = P.short_answers(p).withColumn("other", P.cross_domain(F.col("domain"), "short", SIGNATURES, P.is_comparison("instruction")))
    return s.groupBy("domain", F.coalesce("reason", F.concat(F.lit("cross_"), "other"), F.lit("kept")).alias("verdict")).agg(F.count("*").alias("n"))


_OTHER = "case when domain not in ('databases', 'ai', 'general') then null " + " ".join("when domain <> '{}' and ({}) then '{}'".format(o, " or ".join(f"contains(' ' || {fold('short')} || ' ', '{t}')" for t in ts), o) for o, ts in SIGNATURES.items()) + " end"
_CROSS = f"""with s as (select domain, coalesce(({_SENT})[1], '') as short from {SQL_PAIRS})
select domain, coalesce(case when {_WC('short')} < 12 then 'short' when {_WC('short')} > 35 then 'long' end, 'cross_' || {_OTHER}, 'kept') as verdict, count(*) as n from s group by 1, 2"""


def curated_sample(spark: SparkSession, d: str) -> DataFrame:
    """Curated pairs at their buckets' quotas; a made-up ending gives some general pairs a technical word."""
    p = _pairs(spark, d).withColumn("instruction", F.when(F.col("seq") % 2 == 0, F.concat("instruction", F.lit(" tests"))).otherwise(F.col("instruction")))
    return P.curated(p, "seq", 18).select("bucket", "seq")


_TECHNICAL = f"regexp_matches({fold("instruction || ' ' || response")}, '(?:^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])(?:{'|'.join(L.TECHNICAL_KEYWORDS)})s?(?:$|[^\\p{{L}}\\p{{N}}\\p{{M}}_])')"
_CURATED_OK = " and ".join([
    f"{_WC('instruction')} between 4 and 25", f"{_WC('response')} between 20 and 90", *(f"not starts_with({fold(one_line('instruction'))}, '{g}')" for g in L.GENERIC_OPENINGS),
    "not (len(w) >= 6 and len(g) > len(list_distinct(g)))", f"(domain <> 'general' or {_TECHNICAL})",
])
_CURATED = f"""with o as (select * replace (case when seq % 2 = 0 then instruction || ' tests' else instruction end as instruction) from {SQL_PAIRS}), p as (select *, regexp_extract_all(lower(response), '\\S+') as w from o),
q as (select *, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(list_slice(w, i, i + 2), chr(31))) as g from p),
c as (select case when domain in ('cybersecurity', 'general') then 'cybersecurity_general' else domain end as bucket, domain, seq from q where {_CURATED_OK}),
n as (select count(*) as n from c where domain = 'cybersecurity'),
r as (select *, row_number() over (partition by domain order by seq) - 1 as place, count(*) over (partition by domain) as n, case when domain in ('ai', 'databases') then 5 when domain = 'general' then 4 - least(4, (select n from n)) else 4 end as k from c),
t as (select distinct domain, case when k = 1 then 0 else round_even(i * ((n - 1) / (k - 1)), 0)::bigint end as place from (select distinct domain, n, k from r where n > k and k > 0), range(0, 5) x(i) where i < k)
select bucket, seq from r where n <= k and k > 0 union all select r.bucket, r.seq from r join t using (domain, place) where r.n > r.k"""


def chat_report(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth conversation as the teacher's, repeated three times."""
    return P.gated(P.report(_pairs(spark, d), F.col("conv_id") % 5 == 0, 3).withColumn("longest", F.lit(1))).drop("longest")


_BLOCK = "'<USER>' || chr(10) || instruction || chr(10) || '<ASSISTANT>' || chr(10) || response || chr(10) || '<END>'"
_REPORT = f"""with b as (select {fold(_BLOCK)} as k, len(regexp_extract_all({_BLOCK}, '{HYPHEN}')) as w, conv_id % 5 = 0 as t, case when conv_id % 5 = 0 then 3 else 1 end as n from {SQL_PAIRS})
select sum(n)::bigint as final_examples, sum(n) filter (t)::bigint as teacher_examples, sum(n * w)::bigint as total_words, (sum(n) - count(distinct k))::bigint as duplicate_blocks, round(sum(n) filter (t) / sum(n), 6) as teacher_ratio from b"""


def band_counters(spark: SparkSession, d: str) -> DataFrame:
    return P.band_counters(_pairs(spark, d), 20, 60)


_BAND = f"select count(*) as input, count(*) filter (w < 20) as too_short, count(*) filter (w > 60) as too_long, count(*) filter (w between 20 and 60) as kept from (select {_WC('response')} as w from {SQL_PAIRS})"


def boost_reasons(spark: SparkSession, d: str) -> DataFrame:
    """First sentences of every third answer, whole ones of the others."""
    short = F.when(F.col("seq") % 3 == 0, F.element_at(T.sentences(T.one_line("response")), 1)).otherwise(T.one_line("response"))
    p = _pairs(spark, d).withColumn("short", F.coalesce(short, F.lit("")))
    return p.groupBy(F.coalesce(P.boost_reason("domain", "short", SIGNATURES), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_BOOST = f"""with s as (select domain, coalesce(case when seq % 3 = 0 then ({_SENT})[1] else {one_line('response')} end, '') as short from {SQL_PAIRS}),
r as (select coalesce(case when {_WC('short')} not between 12 and 35 then 'length' when len(list_filter(regexp_split_to_array(short, '[.!?]+'), lambda x: {strip('x')} <> '')) > 1 then 'multisentence' end, 'cross_' || {_OTHER}, 'kept') as reason from s)
select reason, count(*) as n from r group by 1"""

QUERIES = {f.__name__: f for f in (
    pair_turns, pair_clean_greedy, pair_clean_capped, pair_stats, pair_adapters, chat_format, chat_parse_roundtrip, scaffold_counters, merge_keep_shortest, merge_left_biased, shorten_response, cross_domain_reject, curated_sample, chat_report, band_counters, boost_reasons,
)}
ORACLE_SQL = {
    "pair_turns": _TURNS, "pair_clean_greedy": _GREEDY, "pair_clean_capped": _CAPPED, "pair_stats": _STATS, "pair_adapters": _ADAPT, "chat_format": _FORMAT, "chat_parse_roundtrip": _PARSE, "scaffold_counters": _SCAFFOLD,
    "merge_keep_shortest": _SHORTEST, "merge_left_biased": _BIASED, "shorten_response": _SHORTEN, "cross_domain_reject": _CROSS, "curated_sample": _CURATED, "chat_report": _REPORT, "band_counters": _BAND, "boost_reasons": _BOOST,
}
