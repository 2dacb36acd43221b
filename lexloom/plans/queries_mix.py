"""Queries of mixing, ordering and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import mix as M, tokens as K
from ..operators.order import equal_runs, longest_run, without_repeats
from .common import HYPHEN, fold, one_line, table
from .queries_pairs import SQL_PAIRS, _pairs

_WS = "len(regexp_extract_all(text, '\\S+'))"


def prefix_to_target(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return M.prefix_until(docs, "doc_id", T.n_words("text", "space"), 20_000).select("doc_id")


_PREFIX = f"select doc_id from (select doc_id, sum({_WS}) over (order by doc_id) - {_WS} as before from documents) where before < 20000"


def chat_mix_ratio(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), "text")
    chat = _pairs(spark, d).select("seq", F.col("response").alias("text"))
    return M.word_share(M.mix_to_ratio(base, chat, "seq", 0.02), "tag").select("tag", "blocks", "words")


_MIX = f"""with b as (select doc_id as seq, {_WS} as w from documents), t as (select sum(w) * 0.02::double / (1 - 0.02::double) as target from b),
c as (select seq, len(regexp_extract_all(response, '\\S+')) as w from {SQL_PAIRS}), p as (select w from (select w, sum(w) over (order by seq) - w as before from c), t where before < target)
select 'base' as tag, count(*) as blocks, sum(w)::bigint as words from b union all select 'chat', count(*), sum(w)::bigint from p"""


def domain_word_share(spark: SparkSession, d: str) -> DataFrame:
    return M.word_share(table(spark, d, "documents"), "source")


_SHARE = f"select source, count(*) as blocks, sum({_WS})::bigint as words, sum({_WS}) / sum(sum({_WS})) over () as share from documents group by 1"


def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return M.stride_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 10)


_STRIDE = "select doc_id from (select doc_id, row_number() over (order by doc_id) - 1 as k, count(*) over () as n from documents) where k % (n // 10) = 0 order by doc_id limit 10"


def tail_split(spark: SparkSession, d: str) -> DataFrame:
    return M.tail_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.05)


_TAIL = "select doc_id, case when row_number() over (order by doc_id) <= trunc(count(*) over () * (1 - 0.05::double))::bigint then 'train' else 'validation' end as split from documents"


def hold_out_last(spark: SparkSession, d: str) -> DataFrame:
    return M.hold_out_last(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id").groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


_LAST = "select split, count(*) as n, sum(doc_id)::bigint as ids from (select doc_id, case when row_number() over (partition by source order by doc_id desc) = 1 then 'held_out' else 'train' end as split from documents) group by 1"


def seeded_order(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its place in the seeded order."""
    return M.shuffled(table(spark, d, "documents").select("doc_id"), 42, "doc_id").select("doc_id", "place")


_SEEDED = "select doc_id, row_number() over (order by md5('42|' || doc_id), doc_id) as place from documents"


def group_numbering(spark: SparkSession, d: str) -> DataFrame:
    return M.group_ids(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "id")


_NUMBER = "select doc_id, source || '-' || lpad((row_number() over (partition by source order by doc_id))::varchar, 3, '0') as id from documents"


def repeat_rows(spark: SparkSession, d: str) -> DataFrame:
    return M.repeat_rows(table(spark, d, "benchmark").select("item_id"), F.col("item_id") % 3 + 1).groupBy("copy").agg(F.count("*").alias("n"))


_REPEAT = "select copy, count(*) as n from (select unnest(range(1, item_id % 3 + 2)) as copy from benchmark) group by 1"


def no_adjacent_dups(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items, each a few times and one of them often, in an order without equal neighbours: every place."""
    times = F.when(F.col("item") == "0", 25).otherwise(F.col("item").cast("long") % 4 + 1)
    rows = M.repeat_rows(table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("item")), times)
    return M.apart(rows, "item")


# the heap's rule step by step: the most copies left, but for the item just placed; ties by the seeded order
_SPREAD = """with recursive i as (select list(item order by md5('42|' || item)) as items, list(n order by md5('42|' || item)) as n, sum(n)::bigint as total from (select item_id::varchar as item, case when item_id = 0 then 25 else item_id % 4 + 1 end as n from benchmark)),
s as (select -1::bigint as place, n, 0::bigint as last from i union all select place + 1, list_transform(n, lambda c, k: case when k = best then c - 1 else c end), best
from (select s.place, s.n, list_position(m, list_max(m))::bigint as best from (select place, n, list_transform(n, lambda c, k: case when k = last then 0 else c end) as m from s) s, i where place + 1 < total))
select place, items[last] as item from s, i where last > 0"""


def corpus_runs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of one language in the order of the whole corpus, three or more."""
    return equal_runs(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 3)


_RUNS = """with r as (select doc_id, row_number() over (order by doc_id) - row_number() over (partition by lang order by doc_id) as g, lang from documents)
select min(doc_id) as first, count(*) as n from r group by g, lang having count(*) >= 3"""


def corpus_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose language isn't that of the one before, and the longest run of folded sources."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return without_repeats(docs, "doc_id", "lang").select("doc_id").crossJoin(F.broadcast(longest_run(docs, "doc_id", "source")))


_FIRSTS = f"""with s as (select row_number() over (order by doc_id) - row_number() over (partition by {fold('source')} order by doc_id) as g, {fold('source')} as f from documents), m as (select max(n) as longest from (select count(*) as n from s group by g, f))
select doc_id, longest from (select doc_id, lang, lag(lang) over (order by doc_id) as b from documents), m where lang is distinct from b"""


def sparse_running_total(spark: SparkSession, d: str) -> DataFrame:
    """Running totals over keys that are far apart."""
    rows = table(spark, d, "orders").select((F.col("o_orderkey") * 1_000_000_007_000).alias("seq"), F.col("o_custkey").alias("v"))
    return M.running_total(rows, "seq", "v")


_SPARSE = "select o_orderkey * 1000000007000 as seq, o_custkey as v, sum(o_custkey) over (order by o_orderkey)::bigint as total from orders"


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.transform(F.split("text", ""), lambda c: F.ascii(c)).alias("ids"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of the characters' code points of all documents as one stream, across documents, at starts that look random."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return M.random_stream_windows(_stream(spark, d), "doc_id", "ids", 3000, 40).select("k", text("x"), text("y"))


_CODES = lambda at: f"array_to_string(list_transform(string_split(substr(s, b + {at}, 3000), ''), lambda c: unicode(c)), ',')"
_STREAM = f"""with a as (select string_agg(text, '' order by doc_id) as s, sum(length(text))::bigint as n from documents), w as (select k, ('0x' || substr(md5('42|' || k), 1, 15))::bigint % (n - 3000) as b from range(0, 40) x(k), a)
select k, {_CODES(1)} as x, {_CODES(2)} as y from w, a"""


def stream_split(spark: SparkSession, d: str) -> DataFrame:
    """The last tenth of all characters as validation, with the document across the border in both parts."""
    rows = M.stream_split(_stream(spark, d), "doc_id", "ids", 0.1)
    return rows.select("doc_id", "split", F.size("ids").alias("n"), F.element_at("ids", 1).alias("first"))


_STREAM_SPLIT = """with r as (select doc_id, text, length(text) as n, sum(length(text)) over (order by doc_id) - length(text) as b, sum(length(text)) over () as t from documents), c as (select *, least(greatest(trunc(t * (1 - 0.1::double))::bigint - b, 0), n)::bigint as k from r)
select doc_id, 'train' as split, k::int as n, unicode(text) as first from c where k > 0 union all select doc_id, 'validation', (n - k)::int, unicode(substr(text, k + 1, 1)) from c where n > k"""


def _word_ids(df: DataFrame, seq: str, text: str, known: DataFrame) -> DataFrame:
    """(seq, ids) by the sorted vocabulary of the texts' own words."""
    words = known.select(F.explode(T.words("text", "space")).alias("token"))
    return K.as_ids(df, seq, text, K.vocabulary_sorted(words), "space", -1)


def next_token_windows(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select("item_id", "text")
    rows = _word_ids(b, "item_id", "text", b).select("item_id", F.posexplode(M.token_windows("ids", 8, 5)).alias("k", "p"))
    return rows.select("item_id", "k", F.array_join(F.col("p.x").cast("array<string>"), ",").alias("x"), F.array_join(F.col("p.y").cast("array<string>"), ",").alias("y"))


def _sql_ids(key: str, source: str) -> str:
    """(key, ids) of a table (key, text) by the sorted vocabulary of its own words."""
    return f"""(with src as {source}, w as (select {key}, unnest(x) as word, generate_subscripts(x, 1) as p from (select {key}, regexp_extract_all(text, '\\S+') as x from src)), v as (select word, row_number() over (order by word) - 1 as id from (select distinct word from w))
select {key}, list(id order by p) as ids from w join v using (word) group by 1)"""


_WINDOWS = f"""select item_id, (k - 1)::int as k, array_to_string(ids[s + 1:s + 8], ',') as x, array_to_string(ids[s + 2:s + 9], ',') as y from (select item_id, ids, unnest(range(0, len(ids) - 8, 5)) as s, generate_subscripts(range(0, len(ids) - 8, 5), 1) as k
from {_sql_ids('item_id', '(select item_id, text from benchmark)')} where len(ids) > 8)"""


def sft_loss_weights(spark: SparkSession, d: str) -> DataFrame:
    """Pairs as ids of their words, behind the markers' own: -91 stands for the answer's, -92 for the end."""
    p = _pairs(spark, d).select("seq", "instruction", "response")
    sides = p.select((F.col("seq") * 2).alias("s"), F.col("instruction").alias("text")).union(p.select((F.col("seq") * 2 + 1).alias("s"), F.col("response").alias("text")))
    ids = _word_ids(sides, "s", "text", sides).withColumn("seq", F.floor(F.col("s") / 2))
    side = lambda k, name: ids.where(F.col("s") % 2 == k).select("seq", F.col("ids").alias(name))
    rows = side(0, "i").join(side(1, "r"), "seq").select("seq", F.concat("i", F.array(F.lit(-91)), "r", F.array(F.lit(-92))).alias("ids"))
    out = M.loss_rows(rows, "ids", 64, [-91], [-92])
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select("seq", text("x").alias("x"), text("y").alias("y"), F.array_join(F.col("w").cast("array<int>").cast("array<string>"), ",").alias("w"))


_SIDES = _sql_ids("s", f"(select seq * 2 as s, instruction as text from {SQL_PAIRS} union all select seq * 2 + 1, response from {SQL_PAIRS})")
_LOSS_ROWS = f"(with i as {_SIDES} select a.s // 2 as seq, list_concat(a.ids, [-91], b.ids, [-92])[1:65] as i from i a join i b on b.s = a.s + 1 where a.s % 2 = 0)"
_LOSS = f"""with r as {_LOSS_ROWS}, m as (select seq, i, list_position(i, -91) - 1 as a, list_position(i, -92) - 1 as e from r),
f as (select seq, i, a, e, case when e is null then len(i) - 2 else least(len(i) - 2, e - 1) end as l from m where a is not null and a < len(i) - 1),
p as (select *, list_concat(i, list_transform(range(0, 65 - len(i)), lambda x: 0)) as z from f)
select seq, array_to_string(z[1:64], ',') as x, array_to_string(z[2:65], ',') as y,
array_to_string(list_transform(range(0, 64), lambda q: case when e is not null and q >= greatest(a, e - 1) and q <= l then 2 when q = a then 8 when q >= a and q <= l then 1 else 0 end), ',') as w from p"""


def arithmetic_grid(spark: SparkSession, d: str) -> DataFrame:
    return M.arithmetic_grid(spark, 12).select("kind", "instruction", "response")


_GRID = """with g as (select a, b from range(1, 13) x(a), range(1, 13) y(b))
select 'add' as kind, format('What is {} + {}?', a, b) as instruction, format('{} plus {} equals {}.', a, b, a + b) as response from g
union all select 'sub', format('What is {} - {}?', a, b), format('{} minus {} equals {}.', a, b, a - b) from g where a >= b
union all select 'mul', format('What is {} * {}?', a, b), format('{} times {} equals {}.', a, b, a * b) from g"""

_TEMPLATES = ("What is {}?", "Explain {} briefly.", "Why does {} matter?")


def template_questions(spark: SparkSession, d: str) -> DataFrame:
    """Nations as concepts, regions as their domains."""
    c = table(spark, d, "nation").select(F.col("n_name").alias("concept"), F.col("n_nationkey").alias("k"))
    t = spark.createDataFrame([(k, t) for k, t in enumerate(_TEMPLATES)], "t int, template string")
    rows = M.template_rows(c, t).withColumn("n", F.col("k") * len(_TEMPLATES) + F.col("t")).withColumn("answers", F.array(*map(F.lit, ("yes", "no"))))
    return M.cyclic_answers(rows, "n", "answers").select("instruction", "answer")


_TEMPLATE = f"""select replace(t, '{{}}', n_name) as instruction, (['yes', 'no'])[(n_nationkey * 3 + i - 1) % 2 + 1] as answer from nation, (select unnest({list(_TEMPLATES)}) as t, generate_subscripts({list(_TEMPLATES)}, 1) as i)"""


def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("concept"), F.col("n_regionkey").alias("domain"), F.when(F.col("n_nationkey") % 2 == 0, "NOWHERE").alias("related"), F.lit(None).cast("string").alias("contrast"))
    return M.hard_negatives(n).select("concept", F.array_join("negatives", ",").alias("negatives"))


_NEGATIVES = """with r as (select n_name as c, n_regionkey as g, row_number() over (partition by n_regionkey order by n_name) - 1 as k, count(*) over (partition by n_regionkey) as n, n_nationkey % 2 = 0 as rel from nation),
o as (select a.c, a.rel, b.c as o, (b.k - a.k + a.n) % a.n as step from r a join r b on a.g = b.g and a.c <> b.c)
select c as concept, array_to_string(list_slice(list_concat(case when bool_and(rel) then ['NOWHERE'] else []::varchar[] end, list(o order by step)), 1, 3), ',') as negatives from o group by c"""


def running_word_total(spark: SparkSession, d: str) -> DataFrame:
    return M.running_total(table(spark, d, "documents").select("doc_id", T.n_words("text", "space").alias("w")), "doc_id", "w").select("doc_id", "total")


_TOTAL = f"select doc_id, (sum({_WS}) over (order by doc_id))::bigint as total from documents"

def balanced_tail(spark: SparkSession, d: str) -> DataFrame:
    """Languages as domains, sources as concepts: two of each give a document to validation, a long and a short one in turn."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    out = M.balanced_tail(docs, "lang", "source", "doc_id", 2, [F.col("n_chars") >= 1000, F.col("n_chars") < 1000])
    return out.where("last").select("doc_id", "lang", "source")


_TAIL_PICKS = """with i as (select lang, source, min(doc_id) as s from documents group by 1, 2), t as (select *, row_number() over (partition by lang order by s) - 1 as t from i),
r as (select doc_id, d.lang, d.source from documents d join t using (lang, source) where t.t < 2 and ((t.t % 2 = 0 and n_chars >= 1000) or (t.t % 2 = 1 and n_chars < 1000)))
select min(doc_id) as doc_id, lang, source from r group by 2, 3"""

_PARTS = ("{Topic} helps a team in {place}.", "In {place} people ask what {topic} means.", "A note on {topic} and {place}.")


def generated_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Nations as topics, regions as places, templates in turn, until the words reach a target; texts that come twice count once."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.lower("n_name").alias("topic"), F.col("n_regionkey").alias("n_regionkey")).join(F.broadcast(table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.lower("r_name").alias("place"))), "n_regionkey")
    cells = M.grid(spark, template=_PARTS, cycle=("0", "1")).withColumnRenamed("n", "t")
    rows = n.crossJoin(F.broadcast(cells)).withColumn("seq", F.col("t") * 25 + F.col("k"))
    rows = rows.withColumn("text", M.compose(F.col("template"), topic=F.col("topic"), place=F.col("place")))
    return M.generated_until(rows.select("seq", "text"), "seq", "text", 500, have=20).select("seq", "text")


_UP = lambda c: f"upper({c}[1:1]) || {c}[2:]"
_GENERATED = f"""with c as (select (t - 1) * 50 + (case when c then 25 else 0 end) + n_nationkey as seq, lower(n_name) as topic, lower(r_name) as place, t from nation join region on r_regionkey = n_regionkey, range(1, 4) x(t), (select unnest([false, true]) as c)),
x as (select seq, case t when 1 then {_UP('topic')} || ' helps a team in ' || place || '.' when 2 then 'In ' || place || ' people ask what ' || topic || ' means.' else 'A note on ' || topic || ' and ' || place || '.' end as text from c),
u as (select * from x qualify row_number() over (partition by lower(text) order by seq) = 1), w as (select *, len(regexp_extract_all(text, '{HYPHEN}')) as w from u)
select seq, text from (select *, sum(w) over (order by seq) - w as before from w) where before < 480"""


def cycled_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items over and over with a header until their words reach a target; counted by cycle."""
    b = table(spark, d, "benchmark").select("item_id", "text")
    return M.cycled(b, "item_id", "text", 20_000, "space", "=== Book %d ===").groupBy("cycle").agg(F.count("*").alias("blocks"), F.sum(T.n_words("text", "space")).alias("words"))


_CYCLED = f"""with b as (select count(*) as n, sum({_WS}) + 4 as w from benchmark) select c as cycle, n + 1 as blocks, w::bigint as words from b, range(1, 10000) x(c) where (c - 1) * w < 20000"""

_KINDS = ("definition", "comparison", "example", "why", "how", "troubleshooting")


def composed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Nations as concepts: an answer for each kind of question, every second one a contrast."""
    n = table(spark, d, "nation")
    parts = {c: F.concat(F.lit(f"{c.capitalize()} of "), "n_name", F.lit(".")) for c in ("definition", "comparison", "example", "importance", "mechanism", "troubleshooting", "contrast_note")}
    rows = n.select("n_nationkey", "n_name", *(v.alias(k) for k, v in parts.items())).crossJoin(F.broadcast(M.grid(spark, kind=_KINDS, variant=("plain", "contrast"))))
    label = spark.createDataFrame([("FRANCE", "la France"), ("CHINA", "Zhongguo")], "key string, label string")
    out = M.labelled(rows.withColumn("key", F.col("n_name")), "key", label)
    return out.select("n_nationkey", "kind", "variant", "label", M.composed_answer("kind", "variant").alias("answer"))


def _part(name: str) -> str:
    return f"'{name.capitalize()} of ' || n_name || '.'"


_COMPOSED = f"""select n_nationkey, kind, variant, case n_name when 'FRANCE' then 'la France' when 'CHINA' then 'Zhongguo' else replace(n_name, '_', ' ') end as label, {_part('definition')} || case kind when 'definition' then '' when 'comparison' then ' ' || {_part('comparison')} when 'example' then ' ' || {_part('example')}
when 'why' then ' ' || {_part('importance')} when 'how' then ' ' || {_part('mechanism')} else ' To troubleshoot it, troubleshooting of ' || n_name || '.' end || case when variant = 'contrast' then ' Contrast_note of ' || n_name || '.' else '' end as answer
from nation, (select unnest({list(_KINDS)}) as kind), (select unnest(['plain', 'contrast']) as variant)"""


def topic_rows(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("domain"), F.col("n_name").alias("term"), F.concat(F.lit("a nation numbered "), F.col("n_nationkey").cast("string")).alias("definition"))
    return M.topic_rows(n, "What is {term}?", "It has customers.")


_TOPICS = "select 'What is ' || n_name || '?' as instruction, upper(n_name[1:1]) || lower(n_name[2:]) || ' is a nation numbered ' || n_nationkey || '. It has customers.' as response, n_regionkey::varchar as domain from nation"


def random_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of documents as vocabulary ids of their characters' code points, at starts that look random."""
    ids = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    rows = M.random_windows(table(spark, d, "documents").select("doc_id", ids.alias("ids")), "doc_id", "ids", 16, 2)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select("doc_id", "k", text("x").alias("x"), text("y").alias("y"))


_RANDOM = """with c as (select doc_id, list_transform(string_split(text, ''), lambda c: unicode(c)) as ids from documents), w as (select doc_id, ids, k, (('0x' || substr(md5('42|' || doc_id || '|' || k), 1, 8))::bigint % (len(ids) - 16))::int as s from c, range(0, 2) x(k) where len(ids) >= 17)
select doc_id, k::int as k, array_to_string(ids[s + 1:s + 16], ',') as x, array_to_string(ids[s + 2:s + 17], ',') as y from w"""


def contrast_cycled(spark: SparkSession, d: str) -> DataFrame:
    """Documents as questions; those with a comma count as comparisons."""
    docs = table(spark, d, "documents").select("doc_id", F.contains("text", F.lit(",")).alias("c"), F.lit("own").alias("own"))
    return M.contrast_cycled(docs, "doc_id", F.col("c"), "own", ("first", "second", "third")).select("doc_id", "cycled")


_CONTRAST = "select doc_id, case when c then (['first', 'second', 'third'])[(n - 1) % 3 + 1] else 'own' end as cycled from (select doc_id, contains(text, ',') as c, sum(contains(text, ',')::int) over (order by doc_id)::bigint as n from documents)"


def with_generated(spark: SparkSession, d: str) -> DataFrame:
    """Lines of benchmark items as existing blocks, of documents as generated ones."""
    lines = lambda t, i: table(spark, d, t).select(F.col(i).alias("i"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select((F.col("i") * 1000 + F.col("p")).alias("seq"), "text")
    return M.with_generated(lines("benchmark", "item_id"), lines("documents", "doc_id"), "seq").groupBy("generated").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"))


_L = lambda t, i: f"(select {i} * 1000 + generate_subscripts(string_split(text, chr(10)), 1) - 1 as seq, unnest(string_split(text, chr(10))) as text from {t})"
_WITH = f"""with e as (select text, {fold('text')} as f from {_L('benchmark', 'item_id')}), g as (select seq, text, {fold('text')} as f from {_L('documents', 'doc_id')}), n as (select * from g where f not in (select f from e) qualify row_number() over (partition by f order by seq) = 1)
select false as generated, count(*) as n, count(distinct text) as texts from e union all select true, count(*), count(distinct text) from n"""

QUERIES = {f.__name__: f for f in (
    random_windows, contrast_cycled, with_generated, balanced_tail, generated_corpus, cycled_corpus, composed_answers, topic_rows, prefix_to_target, chat_mix_ratio, domain_word_share, stride_sample, tail_split, hold_out_last, seeded_order, group_numbering, repeat_rows, no_adjacent_dups, next_token_windows, sft_loss_weights, arithmetic_grid,
    template_questions, hard_negatives, running_word_total, corpus_runs, corpus_without_repeats, sparse_running_total, stream_windows, stream_split,
)}
ORACLE_SQL = {
    "random_windows": _RANDOM, "contrast_cycled": _CONTRAST, "with_generated": _WITH, "balanced_tail": _TAIL_PICKS, "generated_corpus": _GENERATED, "cycled_corpus": _CYCLED, "composed_answers": _COMPOSED, "topic_rows": _TOPICS, "prefix_to_target": _PREFIX, "chat_mix_ratio": _MIX, "domain_word_share": _SHARE, "stride_sample": _STRIDE, "tail_split": _TAIL, "hold_out_last": _LAST, "seeded_order": _SEEDED, "group_numbering": _NUMBER, "repeat_rows": _REPEAT,
    "no_adjacent_dups": _SPREAD, "next_token_windows": _WINDOWS, "sft_loss_weights": _LOSS, "arithmetic_grid": _GRID, "template_questions": _TEMPLATE, "hard_negatives": _NEGATIVES, "running_word_total": _TOTAL,
    "corpus_runs": _RUNS, "corpus_without_repeats": _FIRSTS, "sparse_running_total": _SPARSE, "stream_windows": _STREAM, "stream_split": _STREAM_SPLIT,
}
