"""PII: fixed patterns, and terms that corpus co-occurrence shows to reveal a protected entity.

An entity is the normalised value of a base match. A term reveals it as far as their pointwise mutual
information reaches the entity's own information: PMI(t, e) / IC(e), with document frequencies over the whole
corpus. A term at or above the threshold, seen with the entity in enough different texts, gets a span wherever
it stands.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, shared_dir, stash

KINDS = ("email", "ip", "card", "phone", "term")
#: Letters of a term; share of the entity's information that a term must carry; different texts that must show
#: both; chance of the entity given the term.
LETTERS, DISCLOSE, CONTEXTS, ODDS = 2, 0.8, 3, 0.5
#: Terms whose counts a task hands on at once; disclosing terms that go round the texts at once.
FLUSH, BLOCK_TERMS = 100_000, 1 << 21
#: Terms whose verdict a task remembers; documents from which a term's counts go to every task, if such terms are so many at most.
KNOWN, HOT, HOT_LIMIT = 100_000, 5_000, 1 << 20

# The base patterns. Quantifiers are possessive where that can't change a match, so that time stays linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
# Chinese and Japanese have no spaces: their terms are the pieces of two and three characters, or one that stands alone.
_UNSPACED = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_TERM = re.compile(r"[^\W\d_%s]{%d,}|[%s]+" % (_UNSPACED, LETTERS, _UNSPACED))
_RUN = re.compile(f"[{_UNSPACED}]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split(".")):
            yield m.span()


def _luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.findall(m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each kind that pass its test: by kind, then start; ends exclusive."""
    out = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [(s, e, "ip") for s, e in _ips(text)]
        out += [(s, e, "card") for s, e in _cards(text)]
        out += [(s, e, "phone") for s, e in _phones(text)] if "+" in text else []
    return out


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind == 'email' else ''.join(c for c in value if c.isdigit() or c == '.' and kind == 'ip')}"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _hash(s: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(s))


def _pieces(run: str) -> list[tuple[int, int]]:
    """Places of the terms within a match of _TERM."""
    if len(run) < 3 or not _RUN.match(run):
        return [(0, len(run))]
    return [(k, k + n) for n in (2, 3) for k in range(len(run) - n + 1)]


def terms_of(text: str, spans: list[tuple[int, int, str]]) -> set[str]:
    """The different terms of a whole text outside its base spans."""
    if spans:
        parts, last = [], 0
        for s, e, _ in sorted(spans):
            parts.append(text[last : max(s, last)])
            last = max(last, e)
        text = "\n".join([*parts, text[last:]])
    if text.isascii() or not _RUN.search(text):
        return {word.lower() for word in set(_TERM.findall(text))}
    return {run[s:e].lower() for run in set(_TERM.findall(text)) for s, e in _pieces(run)}


def term_spans(text: str, spans: list[tuple[int, int, str]], telling: set[str]) -> list[tuple[int, int]]:
    """Every occurrence of the terms outside base spans, by start."""
    out, at = [], 0
    for s, e in [*((x["start"], x["end"]) for x in _merged([(s, e) for s, e, _ in spans])), (len(text), len(text))]:
        for m in _TERM.finditer(text[at:s]):
            out += [(at + m.start() + i, at + m.start() + j) for i, j in _pieces(m[0]) if m[0][i:j].lower() in telling]
        at = e
    return sorted(out)


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Spans by start, overlapping ones as one."""
    out: list[dict] = []
    for s, e in sorted(spans):
        if out and s < out[-1]["end"]:
            out[-1]["end"] = max(e, out[-1]["end"])
        else:
            out.append({"start": s, "end": e})
    return out


BASE = "array<struct<kind:string,start:long,end:long>>"
TERMS = "array<struct<start:long,end:long>>"


def find_pii(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", disclose: float = DISCLOSE, min_contexts: int = CONTEXTS, odds: float = ODDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, base, terms) per row, with the columns to carry (as c_NAME): base spans by kind and start, and spans of disclosing terms by start.

    One pass reads whole texts and counts, for every term of the corpus, the documents that hold it (summed in
    each task before they travel). Only texts with entities move besides, as term and entity hashes, once for
    all copies; of their pairs only those whose document counts can still reach `min_contexts` and `odds`. A
    hot entity's pairs are summed before the shuffle. Another pass marks every occurrence of the disclosing terms,
    whichever text it is in and however far from an entity; they go round in blocks of BLOCK_TERMS.
    Null and empty texts: no spans. Repeated rows count as documents, but not as different texts; each gets
    its spans. Empty table: no rows.
    """
    spark = documents.sparkSession
    folder = shared_dir(spark)
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"c_{c}") for c in carry))
    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name.startswith("c_"))

    def read_texts(batches: Iterator[dict]) -> Iterator[dict]:
        counts: Counter[str] = Counter()
        none: dict[str, list] = {"docs": [], "context": [], "entities": [], "terms": [], "counts": []}
        docs = 0

        def hashes(terms) -> np.ndarray:
            return np.array([_hash(t) for t in terms], np.int64)

        def flush() -> dict:
            items = list(counts.items())
            counts.clear()
            return {"docs": [docs], "context": [None], "entities": [[]], "terms": [hashes(t for t, _ in items)], "counts": [np.array([n for _, n in items], np.int64)]}

        for b in batches:
            out = {k: [] for k in none}
            for t in b["text"].to_pylist():
                t = t or ""
                docs += 1
                spans = base_spans(t)
                terms = terms_of(t, spans)
                counts.update(terms)
                if spans:
                    for k, v in zip(none, (0, _hash(t.lower()), list({_hash(_entity(kind, t[s:e])) for s, e, kind in spans}), hashes(terms), []), strict=True):
                        out[k].append(v)
                if len(counts) >= FLUSH:
                    yield flush()
                    docs = 0
            yield out
        if docs:
            yield flush()

    read = stash(map_batches(rows.select("id", "text"), read_texts, "docs long, context long, entities array<long>, terms array<long>, counts array<long>"), folder, "read")
    total = float(max(read.agg(F.sum("docs")).collect()[0][0] or 0, 1))
    near = read.where("context IS NOT NULL").groupBy("context").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    near = stash(near, folder, "near")
    # entities in too few different texts can't be given away; nor by a term in too many
    held = near.select("copies", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("c")).where(F.col("c") >= min_contexts).drop("c")
    held = stash(held, folder, "held")
    most = held.agg(F.max("n_entity")).collect()[0][0] or 0
    parts = 32
    spread = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    part = F.pmod("context", F.lit(parts)).cast("int")
    known = read.where("context IS NULL").select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n_term"))
    known = stash(known.where((F.col("n_term") >= min_contexts) & (F.col("n_term") * odds <= most)), folder, "known")
    who = near.select("context", "copies", part.alias("part"), F.explode("entities").alias("entity")).join(held.withColumn("part", spread), ["entity", "part"]).select("context", "copies", "entity", "n_entity")
    who = stash(who, folder, "who")
    said = near.select("context", "terms").join(who.groupBy("context").agg(F.max("n_entity").alias("limit")), "context").select("context", "limit", F.explode("terms").alias("term"))
    # terms of HOT documents and more go round if they are few; else they meet their texts in many parts, as a shuffle by
    # term alone would gather each in one task
    hot = known.where(F.col("n_term") >= HOT).select("term", F.col("n_term").alias("n_hot"))
    if hot.count() <= HOT_LIMIT:
        said = said.join(F.broadcast(hot), "term", "left")
    else:
        said = said.withColumn("part", part).join(hot.withColumn("part", spread), ["term", "part"], "left").drop("part")
    rare = said.where("n_hot IS NULL").join(known.where(F.col("n_term") < HOT), "term").select("context", "limit", "term", "n_term")
    said = rare.union(said.where("n_hot IS NOT NULL").select("context", "limit", "term", F.col("n_hot").alias("n_term"))).where(F.col("n_term") * odds <= F.col("limit"))
    pairs = said.select("context", "term", "n_term").join(who, "context").where(F.col("n_term") * odds <= F.col("n_entity"))
    judged = pairs.groupBy("term", "entity", "n_term", "n_entity").agg(F.sum("copies").alias("n_both"), F.count("*").alias("n_contexts")).where(F.col("n_contexts") >= min_contexts)
    information = F.log(F.lit(total) / F.col("n_entity"))
    shared = F.log(F.col("n_both") * F.lit(total) / (F.col("n_term") * F.col("n_entity")))
    telling = judged.where((information > 0) & (shared >= disclose * information) & (F.col("n_both") >= odds * F.col("n_term")))
    telling = stash(telling.select("term").distinct(), folder, "telling")
    blocks = max(1, -(-telling.count() // BLOCK_TERMS))

    def marker(seek, first: bool):
        def mark(batches: Iterator[dict]) -> Iterator[dict]:
            keys, verdicts = seek.value, {}
            for b in batches:
                texts = [t or "" for t in b["text"].to_pylist()]
                if first:
                    found = [base_spans(t) for t in texts]
                    b |= {"base": [[{"kind": k, "start": s, "end": e} for s, e, k in spans] for spans in found]}
                    terms: list[list[dict]] = [[] for _ in texts]
                else:
                    found = [[(x["start"], x["end"], x["kind"]) for x in spans] for spans in b["base"].to_pylist()]
                    terms = b["terms"].to_pylist()
                for k, (t, spans) in enumerate(zip(texts, found, strict=True) if len(keys) else ()):
                    own = terms_of(t, spans)
                    if new := [w for w in own if w not in verdicts]:
                        if len(verdicts) + len(new) > KNOWN:
                            verdicts.clear()
                            new = list(own)
                        h = np.array([_hash(w) for w in new], np.int64)
                        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                        verdicts.update(zip(new, (keys[at] == h).tolist(), strict=True))
                    if hit := {w for w in own if verdicts[w]}:
                        terms[k] = _merged([(x["start"], x["end"]) for x in terms[k]] + term_spans(t, spans, hit))
                yield b | {"terms": terms}

        return mark

    out = rows
    for k in range(blocks):
        keys = telling.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).toPandas()["term"].to_numpy(np.int64)
        out = map_batches(out, marker(spark.sparkContext.broadcast(np.sort(keys)), k == 0), f"id long, text string, base {BASE}, terms {TERMS}{kept}")
        out = out if k + 1 == blocks else stash(out, folder, f"marked-{k}")  # a task has one mapping, however many blocks
    return out.select("id", "base", "terms", *(f"c_{c}" for c in carry))


#: What stands for a generalised term, by its form; entities are generalised to their kind.
NAME, WORD = "[NAME]", "[WORD]"


def sanitise(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with entities generalised to their kind and disclosing terms to their form.

    A capitalised term, or one without letter case, becomes NAME, another one WORD; one that overlaps an earlier
    span goes with it.
    """
    out, last = [], 0
    for s, e, kind in sorted(spans):
        if s < last:
            last = max(last, e)
            continue
        out += [text[last:s], f"[{kind.upper()}]" if kind != "term" else WORD if text[s].islower() else NAME]
        last = e
    return "".join([*out, text[last:]])


def sanitise_documents(documents: DataFrame, *, disclose: float = DISCLOSE, min_contexts: int = CONTEXTS, odds: float = ODDS) -> DataFrame:
    """documents with personal data and the terms that disclose it generalised; n_chars follows a changed text.

    Keeps the five columns; clean rows, null and empty texts stay as they are. Repeated rows are each sanitised.
    Empty table: no rows.
    """
    found = find_pii(documents, disclose=disclose, min_contexts=min_contexts, odds=odds, carry=("text", "lang", "source", "n_chars"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            text, n = b["c_text"].to_pylist(), b["c_n_chars"].to_pylist()
            for k, (base, terms) in enumerate(zip(b["base"].to_pylist(), b["terms"].to_pylist(), strict=True)):
                if base or terms:
                    text[k] = sanitise(text[k], [(x["start"], x["end"], x["kind"]) for x in base] + [(x["start"], x["end"], "term") for x in terms])
                    n[k] = len(text[k])
            yield {"doc_id": b["id"], "text": text, "lang": b["c_lang"], "source": b["c_source"], "n_chars": n}

    return map_batches(found, run, "doc_id long, text string, lang string, source string, n_chars long")
