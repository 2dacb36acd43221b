"""Vocabularies and byte-pair merges learned from a corpus; encoding distinct words once and joining back."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import lexicon as L, text as T
from .merges import ALREADY, END_OF_WORD, NO_PAIRS, REACHED, Merges, joined, learn_merges, symbols
from .order import ranked, scanned

__all__ = ["ALREADY", "NO_PAIRS", "REACHED", "learn_merges"]


def word_frequency(df: DataFrame, text: str = "text", dialect: str = "space") -> DataFrame:
    """(word, n): counted within each task before the shuffle."""
    return df.select(F.explode(T.words(text, dialect)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def pair_counts(frequency: DataFrame) -> DataFrame:
    """(left, right, n): adjacent symbols weighted by word frequency."""
    pairs = T.let(symbols("word"), lambda s: F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.struct(F.element_at(s, i).alias("left"), F.element_at(s, i + 1).alias("right"))))
    return frequency.where("word <> '\n'").select("n", F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def vocabulary_by_first_seen(df: DataFrame, seq: str, text: str = "text", dialect: str = "mixed", reserved: tuple[str, ...] = ("<PAD>", "<UNK>")) -> DataFrame:
    """(token, id): reserved ones first, then words in order of their first place in the corpus."""
    at = df.select(F.col(seq).alias("s"), F.posexplode(T.words(text, dialect)).alias("p", "token")).groupBy("token").agg(F.min(F.struct("s", "p")).alias("first"))
    numbers = ranked(at, "first", "token").select("token", (F.col("place") - 1 + len(reserved)).cast("int").alias("id"))
    head = df.sparkSession.createDataFrame([(t, k) for k, t in enumerate(reserved)], "token string, id int")
    return head.union(numbers)


def vocabulary_sorted(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(token, id) of distinct tokens in code point order."""
    return ranked(tokens.select(F.col(token).alias("token")).distinct(), "token").select("token", (F.col("place") - 1).cast("int").alias("id"))


def as_ids(df: DataFrame, seq: str, text: str, vocabulary: DataFrame, dialect: str = "mixed", unknown: int = 1) -> DataFrame:
    """(seq, ids): texts as arrays of a vocabulary's ids; words outside it as `unknown`.

    Each distinct word is looked up once; a text's places then come together again by seq.
    """
    places = df.select(F.col(seq).alias("_s"), F.posexplode(T.words(text, dialect)).alias("p", "token"))
    found = places.join(vocabulary.select("token", "id"), "token", "left").select("_s", F.struct("p", F.coalesce("id", F.lit(unknown)).alias("id")).alias("x"))
    ids = found.groupBy("_s").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["id"]).alias("ids"))
    return df.select(F.col(seq)).join(ids, F.col(seq) == F.col("_s"), "left").select(seq, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def save_merges(merges: Merges, spark: SparkSession, path: str) -> None:
    """A learned vocabulary as one JSON file, in any store that Spark writes: end_marker, merges, vocab, stoi."""
    body = json.dumps({"end_marker": END_OF_WORD, "merges": [list(p) for p in merges.pairs], "vocab": sorted(merges.vocabulary), "stoi": merges.ids}, ensure_ascii=False)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_merges(spark: SparkSession, path: str) -> Merges:
    """What `save_merges` wrote, or any file of that form on one line or several."""
    body = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if sorted(body["stoi"], key=body["stoi"].get) != sorted(body["vocab"]):
        raise ValueError("ids don't follow the sorted vocabulary")
    out = Merges([tuple(p) for p in body["merges"]], set(body["vocab"]))
    out.alphabet = frozenset(t for t in out.vocabulary if len(t) == 1 or t == body.get("end_marker", END_OF_WORD))
    out.initial = len(out.alphabet)
    return out


def training_text(base: DataFrame, chats: DataFrame, required: tuple[str, ...], times: int = 200, text: str = "text") -> DataFrame:
    """(part, text): base texts, the required symbols so many times, and chats, so that every symbol is in the vocabulary; empty ones left out."""
    lines = base.sparkSession.range(times).select(F.lit("symbols").alias("part"), F.lit(" ".join(required)).alias("text"))
    tagged = lambda df, part: df.select(F.lit(part).alias("part"), T.strip(text).alias("text"))
    return tagged(base, "base").union(lines).union(tagged(chats, "chat")).where("text <> ''")


def encode_prompts(prompts: DataFrame, seq: str, merges: Merges, text: str = "text") -> DataFrame:
    """(seq, ids): prompts with unknown characters as spaces, word by word; a prompt of which nothing is left is [0]."""
    known = sorted(t for t in merges.vocabulary if len(t) == 1 and not t.isspace())
    inside = "".join("\\" + c if c in "\\]^-[&" else c for c in known)
    safe = F.regexp_replace(text, f"[^{inside}]", " ") if known else F.lit("")
    words = prompts.select(F.col(seq).alias("_s"), F.posexplode(F.split(T.one_line(safe), " ")).alias("p", "word")).where("word <> ''")
    coded = encode_words(words, merges, numbers=True).select("word", "ids")
    whole = words.join(coded, "word").groupBy("_s").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p", "ids"))), lambda x: x["ids"])).alias("ids"))
    rows = prompts.select(seq).join(whole, F.col(seq) == F.col("_s"), "left")
    return rows.select(seq, F.when(F.size("ids") > 0, F.col("ids")).otherwise(F.array(F.lit(0))).alias("ids"))


def coverage_report(chats: DataFrame, new: Merges, old: Merges, seq: str, instruction: str = "instruction", response: str = "response") -> DataFrame:
    """One row: examples, those without a part, mean tokens by part, totals of both vocabularies, compression, saved tokens, skipped characters."""
    empty = lambda c: F.coalesce(T.strip(c), F.lit("")) == ""
    base = chats.agg(F.count("*").alias("examples"), F.count_if(empty(instruction) | empty(response)).alias("parse_failures"))
    whole = chats.select(seq, F.concat_ws(" ", instruction, response).alias("text"))

    def total(df: DataFrame, merges: Merges, name: str, skipped: str | None = None) -> DataFrame:
        c = token_counts(df, seq, merges)
        return c.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias(name), *([F.coalesce(F.sum("skipped"), F.lit(0)).alias(skipped)] if skipped else []))

    part = lambda c: chats.select(seq, F.col(c).alias("text"))
    out = base
    for t in (total(part(instruction), new, "instruction_tokens"), total(part(response), new, "response_tokens"), total(whole, new, "new_total", "new_skipped"), total(whole, old, "old_total", "old_skipped")):
        out = out.crossJoin(F.broadcast(t))  # one row each
    mean = lambda c: F.round(F.when(F.col("examples") > 0, F.col(c) / F.col("examples")), 2)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    saved = F.when(F.col("old_total") > 0, 1 - F.col("new_total") / F.col("old_total")).otherwise(0.0)
    return out.select("examples", "parse_failures", mean("instruction_tokens").alias("avg_instruction_tokens"), mean("response_tokens").alias("avg_response_tokens"), "new_total", "old_total", F.round(share("old_total", "new_total"), 4).alias("compression"), F.round(saved, 4).alias("saved"), "new_skipped", "old_skipped")


def estimated_tokens(df: DataFrame, seq: str, merges: Merges, sample: int = 50_000, text: str = "text") -> DataFrame:
    """(words, sample_words, sample_tokens, tokens_per_word, estimated_tokens): the ratio of the first `sample` words in order, carried over to all words.

    The sample is a feature here: whole texts in order of seq, and of the one that crosses its end the first words. Characters
    outside the vocabulary are skipped; a word of none of them has no tokens and still counts.
    """
    if sample < 1:
        raise ValueError("a sample of no words has no ratio")
    sizes = df.select(F.col(seq).alias("_s"), T.n_words(text, "space").cast("long").alias("_n"))
    first = scanned(sizes, "_s", _end="_n").where((F.col("_n") > 0) & (F.col("_end") - F.col("_n") < sample))
    rows = df.join(first, F.col(seq) == F.col("_s"))
    word = F.explode(F.slice(T.words(text, "space"), 1, F.least(F.lit(sample) - F.col("_end") + F.col("_n"), F.col("_n")).cast("int"))).alias("word")
    counted = rows.select(word).groupBy("word").agg(F.count("*").alias("n"))
    coded = counted.join(encode_words(counted, merges).select("word", F.size("tokens").alias("t")), "word")
    ratio = coded.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sample_words"), F.coalesce(F.sum(F.col("n") * F.col("t")), F.lit(0)).alias("sample_tokens"))
    words = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("words"))
    per = F.col("sample_tokens") / F.greatest(F.col("sample_words"), F.lit(1))
    return words.crossJoin(F.broadcast(ratio)).select("words", "sample_words", "sample_tokens", F.bround(per, 4).alias("tokens_per_word"), F.bround(F.col("words") * per).cast("long").alias("estimated_tokens"))


def _split(word: str) -> list[str]:
    return [*word, END_OF_WORD] if word != "\n" else ["\n"]


def encode_word(word: str, rank: dict[tuple[str, str], int]) -> list[str]:
    """The lowest-ranked adjacent pair merged everywhere, until none is known."""
    s = _split(word)
    while len(s) > 1:
        best = min(zip(s, s[1:], strict=False), key=lambda p: rank.get(p, len(rank)))
        if best not in rank:
            break
        s = joined(s, best)
    return s


def replay_word(word: str, merges: list[tuple[str, str]]) -> list[str]:
    """All merges in the order they were learned; differs from rank order where tokens repeat."""
    s = _split(word)
    for p in merges:
        s = joined(s, p)
    return s


def encode_words(words: DataFrame, merges: Merges, replay: bool = False, numbers: bool = False) -> DataFrame:
    """Adds `tokens` (and `ids`, if `numbers`) to distinct words, in Arrow batches; characters outside the vocabulary are dropped first."""
    sent = words.sparkSession.sparkContext.broadcast((merges.pairs, merges.rank, {t for t in merges.vocabulary if len(t) == 1}, merges.vocabulary, merges.ids if numbers else {}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, rank, known, vocabulary, ids = sent.value
        for b in batches:
            safe = ["".join(c for c in w if c in known) for w in b["word"]]
            tokens = [[t for t in (replay_word(w, pairs) if replay else encode_word(w, rank)) if t in vocabulary] if w else [] for w in safe]
            out = {"word": b["word"], "tokens": tokens, "skipped": [len(w) - len(s) for w, s in zip(b["word"], safe, strict=True)]}
            yield pd.DataFrame(out | ({"ids": [[ids[t] for t in own] for own in tokens]} if numbers else {}))

    return words.select("word").distinct().mapInPandas(run, "word string, tokens array<string>, skipped int" + ", ids array<int>" * numbers)


def token_counts(df: DataFrame, seq: str, merges: Merges, text: str = "text") -> DataFrame:
    """(seq, words, tokens, skipped): each distinct word is encoded once, whatever texts hold it."""
    words = df.select(seq, F.explode(T.words(text, "space")).alias("word")).groupBy(seq, "word").agg(F.count("*").alias("n"))
    coded = encode_words(words, merges).select("word", F.size("tokens").alias("t"), "skipped")
    return words.join(coded, "word").groupBy(seq).agg(F.sum("n").alias("words"), F.sum(F.col("n") * F.col("t")).alias("tokens"), F.sum(F.col("n") * F.col("skipped")).alias("skipped"))


def token_totals(frequency: DataFrame, merges: Merges) -> DataFrame:
    """One row (words, tokens) of counted words (word, n): what `token_counts` of the texts adds up to, without their places."""
    coded = encode_words(frequency, merges).select("word", F.size("tokens").alias("t"))
    return frequency.join(coded, "word").agg(F.sum("n").alias("words"), F.sum(F.col("n") * F.col("t")).alias("tokens"))


def coverage(df: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """(character, n): characters outside a vocabulary, counted."""
    chars = df.select(F.explode(F.split(F.regexp_replace(text, r"(?U)\s", ""), "")).alias("character")).where("character <> ''").groupBy("character").agg(F.count("*").alias("n"))
    return chars.join(known.select(F.col("token").alias("character")), "character", "left_anti")


def decode_tokens(tokens: str | Column) -> Column:
    """Tokens as text: end markers part words; then glued words, case gaps and punctuation are put right."""
    c = F.array_join(F.transform(T.col(tokens), lambda t: F.regexp_replace(t, f"{END_OF_WORD}$", " ")), "")
    c = T.strip(c)
    for w in L.GLUED_WORDS:
        c = F.regexp_replace(c, rf"(?i)([a-z0-9]+-[a-z0-9]+)({w})\b", "$1 $2")
    c = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"(?U)\s+([.,;:!?])", "$1")
    return T.one_line(F.regexp_replace(c, r"(?U)([.,;:!?])([^\s.,;:!?])", "$1 $2"))
