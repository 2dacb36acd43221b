"""Checks and transforms of answers and prompts, as Column expressions; word lists are arguments."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from . import lexicon as L, text as T
from .text import col

NOWHERE = 10**9


def _any(hits: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def _found(low: Column, words: tuple[str, ...], pattern: str) -> Column:
    return F.filter(F.array(*(F.when(F.regexp_like(low, F.lit(pattern.format(re.escape(w)))), w) for w in words)), lambda x: x.isNotNull())


def domain_consistency(c: str | Column, keywords: tuple[str, ...]) -> Column:
    """Share of keywords that stand in the text as substrings."""
    low = F.lower(col(c))
    return (sum((low.contains(k).cast("int") for k in keywords), F.lit(0)) / len(keywords)) if keywords else F.lit(0.0)


def topic_keywords(c: str | Column, keywords: tuple[str, ...], plural: bool = True) -> Column:
    """Keywords that stand as words, with or without a plural s."""
    return _found(T.casefold(T.one_line(c)), keywords, r"(?U)\b{}" + ("s?" if plural else "") + r"\b")


def contains_term(c: str | Column, term: str) -> Column:
    """A phrase as a substring, a single word as a word."""
    low = T.casefold(c)
    return low.contains(term) if " " in term else F.regexp_like(low, F.lit(rf"(?U)\b{re.escape(term)}\b"))


def verdicts(c: str | Column, expected: tuple[str, ...], forbidden: tuple[str, ...], least: int = 1, band: tuple[int, int] = (4, 70)) -> Column:
    """struct of an answer's checks; `passes` when all hold."""
    n = sum((contains_term(c, t).cast("int") for t in expected), F.lit(0))
    loop = T.let(T.words(c, "hyphen"), lambda w: (F.size(w) >= 6) & (F.size(T.ngrams(w, 3)) > F.size(F.array_distinct(T.ngrams(w, 3)))))
    parts = {"on_topic": n >= least, "routed": ~_any([contains_term(c, t) for t in forbidden]), "short": T.n_words(c, "hyphen").between(*band), "no_loop": ~loop, "grammar": ~grammar_issue(c)}
    return F.struct(*(v.alias(k) for k, v in parts.items()), reduce(lambda a, b: a & b, parts.values()).alias("passes"))


def grammar_issue(c: str | Column) -> Column:
    """A word twice in a row, or a noun in front of a bare article at the start."""
    start = rf"(?iU)^\s*(?:{'|'.join(L.BARE_NOUNS)})\s+(?:a|an|the)\b"
    return F.regexp_like(col(c), F.lit(r"(?iU)\b(\w+)\s+\1\b")) | F.regexp_like(col(c), F.lit(start))


def boundary_ok(c: str | Column, raw_starts: tuple[str, ...]) -> Column:
    """Not empty, no further user turn, and not the opening of raw corpus text."""
    low = T.casefold(T.one_line(c))
    return (low != "") & ~low.contains("<user>") & ~_any([low.startswith(p) for p in raw_starts])


def chat_response_ok(c: str | Column, topic: str | Column, repeated: str | Column, raw_starts: tuple[str, ...] = L.RAW_STARTS) -> Column:
    """An answer within its turn: not empty, no repetition, no further user turn, no marker or raw corpus text in front, and on its topic."""
    low = T.casefold(T.one_line(c))
    ahead = low.startswith("<assistant>") | low.startswith("<end>")
    return boundary_ok(c, raw_starts) & ~ahead & ~F.coalesce(col(repeated), F.lit(False)) & (F.coalesce(col(topic), F.lit(0.0)) > 0)


def clean_after_end(c: str | Column, raw_phrases: tuple[str, ...]) -> Column:
    """Nothing after the end marker, or nothing that looks like another turn or raw corpus text."""
    low = T.casefold(T.one_line(c))
    return (low == "") | ~(low.contains("<user>") | low.contains("<assistant>") | _any([low.contains(p) for p in raw_phrases]))


def drift(c: str | Column, topics: dict[str, tuple[str, ...]], score: Column, thresholds: dict[str, int] | None = None) -> Column:
    """Whether an unrelated topic shows (by its number of keywords) while the topic score is under 0.4."""
    low = T.casefold(c)
    hits = lambda words: sum((F.regexp_like(low, F.lit(rf"(?U)\b{re.escape(w)}\b")).cast("int") for w in words), F.lit(0))
    return (score < 0.4) & _any([hits(words) >= (thresholds or {}).get(t, 1) for t, words in topics.items()])


def remove_phrases(c: str | Column, phrases: tuple[str, ...]) -> Column:
    return T.one_line(reduce(lambda a, p: F.replace(a, F.lit(p), F.lit(" ")), phrases, T.strip(c)))


def first_sentence(c: str | Column) -> Column:
    return T.let(T.sentences(T.one_line(c)), lambda s: F.coalesce(F.get(s, F.lit(0)), F.lit("")))


def padded_definition(definition: str | Column, importance: str | Column, band: tuple[int, int] = (12, 35), most: int = 12) -> Column:
    """The definition's first sentence; if it is short, with the importance's, where that fits the band."""
    a, b = first_sentence(definition), first_sentence(importance)
    both = F.concat_ws(" ", a, b)
    fits = (b != "") & (T.n_words(b, "hyphen") <= most) & T.n_words(both, "hyphen").between(*band)
    return F.when((T.n_words(a, "hyphen") < band[0]) & fits, both).otherwise(a)


def phrase_position(c: str | Column, phrase: str | Column) -> Column:
    """Character place of a phrase among normalised words; NOWHERE if missing."""
    key = T.word_key(phrase)
    at = F.position(key, T.word_key(c)) - 1
    return F.when((key == "") | (at < 0), NOWHERE).otherwise(at)


def phrase_word_position(c: str | Column, phrase: str | Column) -> Column:
    """Word place of a phrase; NOWHERE if missing."""
    pair = F.struct(T.words(c, "ascii").alias("w"), T.words(phrase, "ascii").alias("p"))

    def find(x: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(x["w"]) - F.size(x["p"]), F.lit(0))), lambda i: F.slice(x["w"], i + 1, F.size(x["p"])) == x["p"])
        return F.when(F.size(x["p"]) > 0, F.coalesce(F.get(at, F.lit(0)), F.lit(NOWHERE))).otherwise(NOWHERE)

    return T.let(pair, find)


def exact(c: str | Column, reference: str | Column) -> Column:
    """Equal normalised words, and some."""
    return (T.word_key(reference) != "") & (T.word_key(c) == T.word_key(reference))


def exact_start(c: str | Column, reference: str | Column, n: int = 4) -> Column:
    """The reference's first words open the text."""
    a, b = T.words(T.casefold(T.one_line(c)), "hyphen"), T.words(T.casefold(T.one_line(reference)), "hyphen")
    head = F.slice(b, 1, n)
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.slice(a, 1, F.greatest(F.size(head), F.lit(1))) == head)


def keyword_set(c: str | Column, stopwords: tuple[str, ...]) -> Column:
    """Distinct words of four letters on that aren't stop words, without plural s."""
    stop = F.array(*map(F.lit, stopwords)) if stopwords else F.array().cast("array<string>")
    kept = F.filter(T.words(c, "letters"), lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w))
    return F.array_distinct(F.transform(kept, lambda w: F.regexp_replace(w, "s+$", "")))


def keyword_overlap(c: str | Column, reference: str | Column, stopwords: tuple[str, ...]) -> Column:
    want = keyword_set(reference, stopwords)
    return F.when(F.size(want) > 0, F.size(F.array_intersect(want, keyword_set(c, stopwords))) / F.size(want)).otherwise(0.0)


def until_stop(c: str | Column, stop: str | None) -> Column:
    """Text in front of a stop sequence, without white space at its end."""
    return F.when(col(c).contains(stop), F.regexp_replace(F.substring_index(col(c), stop, 1), r"(?U)\s+$", "")).otherwise(col(c)) if stop else col(c)


def whole_sentences(c: str | Column, least: int = 1, most: int = 5) -> Column:
    """At most so many sentences; an unfinished last one goes unless it is all there is."""
    t = F.regexp_replace(col(c), r"(?U)\s+$", "")
    done = t.rlike(r"[.!?]$")

    def cut(s: Column) -> Column:
        kept = F.slice(F.when(done | (F.size(s) <= 1), s).otherwise(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(1)))), 1, most)
        lone = ~done & (F.size(s) == 1)
        return F.when(F.size(s) == 0, t).when(lone, F.regexp_replace(t, "[ ,;:-]+$", "")).when(F.size(kept) < least, t).otherwise(F.array_join(kept, " "))

    return T.let(T.sentences(t), cut)


def after_prompt(c: str | Column, prompt: str | Column) -> Column:
    """The text behind the prompt it repeats; all of it if it doesn't."""
    return F.when(F.startswith(col(c), col(prompt)), F.substr(col(c), F.length(col(prompt)) + 1)).otherwise(col(c))


def styled_prompt(prompt: str | Column, style: str | None = None, hint: str | Column | None = None, templates: dict[str, str] | None = None) -> Column:
    """A prompt in a style (None as it is, "paragraph" with its prefix), behind its domain's hint if there is one."""
    if style not in (None, "paragraph"):
        raise ValueError(f"unknown style {style!r}; one of paragraph")
    own = F.concat(F.lit(L.PARAGRAPH_PREFIX), col(prompt)) if style else col(prompt)
    return own if hint is None else with_hint(own, hint, templates or {})


def with_hint(prompt: str | Column, hint: str | Column, templates: dict[str, str]) -> Column:
    """A prompt behind its domain's hint; unknown domains get a plain one."""
    key = F.regexp_replace(F.lower(T.strip(hint)), "[ -]", "_")
    chain = reduce(lambda a, kv: F.when(key == kv[0], kv[1]).otherwise(a), templates.items(), F.concat(F.lit("This text is about "), F.replace(T.strip(hint), F.lit("_"), F.lit(" ")), F.lit(". ")))
    return F.when(F.coalesce(T.strip(hint), F.lit("")) == "", col(prompt)).otherwise(F.concat(chain, col(prompt)))


# Number words below one hundred are made from these.
ONES = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")


def number_words(n: str | Column) -> Column:
    """Whole numbers below one hundred in words, others in digits."""
    n = col(n).cast("int")
    ones, tens = F.array(*map(F.lit, ONES)), F.array(*map(F.lit, TENS))
    two = F.concat(F.get(tens, (n / 10).cast("int")), F.when(n % 10 > 0, F.concat(F.lit(" "), F.get(ones, n % 10))).otherwise(""))
    return F.when((n >= 0) & (n < 20), F.get(ones, n)).when((n >= 20) & (n < 100), two).otherwise(n.cast("string"))


def percent(c: str | Column) -> Column:
    return F.format_string("%.1f%%", 100.0 * col(c))


def trailing_run(c: str | Column) -> Column:
    """How often the last character repeats at the end."""
    return F.length(F.regexp_extract(col(c), r"(?s)(.)\1*$", 0))


def block_size(ids: str | Column, desired: int) -> Column:
    """Aggregate: the desired length, capped by the shortest example less one, at least two."""
    return F.greatest(F.lit(2), F.least(F.lit(desired), F.min(F.size(col(ids))) - 1))


def top_k(logits: str | Column, k: int) -> Column:
    """Logits below the k-th largest as negative infinity."""
    floor = lambda a: F.element_at(F.sort_array(a, asc=False), F.least(F.lit(k), F.size(a)))
    return T.let(col(logits), lambda a: F.transform(a, lambda x: F.when(x >= floor(a), x).otherwise(float("-inf"))))


def top_p(logits: str | Column, p: float) -> Column:
    """Logits outside the smallest set of the largest ones whose chances pass p as negative infinity; the first always stays.

    Of equal logits those in front count first. p of 0 or less, or 1 and more: all as they are.
    """
    if not 0.0 < p < 1.0:
        return col(logits)

    def cut(a: Column) -> Column:
        top = F.array_max(a)
        placed = F.array_sort(F.transform(a, lambda x, i: F.struct((-x).alias("z"), i.alias("i"))))
        chance = F.transform(placed, lambda s: F.exp(-s["z"] - top))
        total = F.aggregate(chance, F.lit(0.0), lambda s, x: s + x)
        # place of the first one whose sum passes p: it stays, what is behind it goes
        walk = F.aggregate(chance, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["n"] + (s["sum"] <= p * total).cast("int")).alias("n")))
        kept = F.transform(F.slice(placed, 1, walk["n"]), lambda s: s["i"])
        return T.let(kept, lambda k: F.transform(a, lambda x, i: F.when(F.array_contains(k, i), x).otherwise(float("-inf"))))

    return T.let(col(logits), cut)


def _counted(ids: str | Column, window: int | None) -> Column:
    recent = col(ids) if window is None else F.slice(col(ids), F.greatest(F.size(col(ids)) - window + 1, F.lit(1)), window)
    return recent


def repetition_penalty(logits: str | Column, ids: str | Column, penalty: float = 1.15, window: int = 64) -> Column:
    """Logits of the last `window` ids made less likely, once for each time they stand there."""
    if penalty <= 1.0:
        return col(logits)
    times = lambda i, r: F.size(F.filter(r, lambda x: x == i))
    shrink = lambda x, f: F.when(x > 0, x / f).otherwise(x * f)
    return T.let(_counted(ids, window), lambda r: F.transform(col(logits), lambda x, i: shrink(x, F.pow(F.lit(penalty), times(i, r)))))


def presence_penalty(logits: str | Column, ids: str | Column, penalty: float = 0.0) -> Column:
    """Logits of ids that stand anywhere before, less the penalty."""
    return col(logits) if penalty <= 0.0 else F.transform(col(logits), lambda x, i: x - F.when(F.array_contains(col(ids), i), penalty).otherwise(0.0))


def ngram_ban(logits: str | Column, ids: str | Column, n: int) -> Column:
    """Negative infinity for each id that would complete an n-gram which the ids hold already."""
    if n < 2:
        return col(logits)

    def cut(a: Column) -> Column:
        tail = F.slice(a, F.greatest(F.size(a) - n + 2, F.lit(1)), n - 1)
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(a) - n + 1, F.lit(1))), lambda i: F.slice(a, i, n - 1) == tail)
        banned = F.when(F.size(a) >= n, F.transform(at, lambda i: F.get(a, i + n - 2))).otherwise(F.array().cast("array<int>"))
        return T.let(banned, lambda b: F.transform(col(logits), lambda x, i: F.when(F.array_contains(b, i), float("-inf")).otherwise(x)))

    return T.let(col(ids).cast("array<int>"), cut)


def postprocessed(c: str | Column, stop: str | None, least: int = 1, most: int = 5) -> Column:
    """Text in front of the stop sequence, cut to whole sentences."""
    return whole_sentences(until_stop(c, stop), least, most)


def technical(c: str | Column) -> Column:
    """Whether a technical keyword stands as a word, with or without a plural s."""
    return F.regexp_like(T.casefold(c), F.lit(rf"(?U)\b(?:{'|'.join(L.TECHNICAL_KEYWORDS)})s?\b"))


def teacher_verdict(c: str | Column, expected: tuple[str, ...], band: tuple[int, int] = (4, 70)) -> Column:
    """An answer that names an expected term, in so many words, and repeats no three of them."""
    w = T.words(T.casefold(T.one_line(c)), "hyphen")
    named = _any([contains_term(c, t) for t in expected])
    loop = T.let(T.ngrams(w, 3), lambda g: F.size(g) > F.size(F.array_distinct(g)))
    return named & F.size(w).between(*band) & ~(loop & (F.size(w) >= 6))


def chat_verdict(c: str | Column, raw_starts: tuple[str, ...], raw_phrases: tuple[str, ...], end: str = L.END) -> Column:
    """A generated turn that stays within its bounds, with nothing of another turn or raw text behind the end marker."""
    head, tail = F.substring_index(col(c), end, 1), F.when(F.contains(col(c), F.lit(end)), F.substr(col(c), F.locate(end, col(c)) + len(end))).otherwise("")
    return boundary_ok(head, raw_starts) & clean_after_end(tail, raw_phrases)
