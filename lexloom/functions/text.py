"""Text as Column expressions: white space, word dialects, ratios, n-grams. All run inside the JVM.

Regular expressions carry (?U) where Unicode classes are meant; Java's defaults are ASCII. Each metric names its
word dialect, because results differ between them.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, functions as F

from . import lexicon as L

#: Word dialects: (pattern, how the text is folded first).
DIALECTS = {
    "unicode": (r"(?U)\w+", None),  # W1; runs of word characters end at word boundaries by themselves
    "hyphen": (r"(?U)\b[\w'-]+\b", None),  # W2
    "space": (r"(?U)\S+", None),  # W3
    "ascii": (r"[a-z0-9]+(?:'[a-z0-9]+)?", "casefold"),  # W4
    "mixed": (r"(?U)\n|\w+|[^\w\s]", None),  # W5
    "lower_space": (r"(?U)\S+", "lower"),  # W6
    "apostrophe": (r"[a-z0-9']+", "casefold"),  # W7
    "latin": (r"[a-z']+", "lower"),  # W9 (after lower-casing)
    "letters": (r"\b[a-z][a-z'-]*\b", "casefold"),  # W8, W10
}

# Characters that Unicode counts as white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row: lambdas would compute a captured expression for each item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def casefold(c: str | Column) -> Column:
    """Lower case with sharp s unfolded."""
    return F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))


def strip(c: str | Column) -> Column:
    """Without white space of any kind at the ends, which alone are looked at."""
    return F.btrim(col(c), F.lit(BLANKS))


def one_line(c: str | Column) -> Column:
    """Every run of white space as one space, ends stripped."""
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def tidy(c: str | Column) -> Column:
    """Line ends as \\n, runs of blanks as one, at most one empty line, ends stripped."""
    c = F.regexp_replace(col(c), r"\r\n|\r", "\n")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def tidy_lines(c: str | Column) -> Column:
    """Each line collapsed; empty lines gone."""
    lines = F.transform(F.split(col(c), LINE_END), one_line)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def lower_line(c: str | Column) -> Column:
    """Lower case on one line: the key of contamination checks."""
    return one_line(F.lower(col(c)))


def dedupe_key(c: str | Column) -> Column:
    """One line, folded: the key of pair deduplication."""
    return casefold(one_line(c))


def content_hash(c: str | Column) -> Column:
    return F.sha2(F.lower(tidy(c)), 256)


def words(c: str | Column, dialect: str) -> Column:
    """Array of a dialect's words; a column of ASCII text goes by the plain character classes, which are faster."""
    pattern, fold = DIALECTS[dialect]
    if isinstance(c, str) and not fold and dialect == "unicode":
        plain = F.regexp_extract_all(c, F.lit(pattern.removeprefix("(?U)")), F.lit(0))
        return F.when(F.octet_length(c) == F.length(c), plain).otherwise(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    c = {"lower": lambda x: F.lower(x), "casefold": casefold}.get(fold, lambda x: x)(col(c))
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def n_words(c: str | Column, dialect: str) -> Column:
    pattern, fold = DIALECTS[dialect]
    c = {"lower": lambda x: F.lower(x), "casefold": casefold}.get(fold, lambda x: x)(col(c))
    return F.regexp_count(c, F.lit(pattern))


def word_key(c: str | Column) -> Column:
    """ASCII words joined by spaces: the key of benchmark questions."""
    return F.array_join(words(c, "ascii"), " ")


def estimated_tokens(n: Column) -> Column:
    return (n * F.lit(L.TOKENS_PER_WORD)).cast("int")


def distinct_share(array: Column) -> Column:
    """Distinct over all items; 0 for none."""
    return F.when(F.size(array) > 0, F.size(F.array_distinct(array)) / F.size(array)).otherwise(0.0)


def repeated_share(array: Column, least: int = 1) -> Column:
    """Items beyond the first of their kind, over all; 0 unless there are more than `least`."""
    return F.when(F.size(array) > least, (F.size(array) - F.size(F.array_distinct(array))) / F.size(array)).otherwise(0.0)


def text_lines(c: str | Column) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(col(c), LINE_END), strip), lambda x: x != "")


def longest_run(c: str | Column) -> Column:
    """Characters in the longest run of one character."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(col(c), F.lit(r"(?s)(.)\1*"), F.lit(0)), lambda x: F.length(x))), F.lit(0))


def character_repetition(c: str | Column) -> Column:
    """The longest run of one character over all characters; 0 for none."""
    return F.when(F.length(col(c)) > 0, longest_run(c) / F.length(col(c))).otherwise(0.0)


def char_count(c: str | Column) -> Column:
    """Characters of the stripped text."""
    return F.length(strip(c))


def characters(c: str | Column) -> Column:
    """Array of single characters."""
    return F.filter(F.split(col(c), ""), lambda x: x != "")


def ngrams(array: Column, n: int) -> Column:
    """Array of n-grams, each joined by a character no word holds."""

    def cut(w: Column) -> Column:
        count = F.size(w) - (n - 1)
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), "\x1f"))).otherwise(F.array().cast("array<string>"))

    return let(array, cut)


def occurrences(c: Column, word: str) -> Column:
    """Non-overlapping occurrences of a substring; most texts hold none, which a plain search tells first."""
    return F.when(~F.contains(c, F.lit(word)), 0).otherwise((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("int")


def first_best(scores: dict[str, Column], fallback: str) -> Column:
    """The name of the largest score; the first of equals; the fallback when all are 0."""
    top = F.greatest(*scores.values())
    return F.when(top == 0, fallback).otherwise(_first(scores, top))


def _first(scores: dict[str, Column], top: Column) -> Column:
    chain = None
    for name, score in scores.items():
        chain = F.when(score == top, name) if chain is None else chain.when(score == top, name)
    return chain


def domain_counts(low: str | Column) -> dict[str, Column]:
    """For each domain, how often its keywords stand in a lower-cased text, as substrings."""
    return {d: sum((occurrences(col(low), k) for k in ks), F.lit(0)) for d, ks in L.CORPUS_DOMAINS.items()}


def corpus_domain(c: str | Column) -> Column:
    """Domain by how often its keywords stand in the text; `corpus.tag_domain` counts each only once for a table."""
    return first_best(domain_counts(F.lower(col(c))), "general")


def pair_domain(c: str | Column, source: str | Column | None = None) -> Column:
    """Domain by how many of its keywords stand in the text as words; a code source decides by itself."""
    low = casefold(c)
    found = first_best({d: sum((F.regexp_like(low, F.lit(rf"(?U)(?<!\w){k}(?!\w)")).cast("int") for k in ks), F.lit(0)) for d, ks in L.PAIR_DOMAINS.items()}, "general")
    return found if source is None else F.when(casefold(source).contains("codealpaca"), "software_engineering").otherwise(found)


def language_confidence(c: str | Column, low: str | Column | None = None) -> Column:
    """English markers among the words, and ASCII among the characters, weighted; 0 without a word.

    `low`: the text in lower case, where a table has it already.
    """
    c, low = col(c), F.lower(col(c)) if low is None else col(low)
    n_ascii = F.when(F.octet_length(c) == F.length(c), F.length(c)).otherwise(F.length(F.regexp_replace(c, r"[^\x00-\x7F]+", "")))
    ascii_share = n_ascii / F.greatest(F.length(c), F.lit(1))
    hits = lambda w: F.size(F.filter(w, lambda x: x.isin(*L.ENGLISH_MARKERS)))
    score = lambda w: F.when(F.size(w) > 0, F.least(F.lit(1.0), L.MARKER_WEIGHT * hits(w) / F.size(w) + L.ASCII_WEIGHT * ascii_share)).otherwise(0.0)
    # the text is cut once: markers are words, so they needn't be searched for by a pattern of their own
    return let(F.regexp_extract_all(low, F.lit(DIALECTS["latin"][0]), F.lit(0)), score)


def language(c: str | Column) -> Column:
    return F.when(language_confidence(c) >= L.ENGLISH_FROM, "en").otherwise("unknown")


def clean_lines(c: str | Column) -> Column:
    """Stripped lines without navigation, separators and footers; empty lines stay empty."""
    lines = F.transform(F.split(col(c), LINE_END), strip)
    bad = "|".join(f"(?i:{p.removeprefix('(?i)')})" for p in (L.NAVIGATION_LINE, L.SEPARATOR_LINE, L.FOOTER_LINE, L.PIPE_LINE))
    return F.filter(lines, lambda x: (x == "") | ~x.rlike(bad))


def clean_text(c: str | Column) -> Column:
    """Clean lines, tidied, each a paragraph of its own."""
    kept = F.filter(clean_lines(c), lambda x: x != "")
    return F.array_join(F.filter(F.transform(kept, lambda x: strip(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != ""), "\n\n")


def sentences(c: str | Column) -> Column:
    parts = F.split(strip(c), r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def sentence_count(c: str | Column) -> Column:
    return F.size(F.filter(F.split(col(c), r"[.!?]+"), lambda x: strip(x) != ""))


def shorten(c: str | Column) -> Column:
    """Leading sentences up to SHORTEN_SENTENCES or SHORTEN_WORDS words; at least SHORTEN_LEAST words if there are more.

    At most SHORTEN_SENTENCES sentences can stay, so the running count is written out over those.
    """

    def cut(s: Column) -> Column:
        first = [F.get(s, F.lit(i)) for i in range(L.SHORTEN_SENTENCES)]
        kept, words_before = F.array(first[0]), n_words(first[0], "hyphen")
        stays = F.lit(True)
        for x in first[1:]:
            stays = stays & x.isNotNull() & (words_before < L.SHORTEN_WORDS)
            kept = F.when(stays, F.array_append(kept, x)).otherwise(kept)
            words_before = words_before + F.coalesce(n_words(x, "hyphen"), F.lit(0))
        short = lambda k: (n_words(F.array_join(k, " "), "hyphen") < L.SHORTEN_LEAST) & (F.size(s) > F.size(k))
        return let(kept, lambda k: F.array_join(F.when(short(k), F.slice(s, 1, L.SHORTEN_SENTENCES)).otherwise(k), " "))

    line = one_line(c)
    return let(sentences(line), lambda s: F.when(F.size(s) == 0, line).otherwise(cut(s)))


def phrase_present(text: str | Column, phrase: str | Column) -> Column:
    """Whether a phrase's words stand in a text's words one after the other."""
    key = word_key(phrase)
    return (key != "") & F.concat(F.lit(" "), word_key(text), F.lit(" ")).contains(F.concat(F.lit(" "), key, F.lit(" ")))


def common_words(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of words: linear in their lengths, in Arrow batches.

    Higher-order functions can only count a word by walking the array again for each.
    """
    return _common_udf()(a, b)


def _common_udf():
    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        both = lambda x, y: 0 if x is None or y is None else (Counter(x) & Counter(y)).total()
        return pd.Series([both(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    return F.pandas_udf(count, "int")


def token_f1(text: str | Column, reference: str | Column) -> Column:
    """Harmonic mean of multiset precision and recall of ASCII words; 0 where either has none."""
    a, b = words(text, "ascii"), words(reference, "ascii")
    c = common_words(a, b)
    p, r = c / F.size(a), c / F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (c == 0), 0.0).otherwise(2 * p * r / (p + r))
