"""URL filters: longest-match rules, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import map_batches

#: Hash buckets; lengths of character n-grams; ridge; probability of "block" from which a URL is blocked.
BUCKETS, GRAMS, RIDGE, BLOCK = 1 << 14, (3, 4, 5), 0.05, 0.5
#: Labelled URLs that a model learns from, at most.
LABELLED_ROWS = 20_000

#: Rules by host and path; a rule fits its host and all subdomains, and paths that start with its path.
RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)

# Words that name a site's purpose, unwanted or wanted, and words that say nothing about it. Of these the
# default table is made up; a user's own table takes its place.
_UNWANTED = "casino poker bingo roulette blackjack jackpot slots bet bets betting lottery win pills pharmacy viagra replica loan payday xxx adult sex porn escort spam farm ads track tracker warez keygen"
_WANTED = "library museum weather school news docs blog wiki council data maps recipes history science forum archive theatre university garden music travel health sport language poetry birds energy law cinema market"
_NEUTRAL = "blue north river hill city old best quick super little open first house team world point"
_TAILS = (".test/en/page", ".invalid/fr/12.html", ".test/", ".invalid/de/4?page=2", ".test/es/index#top")


def sample_table(per_word: int = 6) -> tuple[tuple[str, int], ...]:
    """(url, 1 for block): each purpose with some neutral words before or behind it, under hosts that can't exist."""
    out, neutral = [], _NEUTRAL.split()
    for block, names in ((1, _UNWANTED), (0, _WANTED)):
        for k, word in enumerate(names.split()):
            for j in range(per_word):
                other = neutral[(5 * k + 3 * j) % len(neutral)]
                host = f"{word}-{other}" if j % 2 else f"{other}-{word}"
                out.append((f"https://{'www.' if (k + j) % 3 == 0 else ''}{host}{_TAILS[(k + j) % len(_TAILS)]}", block))
    return tuple(out)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path as they stand; both empty for null or without ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return host.translate(_LOWER), rest[:end]


_LOWER = {c: c + 32 for c in range(65, 91)}


def grams(part: str, text: str) -> list[int]:
    """Buckets of a part's character n-grams, with marked ends."""
    t = f"^{text}$"
    return [xxhash.xxh3_64_intdigest(f"{part}{t[i : i + n]}") % BUCKETS for n in GRAMS for i in range(len(t) - n + 1)]


def features(host: str, path: str) -> np.ndarray:
    """Distinct buckets; digits count as one character, since they only number things."""
    path = "".join("0" if c.isdigit() else c for c in path)
    return np.unique(np.array(grams("h", host) + grams("p", path), np.int64))


def labelled_rows(labelled: DataFrame | Iterable[tuple[str, int]], most: int) -> list[tuple[str, int]]:
    """(url, label) without nulls; at most `most` of a table's distinct rows, the first by a hash."""
    if isinstance(labelled, DataFrame):
        table = labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("int").alias("label")).where("url IS NOT NULL AND label IN (0, 1)").distinct()
        return [(r.url, r.label) for r in table.orderBy(F.xxhash64("url"), "url", "label").limit(most).collect()]
    return [(u, y) for u, y in labelled if u is not None and y in (0, 1)]


def fit(labelled: Iterable[tuple[str, int]], rounds: int = 1500, rate: float = 4.0) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent with a ridge; the table is small by contract, so this runs at once.

    An empty table, or one of a single label, gives what the bias alone learns: 0.5 without any row.
    """
    found = [(features(*split_url(u)), y) for u, y in labelled]
    y, size = np.array([y for _, y in found], float), np.array([len(f) for f, _ in found], np.int64)
    row, col = np.repeat(np.arange(len(y)), size), np.concatenate([np.zeros(0, np.int64), *(f for f, _ in found)])
    value, n = 1 / np.sqrt(np.maximum(size, 1))[row], max(len(y), 1)
    weight, bias = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        miss = (1 / (1 + np.exp(-(np.bincount(row, value * weight[col], len(y)) + bias))) - y) / n
        weight -= rate * (np.bincount(col, value * miss[row], BUCKETS) + RIDGE / n * weight)
        bias -= rate * miss.sum()
    return weight, bias


class Rules:
    """Rules by host, so that a URL looks up its host's suffixes only; longest (host and path) wins."""

    def __init__(self, rules=RULES):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host.lower(), []).append((path, verdict))
        for own in self.by_host.values():
            own.sort(key=lambda x: -len(x[0]))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict): the rule of most characters, host and path together; of equals the longer host."""
        best, labels = None, host.split(".")
        for k in range(len(labels)):
            suffix = ".".join(labels[k:])
            for start, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start):
                    if best is None or len(suffix) + len(start) > len(best[0]):
                        best = (suffix + start, verdict)
                    break
        return best


def judge_urls(pages: DataFrame, labelled: DataFrame | Iterable[tuple[str, int]] | None = None, *, page_id: str = "page_id", url: str = "url", rules=RULES, most: int = LABELLED_ROWS) -> DataFrame:
    """(id, host, path, rule, verdict, score) per row, in one pass over the url column alone.

    labelled: a table (url, label), label 1 for block, of which at most `most` rows are learned from, or such pairs;
    without it the table of `sample_table`. Null urls and those without :// have empty host and path; no rule
    fits them and the model judges the empty parts. Ties between rules: the longer host. Repeated rows: each its
    own. Very long urls are judged whole. Empty table: no rows.
    """
    model = pages.sparkSession.sparkContext.broadcast(fit(labelled_rows(sample_table() if labelled is None else labelled, most)))
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        own, (weight, bias) = Rules(rules), model.value

        for b in batches:
            out: dict[str, list] = {"id": b["id"], "host": [], "path": [], "rule": [], "verdict": [], "score": []}
            for u in b["url"].to_pylist():
                host, path = split_url(u)
                rule = own.match(host, path)
                f = features(host, path)
                score = float(1 / (1 + np.exp(-(weight[f].sum() / np.sqrt(len(f) or 1) + bias))))
                verdict = rule[1] if rule else "block" if score >= BLOCK else "allow"
                for k, v in zip(("host", "path", "rule", "verdict", "score"), (host, path, rule and rule[0], verdict, score), strict=True):
                    out[k].append(v)
            yield out

    return map_batches(rows, run, "id long, host string, path string, rule string, verdict string, score double", rows=4096)
