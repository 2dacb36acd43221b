"""Byte-pair merges learned on the cluster, exactly as one after the other, many in a round.

Words and pair counts stay in tables. A round guesses the next merges from a bounded sample of the most frequent words;
every task then merges the guessed pairs in its own words, one by one, and reports only what each step changes: counts of
pairs beside the merged ones. Summed up, these changes tell the most frequent pair after every step. The guess stands as
far as it names that pair each time; the first pair that it missed begins the next round. So a poor guess costs rounds,
never a wrong merge, and the driver holds guessed pairs and the best pair of each step, no words.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..shared import cut_batches, discard, shared_dir, stash

END_OF_WORD = "</w>"

# Why learning stops.
REACHED, NO_PAIRS, ALREADY = "target_vocab_reached", "no_adjacent_symbol_pairs_left", "initial_vocab_already_reaches_target"

#: Merges guessed for a round, at most; words and pairs that the guess is made from, at most; words for which a task is made;
#: words, and their symbols or bytes, that a task holds at once (Spark reads several small files in one task); changes that it sums up.
AHEAD, GUESS_WORDS, GUESS_PAIRS, TASK_WORDS = 64, 1 << 14, 1 << 14, 50_000
HELD_WORDS, HELD_SYMBOLS, HELD_BYTES, HELD_CHANGES = 16_384, 1 << 18, 1 << 21, 1 << 17


@dataclass
class Merges:
    """Learned merges in order, the vocabulary, and why learning stopped."""

    pairs: list[tuple[str, str]] = field(default_factory=list)
    vocabulary: set[str] = field(default_factory=set)
    initial: int = 0
    repeated_tokens: int = 0
    stopped: str = REACHED
    alphabet: frozenset[str] = frozenset()

    @property
    def rank(self) -> dict[tuple[str, str], int]:
        out: dict[tuple[str, str], int] = {}
        for k, p in enumerate(self.pairs):
            out.setdefault(p, k)
        return out

    @property
    def ids(self) -> dict[str, int]:
        return {t: k for k, t in enumerate(sorted(self.vocabulary))}

    def add(self, pair: tuple[str, str]) -> None:
        self.repeated_tokens += pair[0] + pair[1] in self.vocabulary
        self.pairs.append(pair)
        self.vocabulary.add(pair[0] + pair[1])

    def until(self, target: int) -> Merges:
        """What learning with a smaller target would have given: the beginning of these merges."""
        out = Merges(vocabulary=set(self.alphabet), initial=self.initial, alphabet=self.alphabet, stopped=self.stopped)
        for pair in self.pairs:
            if len(out.vocabulary) >= target:
                break
            out.add(pair)
        if len(out.vocabulary) >= target:
            out.stopped = REACHED if out.pairs else ALREADY
        return out


def symbols(word: str | Column) -> Column:
    """A word's characters and the end marker; a lone line end is itself."""
    c = T.col(word)
    return F.when(c == "\n", F.array(F.lit("\n"))).otherwise(F.array_append(F.split(c, ""), F.lit(END_OF_WORD)))


def joined(symbols_: list[str], pair: tuple[str, str]) -> list[str]:
    """All of a pair merged, from the left, without overlap."""
    out: list[str] = []
    k = 0
    while k < len(symbols_):
        if k + 1 < len(symbols_) and (symbols_[k], symbols_[k + 1]) == pair:
            out.append(pair[0] + pair[1])
            k += 2
        else:
            out.append(symbols_[k])
            k += 1
    return out


class PairIndex:
    """A task's words with counts of adjacent pairs, and which words may hold each; kept up to date as pairs merge."""

    def __init__(self, words: list[list[str]], counts: list[int]):
        self.words, self.counts = words, counts
        self.total: Counter[tuple[str, str]] = Counter()
        self.held: dict[tuple[str, str], set[int]] = {}
        for k, w in enumerate(words):
            for p in pairwise(w):
                self.total[p] += counts[k]
                self.held.setdefault(p, set()).add(k)
        self.queue: list[tuple[int, tuple[str, str]]] | None = None

    def best(self) -> tuple[str, str] | None:
        """The most frequent pair, of equals the smallest; entries of the queue whose count has changed are skipped."""
        if self.queue is None:
            self.queue = [(-n, p) for p, n in self.total.items()]
            heapq.heapify(self.queue)
        while self.queue:
            n, p = self.queue[0]
            if n < 0 and self.total.get(p) == -n:
                return p
            heapq.heappop(self.queue)
        return None

    def places(self) -> dict[tuple[str, str], tuple[int, int]]:
        """For each pair the first word that holds it, and where in that word."""
        out: dict[tuple[str, str], tuple[int, int]] = {}
        for k, w in enumerate(self.words):
            for i, p in enumerate(pairwise(w)):
                out.setdefault(p, (k, i))
        return out

    def merge(self, pair: tuple[str, str]) -> dict[tuple[str, str], int]:
        """Merge a pair in all words; gives the counts that change: those of the pair and of pairs beside it."""
        change: Counter[tuple[str, str]] = Counter()
        for k in self.held.pop(pair, ()):
            old, n = self.words[k], self.counts[k]
            new = joined(old, pair)
            if len(new) == len(old):
                continue  # merged away before
            for p in pairwise(old):
                change[p] -= n
            for p in pairwise(new):
                change[p] += n
                self.held.setdefault(p, set()).add(k)
            self.words[k] = new
        change = {p: n for p, n in change.items() if n}
        for p, n in change.items():
            self.total[p] += n
            if self.queue is not None and self.total[p] > 0:
                heapq.heappush(self.queue, (-self.total[p], p))
            if not self.total[p]:
                del self.total[p]
        return change


Pair = tuple[str, str]


def _index(rows: pd.DataFrame, done: list[Pair], counts: list[int]) -> PairIndex:
    """Words after the merges that their table hasn't seen."""
    index = PairIndex([list(s) for s in rows["s"]], counts)
    for p in done:
        index.merge(p)
    return index


def _all(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A task's words in order of seq."""
    return pd.concat([*batches, pd.DataFrame({"n": [], "s": [], "seq": [], "g": []})]).sort_values("seq", kind="stable")


def _held(batches: Iterator[pd.DataFrame], most: int, size: int) -> Iterator[pd.DataFrame]:
    """A task's words by and by, each time at most `most` of about `size` symbols, or one word; each portion in order of seq."""
    for b in batches:
        start, ends = 0, b["s"].map(len).cumsum().to_numpy()
        while start < len(b):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + most, int(ends.searchsorted(before + size, side="right"))))
            yield b.iloc[start:stop].sort_values("seq", kind="stable")
            start = stop


def _guess(words: DataFrame, pairs: DataFrame, done: list[Pair], known: Pair, want: int) -> list[Pair]:
    """The known next merge and those that would follow, as one task estimates them from a bounded sample.

    Counts of the most frequent pairs are the true ones; what a merge changes beside it is taken from the sample, in
    which a word stands for `g` of its frequency, in the proportion of the merged pair's true count.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _all(batches)
        true, rows = rows[rows["g"] == 0], rows[rows["g"] > 0]
        index = _index(rows, done, [int(n * g) for n, g in zip(rows["n"], rows["g"], strict=True)])
        counts: dict[Pair, float] = dict(index.total) | {tuple(s): float(n) for s, n in zip(true["s"], true["n"], strict=True)}
        queue = [(-n, p) for p, n in counts.items()]
        heapq.heapify(queue)
        out, pair = [], known
        while pair is not None and len(out) < want:
            out.append(pair)
            share = counts.get(pair, 0) / max(index.total.get(pair, 0), 1)
            for p, d in index.merge(pair).items():
                counts[p] = counts.get(p, 0) + d * share
                heapq.heappush(queue, (-counts[p], p))
            counts[pair] = 0
            while queue and counts[queue[0][1]] != -queue[0][0]:
                heapq.heappop(queue)
            pair = queue[0][1] if queue and queue[0][0] < 0 else None
        yield pd.DataFrame({"k": range(len(out)), "a": [a for a, _ in out], "b": [b for _, b in out]})

    top = pairs.orderBy(F.desc("n"), "a", "b").limit(GUESS_PAIRS).select("n", F.array("a", "b").alias("s"), F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("g"))
    rows = words.where("g > 0").unionAll(top).coalesce(1).mapInPandas(run, "k int, a string, b string").collect()
    return [(r.a, r.b) for r in sorted(rows, key=lambda r: r.k)] or [known]


_WORDS = "n long, s array<string>, seq long, g int"


def _holding(s: pa.ListArray, pairs: list[Pair]) -> np.ndarray:
    """Which rows of an array of symbols hold any of the pairs, by numbers of the symbols."""
    ends = s.offsets.to_numpy()
    flat = s.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    codes, number = flat.indices.to_numpy().astype(np.int64), {c: k for k, c in enumerate(flat.dictionary.to_pylist())}
    wanted = [number[a] * len(number) + number[b] for a, b in pairs if a in number and b in number]
    out = np.zeros(len(s), bool)
    at = np.flatnonzero(np.isin(codes[:-1] * len(number) + codes[1:], wanted))
    row = np.searchsorted(ends - ends[0], at, side="right") - 1
    out[row[at + 1 < (ends - ends[0])[row + 1]]] = True  # both symbols stand in one row
    return out


class _Steps:
    """Pairs in the order in which they merge, and the merges that a word takes of them."""

    def __init__(self, pairs: list[Pair]):
        self._of: dict[Pair, list[int]] = {}
        for k, p in enumerate(pairs, 1):
            self._of.setdefault(p, []).append(k)
        self._pairs, self._never = pairs, len(pairs) + 1

    def of(self, word: list[str]) -> Iterator[tuple[int, list[str], list[str]]]:
        """(step, before, after) of each merge that changes the word: always the next step that one of its pairs has."""
        last = 0
        while True:
            near = [k for p in pairwise(word) if p in self._of for k in self._of[p] if k > last]
            if not near:
                return
            last = min(near)
            merged = joined(word, self._pairs[last - 1])
            yield last, word, merged
            word = merged


def _tried(words: DataFrame, done: list[Pair], guess: list[Pair]) -> DataFrame:
    """The words after `done`, and rows (step, a, b, d) of what merging the guessed pairs one by one changes.

    A merge can only begin in a word that holds one of the pairs; all others go on as they came.
    """
    schema = pa.schema([("n", pa.int64()), ("s", pa.list_(pa.string())), ("seq", pa.int64()), ("g", pa.int32()), ("step", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("d", pa.int64())])

    def told(changes: Counter[tuple[int, str, str]]) -> pa.RecordBatch:
        step, a, b = zip(*changes, strict=True)
        gone = [pa.nulls(len(changes), t) for t in schema.types[:4]]
        return pa.RecordBatch.from_arrays([*gone, pa.array(step, pa.int32()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(changes.values(), pa.int64())], schema=schema)

    def kept(n: pa.Array, s: pa.Array, seq: pa.Array, g: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip((n, s, seq, g), schema.types, strict=False)] + [pa.nulls(len(n), t) for t in schema.types[4:]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changes: Counter[tuple[int, str, str]] = Counter()
        before, tries = _Steps(done), _Steps(guess)
        for b in cut_batches(batches, HELD_WORDS, HELD_BYTES):
            held = pa.array(_holding(b["s"], done + guess))
            rest, b = b.filter(pc.invert(held)), b.filter(held)
            yield kept(*(rest[c] for c in ("n", "s", "seq", "g")))
            now = []
            for n, word in zip(b["n"].to_pylist(), b["s"].to_pylist(), strict=True):
                for _, _, word in before.of(word):
                    pass
                now.append(word)
                for step, old, new in tries.of(word):
                    change = Counter(pairwise(new))
                    change.subtract(pairwise(old))
                    for (x, y), d in change.items():
                        if d:
                            changes[step, x, y] += n * d
            yield kept(b["n"], pa.array(now, schema.types[1]), b["seq"], b["g"])
            if len(changes) > HELD_CHANGES:
                yield told(changes)
                changes.clear()
        if changes:
            yield told(changes)

    return words.mapInArrow(run, _WORDS + ", step int, a string, b string, d long")


def _extremes() -> tuple[Column, Column]:
    """Of pairs (a, b, c): the most frequent one, of equals the smallest (low), and of equals the largest (high)."""
    return F.min(F.struct((-F.col("c")).alias("m"), "a", "b")).alias("low"), F.max(F.struct("c", "a", "b")).alias("high")


class _Best:
    """The most frequent pair of a state, how frequent it is, and whether others are as frequent."""

    def __init__(self, rows: list):
        rows = [r for r in rows if r.low is not None]
        self.n = max((r.high.c for r in rows), default=0)
        rows = [r for r in rows if r.high.c == self.n]
        self.pair: Pair | None = min(((r.low.a, r.low.b) for r in rows), default=None)
        self.tied = self.pair is not None and any((r.high.a, r.high.b) != self.pair for r in rows)


def _bests(pairs: DataFrame, changes: DataFrame, guess: list[Pair], folder: str, k: int) -> list[_Best]:
    """The best pair of each state, before any guessed merge and after each but the last, as far as the guess may be right.

    The best count never rises as pairs merge. So a guess that is more frequent than the one before it shows that one to be
    wrong, and up to there only pairs as frequent as the last guessed one can be the best of any state.
    """
    spark = pairs.sparkSession
    touched = changes.select("a", "b").distinct()
    base = pairs.join(touched, ["a", "b"], "left_semi").select("a", "b", F.lit(0).alias("step"), F.col("n").alias("d"))
    w = Window.partitionBy("a", "b").orderBy("step")
    path = changes.select("a", "b", "step", "d").unionAll(base).withColumn("c", F.sum("d").over(w)).withColumn("next", F.coalesce(F.lead("step").over(w), F.lit(len(guess))))
    path = stash(path.where("c > 0 AND step < next").select("a", "b", "c", "step", "next"), folder, f"path-{k}")
    asked = F.broadcast(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(guess)], "k int, a string, b string"))
    found = {r.k: r.c for r in path.join(asked, ["a", "b"]).where("step <= k AND k < next").select("k", "c").collect()}
    counts = [found.get(i, 0) for i in range(len(guess))]
    end = next((i for i in range(1, len(guess)) if counts[i] > counts[i - 1]), len(guess))
    near = path.where((F.col("c") >= counts[end - 1]) & (F.col("step") < end))
    states = near.select("a", "b", "c", F.explode(F.sequence(F.col("step"), F.least(F.col("next"), F.lit(end)) - 1)).alias("k"))
    moving = {r.k: r for r in states.groupBy("k").agg(*_extremes()).collect()}
    still = pairs.join(touched, ["a", "b"], "left_anti").withColumn("c", F.col("n")).agg(*_extremes()).first()
    discard(spark, folder, f"path-{k}")
    return [_Best([r for r in (moving.get(i), still) if r is not None]) for i in range(end)]


def _first_counted(words: DataFrame, done: list[Pair], pairs: DataFrame, n: int) -> Pair:
    """Of the pairs that occur n times, the one that stands first in the words' own order: the least place of any task's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _held(batches, HELD_WORDS, HELD_SYMBOLS):
            seq = rows["seq"].astype("int64").tolist()
            found = _index(rows, done, rows["n"].astype("int64").tolist()).places()
            yield pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found], "seq": [seq[k] for k, _ in found.values()], "i": [i for _, i in found.values()]})

    tied = pairs.where(F.col("n") == n).select("a", "b")
    row = words.mapInPandas(run, "a string, b string, seq long, i int").join(tied, ["a", "b"], "left_semi").agg(F.min(F.struct("seq", "i", "a", "b")).alias("x")).first().x
    return row.a, row.b


def _prepared(frequency: DataFrame, folder: str, ordered: bool, guess_words: int) -> DataFrame:
    """Words as (n, s, seq, g), in partitions of about TASK_WORDS at most; g: how often the word counts in the guess, 0 if it has no part in it."""
    spark = frequency.sparkSession
    raw = stash(frequency.select("word", F.col("n").cast("long").alias("n"), (F.col("seq").cast("long") if ordered else F.lit(0).cast("long")).alias("seq")), folder, "counted")
    total = raw.count()
    least, share = 0, 1
    if total > guess_words:
        least = raw.select("n").orderBy(F.desc("n")).limit(guess_words).agg(F.min("n")).first()[0]
        room = max(1, guess_words - raw.where(F.col("n") > least).count())
        share = -(-raw.where(F.col("n") == least).count() // room)
    chosen = F.when(F.col("n") > least, 1).when((F.col("n") == least) & (F.pmod(F.xxhash64("word"), F.lit(share)) == 0), share).otherwise(0).cast("int")
    parts = max(min(spark.sparkContext.defaultParallelism, -(-total // 1000)), -(-total // TASK_WORDS), 1)
    words = stash(raw.select("n", symbols("word").alias("s"), "seq", chosen.alias("g")).repartition(parts), folder, "words-0")
    discard(spark, folder, "counted")
    return words


def learn_merges(frequency: DataFrame, target: int, *, ties: str = "smallest", ahead: int = AHEAD, guess_words: int = GUESS_WORDS) -> Merges:
    """Merge the most frequent pair of a table of words (word, n) until the vocabulary has `target` tokens.

    Of equally frequent pairs the smallest is taken, or with ties="first" the one that stands first in the words' own
    order (frequency then needs a whole-number `seq`). Up to `ahead` merges are guessed a round, and twice as many as were
    right the round before, from `guess_words` words.
    """
    spark, folder, first = frequency.sparkSession, shared_dir(frequency.sparkSession), ties == "first"
    words = _prepared(frequency, folder, first, guess_words)
    out = Merges(vocabulary={r.c for r in words.select(F.explode("s").alias("c")).distinct().collect()})  # characters
    out.initial, out.alphabet = len(out.vocabulary), frozenset(out.vocabulary)
    if out.initial >= target:
        out.stopped = ALREADY
    both = F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("a"), F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))).alias("b"))
    pairs = words.where(F.size("s") > 1).select("n", F.explode(both).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("n").alias("n"))
    pairs = stash(pairs.where("n > 0"), folder, "pairs-0")
    best = _Best(pairs.withColumn("c", F.col("n")).agg(*_extremes()).collect())
    done: list[Pair] = []
    k, want = 0, ahead
    while len(out.vocabulary) < target:
        if best.pair is None:
            out.stopped = NO_PAIRS
            break
        known = _first_counted(words, done, pairs, best.n) if first and best.tied else best.pair
        guess = _guess(words, pairs, done, known, min(want, target - len(out.vocabulary)))
        k += 1
        tried = stash(_tried(words, done, guess), folder, f"words-{k}")
        changes = stash(tried.where("step IS NOT NULL").groupBy("step", "a", "b").agg(F.sum("d").alias("d")), folder, f"changes-{k}")
        bests, right = _bests(pairs, changes, guess, folder, k), 1
        while right < len(bests) and bests[right].pair == guess[right] and not (first and bests[right].tied):
            right += 1
        done, want = guess[:right], min(ahead, max(16, 2 * right))
        for pair in done:
            out.add(pair)
        moved = changes.where(F.col("step") <= right).select("a", "b", F.col("d").alias("n"))
        pairs = stash(pairs.unionAll(moved).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0"), folder, f"pairs-{k}")
        words = tried.where("step IS NULL").select("n", "s", "seq", "g")
        best = bests[right] if right < len(bests) else _Best(pairs.withColumn("c", F.col("n")).agg(*_extremes()).collect())
        discard(spark, folder, f"words-{k - 1}", f"pairs-{k - 1}", f"changes-{k}")
    discard(spark, folder, f"words-{k}", f"pairs-{k}")
    return out
