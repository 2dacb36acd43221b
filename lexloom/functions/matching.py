"""Bounds of the matching-blocks ratio (difflib's) of many texts with one key, over arrays.

A ratio is twice the matched characters over all characters. difflib takes the longest match, the first of equals, then
what lies left and right of it. In keys of 200 characters and more a match grows from characters that are rare there; only
the text's and the key's common beginning may do without. Bounds follow those steps; no pair is dropped unless it must lose.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: From this length on, difflib lets no match start from characters that make up more than 1 % of a key, and one.
LONG_KEY = 200
#: Characters with a bin of their own, and the rest in one: common bins only make a bound larger.
BINS = 48
#: Characters of texts that are laid out beside each other at once, in arrays and as bits; hits that are lengthened at once.
LAID_OUT, BITS, HITS = 1 << 16, 1 << 14, 1 << 18


class Texts:
    """Texts, and what their ratios with keys can be at most."""

    def __init__(self, texts: list[str]):
        points = [_points(t) for t in texts]
        found, often = np.unique(np.concatenate(points), return_counts=True)
        found = found[np.argsort(-often, kind="stable")]
        kind = np.uint8 if len(found) < 255 else np.uint32
        self._code = np.zeros(0x110000, kind)
        self._code[found] = np.arange(1, len(found) + 1)
        self._stop = len(found) + 1
        self.texts, self.sizes = texts, np.array([len(p) for p in points])
        self._codes = [np.append(self._code[p], kind(self._stop)) for p in points]  # a stop after each text
        self._begins = np.cumsum(self.sizes + 1) - self.sizes - 1
        self._before = _counts_before(np.concatenate(self._codes))
        self._counts = self._before[self._begins + self.sizes] - self._before[self._begins]
        self._bits = [_Bits(g, *self._beside(g)) for g in self._groups(np.arange(len(texts)), BITS)]

    def may_reach(self, key: str, best: np.ndarray) -> list[int]:
        """Texts whose ratio with the key is above 0 and may be as large as their `best`."""
        p = _points(key)
        b, total = self._code[p], self.sizes + len(p)
        can = lambda k, most: k[(most > 0) & (2.0 * most / total[k] >= best[k])]
        near = can(np.arange(len(total)), np.minimum(self.sizes, len(p)))
        if not len(near):
            return []
        near = can(near, _common(self._counts[near], _counts(b)))
        if len(p) < LONG_KEY:
            near = can(near, self._common_sequence(near, b.tolist()))
        large = self.sizes[near] >= LAID_OUT  # no arrays are laid out for these
        kept, near = near[large].tolist(), near[~large]
        if len(p) >= LONG_KEY:
            names, counts = np.unique(p, return_counts=True)
            seeds = np.flatnonzero(np.isin(p, names[counts <= len(p) // 100 + 1]) & (b > 0))
            return kept + [k for g in self._groups(near) for k in can(g, self._from_seeds(g, b, seeds)).tolist()]
        before = _counts_before(b) if len(near) else None
        return kept + [k for g in self._groups(near) for k in self._by_blocks(g, b, before, total, best, can)]

    def _groups(self, near: np.ndarray, most: int = LAID_OUT) -> list[np.ndarray]:
        ends = np.cumsum(self.sizes[near] + 1)
        return np.split(near, np.flatnonzero(np.diff(ends // most)) + 1) if len(near) else []

    def _common_sequence(self, near: np.ndarray, b: list[int]) -> np.ndarray:
        """Lengths of the longest common subsequences, of which the blocks are one."""
        size, wanted = np.zeros(len(self.sizes), np.int64), np.zeros(len(self.sizes), bool)
        wanted[near] = True
        for g in self._bits:
            if wanted[g.texts].any():
                size[g.texts] = self.sizes[g.texts] - g.left_over(b)
        return size[near]

    def _beside(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' codes in a row, and where each begins."""
        return np.concatenate([self._codes[k] for k in near]), np.cumsum(self.sizes[near] + 1) - self.sizes[near] - 1

    def _from_seeds(self, near: np.ndarray, b: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """A block holds a seed of the key or is the common beginning: at most the longest matches around each seed, and that."""
        a, begins = self._beside(near)
        owner = np.repeat(np.arange(len(near)), self.sizes[near] + 1)
        at = {c: np.flatnonzero(a == c) for c in np.unique(b[seeds]).tolist()}
        a, b = np.pad(a, 1, constant_values=self._stop), np.pad(b, 1)  # stops and 0 match nothing
        most = _run(a, b, begins, np.zeros(len(near), np.int64), 1)
        todo, held = [], 0
        for n, j in enumerate(seeds.tolist()):
            todo.append((j, at[int(b[j + 1])]))
            held += len(todo[-1][1])
            if held >= HITS or n == len(seeds) - 1:
                i, j = np.concatenate([x for _, x in todo]), np.repeat([j for j, _ in todo], [len(x) for _, x in todo])
                todo, held = [], 0
                if len(i):
                    size = 1 + _run(a, b, i + 1, j + 1, 1) + _run(a, b, i + 1, j + 1, -1)
                    part = j * len(near) + owner[i]  # rising, as positions do for each seed
                    firsts = np.flatnonzero(np.append(True, np.diff(part) > 0))
                    most += np.bincount(owner[i[firsts]], np.maximum.reduceat(size, firsts), len(near)).astype(np.int64)
        return np.minimum(most, self.sizes[near])

    def _by_blocks(self, near: np.ndarray, b: np.ndarray, before: np.ndarray, total: np.ndarray, best: np.ndarray, can) -> list[int]:
        a, begins = self._beside(near)
        runs = np.zeros((len(b), len(a)), np.uint8)  # length of the common run that ends at both; keys are short here
        equal = {c: (a == c).view(np.uint8) * np.uint8(255) for c in np.unique(b).tolist() if c}
        last = np.zeros(len(a), np.uint8)
        for j, c in enumerate(b.tolist()):
            row = runs[j]
            if c:
                np.add(last[:-1], 1, out=row[1:])
                row[0] = 1
                np.bitwise_and(row, equal[c], out=row)
            last = row
        most = runs.max(0)
        size = np.maximum.reduceat(most, begins)
        hit = np.flatnonzero(most == np.repeat(size, self.sizes[near] + 1))
        i = hit[np.searchsorted(hit, begins)]
        j = (runs[:, i] == size).argmax(0) + 1
        i, size = i - begins + 1, size.astype(np.int64)
        # before and behind the first block, at most the characters that both sides have in common there
        own, key = self._before, before
        at = self._begins[near]
        left = _common(own[at + i - size] - own[at], key[j - size])
        right = _common(own[at + self.sizes[near]] - own[at + i], key[-1] - key[j])
        slot = {k: n for n, k in enumerate(near.tolist())}
        found = []
        for k in can(near, size + left + right).tolist():
            n = slot[k]
            table = runs[:, begins[n] : begins[n] + self.sizes[k]]
            regions = [(int(left[n]), 0, int(i[n] - size[n]), 0, int(j[n] - size[n])), (int(right[n]), int(i[n]), int(self.sizes[k]), int(j[n]), len(b))]
            if self._splits(table, regions, int(size[n]), own[self._begins[k] :], key, float(best[k]), int(total[k])):
                found.append(k)
        return found

    @staticmethod
    def _splits(table: np.ndarray, regions: list, done: int, own: np.ndarray, key: np.ndarray, best: float, total: int) -> bool:
        """Whether the blocks may still reach the best: the widest region is split by its own longest match until it is known."""
        open_ = sum(r[0] for r in regions)
        while open_ and 2.0 * (done + open_) / total >= best:
            regions.sort()
            bound, i0, i1, j0, j1 = regions.pop()
            open_ -= bound
            if not bound:
                continue
            cut = np.minimum(table[j0:j1, i0:i1], _RAMP[: j1 - j0, : i1 - i0] if i1 - i0 <= RAMP else _ramp(j1 - j0, i1 - i0))
            most = cut.max(0)
            i = int(most.argmax())
            size = int(most[i])
            if not size:
                continue
            j = int(cut[:, i].argmax())
            i, j, done = i0 + i + 1, j0 + j + 1, done + size
            for x0, x1, y0, y1 in ((i0, i - size, j0, j - size), (i, i1, j, j1)):
                if x1 > x0 and y1 > y0:
                    most = int(np.minimum(own[x1] - own[x0], key[y1] - key[y0]).sum())
                    if most:
                        regions.append((most, x0, x1, y0, y1))
                        open_ += most
        return 2.0 * (done + open_) / total >= best


class _Bits:
    """Texts side by side as bits of long integers, with a bit between them that no carry gets over."""

    def __init__(self, texts: np.ndarray, codes: np.ndarray, begins: np.ndarray):
        pack = lambda flags: int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
        self.texts, self._begins, self._bytes = texts, begins, len(codes) // 8 + 1
        stop = codes[-1]
        self._full = pack(codes != stop)
        self._masks = {c: pack(codes == c) for c in np.unique(codes).tolist() if c != stop}

    def left_over(self, key: list[int]) -> np.ndarray:
        """Characters of each text that its longest common subsequence with the key leaves out."""
        v, full, masks = self._full, self._full, self._masks
        for c in key:
            if m := masks.get(c):
                u = v & m
                v = (v + u | v - u) & full
        return np.add.reduceat(np.unpackbits(np.frombuffer(v.to_bytes(self._bytes, "little"), np.uint8), bitorder="little"), self._begins, dtype=np.int64)


def _ramp(height: int, width: int) -> np.ndarray:
    """The longest run that can end at each place of a region, as it begins nowhere before it."""
    return np.minimum.outer(np.arange(1, height + 1, dtype=np.uint8), np.minimum(np.arange(1, width + 1), LONG_KEY).astype(np.uint8))


#: Regions up to that width share one.
RAMP = 1024
_RAMP = _ramp(LONG_KEY, RAMP)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _counts_before(codes: np.ndarray) -> np.ndarray:
    """How often each bin occurs before each place; 0 is in no bin."""
    one = np.zeros((len(codes) + 1, BINS), np.uint32)
    one[np.arange(1, len(codes) + 1), np.minimum(codes, BINS - 1)] = 1
    one[:, 0] = 0
    return np.cumsum(one, 0, out=one)


def _counts(codes: np.ndarray) -> np.ndarray:
    n = np.bincount(np.minimum(codes, BINS - 1), minlength=BINS)
    n[0] = 0
    return n


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b).sum(-1, dtype=np.int64)


def _run(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """Equal characters beyond places i and j, in one direction."""
    size, at, n = np.zeros(len(i), np.int64), np.arange(len(i)), 0
    while len(at):
        n += step
        at = at[a[i[at] + n] == b[j[at] + n]]
        size[at] += 1
    return size


def ratios(key: str):
    """difflib's ratio of texts with one key, which is looked through once, if at all."""
    m = None

    def ratio(text: str) -> float:
        nonlocal m
        m = m or SequenceMatcher(None, "", key)
        m.set_seq1(text)
        return m.ratio()

    return ratio
