"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding keeps, for each place of a piece of text, the one token that ends the encoding of everything up to
there. Which one it is depends on the token before it alone: two neighbours stand if merging their own bytes
gives them back. A later token can only begin within the last `lookahead` bytes (the longest token of the
merge list), so tokens in front of where all those beginnings meet are stable and are emitted at once. Memory
is that window, however long the piece. Decoding is a byte-to-text state machine that holds at most three
bytes back.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import math
import re
import sys
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, remember

#: The vocabulary file; a parameter everywhere below.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Pieces and neighbour pairs that a worker remembers; a piece longer than LONG is never remembered.
PIECES, PAIRS, LONG = 160_000, 1 << 19, 64
#: Ids that are handed on at once; characters of a text that are cut into pieces at once, and of these the ones in
#: which a gap is looked for first.
CHUNK, WINDOW, GAP = 1 << 16, 1 << 16, 1 << 10


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes: printable Latin-1 ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _check(spec: dict) -> None:
    """Only files of the kind that this transducer follows: byte-level BPE, nothing done to the text before."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    odd = [k for k in ("single_word", "lstrip", "rstrip", "normalized") if any(a.get(k) for a in spec["added_tokens"])]
    if spec.get("normalizer") or model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout") or odd:
        raise ValueError("this vocabulary file normalises text, splits it in another way, or has other than plain added tokens")


class Transducer:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str = TOKENIZER):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec)
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of = {i: raw(s) for s, i in spec["model"]["vocab"].items()} | {i: s.encode() for s, i in self.added.items()}
        ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.single = [ids.get(bytes([b])) for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        made: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for (a, b), (rank, t) in self.merges.items():
            if t in made:
                raise ValueError(f"token {t} has two merges; this transducer needs one a token")
            made[t], self.rank[t] = (a, b), rank
        self.left = {i: (i,) for i in self.single if i is not None}  # tokens at a token's left edge as it grows
        self.right = dict(self.left)
        self.tokens = {bytes([b]): i for b, i in enumerate(self.single) if i is not None}
        for t, (a, b) in sorted(made.items(), key=lambda x: self.rank[x[0]]):
            if a in self.left and b in self.left and not self._collide(a, b, self.rank[t]):
                self.left[t], self.right[t] = (*self.left[a], t), (*self.right[b], t)
                self.tokens[self.bytes_of[t]] = t
        self.lookahead = max(map(len, self.tokens))
        # every beginning of a token's bytes: the token itself, or -1
        self.starts = {b[:k]: -1 for b in self.tokens for k in range(1, len(b) + 1)} | self.tokens
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _collide(self, a: int, b: int, end: float = math.inf) -> bool:
        """Whether, while a and b grow from their bytes, a merge across their border comes first.

        Follows the edge tokens of both by rank; of equal ranks the left one merges first. `end` is the rank at
        which a and b themselves merge, if they do.
        """
        x, y, rank = self.right[a], self.left[b], self.rank
        i = j = 0
        while True:
            until_x = rank[x[i + 1]] if i + 1 < len(x) else end
            until_y = rank[y[j + 1]] if j + 1 < len(y) else end
            m = self.merges.get((x[i], y[j]))
            if m is not None and m[0] < until_x and (m[0] <= until_y if j + 1 < len(y) else m[0] < until_y):
                return True
            if i + 1 == len(x) and j + 1 == len(y):
                return False
            if j + 1 == len(y) or i + 1 < len(x) and until_x <= until_y:
                i += 1
            else:
                j += 1

    def stands(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay as they are when they meet."""
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = not self._collide(a, b)
        return got

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one piece of text that comes in chunks, each as soon as it is stable."""
        buf = b""  # bytes from the first place that is still kept
        last: list[int | None] = [-1]  # last[k]: the token that ends at place k of buf
        back: list[int] = [0]  # where it begins
        for chunk in chunks:
            buf += chunk
            last += [None] * len(chunk)
            back += [0] * len(chunk)
            done = len(buf) - len(chunk)
            # beginnings whose tokens may reach into the new bytes
            for s in range(max(0, done - self.lookahead), len(buf)):
                self._extend(buf, last, back, s, done)
            cut = self._meeting(last, back, len(buf))
            if cut:
                yield from self._path(last, back, cut)
                buf, last, back = buf[cut:], last[cut:], [x - cut for x in back[cut:]]
                last[0], back[0] = (last[0] if cut else -1), 0
        yield from self._path(last, back, len(buf))

    def window(self, raw: bytes) -> list[int]:
        """Tokens of a piece that lies within one window: the same walk, longest tokens first.

        It is `stream` with a lookahead of the whole piece. Both follow the same tokens under the same test of neighbours, and
        by that test one token alone can end at a place, whichever way a walk came there; so the tokens that end at the
        piece's end, and in front of each of those, are the same. For that reason a place from which the walk had to turn back is never
        tried again, either. Short pieces take it because nothing of them could leave earlier.
        """
        if (t := self.tokens.get(raw)) is not None:
            return [t]
        n, grown, known, stands = len(raw), self.starts.get, self.pairs.get, self.stands
        out: list[int] = []
        places: list[int] = []  # where each token of the walk begins
        turns: list[list[tuple[int, int]]] = []  # what else may begin there, the longest last
        dead: set[int] = set()
        at, before, ways = 0, -1, None
        while at < n:
            if ways is None:
                ways = []
                for e in range(at + 1, n + 1):
                    if (t := grown(raw[at:e])) is None:
                        break
                    if t >= 0:
                        ways.append((e, t))
            while ways:
                e, t = ways.pop()
                if e in dead:
                    continue
                fits = before == -1 or known(before << 32 | t)
                if fits or fits is None and stands(before, t):
                    out.append(t)
                    places.append(at)
                    turns.append(ways)
                    at, before, ways = e, t, None
                    break
            else:
                if not out:
                    raise ValueError("bytes outside the vocabulary")
                dead.add(at)
                out.pop()
                at, ways = places.pop(), turns.pop()
                before = out[-1] if out else -1
        return out

    def _extend(self, buf: bytes, last: list, back: list, s: int, done: int) -> None:
        before, starts = last[s], self.starts
        if before is None:
            return
        for e in range(s + 1, min(len(buf), s + self.lookahead) + 1):
            if (t := starts.get(buf[s:e])) is None:
                return
            if e > done and last[e] is None and t >= 0 and (before == -1 or self.stands(before, t)):
                last[e], back[e] = t, s

    def _meeting(self, last: list, back: list, n: int) -> int:
        """The last place that every path through the final `lookahead` places visits."""
        ways = {k for k in range(max(0, n - self.lookahead), n + 1) if last[k] is not None}
        while len(ways) > 1:
            k = max(ways)
            ways.discard(k)
            ways.add(back[k])
        return ways.pop() if ways else 0

    def _path(self, last: list, back: list, at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _piece(self, piece: str) -> bytes:
        """Ids of one short piece as little-endian 32-bit integers, remembered while there is room."""
        got = self.pieces.get(piece)
        if got is None and (got := self.older.get(piece)) is None:
            got = np.array(self.window(piece.encode()), "<u4").tobytes()
        if len(self.pieces) >= PIECES:
            self.older, self.pieces = self.pieces, {}
        self.pieces[piece] = got
        return got

    def _long_piece(self, piece: str) -> Iterator[bytes]:
        """Ids of a piece of any length in parts, while its bytes still come."""
        size = 4 * self.lookahead
        stream = self.stream(piece[k : k + size].encode() for k in range(0, len(piece), size))
        while part := np.fromiter(islice(stream, CHUNK), "<u4").tobytes():
            yield part

    def parts(self, text: str) -> Iterator[bytes]:
        """Ids of a whole text as little-endian unsigned 32-bit integers, a window of text at a time.

        Added tokens in it count as themselves. Beside the text itself, only a window's pieces are ever held.
        """
        at = 0
        while at < len(text):  # added tokens first: text between them is cut on its own
            m = self.splitter.search(text, at) if self.splitter else None
            end = m.start() if m else len(text)
            for start, stop in windows(text, at, end):
                if stop - start > WINDOW:
                    for m_ in piece_matches(text[start:stop]):
                        yield from (self._long_piece(m_[0]) if len(m_[0]) > LONG else [self._piece(m_[0])])
                    continue
                known, missing = self.pieces, self._piece
                own = pieces(text[start:stop])
                if max(map(len, own), default=0) <= LONG:
                    yield b"".join([known.get(p) or missing(p) for p in own])
                else:
                    for p in own:
                        yield from (self._long_piece(p) if len(p) > LONG else [known.get(p) or missing(p)])
            if m:
                yield np.uint32(self.added[m[0]]).tobytes()
                end = m.end()
            at = end

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(self.parts(text))

    def decode(self, ids: bytes) -> Iterator[str]:
        """Text of ids in parts; bytes that aren't UTF-8 become U+FFFD, as a lossy conversion has it."""
        yield from self.decoded(ids[k : k + 4 * CHUNK] for k in range(0, len(ids), 4 * CHUNK))

    def decoded(self, parts: Iterable[bytes]) -> Iterator[str]:
        """Text of ids that come in parts: a byte-to-text state machine that holds at most three bytes back."""
        machine, bytes_of = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of
        for part in parts:
            yield machine.decode(b"".join([bytes_of[i] for i in np.frombuffer(part, "<u4").tolist()]))
        yield machine.decode(b"", final=True)


# The pattern of pieces, in the exact form, and one for texts whose characters mean the same to both.
EXACT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Letters first: what the other forms begin with is none, so the order between them doesn't matter.
_FAST = re.compile(r""" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
_ASCII = re.compile(r""" ?[A-Za-z]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+""", re.A)


@cache
def _odd_characters() -> re.Pattern:
    """Characters that the two patterns class differently, found by trying all of them."""
    import regex

    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    kinds = []
    for lib, letter, number, blank in ((regex, r"\p{L}", r"\p{N}", r"[\t-\r\x20\x85\p{Z}]"), (re, r"[^\W\d_]", r"\d", r"\s")):
        kind = np.zeros(len(every), np.int8)
        for k, pattern in enumerate((letter, number, blank), 1):
            kind[[m.start() for m in lib.finditer(pattern, every)]] = k
        kinds.append(kind)
    odd = np.flatnonzero(kinds[0] != kinds[1])
    ends = np.flatnonzero(np.diff(odd) != 1)
    first, last = odd[np.append(0, ends + 1)], odd[np.append(ends, len(odd) - 1)]
    return re.compile("[" + "".join(f"{re.escape(every[a])}-{re.escape(every[b])}" for a, b in zip(first, last, strict=True)) + "]")


@cache
def _odd_latin() -> re.Pattern:
    """Those of them in the first 256, a class that is searched much faster."""
    return re.compile("[" + re.escape("".join(c for c in map(chr, range(256)) if _odd_characters().match(c))) + "]")


@cache
def _exact():
    import regex

    return regex.compile(EXACT.replace(r"\s", r"[\t-\r\x20\x85\p{Z}]").replace(r"[^[\t-\r\x20\x85\p{Z}]", r"[^\t-\r\x20\x85\p{Z}").replace(r"\S", r"[^\t-\r\x20\x85\p{Z}]"))


def _pattern(text: str):
    if text.isascii():
        return _ASCII
    try:
        text.encode("latin-1")
        odd = _odd_latin()
    except UnicodeEncodeError:
        odd = _odd_characters()
    return _exact() if odd.search(text) else _FAST


def pieces(text: str) -> list[str]:
    """The pieces that merges never cross."""
    return _pattern(text).findall(text)


def piece_matches(text: str) -> Iterator:
    """The same, one by one."""
    return _pattern(text).finditer(text)


#: The last character of a piece that surely ends there: a space comes, then another letter or digit.
_GAP = re.compile(r"\w(?=\x20\w)")


def windows(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Stretches of a text that are cut into pieces on their own: WINDOW characters and on to the next gap."""
    while end - start > WINDOW:
        m = _GAP.search(text, start + WINDOW - 1 - GAP, end)
        if not m or m.end() >= end:
            break
        yield start, m.end()
        start = m.end()
    if start < end:
        yield start, end


@cache
def transducer(path: str = TOKENIZER) -> Transducer:
    """One of each file in a process; a worker drops it when other stages need the room."""
    remember(transducer.cache_clear)
    return Transducer(path)


def encode_documents(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, with_ids: bool = True, with_digests: bool = False) -> DataFrame:
    """(id, n_tokens, ids) per row, and on request the digests of ids and of the text decoded from them.

    ids is a binary of little-endian unsigned 32-bit integers, which `decode_documents` turns back. Null and empty
    texts: no tokens. Repeated rows: each its own. Very long texts go through window by window; without ids in
    the result, nothing of a text's size is built beside the text itself. Each row by itself, one pass, no
    shuffle; a worker holds the vocabulary, a bounded memory of pieces, and one batch of texts.
    """
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        t = transducer(tokenizer)
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("n_tokens", "ids", "ids_sha256", "decoded_sha256")}
            for x in b["text"].to_pylist():
                sizes, kept, of_ids, of_text = [0], [], hashlib.sha256(), hashlib.sha256()

                def seen(x: str = x or "", sizes: list = sizes, kept: list = kept, of_ids=of_ids) -> Iterator[bytes]:
                    for part in t.parts(x):
                        sizes[0] += len(part) // 4
                        if with_ids:
                            kept.append(part)
                        if with_digests:
                            of_ids.update(part)
                        yield part

                if with_digests:
                    for part in t.decoded(seen()):
                        of_text.update(part.encode())
                else:
                    for _ in seen():
                        pass
                for c, v in zip(out, (sizes[0], b"".join(kept), of_ids.hexdigest(), of_text.hexdigest()), strict=True):
                    out[c].append(v)
            yield {"id": b["id"]} | out

    return map_batches(rows, run, "id long, n_tokens long" + ", ids binary" * with_ids + ", ids_sha256 string, decoded_sha256 string" * with_digests, keeps=True)


def decode_documents(encoded: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, text) from (id, ids); null ids: empty text."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        t = transducer(tokenizer)
        for b in batches:
            yield {"id": b["id"], "text": ["".join(t.decode(x or b"")) for x in b["ids"].to_pylist()]}

    return map_batches(encoded.select("id", "ids"), run, "id long, text string", keeps=True)
