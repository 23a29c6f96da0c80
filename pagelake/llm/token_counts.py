"""Token counts: exact counts at every prefix by dynamic programming.

Byte-level BPE encodes a text piece by piece, as a pattern parts it. Within a piece the encoding of a prefix ends in the
one token t for which the pair (last token of the encoding before t, t) is stable, that is, encodes to itself. So going
through the prefixes in order, each gets its last token from the few tokens of the vocabulary that end there, and
count[i] = count[i - len(t)] + 1. All prefixes of a piece are counted at once and stored; a text's count is the sum over
its pieces, and truncating to a budget is a search in the stored counts: nothing is encoded again.

Where a prefix of the text ends, the pattern may part its tail otherwise than it parts the whole text (a run of white
space, an apostrophe, a special string). `prefix_counts` redoes those tails with the same dynamic programme.

Defined results: a null text counts as empty: no bytes, no tokens. Repeated rows get equal rows; extra columns are
carried by `keep`; an empty table gives an empty table. Very long pieces take time in proportion to their length.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .shared import extended, only
from .words import Memo, Texts, chunks, ragged, units

#: Fixed value: how this kind of vocabulary parts text before its merges.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_WHITE = regex.compile(r"\s+")


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level BPE files: itself if printable Latin-1, else the next code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """The dynamic programme over a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kind = _byte_of()
        raw = lambda s: bytes(kind[c] for c in s)
        vocab = file["model"]["vocab"]
        self.specials = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        # Tokens are numbered anew: single bytes first, then by the rank of their merge.
        self.number = {bytes([b]): b for b in range(256)}
        self.left, self.right = [*range(256)], [*range(256)]
        self.merged: dict[int, int] = {}
        for pair in file["model"]["merges"]:
            a, b = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            if a + b in self.number or (a.decode("latin-1") and "".join(pair) not in vocab):
                continue
            new = len(self.left)
            x, y = self.number[a], self.number[b]
            self.number[a + b] = new
            self.left.append(x)
            self.right.append(y)
            self.merged[x << 20 | y] = new
        self.longest = max(map(len, self.number))
        self._stable: dict[int, bool] = {}
        self.memo = Memo(lambda strings: [self.count(s).to_bytes(4, "little") for s in strings])
        self._pieces: dict[str, int] = {}

    def stable(self, a: int, b: int) -> bool:
        """Whether a followed by b encodes to a, b: no merge across the seam comes before those that build a and b."""
        key = a << 20 | b
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) > 400_000:
                self._stable.clear()
            known = self._stable[key] = self._seam(a, b)
        return known

    def _seam(self, a: int, b: int) -> bool:
        merged, left, right = self.merged, self.left, self.right
        bound = len(left)
        # Undo the latest merge on either side of the seam step by step; a pair that stood at the seam until then would
        # have merged if its own merge comes first. On equal rank the left one merges first.
        while True:
            over = merged.get(a << 20 | b)
            if over is not None and over < bound:
                return False
            if a >= 256 and (a > b or b < 256):
                bound, a = a, right[a]
            elif b >= 256:
                bound, b = b + 1, left[b]
            else:
                return True

    def prefixes(self, piece: bytes) -> list[int]:
        """Token counts of piece[:0], piece[:1], ..., piece."""
        find, stable, longest = self.number.get, self.stable, self.longest
        counts, last, start = [0], [-1], [0]
        for end in range(1, len(piece) + 1):
            # Exactly one token qualifies, so the order of trying is free: the last token grown by a byte, the byte alone, the rest.
            begin = start[-1]
            token = find(piece[begin:end])
            if token is None or begin and not stable(last[begin], token):
                begin = end - 1
                token = find(piece[begin:end])
                if begin and not stable(last[begin], token):
                    for begin in range(max(0, end - longest), end - 1):
                        token = find(piece[begin:end])
                        if token is not None and (begin == 0 or stable(last[begin], token)):
                            break
                    else:
                        raise ValueError("no token fits")
            counts.append(counts[begin] + 1)
            last.append(token)
            start.append(begin)
        return counts

    def _piece(self, piece: str) -> int:
        n = self._pieces.get(piece)
        if n is None:
            raw = piece.encode("utf-8")
            n = 1 if raw in self.number else self.prefixes(raw)[-1]
            if len(self._pieces) > 100_000:
                self._pieces.clear()
            if len(raw) < 200:
                self._pieces[piece] = n
        return n

    def segments(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """(begin, end, is a special string), in order."""
        at = 0
        for m in self._special.finditer(text) if self._special else ():
            if m.start() > at:
                yield at, m.start(), False
            yield m.start(), m.end(), True
            at = m.end()
        if at < len(text):
            yield at, len(text), False

    def count(self, text: str) -> int:
        return sum(1 if special else sum(map(self._piece, PATTERN.findall(text, a, b) if b == len(text) else PATTERN.findall(text[a:b]))) for a, b, special in self.segments(text))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of text[:0], text[:1], ..., text, each as the library encodes that prefix."""
        out = np.zeros(len(text) + 1, np.int64)
        before = 0  # tokens before the segment
        begin = 0  # where the ordinary text before a special string begins
        for a, b, special in self.segments(text):
            if special:
                # Until the special string is whole, it is ordinary text that continues the segment before it.
                base = out[begin]
                for p in range(a + 1, b):
                    out[p] = base + self.count(text[begin:p])
                before = out[b] = out[a] + 1
                begin = b
                continue
            begin = a
            for m in PATTERN.finditer(text[a:b]):
                s, e = a + m.start(), a + m.end()
                piece = m.group()
                counts = self.prefixes(piece.encode("utf-8"))
                out[s + 1 : e + 1] = before + np.array(counts)[_ends(piece)]
                before += counts[-1]
                # A prefix that ends in white space takes the whole run of it as one piece; one that cuts a contraction, two pieces.
                run = s
                contracted = len(piece) > 1 and piece[0] == "'" and piece[1].isalpha()
                white = _WHITE.match(piece)
                while (white or contracted) and run > a and _WHITE.match(text, run - 1):
                    run -= 1
                if contracted:
                    for p in range(s + 1, e):
                        out[p] = out[run] + sum(map(self._piece, PATTERN.findall(text[run:p])))
                elif run < s:
                    spaces = text[run : s + white.end()]
                    out[s + 1 : run + len(spaces) + 1] = (out[run] + np.array(self.prefixes(spaces.encode("utf-8")))[_ends(spaces)])[s - run :]
        return out

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix with no more tokens than the budget."""
        counts = self.prefix_counts(text)
        return text[: int(np.flatnonzero(counts <= budget)[-1])]


def _ends(text: str) -> np.ndarray:
    """Where each character ends in the UTF-8 form."""
    return np.cumsum([len(c.encode("utf-8")) for c in text])


_OPEN: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _OPEN:
        _OPEN[path] = PrefixCounter(path)
    return _OPEN[path]


def token_counts(docs: DataFrame, vocab_path: str, keep: list[str], limit: int = 512, with_prefixes: bool = False) -> DataFrame:
    """docs(text, ...) -> the columns `keep`, n_bytes, n_tokens, over_limit (n_tokens > limit) and, if asked, prefixes: the counts of text[:0], text[:1], ... by code point."""
    ready = only(docs, *dict.fromkeys([*keep, "text"]))
    schema = extended(ready, keep, {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"} | ({"prefixes": "array<long>"} if with_prefixes else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocab_path)
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = Texts(part["text"])
                strings, n_units = units(texts, spaces=True)
                coded = strings.dictionary_encode()
                each = np.frombuffer(b"".join(count.memo(coded.dictionary.to_pylist())), np.int32)[coded.indices.to_numpy()]
                total = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])[np.concatenate([[0], np.cumsum(n_units)])]
                n = np.diff(total)
                cols = [*[part[c] for c in keep], pa.array(np.diff(texts.offsets)), pa.array(n), pa.array(n > limit)]
                if with_prefixes:
                    cols.append(pa.array([count.prefix_counts(t or "").tolist() for t in part["text"].to_pylist()], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return ready.mapInArrow(run, schema)
