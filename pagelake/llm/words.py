"""Vectorised text kernels on Arrow batches, shared by the operators.

A word is a maximal run of bytes other than space and 0x09-0x0D, so it is also a run of code points.
Texts are never cut: `chunks` only groups whole texts, and one very long text is a chunk of its own.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
#: For kernels with many arrays as long as the words.
FINE = 2 << 20
#: Where several stages share a worker and memory is short.
FINEST = 1 << 20
#: Longer words are hashed one by one.
_LONG = 256

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_SOLID = ~_WS
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_rng = np.random.default_rng(20240613)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SHINGLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; bijective."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose texts hold about `limit` bytes together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(sizes):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Gives memory that is free in this worker back to the system, which the JVM beside it and later stages need."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], spare: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The batch function `run`, which if asked to spare memory drops what an earlier stage's memo keeps in this worker, and gives free memory back at the end of its task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.forget()
        yield from run(batches)
        give_back()

    return tidied if spare else run


class Texts:
    """The texts of a chunk as one byte buffer. A null text is empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.bytes = whole[offsets[0] : offsets[-1]]
        if lower:
            self.bytes = _LOWER[self.bytes]
        self.offsets = offsets - offsets[0]
        self.n = len(column)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each text has."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


class Words:
    """All words of a chunk in order: where each begins and ends among the texts' bytes, and how many each text has."""

    def __init__(self, texts: Texts):
        solid = _SOLID[texts.bytes]
        n = len(solid)
        turns = np.zeros(n + 1, bool)
        if n:
            turns[0], turns[n] = solid[0], solid[n - 1]
            np.not_equal(solid[1:], solid[:-1], out=turns[1:n])
        edges = np.flatnonzero(turns)
        # Where one text's last word meets the next one's first, a word ends and another begins.
        seams = texts.offsets[1:-1]
        seams = np.unique(seams[(seams > 0) & (seams < n)])
        seams = seams[solid[seams] & solid[seams - 1]]
        if len(seams):
            edges = np.sort(np.concatenate([edges, np.repeat(seams, 2)]), kind="stable")
        self.solid, self.texts = solid, texts
        self.starts, self.stops = edges[::2], edges[1::2]
        self.n = len(self.starts)
        self.bounds = np.searchsorted(self.starts, texts.offsets)
        self.counts = np.diff(self.bounds)

    @cached_property
    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.texts.n), self.counts)

    def strings(self) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(self.stops - self.starts)])
        return pa.LargeStringArray.from_buffers(self.n, pa.py_buffer(ends), pa.py_buffer(self.texts.bytes[self.solid]))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process: eight bytes at a time, for all words that have so many."""
        padded = np.zeros((len(self.texts.bytes) + 23) // 8 * 8, np.uint8)
        padded[: len(self.texts.bytes)] = self.texts.bytes
        blocks = padded.view("<u8")
        sizes = self.stops - self.starts

        def load(at: np.ndarray, left: np.ndarray) -> np.ndarray:
            block, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
            return (blocks[block] >> shift | blocks[block + 1] << np.uint64(1) << (np.uint64(63) - shift)) & _FIRST[np.minimum(left, 8)]

        out = mix(load(self.starts, sizes) + sizes.astype(np.uint64) * _BASE)
        more, done = np.flatnonzero((sizes > 8) & (sizes <= _LONG)), 8
        while len(more):
            left = sizes[more] - done
            out[more] = mix(out[more] ^ load(self.starts[more] + done, left) * _BASE)
            more, done = more[left > 8], done + 8
        for i in np.flatnonzero(sizes > _LONG).tolist():
            whole = hashlib.blake2b(self.texts.bytes[self.starts[i] : self.stops[i]].tobytes(), digest_size=8)
            out[i] = int.from_bytes(whole.digest(), "little")
        return out


def hash_runs(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run data[ends[i]:ends[i + 1]]; the runs are not empty."""
    if len(ends) < 2:
        return np.zeros(0, np.uint64)
    sizes = np.diff(ends)
    power = np.multiply.accumulate(np.full(int(sizes.max()), _BASE, np.uint64))
    place = np.arange(len(data), dtype=np.int64) - np.repeat(ends[:-1], sizes)
    return mix(np.add.reduceat(_BYTE[data] * power[place], ends[:-1]) + sizes.astype(np.uint64))


#: Byte classes for `units`: white space, letter, digit, other sign, and what is never parted from its neighbours.
_SPACE, _LETTER, _DIGIT, _SIGN, _GLUE = range(5)
_CLASS = np.full(256, _GLUE, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[[ord(c) for c in "'<|>"]] = _GLUE
_CLASS[_WS] = _SPACE


def _wide_space_ends(b: np.ndarray) -> np.ndarray:
    """Flags the last bytes of white space outside ASCII."""
    out = np.zeros(len(b), bool)
    if len(b) > 1:
        out[1:] |= (b[:-1] == 0xC2) & ((b[1:] == 0x85) | (b[1:] == 0xA0))
    if len(b) > 2:
        x, y, z = b[:-2], b[1:-1], b[2:]
        out[2:] |= (x == 0xE1) & (y == 0x9A) & (z == 0x80)
        out[2:] |= (x == 0xE2) & (y == 0x80) & (((z >= 0x80) & (z <= 0x8A)) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
        out[2:] |= (x == 0xE2) & (y == 0x81) & (z == 0x9F) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
    return out


def units(texts: Texts, spaces: bool) -> tuple[pa.Array, np.ndarray]:
    """The pieces of `unit_runs` as strings, and how many each text has."""
    data, ends, counts = unit_runs(texts, spaces)
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data)), counts


def unit_runs(texts: Texts, spaces: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of each text, as bytes and offsets in them, that any tokenizer which parts letters, digits, other signs and white space encodes one by one
    as it encodes the whole, and how many each text has. spaces: white space stays before the piece that follows it;
    else it is dropped. Where it is doubtful whether the tokenizer parts, the text isn't parted."""
    b = texts.bytes
    kind = _CLASS[b]
    before = np.empty_like(kind)
    before[1:], before[:1] = kind[:-1], _SPACE
    inner = texts.offsets[:-1]
    inner = inner[inner < len(b)]
    part = (kind != before) & (kind != _GLUE) & (before != _GLUE) & (kind != _SPACE) & (before != _SPACE)
    if spaces:
        after = b[:-1]
        solid = (kind[:-1] != _SPACE) & ~_wide_space_ends(b)[:-1] & ((after >= 0x80) | (after > 0x20) & (after != 0x7F))
        part[1:] |= (kind[1:] == _SPACE) & solid
        part[inner] = True
        begin = np.flatnonzero(part)
        return np.ascontiguousarray(b), np.append(begin, len(b)), texts.per_text(part)
    part |= (kind != _SPACE) & (before == _SPACE)
    part[inner] = kind[inner] != _SPACE
    solid = kind != _SPACE
    place = np.cumsum(solid, dtype=np.int64) - solid
    begin = place[part]
    data = b[solid]
    return data, np.append(begin, len(data)), texts.per_text(part)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows of one text; with fewer words, the whole sequence is one; without words, none."""
    if not len(words):
        return words
    m = min(k, len(words))
    total = np.full(len(words) - m + 1, m, np.uint64)
    for j in range(m):
        total += words[j : len(words) - m + 1 + j] * _SHINGLE[j]
    return mix(total)


class Memo:
    """What `make` gives for each distinct string as bytes, kept for the strings seen lately.

    Two generations of at most `size` strings each bound the memory, and a worker that goes on to another memo empties
    the one before; the answers never depend on what is kept."""

    _last: Memo | None = None

    def __init__(self, make: Callable[[list[str]], list[bytes]], size: int = 150_000):
        self.make, self.size = make, size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def forget(cls) -> None:
        """Empties the memo used last."""
        if cls._last is not None:
            cls._last.young, cls._last.old = {}, {}
            cls._last = None
            give_back()

    def __call__(self, strings: list[str]) -> list[bytes]:
        if Memo._last is not self:
            Memo.forget()
            Memo._last = self
        young, old = self.young, self.old
        found = [young.get(s) for s in strings]
        missing = [i for i, x in enumerate(found) if x is None]
        unknown = []
        for i in missing:
            x = found[i] = old.get(strings[i])
            if x is None:
                unknown.append(i)
        for at in range(0, len(unknown), 20_000):
            part = unknown[at : at + 20_000]
            for i, x in zip(part, self.make([strings[i] for i in part])):
                found[i] = x
        if len(young) + len(missing) > self.size:
            self.old, self.young = young, {}
        if len(missing) <= self.size:
            self.young.update((strings[i], found[i]) for i in missing if len(strings[i]) <= 200)
        return found


def ragged(parts: list[bytes], codes: np.ndarray, dtype=np.int32) -> tuple[np.ndarray, np.ndarray]:
    """The values of parts[c] for every c of codes in turn, and how many each c has."""
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts)) // np.dtype(dtype).itemsize
    flat = np.frombuffer(b"".join(parts), dtype)
    begin = np.cumsum(sizes) - sizes
    n = sizes[codes]
    shift = np.repeat(begin[codes] - (np.cumsum(n) - n), n)
    return flat[shift + np.arange(len(shift))], n
