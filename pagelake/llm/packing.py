"""Best-fit packing of token sequences by hierarchical residual packing.

Each task tokenizes its documents and packs their pieces best-fit decreasing, in blocks of bounded size. Bins that are
nearly full are final. The others go up a tree: at each level a bounded number of them meets in one task, where whole
bins are the items of another best-fit round. Levels accept ever less full bins, and the last accepts all, so no task
ever holds more than a block, however large the corpus is or whatever its sizes are.

Defined results: a null doc_id stays null. A null text is empty, and an empty text is one piece of the end token alone. Only sequences longer than
the capacity are cut. Repeated rows are packed once each; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, only
from .words import CHUNK_BYTES, Memo, Texts, chunks, give_back, ragged, units

#: Pieces, or unfilled bins, that one best-fit round holds at most.
BLOCK = 65_536
#: Bins that meet in one task of a higher level.
FAN_IN = 4_096
#: Pieces of text of which a worker keeps the ids, in each of two generations.
MEMO = 250_000
#: The share of the capacity from which a bin is final, by level. The last level accepts every bin.
FULL = (0.995, 0.98, 0.95, 0.9, 0.75, 0.0)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: each item's bin and offset, and the number of bins."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r: there is an open bin with room r
    n = 0
    for i in order.tolist():
        size = int(sizes[i])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            open_bins[left].append(b)
            rooms |= 1 << left
    return bins, offsets, n


class Encoder:
    """Token ids of whole texts under a tokenizer that drops white space, a piece of text at a time."""

    SEPARATOR = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.mark = self._encode(self.SEPARATOR)
        self.memo = Memo(self._many, MEMO)

    def _encode(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _many(self, strings: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(strings), 256):
            part = strings[at : at + 256]
            if len(self.mark) == 1 and not any(self.SEPARATOR in s for s in part):
                ids = np.array(self._encode(f" {self.SEPARATOR} ".join(part)), np.int32)
                split = np.split(ids, np.flatnonzero(ids == self.mark[0]))
                if len(split) == len(part):
                    out += [split[0].tobytes(), *[x[1:].tobytes() for x in split[1:]]]
                    continue
            out += [np.array(self._encode(s), np.int32).tobytes() for s in part]
        return out

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk in turn, each followed by `end`, and how many each has."""
        texts = Texts(column)
        strings, n_units = units(texts, spaces=False)
        coded = strings.dictionary_encode()
        ids, per_unit = ragged(self.memo(coded.dictionary.to_pylist()), coded.indices.to_numpy())
        bounds = np.concatenate([[0], np.cumsum(per_unit)])[np.concatenate([[0], np.cumsum(n_units)])]
        return np.insert(ids, bounds[1:], end).astype("<u4"), np.diff(bounds) + 1


_OPEN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_NAMES = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def tokenized(column: pa.Array, doc_ids: np.ndarray, vocab_path: str, capacity: int, end: int) -> dict[str, np.ndarray]:
    """The pieces of a chunk's documents, and their ids one after another."""
    ids, n = encoder(vocab_path).encode(column, end)
    pieces = -(-n // capacity)
    doc = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * capacity
    length = np.minimum(capacity, n[doc] - start)
    begin = (np.cumsum(n) - n)[doc] + start
    raw = memoryview(ids.view(np.uint8))
    crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(begin.tolist(), length.tolist())), np.int64, len(begin))
    return {"row": doc, "doc_id": doc_ids[doc], "piece": piece, "start": start, "length": length, "ids_crc32": crc, "begin": begin, "ids": ids}


def _merge(level: int, nodes: int, capacity: int, full: float):
    """A best-fit round whose items are whole bins."""

    def merge(key, held: pd.DataFrame) -> pd.DataFrame:
        item = np.unique(held["sequence_id"].to_numpy(), return_inverse=True)[1]
        sizes = np.bincount(item, held["length"]).astype(np.int64)
        bins, offsets, n = best_fit(sizes, capacity)
        done = np.bincount(bins, sizes, n) >= full * capacity
        number = (np.int64(level) << 56) + int(key[0]) + bins * np.int64(nodes)
        return held.assign(sequence_id=number[item], offset=held["offset"].to_numpy() + offsets[item], done=done[bins][item])

    return merge


def pack(docs: DataFrame, vocab_path: str, capacity: int = 4096, end: int = 1, with_ids: bool = False, chunk: int = CHUNK_BYTES, memo: int = MEMO) -> DataFrame:
    """docs(doc_id, text, ...) -> one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked, ids.

    chunk: bytes of whole texts that a worker encodes at once; memo: pieces of text whose ids a worker keeps. Fewer take less memory and more time."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    ready = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    names = [*_NAMES, "done", "known", *(["ids"] if with_ids else [])]
    schema = PIECE + ", done boolean, known boolean" + (", ids array<int>" if with_ids else "")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        held: list[dict[str, np.ndarray]] = []
        n_held = n_bins = 0

        def settle() -> pa.RecordBatch:
            nonlocal held, n_held, n_bins
            cols = {k: np.concatenate([h[k] for h in held]) for k in _NAMES[:5]}
            bins, offsets, n = best_fit(cols["length"], capacity)
            done = np.bincount(bins, cols["length"], n) >= FULL[0] * capacity
            out = [pa.array(cols[k]) for k in _NAMES[:5]] + [pa.array(bins + base + n_bins), pa.array(offsets), pa.array(done[bins]), pa.array(np.concatenate([h["known"] for h in held]))]
            out[1] = out[1].cast(pa.int32())
            if with_ids:
                out.append(pa.array([h["ids"][a : a + k].astype(np.int32) for h in held for a, k in zip(h["begin"], h["length"])], pa.list_(pa.int32())))
            held, n_held, n_bins = [], 0, n_bins + n
            return pa.RecordBatch.from_arrays(out, names)

        encoder(vocab_path).memo.size = memo
        for batch in batches:
            for part in chunks(batch, "text", chunk):
                ids = part["doc_id"]
                found = tokenized(part["text"], np.arange(part.num_rows), vocab_path, capacity, end)
                found["doc_id"] = np.asarray(ids.fill_null(0))[found["row"]]
                found["known"] = np.asarray(ids.is_valid())[found["row"]]
                if not with_ids:
                    found.pop("ids")
                held.append(found)
                n_held += len(found["piece"])
                if n_held >= BLOCK or with_ids:
                    yield settle()
            give_back()
        if held:
            yield settle()

    table = scratch.write(ready.mapInArrow(first, schema), "level0")
    accepted = table.where("done")
    for level in range(1, len(FULL)):
        rest = table.where("not done")
        n_bins = rest.where("offset = 0").count()
        if not n_bins:
            break
        nodes = -(-n_bins // FAN_IN)
        full = 0.0 if nodes == 1 else FULL[level]

        node = F.pmod(F.xxhash64("sequence_id"), F.lit(nodes))
        table = scratch.write(rest.groupBy(node.alias("node")).applyInPandas(_merge(level, nodes, capacity, full), table.schema), f"level{level}")
        accepted = accepted.unionByName(table.where("done"))
        if nodes == 1:
            break
    # Ids stay whole numbers on their way; a null one is a null again at the end.
    return accepted.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("done", "known")
