"""Approximate nearest neighbours by multi-index hashing.

Learned codes: the vectors' principal axes, turned by rotations that make the signs of the coordinates lose least (a few
alternating steps per rotation); several rotations give a code longer than the vector. A code is split into substrings,
and each substring has its own index. If two codes differ in at most r bits, some substring differs in at most
floor(r / m) bits, so probing all values within that distance in every index finds every code within the radius; what
it finds is checked on the whole code and then ranked by the float inner product in double precision.

The rotations and the radius come from a bounded sample (SAMPLE rows, the first by a hash): the radius takes in the stated
share of true neighbours, and is widened for a query until it has found enough. All rows are indexed, in shards of bounded
size that stay where they are read; the distinct query vectors are sent to them in blocks of bounded size, and the nearest
of all shards are merged. A stated query set against all rows in blocks is no join of all pairs.

Equal vectors are one entry with its 1 + k smallest ids, which is exact: equal vectors tie, and smaller ids come first.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite values take no part.
Fewer candidates than k are all returned. Rows with equal vec_id and vector count once. Extra columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch, only

#: Rows that the rotations and the radius are fitted on, at most.
SAMPLE = 4_096
#: Distinct vectors of a shard at most, but for its last batch, and distinct queries of a block, about.
SHARD = 65_536
BLOCK = 8_192
#: The share of true neighbours that the first radius takes in.
SHARE = 0.98


class Codes:
    """Rotated binary codes of several times the vectors' length, in substrings of 16 bits."""

    BITS = 16

    def __init__(self, sample: np.ndarray, rotations: int = 2, steps: int = 20, seed: int = 3):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.mean = sample.mean(0)
        centred = sample - self.mean
        axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
        self.substrings = -(-rotations * d // self.BITS)
        turns = []
        for _ in range(rotations):
            turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
            for _ in range(steps):
                signs = np.where(centred @ axes @ turn >= 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(signs.T @ (centred @ axes))
                turn = (u @ v).T
            turns.append(axes @ turn)
        self.turn = np.concatenate(turns, 1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        bits = (x - self.mean) @ self.turn >= 0
        bits = np.pad(bits, ((0, 0), (0, self.substrings * self.BITS - bits.shape[1])))
        return np.packbits(bits, axis=1).view(np.uint16)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(1, dtype=np.int64)


@cache
def ball(weight: int) -> np.ndarray:
    """All 16-bit values with at most so many bits set."""
    values = np.arange(2**Codes.BITS).astype(np.uint16)
    return values[np.bitwise_count(values) <= weight]


class Index:
    """One table per substring: the values that occur, in order, and the entries of each."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.m = codes, codes.shape[1]
        self.whole = _whole(codes)
        self.tables = []
        for j in range(self.m):
            order = np.argsort(codes[:, j], kind="stable")
            values, begin = np.unique(codes[order, j], return_index=True)
            self.tables.append((order, values, np.append(begin, len(codes))))

    def _probe(self, code: np.ndarray, weight: int) -> np.ndarray:
        """Entries that some table holds under a value within `weight` bits of the code's substring.

        The values in question are looked up in the table, or, where it holds fewer than these, its own are gone through."""
        hit = np.zeros(len(self.codes), bool)
        reach = sum(math.comb(Codes.BITS, w) for w in range(weight + 1))
        for j, (order, values, begin) in enumerate(self.tables):
            if reach < len(values):
                near = ball(weight) ^ code[j]
                at = np.minimum(np.searchsorted(values, near), len(values) - 1)
                at = at[values[at] == near]
            else:
                at = np.flatnonzero(np.bitwise_count(values ^ code[j]) <= weight)
            first, n = begin[at], begin[at + 1] - begin[at]
            hit[order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
        return np.flatnonzero(hit)

    def within(self, code: np.ndarray, radius: int, least: int) -> np.ndarray:
        """All entries within the radius of a code, or within the first wider one that has `least` entries.

        Of two codes that differ in at most r bits, some substrings differ in at most floor(r / m): what the tables give
        for that is checked on the whole codes."""
        whole, least = _whole(code[None])[0], min(least, len(self.codes))
        while True:
            probed = self._probe(code, min(radius // self.m, Codes.BITS))
            found = probed[np.bitwise_count(self.whole[probed] ^ whole).sum(1, dtype=np.int64) <= radius]
            if len(found) >= least or radius >= self.m * Codes.BITS:
                return found
            radius += self.m


def _whole(codes: np.ndarray) -> np.ndarray:
    """Codes in 64-bit parts."""
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 4)))).view(np.uint64)


def fit(vectors: np.ndarray, population: int, k: int, rotations: int = 2) -> tuple[Codes, int]:
    """Codes and the radius within which SHARE of the true neighbours lie, judged by a sample of the population."""
    codes = Codes(vectors, rotations)
    bits = codes.encode(vectors)
    asked = np.arange(0, len(vectors), max(1, len(vectors) // 256))
    # A sample is thinner than the whole: fewer of its nearest stand for the k nearest.
    near = max(1, min(len(vectors) - 1, round(k * len(vectors) / max(1, population))))
    held = []
    for i in asked:
        score = vectors @ vectors[i]
        score[i] = -np.inf
        top = np.argpartition(-score, near - 1)[:near] if near < len(vectors) else np.arange(len(vectors))
        held.append(distances(bits[top], bits[i]))
    return codes, int(np.quantile(np.concatenate(held), SHARE)) if held else 0


def _search(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, codes: Codes, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, score) of each query's nearest entries."""
    index = Index(codes.encode(vectors))
    q, e, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for i, (x, code) in enumerate(zip(queries, codes.encode(queries))):
        found = index.within(code, radius, k + 1)
        score = np.einsum("ij,j->i", vectors[found], x)
        if len(found) > k + 1:
            least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            keep = score >= least
            found, score = found[keep], score[keep]
        best = np.lexsort((ids[found], -score))[: k + 1]
        q.append(np.full(len(best), i))
        e.append(found[best])
        s.append(score[best])
    return np.concatenate(q), np.concatenate(e), np.concatenate(s)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy().reshape(-1, width)


def nearest(vectors: DataFrame, is_query, k: int = 20, rotations: int = 2) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank (from 1), vec_id, score: the k nearest other rows of each row for which the condition is_query holds."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "mih")
    v = F.col("embedding").cast("array<double>")
    rows = only(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x + 0.0).alias("v"), is_query.alias("asked"))
    rows = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    widths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if widths is None:
        return spark.createDataFrame([], schema)
    rows = scratch.write(rows.where(F.size("v") == widths["d"]).withColumn("key", F.xxhash64("v")), "rows")
    # Equal vectors: the smallest ids of each; partial ranks are cut before the shuffle.
    first = Window.partitionBy("key", "v").orderBy("vec_id")
    top = rows.select("vec_id", "v", "key").withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= k + 1)
    entries = scratch.write(top.groupBy("key", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("entry"), "v", "ids"), "entries")
    asked = scratch.write(rows.where("asked").join(entries.select(F.col("v").alias("w"), F.xxhash64("v").alias("key"), "entry"), "key").where(F.col("v") == F.col("w")).select("vec_id", "entry"), "asked")
    queries = scratch.write(entries.join(asked.select("entry").distinct(), "entry", "left_semi").select("entry", "v"), "queries")

    sample = np.array([r[0] for r in entries.orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).select("v").collect()], float)
    n_entries = entries.count()
    codes, radius = fit(sample, n_entries, k, rotations)
    n_blocks = max(1, math.ceil(queries.count() / BLOCK))
    own = entries.select("entry", "v")

    def searched(block: int) -> DataFrame:
        """All entries, where they are, against one block of queries, which is of bounded size and is sent there."""
        asking = queries.where(F.pmod(F.xxhash64("entry"), F.lit(n_blocks)) == block).toArrow()
        names, x = asking["entry"].to_numpy(), _matrix(asking["v"].combine_chunks(), widths["d"])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def shard() -> pa.RecordBatch:
                ids = np.concatenate([b["entry"].to_numpy() for b in held])
                q, e, score = _search(x, np.concatenate([_matrix(b["v"], x.shape[1]) for b in held]), ids, codes, radius, k)
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(ids[e]), pa.array(score)], ["query", "entry", "score"])

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                if sum(b.num_rows for b in held) >= SHARD:
                    yield shard()
            if held:
                yield shard()

        return own.mapInArrow(search, "query long, entry long, score double")

    found = scratch.write_all((searched(block) for block in range(n_blocks)), "found")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    merged = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("query", "entry", "score")
    # A query's own entry holds its copies; each entry stands for its ids, the smallest first.
    listed = merged.join(entries.select("entry", "ids"), "entry").groupBy("query").agg(F.sort_array(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("vec_id")))))).alias("near"))
    listed = listed.select(F.col("query").alias("entry"), F.slice("near", 1, k + 1).alias("near"))
    each = asked.select(F.col("vec_id").alias("query_id"), "entry").distinct().join(listed, "entry")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = each.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))


def usable(v):
    """Whether an array column can take part."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
