"""Near-duplicate documents by min-max hashing.

A document is its set of distinct k-word shingles (64-bit hashes). Each permutation a * h + b gives two signature values,
the smallest and the largest, so half as many permutations are evaluated; each agrees with probability equal to the
Jaccard similarity, and the mean over both has a lower variance than over as many minima. Bands of `rows` values, all of
distinct permutations and all minima or all maxima, put similar documents into one bucket: a pair at the threshold s
shares none of the `bands` buckets with probability (1 - s^rows)^bands, below 1.2e-5 for the settings used here.

Equal sets are one class from the start, by a 128-bit digest. In a bucket every class is first paired with the smallest
one, and the pairs are confirmed on full sets. Where a bucket's classes then lie in several components, more links are
looked for between these; pairs within one component can add nothing and are never formed. Classes beside a big
component are held against all its sets and one another, block by block, through postings of shingles, and give as many
links as connect what all links connect. What is still apart after that, in small components, is paired. So no group of copies, however large, is expanded
into all its pairs, and no link between components is left out.

Defined results: a document with fewer than k words is the one shingle of all its words; one without words or with a null
text has an empty set and is linked with nothing. Rows with equal doc_id are one document, linked with all that any of
their texts is linked with; with equal text too, they get equal rows. A null doc_id is
linked with nothing and kept. Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, only
from .words import FINE, Texts, Words, chunks, mix, shingle_hashes, tidy


#: Classes from which a component is big, and shingles that a block of it holds, about.
BIG = 32
BLOCK = 400_000


class MinMax:
    """Band keys of a set; `bands` is even, and half of them hold minima, half maxima."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        if bands % 2:
            raise ValueError("bands must be even")
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        n = bands // 2 * rows
        self.a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64)
        self.c = rng.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Minima and maxima over all permutations of a set that is not empty."""
        low = high = None
        for at in range(0, len(hashes), 4096):
            x = np.multiply.outer(self.a, hashes[at : at + 4096])
            x += self.b[:, None]
            l, h = x.min(1), x.max(1)
            low, high = (l, h) if low is None else (np.minimum(low, l), np.maximum(high, h))
        return low, high

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        both = np.concatenate(self.signature(hashes)).reshape(self.bands, self.rows)
        return mix((both * self.c).sum(1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z are lower-cased."""
    words = Words(Texts(column, lower=True))
    hashes = words.hashes()
    return [np.unique(shingle_hashes(hashes[a:b], k)) for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())]


def sketches(docs: DataFrame, k: int, bands: int, rows: int, spare: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, d1 and d2 (digest of the set), keys (of its bands)."""
    schema = "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = MinMax(bands, rows)
        for batch in batches:
            for part in chunks(batch, "text", FINE):
                sets = shingle_sets(part["text"], k)
                n = [len(s) for s in sets]
                d1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                d2 = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                keys = [family.keys(s) if len(s) else s[:0].view(np.int64) for s in sets]
                flat = pa.array(np.concatenate(keys)) if keys else pa.array([], pa.int64())
                ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "n_shingles", "d1", "d2", "keys"])

    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidy(run, spare), schema)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, spare: bool) -> DataFrame:
    """The pairs (a, b) whose full sets have at least that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch["left"].to_pylist(), batch["right"].to_pylist()
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(left, right)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(good))

    joined = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")), "a")
    joined = joined.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")), "b")
    return joined.select("a", "b", "left", "right").mapInArrow(tidy(run, spare), "a long, b long")


def _forest(members: list[np.ndarray], member_ids: np.ndarray, one: np.ndarray, asking: list[np.ndarray], asking_ids: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect the sets asking with the members as all their links do; the members flagged in `one` are connected already.

    A set's intersections with all members are counted at once, through postings of the members' shingles."""
    sizes = np.array([len(s) for s in members], np.int64)
    shingles = np.concatenate(members) if members else np.zeros(0, np.uint64)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], np.repeat(np.arange(len(members)), sizes)[order]
    names, at = np.unique(np.concatenate([member_ids, asking_ids]), return_inverse=True)
    label = np.arange(len(names))
    if one.any():
        label[at[: len(members)][one]] = at[: len(members)][one][0]
    out = []
    for own, name, me in zip(asking, asking_ids.tolist(), at[len(members) :].tolist()):
        begin, end = np.searchsorted(shingles, own, "left"), np.searchsorted(shingles, own, "right")
        n = end - begin
        hits = owner[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        common = np.bincount(hits, minlength=len(members))
        good = np.flatnonzero(100 * common >= percent * (sizes + len(own) - common))
        for other, first in zip(*np.unique(label[at[good]], return_index=True)):
            if other != label[me]:
                out.append((name, int(member_ids[good[first]])))
                label[label == other] = label[me]
    return out


def _attached(named: DataFrame, scratch: Scratch) -> DataFrame:
    """Which classes share a bucket with which big components (into); of two big ones only the smaller is attached to the other."""
    big = scratch.write(named.where("size IS NOT NULL").select("key", F.col("component").alias("into"), F.col("size").alias("into_size"), F.col("shingles").alias("into_shingles")).distinct(), "big")
    smaller = F.struct(F.col("size"), F.col("component")) < F.struct(F.col("into_size"), F.col("into"))
    attached = named.join(big, "key").where((F.col("component") != F.col("into")) & (F.col("size").isNull() | smaller))
    return scratch.write(attached.select("rep", "n", "into", "into_shingles").distinct(), "attached")


def _to_big(attached: DataFrame, found: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links of the classes attached to big components, with these and with one another: as many as connect what they connect.

    The sets of a component and of what is attached to it are dealt into blocks of bounded size, and so are the attached
    ones once more, to be held against them; each meets every block."""
    blocks = lambda total: F.ceil(total / BLOCK).cast("int")
    needs = attached.groupBy("into", "into_shingles").agg(F.sum("n").alias("asking"))
    needs = scratch.write(needs.select("into", blocks(F.col("into_shingles") + F.col("asking")).alias("parts"), blocks(F.col("asking")).alias("turns")), "needs")
    dealt = lambda node, count: F.pmod(F.xxhash64(node), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    nodes = found.select(F.col("component").alias("into"), "node", F.lit(True).alias("one")).unionByName(attached.select("into", F.col("rep").alias("node"), F.lit(False).alias("one")))
    members = nodes.join(needs, "into").select("into", dealt("node", F.col("parts")).alias("part"), "turns", "node", "one").select("into", "part", every(F.col("turns")).alias("turn"), F.col("node").alias("doc_id"), "one")
    asking = attached.join(needs, "into").select("into", dealt("rep", F.col("turns")).alias("turn"), "parts", "rep").select("into", every(F.col("parts")).alias("part"), "turn", F.col("rep").alias("doc_id"))

    def hold(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        to_sets = lambda frame: [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
        edges = _forest(to_sets(own), own["doc_id"].to_numpy(), own["one"].to_numpy(bool), to_sets(others), others["doc_id"].to_numpy(), percent)
        return pd.DataFrame(edges or np.zeros((0, 2), np.int64), columns=["a", "b"])

    keys = ["into", "part", "turn"]
    own = scratch.write(members.join(sets, "doc_id").select(*keys, "doc_id", "one", "shingles"), "members")
    others = scratch.write(asking.join(sets, "doc_id").select(*keys, "doc_id", "shingles"), "asking")
    return scratch.write(own.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInPandas(hold, "a long, b long"), "big_links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 30, rows: int = 5, spare: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept (it is its own).

    Links: 100 * common shingles >= percent * shingles of either. spare: workers give their free memory back after each task."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minmax")
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    every = scratch.write(sketches(docs, k, bands, rows, spare), "sketches")
    filled = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.write(filled.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "n_shingles", "keys")).alias("x")).select("d1", "d2", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("n"), F.col("x.keys").alias("keys")), "classes")

    buckets = classes.select("rep", "n", F.explode("keys").alias("key"))
    hubs = buckets.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last").select("key", "hub")
    shared = scratch.write(buckets.join(hubs, "key"), "buckets")
    involved = shared.select(F.col("rep").alias("doc_id")).distinct()

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", FINE):
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([s.tobytes() for s in shingle_sets(part["text"], k)], pa.binary())], ["doc_id", "shingles"])

    sets = scratch.write(docs.join(involved, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(tidy(to_sets, spare), "doc_id long, shingles binary"), "sets")
    sizes = classes.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n"))
    stars = shared.where("rep <> hub").select("hub", "rep", "n").distinct().join(sizes, "hub")
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    stars = scratch.write(stars.where(fits(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("rep").alias("b")), "stars")
    links = scratch.write(_confirmed(stars, sets, percent, spare), "links")
    found = components(links, scratch)

    named = shared.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    big = found.join(classes.select(F.col("rep").alias("node"), "n"), "node").groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where(F.col("size") >= BIG)
    named = scratch.write(named.join(big, "component", "left"), "named")
    attached = _attached(named, scratch)
    if not attached.isEmpty():
        links = links.union(_to_big(attached, found, sets, percent, scratch))
        found = components(links, scratch)

    # Pairs with a member of a big component, or of two attached to the same one, are settled; what is left is paired across components.
    families = attached.groupBy("rep").agg(F.collect_set("into").alias("families"))
    small = named.where("size IS NULL").select("key", "rep", "n").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").join(families, "rep", "left")
    small = small.select("key", "rep", "n", F.coalesce("component", "rep").alias("component"), F.coalesce("families", F.array().cast("array<long>")).alias("families"))
    per = small.groupBy("key", "component").agg(F.count("*").alias("m"))
    largest = per.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    mixed = scratch.write(small.join(largest, "key"), "mixed")
    outer = mixed.where("component <> main").select("key", F.col("rep").alias("x"), F.col("n").alias("xn"), F.col("component").alias("xc"), F.col("families").alias("xf"), "main")
    inner = mixed.select("key", F.col("rep").alias("y"), F.col("n").alias("yn"), F.col("component").alias("yc"), F.col("families").alias("yf"))
    once = (F.col("yc") == F.col("main")) | (F.col("x") < F.col("y"))
    more = outer.join(inner, "key").where((F.col("xc") != F.col("yc")) & once & fits(F.col("xn"), F.col("yn")) & ~F.arrays_overlap("xf", "yf"))
    more = more.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = more.join(stars, ["a", "b"], "left_anti")
    links = links.union(scratch.write(_confirmed(more, sets, percent, spare), "more"))
    found = components(links, scratch)

    members = every.join(classes.select("d1", "d2", "rep"), (every.d1 == classes.d1) & (every.d2 == classes.d2) & (every.n_shingles > 0) & every.doc_id.isNotNull(), "left").select("doc_id", "n_shingles", "rep")
    out = members.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The documents without those whose component has a smaller doc_id; columns as they were. Rows with equal doc_id stay or go together."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    gone = near_duplicates(docs, **options).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    own = F.col(names[docs.columns.index("doc_id")]).cast("long")
    return docs.toDF(*names).join(gone, own == F.col("gone"), "left_anti").toDF(*docs.columns)
