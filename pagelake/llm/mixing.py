"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations alone.

Each source gets a target in words; no target passes `max_repeats` times its source's size, and what is cut off is
shared among the others by weight (a water level, found from running sums over the sorted sources). Target over size is
the expected number of copies of each of its documents, or in proportion to a weight column if one is named. The whole
part of it is certain. For the rest, with inclusion probability p, documents rank by (u / (1 - u)) / (p / (1 - p)), u a
hash of the row, and the first ones are taken, up to the number of words that comes nearest to what the target still needs.

A source's cut in that order is found without sorting it: sums over 4096 ranges of rank, then over 4096 ranges within
the range that the target falls into, then over the single ranks within that. A hot source is summed before its rows
are shuffled, and the decision on each row needs only its source's cut.

Defined results: a null text has size 0; a null source is a source of its own, the last. Rows equal in id and text are
decided alike. A source without words has target 0 and none of its rows are taken. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch, only

RANKS = 1 << 48
STEP = 1 << 12


@dataclass
class Plan:
    """cuts: a row per source with source_size, target, scale (expected copies of a document of weight 1), cap and cut (the last rank taken)."""

    cuts: DataFrame
    sized: DataFrame


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _uniform(*columns: Column) -> Column:
    """In (0, 1), the same for equal rows in every run."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + 0.5) / float(1 << 53)


def _decided(rows: DataFrame, cuts: DataFrame, max_repeats: int) -> DataFrame:
    """rows(source, size, u, weight) with their source's plan, the certain copies and the rank for the rest (null: none)."""
    joined = rows.join(cuts.withColumnRenamed("source", "cut_source"), F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    expected = F.least(F.col("scale") * F.col("weight"), F.lit(float(max_repeats)))
    whole = F.floor(expected + 1e-9)
    p = F.when(expected - whole > 1e-9, expected - whole)
    odds = F.col("u") * (1 - p) / (F.col("u") * (1 - p) + p * (1 - F.col("u")))
    return joined.withColumns({"whole": F.coalesce(whole, F.lit(0)).cast("long"), "rank": F.least(F.floor(odds * RANKS).cast("long"), F.lit(RANKS - 1))})


def _targets(sources: DataFrame, weights: tuple[float, ...], share: float, max_repeats: int) -> DataFrame:
    """sources(source, source_size) -> adds target."""
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sources.withColumn("weigh", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    ranked = ranked.withColumns({"most": F.col("source_size").cast("double") * max_repeats, "total": F.sum("source_size").over(everything).cast("double") * share})
    by_level = Window.orderBy(F.col("most") / F.col("weigh"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumns({"at": F.row_number().over(by_level), "level": (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weigh").over(after)})
    level = F.min(F.when(F.col("level") <= F.col("most") / F.col("weigh"), F.struct("at", "level"))).over(everything)["level"]
    target = F.when(F.col("water").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("water") * F.col("weigh")))
    return ranked.withColumn("water", level).select("source", "source_size", target.alias("target"))


def _first_beyond(sums: DataFrame, key: str) -> DataFrame:
    """sums(source, needed, before, key, words): per source the key in whose range the sum of words passes what is needed, with the words before it."""
    running = Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    up_to = sums.withColumn("up_to", F.col("before") + F.sum("words").over(running))
    return up_to.where(F.col("up_to") > F.col("needed")).groupBy("source").agg(F.min(F.struct(key, F.col("needed"), (F.col("up_to") - F.col("words")).alias("before"))).alias("x")).select("source", "x.*")


def plan(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2, seed: int = 0, weight_column: str | None = None) -> Plan:
    """docs(doc_id, text, source[, weight_column]) -> the cut of each source, and the rows' sizes."""
    scratch = Scratch(docs.sparkSession, "mixing")
    weight = F.coalesce(F.greatest(F.col(weight_column).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_column else F.lit(1.0)
    ready = only(docs, "doc_id", "text", "source", *([weight_column] if weight_column else []))
    sized = scratch.write(ready.select("doc_id", "source", _size(F.col("text")).alias("size"), _uniform(F.lit(seed), F.col("doc_id"), F.col("text")).alias("u"), weight.alias("weight")), "sized")

    sources = scratch.write(_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeats), "targets")
    scaled = sources.withColumn("scale", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    # With unequal weights, copies that would pass max_repeats are cut off and the scale of the others grows until none does.
    for _ in range(20 if weight_column else 0):
        own = sized.join(scaled.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        above = F.col("scale") * F.col("weight") >= max_repeats
        sums = own.groupBy("source").agg(F.sum(F.when(above, F.col("size") * max_repeats).otherwise(0)).alias("full"), F.sum(F.when(~above, F.col("size") * F.col("weight")).otherwise(0.0)).alias("open"))
        renewed = sources.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", F.coalesce(F.when(F.col("open") > 0, (F.col("target") - F.col("full")) / F.col("open")), F.lit(float(max_repeats) * 1e12)).alias("scale"))
        renewed = scratch.write(renewed, "scale")
        moved = renewed.select("source", F.col("scale").alias("new")).join(scaled.select(F.col("source").alias("s"), "scale"), F.col("source").eqNullSafe(F.col("s"))).where(F.abs(F.col("new") - F.col("scale")) > 1e-9 * F.abs(F.col("new")))
        done = moved.isEmpty()
        scaled = renewed
        if done:
            break

    rows = _decided(sized, scaled, max_repeats)
    ranked = rows.where("rank IS NOT NULL AND size > 0")
    certain = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("whole")).alias("certain"))
    needs = scratch.write(certain.withColumnRenamed("source", "s").join(scaled, F.col("s").eqNullSafe(F.col("source"))).select("source", (F.col("target") - F.col("certain")).alias("needed")), "needs")

    def narrowed(held: DataFrame, found: DataFrame, key: Column, name: str, *on: str) -> DataFrame:
        found = found.select(F.col("source").alias("s"), "needed", "before", *[F.col(c).alias(f"_{c}") for c in on])
        match = F.col("source").eqNullSafe(F.col("s"))
        for c in on:
            match = match & (F.col(c) == F.col(f"_{c}"))
        sums = held.join(found, match).groupBy("source", "needed", "before", key.alias(name)).agg(F.sum("size").alias("words"))
        return sums

    held = ranked.select("source", "size", "rank", F.floor(F.col("rank") / (STEP * STEP * STEP)).alias("high"), F.floor(F.col("rank") / (STEP * STEP)).alias("middle"))
    high = scratch.write(_first_beyond(narrowed(held, needs.withColumn("before", F.lit(0)), F.col("high"), "high"), "high"), "high")
    middle = scratch.write(_first_beyond(narrowed(held, high, F.col("middle"), "middle", "high"), "middle"), "middle")
    single = narrowed(held, middle, F.col("rank"), "rank", "middle")
    running = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    over = single.withColumn("up_to", F.col("before") + F.sum("words").over(running))
    first = over.where(F.col("up_to") > F.col("needed")).groupBy("source").agg(F.min(F.struct("rank", "up_to", "words", "needed")).alias("x"))
    # The row that passes the target is taken if that comes nearer to it than leaving it.
    nearer = F.col("x.up_to") - F.col("x.needed") < F.col("x.needed") - (F.col("x.up_to") - F.col("x.words"))
    cut = first.select(F.col("source").alias("s"), F.when(nearer, F.col("x.rank")).otherwise(F.col("x.rank") - 1).alias("found"))
    cuts = scaled.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "scale", F.coalesce("found", F.lit(RANKS)).alias("cut"))
    return Plan(scratch.write(cuts, "cuts"), sized)


def apply(rows: DataFrame, made: Plan, max_repeats: int = 2) -> DataFrame:
    """rows(source, size, u, weight, ...) -> adds source_size, target and copies."""
    decided = _decided(rows, made.cuts, max_repeats)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce((F.col("rank") <= F.col("cut")).cast("long"), F.lit(0))).otherwise(0)
    return decided.withColumn("copies", copies.cast("long")).drop("scale", "cut", "whole", "rank", "u", "weight")


def mix_report(docs: DataFrame, max_repeats: int = 2, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies and taken, the words that the mix takes of it."""
    made = plan(docs, max_repeats=max_repeats, **options)
    out = apply(made.sized, made, max_repeats)
    return out.select("doc_id", "source", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, max_repeats: int = 2, seed: int = 0, weight_column: str | None = None, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with the columns they had."""
    made = plan(docs, max_repeats=max_repeats, seed=seed, weight_column=weight_column, **options)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text", "source")}
    weight = F.coalesce(F.greatest(F.col(names[docs.columns.index(weight_column)]).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_column else F.lit(1.0)
    rows = docs.toDF(*names).select("*", at["source"].alias("source"), _size(at["text"]).alias("size"), _uniform(F.lit(seed), at["doc_id"], at["text"]).alias("u"), weight.alias("weight"))
    taken = apply(rows, made, max_repeats).where("copies > 0")
    return taken.select(*names, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*names).toDF(*docs.columns)
