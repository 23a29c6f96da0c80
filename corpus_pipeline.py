"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents. SQL cannot express tokenizer fertility, min-max hashing, the hash order of the sample or best-fit packing, so
ORACLE_SQL is None and tests/llm/test_pipeline.py holds the stages against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import fertility, line_dedup, minmax, mixing, packing
from pagelake.llm.queries import vocab
from pagelake.llm.shared import Scratch
from pagelake.llm.words import FINEST

#: Words of which a worker keeps the ids: the stages share their workers, and what those hold adds up beside the JVM.
MEMO = 40_000
MEMO_PACKING = 120_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands."""
    return fertility.quality(docs, vocab("piece_bpe_32k.model"), docs.columns, drop=True, chunk=FINEST, memo=MEMO)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later similar lines are removed; a document of which no word is left goes."""
    cut = line_dedup.dedup_lines(docs, percent=80, spare=True)
    return cut.where((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return minmax.deduplicate(docs, k=5, percent=80, bands=30, rows=5, spare=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs, weights=(3, 1, 2), share=1.5, max_repeats=2)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens."""
    return packing.pack(docs, vocab("word_bpe_49k.json"), 4096, 1, chunk=FINEST, memo=MEMO_PACKING)


STAGES = [("quality rules", quality_rules), ("line dedup", dedup_lines), ("near dedup", near_dedup), ("mix sources", mix_sources), ("pack sequences", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
