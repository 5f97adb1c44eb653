"""The corpus pipeline: quality rules, SimHash near-dedup, suffix-array dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; its result is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsla.llm import mixing, packing, quality, simhash, suffixes
from gridsla.llm.common import discard, materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood threshold."""
    return quality.score_quality(docs, table(spark, sf_dir, "labels")).where("quality.kept").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that start earlier; n_chars follows, documents with nothing left go."""
    cut = suffixes.cut_repeats(docs, as_text=True)
    values = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return cut.where((F.col("n_bytes") == 0) | (F.col("kept") != "")).select(
        *[(values[c] if c in values else F.col("rest").getField(c)).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources approach their target weights, in a global random order."""
    return mixing.mix_sources(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids."""
    import public_tokenizers
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeated_passages),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

ORACLE_SQL = None  # SimHash and the tokenizer are beyond SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir))
        discard(docs)  # the table of the stage before; the documents themselves stay
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
