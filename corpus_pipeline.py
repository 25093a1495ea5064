"""Corpus pipeline: toxicity, quality, exact and near deduplication, then packing, over ``documents``.

Each stage takes the rows its predecessor kept, written as Parquet and read again; all but the last return the columns
of ``documents``.

Defined cases: null and empty texts fail the quality rules; very long texts pass every stage whole; of repeated rows and
ties the row with the largest id stays in exact dedup, one row of each class in near dedup; an empty table gives an empty
result; extra columns of any name are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm import exact_dedup, packing, quality, toxicity, weighted_minhash
from veridoc.llm.common import every, fresh, new_path
from veridoc.llm.queries import table, word_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt on the labelled part of its input, does not call toxic."""
    [score] = fresh(docs.columns, "score")
    scored = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"), out=score)
    return scored.filter(F.col(score) < toxicity.THRESHOLD).select(*every(docs))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoff of their language."""
    [verdict] = fresh(docs.columns, "verdict")
    judged = quality.quality_verdicts(docs, table(spark, sf_dir, "labels"), out=verdict)
    return judged.filter(F.col(f"{verdict}.kept")).select(*every(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return weighted_minhash.near_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences of what is left."""
    packed = packing.packed_pieces(docs, word_bpe())
    return packed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("packing", pack),
]

#: Learnt cutoffs, similarity classes and tokens have no SQL form; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
