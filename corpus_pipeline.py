"""The corpus pipeline: documents to packed token sequences in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatorium.llm import minhash_dedup, mixing, packing, quality, secrets
from curatorium.llm.shared import written

#: A document scored below this goes: the classifier's own decision.
QUALITY_LEAST = 0.5


def _hidden(docs: DataFrame, *read: str) -> tuple[DataFrame, list[Column]]:
    """docs with every column but those an operator reads under a name that no operator uses, and the columns to select for the old names."""
    names = [c if c in read else f"column{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, learnt from the labels of these documents that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    weights = quality.train(docs.select("doc_id", "text"), labels.where(quality.remainder(3) != 1))
    rows, back = _hidden(docs, "text")
    return quality.score(rows, weights).where(F.col("score") >= QUALITY_LEAST).select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id; of rows that repeat it, all stay."""
    kept = minhash_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept")).distinct()
    rows, back = _hidden(docs, "doc_id")
    return rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi").select(*back)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets in its text masked and n_chars counted anew."""
    return secrets.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have the same share of rows, in a global random order."""
    rows, back = _hidden(docs, "doc_id", "text", "source")
    return mixing.mixed(rows).select(*back)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of tokens, each mixed as the whole is."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scans", mask_secrets),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained weights, sketches and tokens are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
