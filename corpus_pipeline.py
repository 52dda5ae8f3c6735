"""Corpus pipeline: quality, exact copies, near copies, benchmark passages, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that ``run`` writes as Parquet and reads again as the
next stage's documents.  All but the last return the columns of ``documents``.

Null and empty texts are scored by their statistics (and go, unless the classifier accepts those), equal each other, have no
near copies, no benchmark words, and null or no ids.  Very long texts are read whole.  A row that is repeated is an exact copy
of itself, so one stays; of equal texts the longest, then the smallest id stays, of near copies the smallest id; a null id
is smaller than all others.  Empty tables give empty results with the same columns.  Further columns of ``documents``,
whatever their names, pass through all stages but the last, which returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, exact_dedup, jaccard, pieces, quality
from ledgerlens.llm.queries import PIECE_MODEL, fold, table
from ledgerlens.session import scratch_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rates at its threshold or above."""
    machine = quality.fit_quality(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2))
    score = "quality_score"
    while score in docs.columns:
        score = f"_{score}"
    scored = quality.score_quality(docs, machine, score_col=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.drop_near_copies(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly such passages go."""
    clean = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that stays."""
    coded = pieces.encode_documents(docs, PIECE_MODEL)
    return coded.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("bigint").alias("n_ids"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("SentencePiece encoding", encode),
]

ORACLE_SQL = None  # a fitted model and the piece encoding have no SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + "-".join(name.lower().split()))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
