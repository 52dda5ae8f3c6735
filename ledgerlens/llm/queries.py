"""Registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@register("op1_url_filter")
def op1(spark, d):
    from .url_filter import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, d, "pages"), rules)


@register("op2_exact_dedup")
def op2(spark, d):
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, d, "documents"))


@register("op4_decontaminate")
def op4(spark, d):
    from pyspark.sql import functions as F

    from .decontaminate import contamination

    found = contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        digest.alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@register("op6_sentencepiece")
def op6(spark, d):
    from .pieces import round_trip

    return round_trip(table(spark, d, "documents"), PIECE_MODEL)


@register("op8_secret_scan")
def op8(spark, d):
    from pyspark.sql import functions as F

    from .secret_scan import scan_secrets

    found = scan_secrets(table(spark, d, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_novel")


@register("op10_license_scan")
def op10(spark, d):
    from pyspark.sql import functions as F

    from .licenses import scan_licenses

    found = scan_licenses(table(spark, d, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "best", "dice", "n_units")


@register("op3_jaccard_join")
def op3(spark, d):
    from .jaccard import jaccard_join

    return jaccard_join(table(spark, d, "documents"))


def fold(column: str, parts: int):
    """crc32 of an id as text modulo ``parts``; a null id counts as an empty text."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


@register("op9_quality_classifier")
def op9(spark, d):
    from pyspark.sql import functions as F

    from .quality import THRESHOLD, fit_quality, score_quality

    docs = table(spark, d, "documents").select("doc_id", "text")
    machine = fit_quality(docs, table(spark, d, "labels").where(fold("doc_id", 4) != 2))
    scored = score_quality(docs, machine)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@register("op7_suffix_dedup")
def op7(spark, d):
    from pyspark.sql import functions as F

    from .repeats import repeated_passages

    found = repeated_passages(table(spark, d, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s.cast("array<string>"))), ",")
    return found.select("doc_id", "n_repeated", F.size("spans").cast("bigint").alias("n_spans"), spans.alias("spans"))


@register("op5_context_mixing")
def op5(spark, d):
    from .mixing import score_texts

    scored = score_texts(table(spark, d, "documents"), fold("doc_id", 10) != 0)
    return scored.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@register("op11_line_dedup")
def op11(spark, d):
    from pyspark.sql import functions as F

    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, d, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op12_centroids")
def op12(spark, d):
    from .centroids import cluster_vectors

    return cluster_vectors(table(spark, d, "embeddings")).drop("n_checked")


@register("op13_source_divergence")
def op13(spark, d):
    from .divergence import audit_sources

    return audit_sources(table(spark, d, "documents"))
