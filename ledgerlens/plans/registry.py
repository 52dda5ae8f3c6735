"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each reads the shared tables (or data Spark derives from them) in full.
The matching DuckDB SQL for the independent oracle lives in ``oracle``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, labels, text
from ..operators import metrics as M
from ..schema import AMOUNT, CATEGORY, DATE, DESCRIPTION, LEDGER_COLUMNS, TYPE
from ..sources import adapters as A
from . import dashboard

# Fixed clock for registered queries, so results are reproducible.
AS_OF = dt.datetime(2026, 1, 1)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


# --- aggregates and lists over the main ledger --------------------------------


@register("monthly_net")
def q_monthly_net(spark, d):
    return M.monthly_net(A.ledger(spark, d))


@register("monthly_net_events")
def q_monthly_net_events(spark, d):
    return M.monthly_net(A.ledger_events(spark, d))


@register("kpi_totals")
def q_kpi_totals(spark, d):
    return M.kpi_totals(A.ledger(spark, d))


@register("kpi_totals_events")
def q_kpi_totals_events(spark, d):
    return M.kpi_totals(A.ledger_events(spark, d))


@register("txn_count")
def q_txn_count(spark, d):
    return M.txn_count(A.ledger(spark, d))


@register("expense_rows")
def q_expense_rows(spark, d):
    return M.expense_rows(A.ledger(spark, d))


@register("distinct_months")
def q_distinct_months(spark, d):
    return M.distinct_months(A.ledger(spark, d))


@register("expense_by_category")
def q_expense_by_category(spark, d):
    return M.expense_by_category(A.ledger(spark, d))


@register("top_expense_category")
def q_top_expense_category(spark, d):
    return M.top_expense_category(A.ledger(spark, d))


@register("top_expense_category_events")
def q_top_expense_category_events(spark, d):
    return M.top_expense_category(A.ledger_events(spark, d))


@register("default_month")
def q_default_month(spark, d):
    return M.default_month(A.ledger(spark, d), AS_OF)


@register("month_slice")
def q_month_slice(spark, d):
    led = A.ledger(spark, d)
    return M.month_slice(led, dashboard.resolve_default_month(led, AS_OF))


@register("month_distribution")
def q_month_distribution(spark, d):
    led = A.ledger(spark, d)
    return M.month_distribution(led, dashboard.resolve_default_month(led, AS_OF))


@register("category_share")
def q_category_share(spark, d):
    return M.category_share(A.ledger(spark, d))


@register("category_frequency")
def q_category_frequency(spark, d):
    return M.category_frequency(A.ledger(spark, d))


@register("top_categories")
def q_top_categories(spark, d):
    return M.top_categories(A.ledger(spark, d))


@register("top_category_rows")
def q_top_category_rows(spark, d):
    return M.top_category_rows(A.ledger(spark, d))


@register("category_drilldown")
def q_category_drilldown(spark, d):
    led = A.ledger(spark, d)
    return M.category_drilldown(led, dashboard.resolve_top_category(led))


@register("recent_activity")
def q_recent_activity(spark, d):
    return M.recent_activity(A.ledger(spark, d))


@register("recent_activity_events")
def q_recent_activity_events(spark, d):
    return M.recent_activity(A.ledger_events(spark, d))


# --- per-row display columns -------------------------------------------------


@register("date_labels")
def q_date_labels(spark, d):
    dd = F.col(DATE)
    return A.ledger_events(spark, d).select(
        DATE,
        labels.month_short(dd).alias("month_label"),
        labels.day_label(dd).alias("day_label"),
        labels.long_date(dd).alias("long_date"),
        labels.month_year(dd).alias("month_year"),
        labels.month_name(dd).alias("month_name"),
    )


@register("with_labels")
def q_with_labels(spark, d):
    return labels.with_labels(A.ledger_events(spark, d))


@register("format_currency")
def q_format_currency(spark, d):
    m = M.monthly_net(A.ledger(spark, d))
    return m.select(
        "month_key",
        "net",
        labels.currency(F.col("income")).alias("income_text"),
        labels.currency(F.col("expense")).alias("expense_text"),
        labels.currency(F.col("net")).alias("net_text"),
    )


@register("classify_icon")
def q_classify_icon(spark, d):
    led = A.ledger_events(spark, d)
    cls = labels.icon_class(F.col(CATEGORY), F.col(TYPE))
    return led.select(*LEDGER_COLUMNS, cls.alias("icon"), labels.icon_glyph(cls).alias("icon_glyph"))


@register("signed_display")
def q_signed_display(spark, d):
    led = A.ledger_events(spark, d)
    s = labels.sign(F.col(TYPE))
    return led.select(
        *LEDGER_COLUMNS,
        s.alias("sign"),
        F.concat(s, F.lit(" "), labels.currency(F.col(AMOUNT))).alias("amount_display"),
    )


# --- cleaning ----------------------------------------------------------------


@register("infer_type")
def q_infer_type(spark, d):
    p = A.dirty_part(spark, d)
    return clean.infer_type(p.select("p_partkey", DESCRIPTION, CATEGORY))


@register("coerce_amount")
def q_coerce_amount(spark, d):
    p = A.dirty_part(spark, d)
    return p.select("p_partkey", "raw_amount", clean.amount_expr(F.col("raw_amount")).alias(AMOUNT))


@register("parse_date")
def q_parse_date(spark, d):
    raw = A.dirty_orders(spark, d).select(F.col("order_key"), F.col(" date ").alias(DATE))
    return clean.parse_date(raw)


@register("normalize_headers")
def q_normalize_headers(spark, d):
    from ..sources.csv import normalize_headers

    p = A.table(spark, d, "part").select(
        F.col("p_partkey").alias(" part_key"),
        F.col("p_name").alias(" DESCRIPTION "),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("amount_inr"),
    )
    return normalize_headers(p)


# --- text --------------------------------------------------------------------


@register("row_text")
def q_row_text(spark, d):
    return text.row_text(A.ledger_events(spark, d))


@register("text_fingerprint")
def q_text_fingerprint(spark, d):
    return text.text_fingerprint(text.row_text(A.ledger(spark, d)))


@register("dataset_fingerprint")
def q_dataset_fingerprint(spark, d):
    return text.dataset_fingerprint(text.row_text(A.ledger(spark, d)))


@register("records_json")
def q_records_json(spark, d):
    return text.records_json(A.ledger_events(spark, d))


# --- sources and sinks (write to shared scratch, read back) -------------------


@register("csv_scan")
def q_csv_scan(spark, d):
    from ..session import scratch_path
    from ..sources.csv import read_ledger_csv, write_csv

    path = write_csv(A.dirty_orders(spark, d), scratch_path(spark, "upload"))
    return read_ledger_csv(spark, path)


@register("sync_collection")
def q_sync_collection(spark, d):
    from ..session import scratch_path
    from ..sources.collection import append_collection, read_collection

    path = scratch_path(spark, "collection")
    append_collection(A.ledger_events(spark, d), path)
    return read_collection(spark, path)


@register("read_collection")
def q_read_collection(spark, d):
    """Two batches with different keys in one collection; reading gives the union of keys."""
    from ..session import scratch_path
    from ..sources.collection import append_collection, read_collection

    path = scratch_path(spark, "collection")
    led = A.ledger_events(spark, d, extra=("user_id",))
    typed = F.col(CATEGORY).isin("signup", "purchase")
    append_collection(led.where(typed).drop("user_id"), path)
    append_collection(led.where(~typed).drop(TYPE), path)
    return read_collection(spark, path)


@register("replace_ledger")
def q_replace_ledger(spark, d):
    from ..session import scratch_path
    from ..sources.collection import read_current_ledger, replace_ledger

    root = scratch_path(spark, "ledger")
    replace_ledger(A.ledger_events(spark, d), root)
    replace_ledger(A.ledger(spark, d), root)
    return read_current_ledger(spark, root)


# --- measures from the rollup beside a ledger version --------------------------


def _rollup(spark, d) -> DataFrame:
    from ..session import scratch_path
    from ..sources.collection import read_current_rollup, replace_ledger

    root = scratch_path(spark, "ledger")
    replace_ledger(A.ledger(spark, d), root)
    return read_current_rollup(spark, root)


@register("ledger_rollup")
def q_ledger_rollup(spark, d):
    amount = M.to_money(F.struct("cents", "rest")).alias("amount")
    return _rollup(spark, d).select("month", CATEGORY, TYPE, amount, F.col("n").alias("txn_count"), "last_date")


@register("rollup_kpi_totals")
def q_rollup_kpi_totals(spark, d):
    return M.kpi_totals(_rollup(spark, d))


@register("rollup_monthly_net")
def q_rollup_monthly_net(spark, d):
    return M.monthly_net(_rollup(spark, d))


@register("rollup_month_distribution")
def q_rollup_month_distribution(spark, d):
    rollup = _rollup(spark, d)
    return M.month_distribution(rollup, dashboard.resolve_default_month(rollup, AS_OF))


@register("rollup_top_categories")
def q_rollup_top_categories(spark, d):
    return M.top_categories(_rollup(spark, d))


# --- conversations, retrieval, prompts ---------------------------------------


def _embeddings(spark, d):
    e = A.table(spark, d, "embeddings")
    return (
        e.select(F.col("vec_id").alias("query_id"), "embedding"),
        e.select(
            F.col("vec_id").alias("row_id"),
            "embedding",
            F.format_string("Record %d, label %d", F.col("vec_id"), F.col("label")).alias("text"),
        ),
    )


@register("pending_turns")
def q_pending_turns(spark, d):
    from ..operators.conversation import pending_turns

    return pending_turns(A.table(spark, d, "conversations"))


@register("append_answers")
def q_append_answers(spark, d):
    """Echo answers (stand-in for the hosted model) appended after each pending question."""
    from ..operators.conversation import append_answers, pending_turns

    conv = A.table(spark, d, "conversations")
    answers = pending_turns(conv).select("conv_id", "turn", F.concat(F.lit("Received: "), F.col("text")).alias("text"))
    return append_answers(conv, answers)


@register("knn")
def q_knn(spark, d):
    from ..operators.knn import knn

    queries, corpus = _embeddings(spark, d)
    return knn(queries, corpus.drop("text"))


@register("knn_lookup")
def q_knn_lookup(spark, d):
    labels_ = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label")
    return q_knn(spark, d).join(labels_, "row_id")


@register("knn_small_corpus")
def q_knn_small_corpus(spark, d):
    """k above the corpus size: one representative vector per label, every vector as a query."""
    from ..operators.knn import knn

    e = A.table(spark, d, "embeddings")
    reps = e.groupBy("label").agg(F.min("vec_id").alias("row_id"), F.min_by("embedding", "vec_id").alias("embedding"))
    return knn(e.select(F.col("vec_id").alias("query_id"), "embedding"), reps.select("row_id", "embedding"), k=5)


@register("assemble_context")
def q_assemble_context(spark, d):
    from ..operators.knn import knn
    from ..operators.prompts import assemble_context

    queries, corpus = _embeddings(spark, d)
    return assemble_context(knn(queries, corpus, payload=("text",)), queries)


@register("build_prompts")
def q_build_prompts(spark, d):
    from ..operators.prompts import build_prompts, with_system_context

    e = A.table(spark, d, "embeddings")
    q = F.format_string("Which records are closest to record %d?", F.col("vec_id"))
    questions = e.select(F.col("vec_id").alias("query_id"), with_system_context(q, AS_OF).alias("question"))
    return build_prompts(questions.join(q_assemble_context(spark, d), "query_id"))


@register("embed_texts")
def q_embed_texts(spark, d):
    from ..operators.embed import embed_texts

    docs = A.table(spark, d, "documents").select("doc_id", "text")
    return embed_texts(docs, spread=True).select("doc_id", "embedding")


@register("embed_cached")
def q_embed_cached(spark, d):
    from ..operators.embed import embed_cached
    from ..session import scratch_path

    docs = A.table(spark, d, "documents").select("doc_id", "text")
    out, _ = embed_cached(docs, scratch_path(spark, "embed-cache"))
    return out.select("doc_id", "fp", "embedding")


@register("cache_misses")
def q_cache_misses(spark, d):
    """Cache filled from the English documents; the misses are every other distinct text."""
    from ..operators.embed import cache_misses, fill_cache
    from ..session import scratch_path

    docs = A.table(spark, d, "documents")
    cache = scratch_path(spark, "embed-cache")
    fill_cache(docs.where(F.col("lang") == "en"), cache)
    return cache_misses(docs, cache)


def _ledger_index(spark, d) -> DataFrame:
    from ..session import scratch_path
    from .rag import ingest

    done = ingest(A.ledger(spark, d), scratch_path(spark, "index"), scratch_path(spark, "embed-cache"))
    return spark.read.parquet(done.path)


@register("ingest")
def q_ingest(spark, d):
    """The index rows without their ingest-time row ids (which SQL cannot reproduce)."""
    return _ledger_index(spark, d).select("text", "fp", "embedding")


@register("retrieve")
def q_retrieve(spark, d):
    from ..operators.conversation import pending_turns
    from ..operators.prompts import with_system_context
    from .rag import retrieve

    pend = pending_turns(A.table(spark, d, "conversations"))
    qs = pend.select(F.col("conv_id").alias("query_id"), with_system_context(F.col("text"), AS_OF).alias("question"))
    return retrieve(qs, _ledger_index(spark, d)).select("query_id", "rank", "distance", "text")


@register("rag_batch")
def q_rag_batch(spark, d):
    from .rag import rag_batch

    return rag_batch(A.table(spark, d, "conversations"), _ledger_index(spark, d), AS_OF)
