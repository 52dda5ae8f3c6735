"""Adapters from the shared test tables to ledger-shaped frames.

Each adapter reads only the columns it needs, so the parquet scan's
``ReadSchema`` is pruned and predicates on ``Date`` reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import AMOUNT, CATEGORY, DATE, DESCRIPTION, EXPENSE, INCOME, TYPE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` joined to ``part``: shipped line = transaction, returned line = income.

    The join strategy is left to the planner: ``part`` is broadcast only when
    its measured size is under the broadcast threshold, else sort-merge.
    """
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_returnflag")
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    j = li.join(pt, li.l_partkey == pt.p_partkey, "inner")
    return j.select(
        F.col("l_shipdate").alias(DATE),
        F.col("p_name").alias(DESCRIPTION),
        F.col("l_extendedprice").alias(AMOUNT),
        F.col("p_type").alias(CATEGORY),
        F.when(F.col("l_returnflag") == "R", F.lit(INCOME)).otherwise(F.lit(EXPENSE)).alias(TYPE),
    )


def ledger_events(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """``events`` as a ledger; types other than signup/purchase pass through as-is.

    ``extra`` names further ``events`` columns to carry along.
    """
    ev = table(spark, sf_dir, "events")
    t = (
        F.when(F.col("event_type") == "signup", F.lit(INCOME))
        .when(F.col("event_type") == "purchase", F.lit(EXPENSE))
        .otherwise(F.col("event_type"))
    )
    return ev.select(
        F.col("ts").alias(DATE),
        F.col("props").alias(DESCRIPTION),
        F.col("value").alias(AMOUNT),
        F.col("event_type").alias(CATEGORY),
        t.alias(TYPE),
        *extra,
    )


def dirty_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` with string amounts of five kinds and keyword descriptions."""
    p = table(spark, sf_dir, "part")
    raw = (
        F.when(F.col("p_size") % 5 == 0, F.col("p_brand"))
        .when(F.col("p_size") % 5 == 1, F.lit("1,200"))
        .when(F.col("p_size") % 5 == 2, F.lit("12d"))
        .when(F.col("p_size") % 5 == 3, F.col("p_size").cast("string"))
    )
    desc = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("Salary "), F.col("p_name"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", raw.alias("raw_amount"), desc.alias(DESCRIPTION), F.col("p_type").alias(CATEGORY))


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as an all-string upload with messy headers, as read from a CSV.

    Headers `` date ``, ``DESCRIPTION``, ``Amount``, ``category``, ``order_key``;
    blank dates, NA tokens, thousands separators, a ``12d`` literal and keyword
    descriptions appear on a fixed rule of the order key.
    """
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    date = F.when(k % 11 == 0, F.lit("")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    desc = F.when(k % 7 == 0, F.concat(F.lit("Salary "), F.col("o_orderpriority"))).otherwise(F.col("o_orderpriority"))
    amount = (
        F.when(k % 5 == 0, F.lit("1,200"))
        .when(k % 5 == 1, F.lit("12d"))
        .when(k % 5 == 2, F.lit("NA"))
        .otherwise(F.col("o_totalprice").cast("string"))
    )
    cat = F.when(k % 13 == 0, F.lit("NA")).otherwise(F.col("o_orderstatus"))
    return o.select(
        date.alias(" date "),
        desc.alias("DESCRIPTION"),
        amount.alias("Amount"),
        cat.alias("category"),
        k.cast("string").alias("order_key"),
    )
