"""Generated demo ledger: a 10-transaction pattern repeated over daily dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import AMOUNT, CATEGORY, DATE, DESCRIPTION, TYPE

# --- fixed values: the demo pattern, in order ---------------------------------
DEMO_DESCRIPTIONS = ["Salary", "Rent", "Groceries", "Uber", "Netflix", "Dividends", "Gym", "Dining Out", "Flight", "Consulting"]
DEMO_AMOUNTS = [5000, 2000, 300, 45, 15, 150, 60, 120, 400, 1500]
DEMO_CATEGORIES = ["Income", "Rental", "Grocery", "Travel", "Entertainment", "Investments", "Health", "Food", "Travel", "Business"]
DEMO_TYPES = ["Income", "Expense", "Expense", "Expense", "Expense", "Income", "Expense", "Expense", "Expense", "Income"]


def demo_ledger(spark: SparkSession, n: int = 30, as_of=None, num_partitions: int | None = None) -> DataFrame:
    """``n`` rows, one per day, the last one at ``as_of`` (default: now, zone-less).

    Generated from ``spark.range`` with the pattern as array literals, so any
    ``n`` is produced in parallel without a driver-side list.
    """
    if as_of is None:
        end = F.current_timestamp().cast(T.TimestampNTZType())
    else:
        text = as_of.strftime("%Y-%m-%d %H:%M:%S.%f") if isinstance(as_of, (dt.date, dt.datetime)) else str(as_of)
        end = F.lit(text).cast(T.TimestampNTZType())
    ids = spark.range(0, n, 1, num_partitions)
    pick = lambda values, typ: F.element_at(F.array(*[F.lit(v) for v in values]).cast(T.ArrayType(typ)), (F.col("id") % 10 + 1).cast("int"))
    back = (F.lit(n - 1) - F.col("id")).cast("int")
    return ids.select(
        F.timestamp_add("DAY", -back, end).alias(DATE),
        pick(DEMO_DESCRIPTIONS, T.StringType()).alias(DESCRIPTION),
        pick(DEMO_AMOUNTS, T.DoubleType()).alias(AMOUNT),
        pick(DEMO_CATEGORIES, T.StringType()).alias(CATEGORY),
        pick(DEMO_TYPES, T.StringType()).alias(TYPE),
    )
