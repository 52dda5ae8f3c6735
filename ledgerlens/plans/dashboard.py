"""Dashboard views as compositions of the metric operators.

``home`` and ``analytics`` return dictionaries of lazy DataFrames (one job per
frame when the caller collects it).  With the ledger's rollup, the ledger
itself is read only for the views that list its rows; every total, and the
parameters that the UI derives from the data (the default month, the category
chosen for drill-down), come from the rollup.  Those parameters are resolved
with one single-row action each, so later filters are literals that reach the
parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import metrics as M
from ..schema import CATEGORY, RECENT_N, TOP_N
from ..sources.collection import read_current_ledger, read_current_rollup


def home(ledger: DataFrame, recent_n: int = RECENT_N, rollup: DataFrame | None = None) -> dict[str, DataFrame]:
    sums = ledger if rollup is None else rollup
    return {
        "kpi_totals": M.kpi_totals(sums),
        "monthly_net": M.monthly_net(sums),
        "top_expense_category": M.top_expense_category(sums),
        "recent_activity": M.recent_activity(ledger, recent_n),
    }


def resolve_default_month(ledger: DataFrame, as_of=None):
    """The month the analytics view opens on: the month of the latest date (of a ledger or its rollup)."""
    return M.default_month(ledger, as_of).first()["default_date"]


def resolve_top_category(ledger: DataFrame) -> str | None:
    """The most frequent category (what the first filter button selects), of a ledger or its rollup."""
    row = M.top_categories(ledger, 1).first()
    return None if row is None else row[CATEGORY]


def analytics(ledger: DataFrame, month=None, category: str | None = None, top_n: int = TOP_N, as_of=None, rollup: DataFrame | None = None) -> dict[str, DataFrame]:
    sums = ledger if rollup is None else rollup
    month = resolve_default_month(sums, as_of) if month is None else month
    return {
        "month_distribution": M.month_distribution(sums, month),
        "top_categories": M.top_categories(sums, top_n),
        "category_drilldown": M.category_drilldown(ledger, category),
    }


def open_views(spark: SparkSession, root: str, as_of=None) -> dict[str, DataFrame]:
    """Both views of the current ledger version under ``root``, opened on the default month and the most frequent category."""
    ledger, rollup = read_current_ledger(spark, root), read_current_rollup(spark, root)
    category = resolve_top_category(rollup)
    return {**home(ledger, rollup=rollup), **analytics(ledger, category=category, as_of=as_of, rollup=rollup)}
