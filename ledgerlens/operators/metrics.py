"""Ledger analytics: totals, monthly flow, category breakdowns, lists.

Every measure is one declarative aggregate over one scan (partial aggregate
per task, one small shuffle of partial states).  Money is summed as exact
cents (integer count, decimal total) so the result does not depend on
partitioning (amounts that are not whole cents, or are beyond the cent range,
are added as doubles), and reported as double.  Sums over no rows are 0, not null.

Measures that only need sums and counts by month, category and type also take
the ledger's rollup (``build_rollup``) in its place: a table of such sums that
is written once beside a ledger version, so that a dashboard does not scan
the ledger again for each measure.  The results are the same.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import currency, day_label, icon_class, icon_glyph, month_key, month_short, month_start, month_year, sign
from ..schema import AMOUNT, CATEGORY, DATE, DESCRIPTION, EXPENSE, INCOME, LEDGER_COLUMNS, RECENT_N, TOP_N, TYPE



# Whole-cent amounts below this magnitude are counted as cents in a long; all others are summed as they are.
CENT_LIMIT = 9.0e15
CENTS = T.DecimalType(18, 0)
ONE_CENT = Decimal("0.01")
BROADCAST_KEYS = 10_000


def _zero() -> Column:
    return F.lit(0).cast(CENTS)


def _whole_cents(x: Column) -> Column:
    """Cents of an amount that is a whole number of them (typed DECIMAL(18,0)), else null.

    Computed with primitive double/long arithmetic (Spark's double->decimal
    cast formats every value as text first).
    """
    units = F.floor(F.abs(x) * F.lit(100.0) + F.lit(0.5))
    signed = F.when(x < 0, -units).otherwise(units)
    return F.when((F.abs(x) < F.lit(CENT_LIMIT)) & (units.cast("double") / F.lit(100.0) == F.abs(x)), signed).cast(CENTS)


def money_sum(cond: Column | None = None) -> Column:
    """Sum of amounts (optionally of rows matching ``cond``) in two parts, so that nothing is rounded away.

    ``cents``: whole-cent amounts, exact and independent of partition order
    (DECIMAL(18,0) sums to DECIMAL(28,0)).  ``rest``: all other amounts, as doubles.
    """
    x = F.col(AMOUNT) if cond is None else F.when(cond, F.col(AMOUNT))
    whole = _whole_cents(x)
    rest = F.when(whole.isNull() & ~F.isnan(x), x)
    return F.struct(F.sum(whole).alias("cents"), F.sum(rest).alias("rest"))


# --- rollup ------------------------------------------------------------------

MONTH, LAST, CENTS_SUM, REST_SUM, ROWS = "month", "last_date", "cents", "rest", "n"


def build_rollup(ledger: DataFrame) -> DataFrame:
    """One row per (month, category, type) of the ledger: both parts of the amount sum, the row count and the latest date.

    Rows without a date have a null month, rows without a category or type a null one; every ledger row is in exactly one group.
    """
    return (
        ledger.groupBy(month_start(F.col(DATE)).alias(MONTH), CATEGORY, TYPE)
        .agg(money_sum().alias("_amt"), F.count(F.lit(1)).alias(ROWS), F.max(F.col(DATE)).alias(LAST))
        .select(MONTH, CATEGORY, TYPE, F.col("_amt.cents").alias(CENTS_SUM), F.col("_amt.rest").alias(REST_SUM), ROWS, LAST)
    )


def merge_rollups(rollups: DataFrame) -> DataFrame:
    """The rollup of several ledgers' rows taken together, from the union of their rollups."""
    parts = [F.sum(c).alias(c) for c in (CENTS_SUM, REST_SUM, ROWS)]
    out = rollups.groupBy(MONTH, CATEGORY, TYPE).agg(*parts, F.max(LAST).alias(LAST))
    return out.select(MONTH, CATEGORY, TYPE, F.col(CENTS_SUM).cast(T.DecimalType(28, 0)).alias(CENTS_SUM), REST_SUM, ROWS, LAST)


def is_rollup(df: DataFrame) -> bool:
    return AMOUNT not in df.columns and {CENTS_SUM, REST_SUM, ROWS} <= set(df.columns)


def _money(df: DataFrame, cond: Column | None = None) -> Column:
    """Two-part amount sum over ledger rows, or over the groups of a rollup."""
    if not is_rollup(df):
        return money_sum(cond)
    cents, rest = (F.col(c) if cond is None else F.when(cond, F.col(c)) for c in (CENTS_SUM, REST_SUM))
    return F.struct(F.sum(cents).alias("cents"), F.sum(rest).alias("rest"))


def _row_count(df: DataFrame) -> Column:
    return F.coalesce(F.sum(F.col(ROWS)), F.lit(0).cast("bigint")) if is_rollup(df) else F.count(F.lit(1))


def _month_of(df: DataFrame) -> Column:
    return F.col(MONTH) if is_rollup(df) else month_start(F.col(DATE))


def to_money(m: Column) -> Column:
    """A two-part sum as currency units in double (0 for no rows)."""
    whole = (F.coalesce(m["cents"], _zero()) * F.lit(ONE_CENT)).cast("double")
    return whole + F.coalesce(m["rest"], F.lit(0.0))


def _minus(a: Column, b: Column) -> Column:
    cents = F.coalesce(a["cents"], _zero()) - F.coalesce(b["cents"], _zero())
    return F.struct(cents.alias("cents"), (F.coalesce(a["rest"], F.lit(0.0)) - F.coalesce(b["rest"], F.lit(0.0))).alias("rest"))


def _ntz(value) -> Column:
    """A TIMESTAMP_NTZ literal (folded by the optimizer, so it reaches the scan)."""
    if isinstance(value, dt.datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, dt.date):
        text = value.strftime("%Y-%m-%d 00:00:00")
    else:
        text = str(value)
    return F.lit(text).cast(T.TimestampNTZType())


def month_bounds(month) -> tuple[dt.datetime, dt.datetime]:
    """Half-open ``[first day, first day of next month)`` for a date, datetime or ``yyyy-MM[-dd]`` text."""
    if isinstance(month, str):
        month = dt.datetime.strptime(month[:7], "%Y-%m")
    start = dt.datetime(month.year, month.month, 1)
    end = dt.datetime(month.year + (month.month == 12), month.month % 12 + 1, 1)
    return start, end


def _small_sorted(df: DataFrame, *cols: str) -> DataFrame:
    """Order an already-aggregated, small frame (e.g. one row per month).

    One exchange into a single partition, then a local sort: no range-sampling
    job.  Only for frames whose size is bounded by the number of groups.
    """
    return df.repartition(1).sortWithinPartitions(*cols)


# --- A1, A7, P14, F1 ---------------------------------------------------------


def kpi_totals(ledger: DataFrame) -> DataFrame:
    """One row: income, expense, balance = income - expense, txn_count."""
    agg = ledger.agg(
        _money(ledger, F.col(TYPE) == INCOME).alias("_inc"),
        _money(ledger, F.col(TYPE) == EXPENSE).alias("_exp"),
        _row_count(ledger).alias("txn_count"),
    )
    inc, exp = F.col("_inc"), F.col("_exp")
    return agg.select(
        to_money(inc).alias("income"),
        to_money(exp).alias("expense"),
        to_money(_minus(inc, exp)).alias("balance"),
        "txn_count",
    )


def txn_count(ledger: DataFrame) -> DataFrame:
    return ledger.agg(_row_count(ledger).alias("txn_count"))


def expense_rows(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col(TYPE) == EXPENSE)


# --- A2, A11, T3, F3 ---------------------------------------------------------


def monthly_net(ledger: DataFrame) -> DataFrame:
    """Income, expense and net per calendar month, chronological.

    One group-by replaces a scan per month.  Rows without a date have no month
    and are left out.  ``month_key`` (``yyyy-MM``) is the key; ``label`` is the
    short month name, which repeats across years.
    """
    agg = (
        ledger.where(F.col(MONTH if is_rollup(ledger) else DATE).isNotNull())
        .groupBy(_month_of(ledger).alias("month"))
        .agg(_money(ledger, F.col(TYPE) == INCOME).alias("_inc"), _money(ledger, F.col(TYPE) == EXPENSE).alias("_exp"))
    )
    inc, exp = F.col("_inc"), F.col("_exp")
    return agg.select(
        "month",
        month_key(F.col("month")).alias("month_key"),
        month_short(F.col("month")).alias("label"),
        to_money(inc).alias("income"),
        to_money(exp).alias("expense"),
        to_money(_minus(inc, exp)).alias("net"),
    ).transform(_small_sorted, "month")


def distinct_months(ledger: DataFrame) -> DataFrame:
    """Months present in the ledger as ``yyyy-MM`` text and parsed back to the month start, ascending."""
    date = F.col(MONTH if is_rollup(ledger) else DATE)
    keys = ledger.where(date.isNotNull()).select(month_key(date).alias("month_key")).distinct()
    back = F.to_timestamp_ntz(F.col("month_key"), F.lit("yyyy-MM"))
    return keys.select("month_key", back.alias("month")).transform(_small_sorted, "month_key")


# --- A3, A4, E4, E5 ----------------------------------------------------------


def _by_category(ledger: DataFrame) -> DataFrame:
    """Grouped two-part sums and counts per non-null category (a null category is no group)."""
    return (
        ledger.where(F.col(CATEGORY).isNotNull())
        .groupBy(CATEGORY)
        .agg(_money(ledger).alias("_amt"), _row_count(ledger).alias("txn_count"))
    )


def expense_by_category(ledger: DataFrame) -> DataFrame:
    g = _by_category(ledger.where(F.col(TYPE) == EXPENSE))
    return g.select(CATEGORY, to_money(F.col("_amt")).alias("amount"), "txn_count")


def top_expense_category(ledger: DataFrame) -> DataFrame:
    """The expense category with the largest total (ties -> first by name).

    One row always: ``("None", 0.0)`` when there is no expense with a category.
    A global aggregate of ``min(struct(-total, category))`` picks the winner
    without a sort and returns one row even for empty input.
    """
    g = _by_category(ledger.where(F.col(TYPE) == EXPENSE))
    best = g.agg(F.min(F.struct((-to_money(F.col("_amt"))).alias("neg"), F.col(CATEGORY).alias("cat"))).alias("b"))
    return best.select(
        F.coalesce(F.col("b.cat"), F.lit("None")).alias(CATEGORY),
        (F.lit(0.0) - F.coalesce(F.col("b.neg"), F.lit(0.0))).alias("amount"),
    )


# --- A10, F2, P9 -------------------------------------------------------------


def default_month(ledger: DataFrame, as_of=None) -> DataFrame:
    """Latest date in the ledger (``as_of`` when empty) and the month it selects."""
    fallback = F.current_timestamp().cast(T.TimestampNTZType()) if as_of is None else _ntz(as_of)
    d = F.coalesce(F.max(F.col(LAST if is_rollup(ledger) else DATE)), fallback)
    one = ledger.agg(d.alias("default_date"))
    dd = F.col("default_date")
    return one.select(
        "default_date",
        month_start(dd).alias("month"),
        month_key(dd).alias("month_key"),
        month_year(dd).alias("month_label"),
    )


def month_slice(ledger: DataFrame, month) -> DataFrame:
    """Rows of one calendar month as a half-open range on ``Date``.

    A range (not ``date_format(Date) = ...``) so both bounds reach the scan's
    pushed filters and row-group statistics.
    """
    start, end = month_bounds(month)
    if is_rollup(ledger):
        return ledger.where(F.col(MONTH) == _ntz(start))
    rows = ledger.where((F.col(DATE) >= _ntz(start)) & (F.col(DATE) < _ntz(end)))
    if "month_key" in ledger.columns:  # a month-partitioned ledger: prune folders too
        rows = rows.where(F.col("month_key") == F.lit(start.strftime("%Y-%m")))
    return rows


# --- A5, A6, E17 -------------------------------------------------------------


def _with_share(g: DataFrame) -> DataFrame:
    """Share of each category in the total of the grouped frame.

    The total is a scalar subquery over the grouped frame (one value, computed
    once, reusing the group-by's exchange), so the per-category rows stay
    distributed.  ``try_divide``: a zero total gives null instead of an error.
    """
    parts = F.struct(F.sum("_amt.cents").alias("cents"), F.sum("_amt.rest").alias("rest"))
    total = g.agg(to_money(parts)).scalar()
    amount = to_money(F.col("_amt"))
    return g.select(CATEGORY, amount.alias("amount"), F.try_divide(amount, total).alias("share"))


def category_share(ledger: DataFrame, types: list[str] | None = None) -> DataFrame:
    rows = ledger if types is None else ledger.where(F.col(TYPE).isin(*types))
    return _with_share(_by_category(rows))


def month_distribution(ledger: DataFrame, month, types: list[str] | None = None) -> DataFrame:
    """Per-category total and share within one month; all types by default."""
    return category_share(month_slice(ledger, month), types)


# --- A8, A13, T2, J4, F4 -----------------------------------------------------


def category_frequency(ledger: DataFrame) -> DataFrame:
    return _by_category(ledger).select(CATEGORY, "txn_count")


def top_categories(ledger: DataFrame, n: int = TOP_N) -> DataFrame:
    """The ``n`` most frequent categories with their row count and total amount.

    Ties break by category name (rows have no order to break them by).
    """
    g = _by_category(ledger)
    w = Window.orderBy(F.col("txn_count").desc(), F.col(CATEGORY).asc())
    ranked = g.select(CATEGORY, "txn_count", to_money(F.col("_amt")).alias("amount"), F.row_number().over(w).cast("long").alias("rank"))
    return ranked.where(F.col("rank") <= n)


def top_category_rows(ledger: DataFrame, n: int = TOP_N) -> DataFrame:
    """Ledger rows of the top-``n`` categories; the key set holds at most n rows, so it is broadcast (for a large n the optimizer decides)."""
    keys = top_categories(ledger, n).select(CATEGORY)
    return ledger.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, on=CATEGORY, how="left_semi")


def category_drilldown(ledger: DataFrame, category: str | None) -> DataFrame:
    """All columns of the rows of one category; no category chosen -> no rows."""
    if category is None:
        return ledger.where(F.lit(False))
    return ledger.where(F.col(CATEGORY) == F.lit(category))


# --- T1 ----------------------------------------------------------------------


def recent_activity(ledger: DataFrame, n: int = RECENT_N) -> DataFrame:
    """The ``n`` latest rows (null dates last) with their display columns.

    Ties on Date break over the remaining columns.  ``orderBy + limit`` is a
    per-task top-n merged on one node (TakeOrderedAndProject), no full sort.
    """
    order = [F.col(DATE).desc_nulls_last()] + [F.col(c).asc_nulls_first() for c in (DESCRIPTION, AMOUNT, CATEGORY, TYPE)]
    top = ledger.select(*LEDGER_COLUMNS).orderBy(*order).limit(n)
    cls = icon_class(F.col(CATEGORY), F.col(TYPE))
    return top.select(
        *LEDGER_COLUMNS,
        F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"),
        day_label(F.col(DATE)).alias("day_label"),
        sign(F.col(TYPE)).alias("sign"),
        currency(F.col(AMOUNT)).alias("amount_text"),
        cls.alias("icon"),
        icon_glyph(cls).alias("icon_glyph"),
    )
