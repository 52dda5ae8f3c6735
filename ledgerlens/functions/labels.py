"""Display expressions: month keys and labels, currency text, sign and icon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AMOUNT, CATEGORY, CURRENCY_SYMBOL, DATE, EXPENSE, ICONS, TYPE
from .clean import safe_lower


def month_start(c: Column) -> Column:
    """First instant of the month as TIMESTAMP_NTZ, built from year and month (no session zone involved)."""
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def month_short(c: Column) -> Column:
    return F.date_format(c, "MMM")


def day_label(c: Column) -> Column:
    return F.date_format(c, "dd MMM")


def long_date(c: Column) -> Column:
    return F.date_format(c, "EEEE, dd MMMM yyyy")


def month_year(c: Column) -> Column:
    return F.date_format(c, "MMMM yyyy")


def month_name(c: Column) -> Column:
    return F.date_format(c, "MMMM")


def currency(c: Column) -> Column:
    """``₹12,345``: thousands separators, no decimals, half-even, ``₹-1,234`` when negative."""
    return F.concat(F.lit(CURRENCY_SYMBOL), F.format_number(c.cast("double"), 0))


def sign(type_col: Column) -> Column:
    """``-`` for exactly Expense, ``+`` for everything else, null included."""
    return F.when(type_col == F.lit(EXPENSE), F.lit("-")).otherwise(F.lit("+"))


def icon_class(category: Column, type_col: Column) -> Column:
    """food / travel by category substring, else income by type substring, else other."""
    cat = safe_lower(category)
    return (
        F.when(cat.contains("food"), F.lit("food"))
        .when(cat.contains("travel"), F.lit("travel"))
        .when(safe_lower(type_col).contains("income"), F.lit("income"))
        .otherwise(F.lit("other"))
    )


def icon_glyph(cls: Column) -> Column:
    expr = F.lit(ICONS["other"])
    for name in ("income", "travel", "food"):
        expr = F.when(cls == F.lit(name), F.lit(ICONS[name])).otherwise(expr)
    return expr


def with_labels(df: DataFrame) -> DataFrame:
    """Add every display column the activity list and charts use."""
    d, cls = F.col(DATE), icon_class(F.col(CATEGORY), F.col(TYPE))
    return df.select(
        "*",
        month_start(d).alias("month"),
        month_key(d).alias("month_key"),
        month_short(d).alias("month_label"),
        day_label(d).alias("day_label"),
        currency(F.col(AMOUNT)).alias("amount_text"),
        sign(F.col(TYPE)).alias("sign"),
        cls.alias("icon"),
        icon_glyph(cls).alias("icon_glyph"),
    )
