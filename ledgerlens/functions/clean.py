"""Cleaning expressions: date parsing, amount coercion, type inference.

All of these are native Column expressions, so they stay inside whole-stage
codegen and are pushed into whatever scan feeds them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import AMOUNT, CATEGORY, DATE, DESCRIPTION, EXPENSE, INCOME, INCOME_KEYWORDS, NA_TOKENS, NULL_TEXT, NUMERIC_PATTERN, TYPE

_MAX_DOUBLE = 1.7976931348623157e308


def na_to_null(c: Column) -> Column:
    """Missing-value tokens a CSV reader would treat as null (exact match)."""
    return F.when(~c.isin(*NA_TOKENS), c)


def parse_timestamp(c: Column, fmt: str | Sequence[str] | None = None) -> Column:
    """String -> TIMESTAMP_NTZ.  Blank is null; unparsable raises under ANSI mode.

    ``fmt`` is an explicit Spark datetime pattern; without it the ISO cast rules
    apply (``yyyy-MM-dd``, ``yyyy-MM-dd HH:mm:ss[.SSSSSS]``, ``T`` separator).
    Of a list of patterns, the first that fits counts; the last one raises.
    """
    s = F.when(F.trim(c) != "", F.trim(c))
    if fmt and not isinstance(fmt, str):
        *first, last = fmt
        return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast(T.TimestampNTZType()) for f in first], parse_timestamp(c, last))
    return F.to_timestamp_ntz(s, F.lit(fmt)) if fmt else F.to_timestamp_ntz(s)


def to_timestamp_ntz(c: Column, dtype: T.DataType, fmt: str | Sequence[str] | None = None) -> Column:
    """Bring a Date column of any physical type to TIMESTAMP_NTZ."""
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast(T.TimestampNTZType())
    return parse_timestamp(c.cast("string"), fmt)


def parse_date(df: DataFrame, fmt: str | Sequence[str] | None = None, column: str = DATE) -> DataFrame:
    """Parse ``column`` to TIMESTAMP_NTZ in place; a no-op when already a timestamp."""
    dtype = df.schema[column].dataType
    return df.withColumn(column, to_timestamp_ntz(F.col(column), dtype, fmt))


def amount_expr(c: Column, dtype: T.DataType | None = None) -> Column:
    """Amount as a finite double; anything unparsable or non-finite becomes 0.0.

    Strings must look like a plain decimal/scientific literal first: Spark's
    cast alone would accept ``12d`` (12.0) and ``1e400`` (Infinity).
    """
    if dtype is not None and isinstance(dtype, T.NumericType):
        value = c.cast("double")
    else:
        s = c.cast("string")
        value = F.when(s.rlike(NUMERIC_PATTERN), F.trim(s).try_cast("double"))
    finite = F.when((value >= -_MAX_DOUBLE) & (value <= _MAX_DOUBLE), value)
    return F.coalesce(finite, F.lit(0.0))


def coerce_amount(df: DataFrame, column: str = AMOUNT) -> DataFrame:
    return df.withColumn(column, amount_expr(F.col(column), df.schema[column].dataType))


def safe_lower(c: Column) -> Column:
    """``str(x).lower()``: null renders as ``nan`` instead of nulling the result."""
    return F.lower(F.coalesce(c.cast("string"), F.lit(NULL_TEXT)))


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    lowered = safe_lower(c)
    cond = F.lit(False)
    for kw in needles:
        cond = cond | lowered.contains(kw)
    return cond


def type_expr(
    category: Column | None = None,
    description: Column | None = None,
    keywords: Iterable[str] = INCOME_KEYWORDS,
) -> Column:
    """Income when any keyword is a substring of Category or of Description.

    Each column is tested on its own: concatenating them could create a match
    across the boundary.
    """
    kws = tuple(keywords)
    category = F.col(CATEGORY) if category is None else category
    description = F.col(DESCRIPTION) if description is None else description
    is_income = contains_any(category, kws) | contains_any(description, kws)
    return F.when(is_income, F.lit(INCOME)).otherwise(F.lit(EXPENSE))


def infer_type(df: DataFrame, keywords: Iterable[str] = INCOME_KEYWORDS) -> DataFrame:
    """Derive ``Type`` only when the input does not carry one."""
    if TYPE in df.columns:
        return df
    cat = F.col(CATEGORY) if CATEGORY in df.columns else F.lit(None).cast("string")
    return df.withColumn(TYPE, type_expr(cat, F.col(DESCRIPTION), keywords))
