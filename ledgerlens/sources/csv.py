"""CSV upload -> typed ledger.

One lazy pass: the file is read all-string, missing-value tokens become
null, headers are normalised on the driver (metadata only), then Date is
parsed, Amount coerced and Type inferred when absent.  A row with more
fields than the header, or a date that does not parse, fails the job (the
upload is rejected as a whole) through a filter that column pruning cannot
remove.

The parts of an upload may order, spell (before normalising) or extend their
columns differently: the headers of all parts are catalogued first, each
distinct header is one scan of its files, and the scans are joined by column
name.  The reader checks each file's header again and fails the job if it is
another one by then.  It keeps the
raw text of rows with another number of fields than the header, so fields
are counted on those rows alone: more fields (empty ones included, as in
``a,b,c,d,``) reject the upload, fewer leave the last columns null.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import amount_expr, na_to_null, parse_timestamp, type_expr
from ..schema import AMOUNT, CATEGORY, DATE, DESCRIPTION, INCOME_KEYWORDS, LEDGER_COLUMNS, REQUIRED_SYNC, REQUIRED_UPLOAD, TYPE
from .files import data_files, first_records, literal_path

RAW_ROW = "_raw_row"
# A quote inside a quoted field is doubled (RFC 4180, as pandas reads it); Spark's default escape is a backslash.
QUOTE = '"'


def normalize_name(name: str) -> str:
    """Trim + title-case (title-case also restarts after digits and ``_``)."""
    return name.strip().title()


def normalize_headers(df: DataFrame) -> DataFrame:
    """Rename every column to its normalised name; duplicates after normalising are rejected."""
    names = [normalize_name(c) for c in df.columns]
    check_unique(names)
    return df.toDF(*names)


def check_unique(names: Sequence[str]) -> None:
    seen, dups = set(), []
    for n in names:
        if n in seen:
            dups.append(n)
        seen.add(n)
    if dups:
        raise ValueError(f"Duplicate columns after normalising headers: {', '.join(sorted(set(dups)))}")


def missing_columns(columns: Iterable[str], required: Iterable[str] = REQUIRED_UPLOAD) -> list[str]:
    """Required names absent from ``columns`` (sorted)."""
    return sorted(set(required) - set(columns))


def require_columns(columns: Iterable[str], required: Iterable[str] = REQUIRED_UPLOAD) -> None:
    missing = missing_columns(columns, required)
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}")


def header_catalogue(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files of an upload by their header (raw names, in order), the first file's header first; files without a record are left out."""
    files = data_files(spark, path)
    found: dict[tuple[str, ...], list[str]] = {}
    for name, record in zip(files, first_records(spark, files), strict=True):
        if record is not None:
            # A UTF-8 byte-order mark is not part of the name; the reader drops it too.
            names = next(csv.reader(io.StringIO(record.removeprefix("\ufeff"), newline="")))
            found.setdefault(tuple(names), []).append(name)
    if not found:
        raise ValueError(f"No header in {path}")
    return found


# A quoted section; delimiters within it do not separate fields.  A doubled quote is two
# sections side by side, so no alternation is needed (one would recurse for every character).
QUOTED_FIELD = r'"[^"]*"'


def field_count(row: Column, sep: str = ",") -> Column:
    """Fields of a raw CSV row: delimiters outside quoted sections + 1 (no per-row array)."""
    if len(sep) != 1:
        raise ValueError("single-character delimiter expected")
    unquoted = F.when(row.contains(QUOTE), F.regexp_replace(row, QUOTED_FIELD, "")).otherwise(row)
    return F.length(unquoted) - F.length(F.translate(unquoted, sep, "")) + F.lit(1)


def clean_ledger(raw: DataFrame, date_format: str | Sequence[str] | None = None, keywords: Iterable[str] = INCOME_KEYWORDS) -> DataFrame:
    """All-string ledger columns -> LEDGER types, extra columns carried as text.

    The validity filter raises on an unparsable date, and on a ``RAW_ROW``
    (kept by the reader for rows of another width) of more fields than columns.
    """
    cols = raw.columns
    date_raw = F.col(DATE)
    parsed = parse_timestamp(date_raw, date_format)
    checks = F.lit(True)
    if RAW_ROW in cols:
        long_row = F.coalesce(field_count(F.col(RAW_ROW)) > F.lit(len(cols) - 1), F.lit(False))
        checks = F.when(long_row, F.raise_error(F.lit("CSV row has more fields than the header"))).otherwise(F.lit(True))
    checks = F.when(
        date_raw.isNotNull() & (F.trim(date_raw) != "") & parsed.isNull(),
        F.raise_error(F.concat(F.lit("Unparsable Date: "), date_raw)),
    ).otherwise(checks)
    valid = raw.where(checks)
    category = F.col(CATEGORY) if CATEGORY in cols else F.lit(None).cast("string")
    typ = F.col(TYPE) if TYPE in cols else type_expr(category, F.col(DESCRIPTION), keywords)
    extras = [c for c in cols if c not in LEDGER_COLUMNS and c != RAW_ROW]
    return valid.select(
        parsed.alias(DATE),
        F.col(DESCRIPTION),
        amount_expr(F.col(AMOUNT)).alias(AMOUNT),
        category.alias(CATEGORY),
        typ.alias(TYPE),
        *extras,
    )


def read_ledger_csv(
    spark: SparkSession,
    path: str,
    date_format: str | Sequence[str] | None = None,
    normalize: bool = True,
    required: Iterable[str] | None = None,
    keywords: Iterable[str] = INCOME_KEYWORDS,
    multiline: bool = False,
) -> DataFrame:
    """Read an uploaded transaction CSV (file or folder of parts) as a ledger.

    ``normalize=True`` is the upload contract (trimmed title-case headers,
    Category required); ``normalize=False`` the sync contract (exact headers,
    Date/Description/Amount required, Category optional).  ``date_format``
    may list several patterns: the first that fits a date counts, and a date
    that fits none rejects the upload.  A column that only some parts have is
    null in the others (``Type`` is inferred there).  ``multiline=True`` reads quoted fields
    with line breaks (a file is then one task, as it cannot be split).
    """
    needed = required if required is not None else (REQUIRED_UPLOAD if normalize else REQUIRED_SYNC)
    catalogue = header_catalogue(spark, path)
    for header in catalogue:  # all headers are checked before anything is scanned
        names = _names(header, normalize)
        check_unique(names)
        require_columns(names, needed)
    frames = []
    for header, files in catalogue.items():
        where = path if len(catalogue) == 1 else [literal_path(f) for f in files]
        frames.append(clean_ledger(_scan(spark, where, list(header), _names(header, normalize), multiline), date_format, keywords))
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def _names(header: Sequence[str], normalize: bool) -> list[str]:
    return [normalize_name(h) for h in header] if normalize else list(header)


def _scan(spark: SparkSession, where: str | list[str], header: list[str], names: list[str], multiline: bool) -> DataFrame:
    """All-string rows of files with one header, missing-value tokens as null, and the raw text of rows of another width."""
    # Headers that Spark would call ambiguous or that are blank cannot be checked by name.
    checked = "" not in header and len({h.lower() for h in header}) == len(header) and RAW_ROW not in header
    given = header if checked else [f"_c{i}" for i in range(len(header))]
    raw = (
        spark.read.schema(T.StructType([T.StructField(c, T.StringType(), True) for c in [*given, RAW_ROW]]))
        .option("header", True)
        .option("enforceSchema", not checked)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RAW_ROW)
        .option("columnPruning", False)  # a pruned parser does not see a row's other fields
        .option("escape", QUOTE)
        .option("multiLine", multiline)
        .option("maxCharsPerColumn", -1)
        .csv(where)
        .toDF(*names, RAW_ROW)
    )
    return raw.select(*[na_to_null(F.col(f"`{n}`")).alias(n) for n in names], RAW_ROW)


def write_csv(df: DataFrame, path: str) -> str:
    """Write a frame as header CSV parts (the shape an upload folder has)."""
    df.write.mode("errorifexists").option("header", True).option("escape", QUOTE).csv(path)
    return path
