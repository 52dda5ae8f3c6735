"""Line dedup across documents.

Texts are exploded into lines, each line is normalised and hashed, the distinct documents of each hash are counted, and
the lines of hashes above the threshold go, except in one document.  Texts are reassembled by position: what is sent to a
document is the sorted list of positions it loses, and the runs between those positions are joined again.

Only hashes, ids and positions are grouped.  A line that very many documents share is one of the few with the most lines;
those few are broadcast, so that no task gets all rows of one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

MIN_CHARS, MIN_DOCS = 20, 3
HEAVY = 4096  # hashes that are broadcast; each other one has less than 1/HEAVY of the lines

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    """Lines of a text as an array; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _UPPER, _LOWER)


def two_hashes(*what: Column) -> list[Column]:
    """Two 64-bit hashes of some values."""
    return [F.xxhash64(*what), F.xxhash64(F.lit(7), *what)]


def without(parts: Column, positions: Column) -> Column:
    """An array without the elements at some ascending positions, in time linear in its length: the runs between them."""
    size = F.size(parts)
    begins = F.concat(F.array(F.lit(-1)), positions)
    runs = F.arrays_zip(begins.alias("a"), F.concat(positions, F.array(size)).alias("b"))
    return F.flatten(F.transform(runs, lambda r: F.slice(parts, r["a"] + 2, r["b"] - r["a"] - 1)))


def _dropped(docs: DataFrame, min_chars: int, min_docs: int, heavy: int) -> DataFrame:
    """``r1, r2, lost``: ascending positions of the lines that a document (by its identity hashes) loses."""
    spark = docs.sparkSession
    root = scratch_path(spark, "lines")
    every = docs.select("id", "r1", "r2", F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    keyed = every.select("id", "r1", "r2", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    h1, h2 = two_hashes(F.col("key"))
    keyed.select("id", "r1", "r2", "pos", h1.alias("h1"), h2.alias("h2")).write.parquet(f"{root}/lines")
    keyed = spark.read.parquet(f"{root}/lines")

    # Distinct (hash, document) first, so that the rows of a frequent line are spread over tasks before they are counted.
    held = keyed.groupBy("h1", "h2", "id").agg(F.count("*").alias("n"))
    shared = held.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.max("id").alias("last"))
    shared.where(F.col("docs") >= min_docs).select("h1", "h2", "n", "last").write.parquet(f"{root}/shared")
    shared = spark.read.parquet(f"{root}/shared")

    top = shared.orderBy(F.col("n").desc(), "h1", "h2").limit(heavy)
    top.select("h1", "h2", F.col("last").alias("top_last"), F.lit(True).alias("top")).write.parquet(f"{root}/top")
    top = F.broadcast(spark.read.parquet(f"{root}/top"))
    # A null id is no last id: nulls are below all ids.
    loses = lambda last: F.coalesce(F.col("id") < F.col(last), F.col("id").isNull() & F.col(last).isNotNull())
    marked = keyed.join(top, ["h1", "h2"], "left")
    by_top = marked.where(F.col("top") & loses("top_last"))
    rest = marked.where("top is null").select("id", "r1", "r2", "pos", "h1", "h2")
    others = shared.join(top, ["h1", "h2"], "left_anti")
    by_join = rest.join(others, ["h1", "h2"]).where(loses("last"))
    lost = by_top.select("r1", "r2", "pos").union(by_join.select("r1", "r2", "pos"))
    return lost.groupBy("r1", "r2").agg(F.array_sort(F.collect_set("pos")).alias("lost"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, heavy: int = HEAVY) -> DataFrame:
    """Texts without the lines that several documents share: one row per row of ``docs`` with ``id_col, n_lines, n_dropped, kept_text``.

    A text is cut at each ``\\n``; a null or empty text is one empty line.  A line's key is the line without
    ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased.  All lines of a key with at least ``min_chars`` code points that
    stands in at least ``min_docs`` documents go, except those in the largest id that holds it.  The other lines, as they
    were, are joined by ``\\n``; a text that loses all lines is empty.  ``n_lines`` counts lines before dropping.

    Documents are told apart by id: rows repeated with one id are one document when documents are counted, and all of them
    keep the line if the id is the largest.  A null id is one document below all others.  A key that stands
    several times in one document goes at all its places.  Other columns are not read.  An empty table gives no rows.
    Keys are compared by 128 bits of hash.  A position list is as long as its text's lines at most.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    # Null and empty texts have one identity, and no line that could go.
    r1, r2 = two_hashes(F.col("id").isNull(), F.col("id"), F.col("text"))
    src = src.select("id", "text", r1.alias("r1"), r2.alias("r2"))
    out = src.join(_dropped(src, min_chars, min_docs, heavy), ["r1", "r2"], "left")
    parts = lines(F.col("text"))
    kept = F.when(F.col("lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(without(parts, F.col("lost")), "\n"))
    return out.select(
        F.col("id").alias(id_col),
        F.size(parts).cast("bigint").alias("n_lines"),
        F.coalesce(F.array_size("lost"), F.lit(0)).cast("bigint").alias("n_dropped"),
        kept.alias("kept_text"),
    )
