"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

A text (without ASCII white space) is cut where its own content says so, so equal
stretches are cut alike wherever they stand; a stretch without such a place is cut at
a largest size.  Each chunk gets a 128-bit identifier.
The distinct (identifier, SHA-256 digest) pairs verify that no two different chunks share
an identifier; those that do are told apart by a rank.  A document is then its ordered list
of identifiers, a few hundredths of its text; documents are grouped by comparing these
lists.  Texts are never shuffled to find the groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .line_dedup import two_hashes

# A chunk ends, after SHORTEST characters at least, behind two characters whose codes leave 14 and 2 modulo 16 (one place in
# about 150 to 260 of European prose, 400 of base64), or, among characters from U+0100 on, behind one that repeats the
# last but one; at the latest after LONGEST characters.
SHORTEST, LONGEST = 48, 1500


def _anchor() -> str:
    first, second = ("".join(f"\\x{c:02x}" for c in range(0x21, 0x100) if c % 16 == r) for r in (14, 2))
    return rf"(?:[{first}][{second}]|([^\x00-\xff]).\1)"


CHUNK = rf"(?s).{{{SHORTEST},{LONGEST - 3}}}?{_anchor()}|.{{1,{LONGEST}}}"


def normalized(text: Column) -> Column:
    """Text without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def chunks(norm: Column) -> Column:
    """Content-defined chunks, which joined give the text: lists are equal exactly if the texts are.  An empty text is one empty chunk."""
    return F.when(norm == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0)))


def _ident(chunk: Column, bits: int) -> Column:
    """Identifier of a chunk as two longs; fewer ``bits`` (for tests) make collisions."""
    a, b = F.xxhash64(chunk), F.xxhash64(F.lit(7), chunk)
    return F.array(a, b) if bits >= 128 else F.array(F.pmod(a, F.lit(1 << bits)), F.lit(0).cast("bigint"))


def _told_apart(rows: DataFrame) -> DataFrame:
    """Recipes whose identifiers mean one chunk each: where two digests share one, a rank is added to it."""
    spark = rows.sparkSession
    each = rows.select(F.explode(F.arrays_zip("ids", "digests")).alias("c")).select("c.ids", "c.digests").distinct()
    shared = each.groupBy("ids").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("digests")).alias("all")).where("n > 1")
    path = scratch_path(spark, "shared-identifiers")
    shared.write.parquet(path)
    shared = spark.read.parquet(path)
    if shared.isEmpty():
        return rows.withColumn("recipe", F.flatten("ids"))
    rank = shared.select("ids", F.posexplode("all").alias("rank", "digests"))
    spelled = rows.select("row", F.posexplode(F.arrays_zip("ids", "digests")).alias("pos", "c")).select("row", "pos", "c.ids", "c.digests")
    spelled = spelled.join(rank, ["ids", "digests"], "left")
    ident = F.concat("ids", F.array(F.coalesce(F.col("rank"), F.lit(0)).cast("bigint")))
    listed = spelled.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", ident.alias("i")))).alias("r"))
    return rows.join(listed.select("row", F.flatten(F.col("r.i")).alias("recipe")), "row")


def _recipes(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """``id, row, r1, r2, cp, sha, recipe`` of every document, written to the shared folder; r1 and r2 are hashes of id and text."""
    spark = docs.sparkSession
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    # Rows with one id are told apart by their place in the table.
    seen = src.select("id", F.monotonically_increasing_id().alias("row"), *_identity(F.col("id"), F.col("text")), F.coalesce(F.length("text"), F.lit(0)).alias("cp"), normalized(F.col("text")).alias("norm"))
    seen = seen.select("id", "row", "r1", "r2", "cp", F.sha2("norm", 256).alias("sha"), chunks(F.col("norm")).alias("chunks"))
    ids = F.transform("chunks", lambda c: _ident(c, bits)).alias("ids")
    digests = F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("digests")
    path = scratch_path(spark, "recipes")
    seen.select("id", "row", "r1", "r2", "cp", "sha", ids, digests).write.parquet(path)
    return _told_apart(spark.read.parquet(path))


def _identity(id_: Column, text: Column) -> list[Column]:
    r1, r2 = two_hashes(id_.isNull(), id_, text.isNull(), text)
    return [r1.alias("r1"), r2.alias("r2")]


def _groups(rows: DataFrame) -> DataFrame:
    """``recipe, n, best`` of the recipes that several documents have; best: id, row, r1 and r2 of the document that stays."""
    order = F.struct((-F.col("cp")).alias("cp"), "id", "row", "r1", "r2")
    groups = rows.groupBy("recipe").agg(F.count("*").alias("n"), F.min(order).alias("best")).where("n > 1")
    path = scratch_path(rows.sparkSession, "groups")
    groups.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 128) -> DataFrame:
    """Groups of equal texts: one row per document with ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without ASCII white space; null counts as empty, and empty texts are one group.
    The row with the most code points in its original text stays, of ties the one with the smallest id.
    Rows repeated with the same id and text are separate members of which exactly one is kept.
    A null id sorts first.  Other columns are not read.  An empty table gives no rows.
    """
    rows = _recipes(docs, id_col, text_col, id_bits)
    out = rows.join(_groups(rows), "recipe", "left")
    alone = F.col("n").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents (all columns) that ``exact_dedup`` keeps; of rows with one id and one text, one stays.

    Groups are found from recipes alone.  What goes is named by two hashes of id and text, so the texts themselves are sent
    once, for the last join, and no copy of the table is written.
    """
    rows = _recipes(docs, id_col, text_col, 128)
    gone = rows.select("recipe", "r1", "r2").join(_groups(rows), "recipe").where("r1 <> best.r1 or r2 <> best.r2").select("r1", "r2")
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    marked = flat.select("*", *_identity(*(flat[f"c{docs.columns.index(c)}"] for c in (id_col, text_col))))
    once = Window.partitionBy("r1", "r2").orderBy("r1")
    kept = marked.join(gone, ["r1", "r2"], "left_anti").withColumn("again", F.row_number().over(once)).where("again = 1")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
