"""Source divergence audit by count-level bitmaps.

For every language, the terms of at least ``min_docs`` of its documents are kept and numbered, frequent ones first.  Each
group (lang, source) stores, for each count that occurs in it, the bitset of the terms with that count, in words of 64 terms;
only words with bits are rows.  AND and popcount of two groups' words give the joint cells (terms with count a here and count b
there), and a cell adds its size times f(p(a), q(b)).

Terms that one group or both do not have are taken by complement: with n(a), n(b) the sizes of whole levels and n(a, b) the
joint cells of counts above 0, the sum over all V terms is

    sum n(a) f(a, 0) + sum n(b) f(0, b) + (V - sum n(a) - sum n(b)) f(0, 0)
      + sum n(a, b) (f(a, b) - f(a, 0) - f(0, b) + f(0, 0)),

so the first line needs only the sizes of the levels, and zeros are never stored.  All arithmetic is on integers.

Texts are counted part by part in tasks and by Spark over parts; a bitmap task holds one chunk of terms and one pair of source
blocks.  Pairs of sources appear only as sums, one row for each pair and chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import textbytes as B
from .mixing import gathered

MIN_DOCS, TOP_TERMS = 10, 10
UNIT = 1_000_000_000  # rates are in billionths
CHUNK_BITS = 10  # terms of a chunk, as a power of two: 16 words of 64
SOURCE_BLOCK = 256  # sources of a block, about
SALTS = 32  # parts of a group's rows when its totals are looked up
COUNT_BYTES = 8 << 20  # of text that is counted at a time

LETTER = np.zeros(256, dtype=bool)  # a-z and every byte of a non-ASCII character
LETTER[97:123] = LETTER[128:] = True


def _codes(col: pa.Array) -> np.ndarray:
    return col.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _count_terms(batches):
    """``lang, source, term, n, docs`` of each part of (lang, source, text) rows: occurrences, and rows that have the term."""
    for batch in batches:
        for part in B.slices(batch, "text", COUNT_BYTES):
            buf, off = B.raw(part.column(2))
            buf = B.LOWER[buf]
            start, end, first = B.tokens(buf, off, LETTER)
            if not start.size:
                continue
            row = np.repeat(np.arange(part.num_rows), np.diff(first))
            group = _codes(part.column(0)) * part.num_rows + _codes(part.column(1))
            key = B.mix(B.hashes(buf, start, end) + B.mix(group.astype(np.uint64) + np.uint64(1))[row])
            order = np.argsort(key, kind="stable")  # rows ascend among equal keys
            key, by = key[order], row[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            at = np.flatnonzero(new)
            docs = np.add.reduceat((new | np.concatenate([[True], by[1:] != by[:-1]])).astype(np.int64), at)
            one = order[at]
            data, bounds = gathered(buf, start[one], end[one])
            term = pa.Array.from_buffers(pa.string(), one.size, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            where = pa.array(row[one])
            cols = [part.column(0).take(where), part.column(1).take(where), term, pa.array(np.diff(np.append(at, key.size))), pa.array(docs)]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])


def rate(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(UNIT * (count + 2) / (total + 2 * kept))`` as a long; 1 where no terms are kept."""
    wide = lambda c: c.cast("decimal(19,0)")
    share = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(count + 2), wide(total + 2 * kept))
    return F.when(kept > 0, F.lit(1).cast("bigint") + share).otherwise(F.lit(1).cast("bigint"))


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f: ``floor((p - q)^2 / (p + q))`` of positive integers up to about ``UNIT``."""
    return (p - q) ** 2 // (p + q)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _sources(table: pa.Table) -> tuple[list[str], np.ndarray]:
    """Distinct sources in ascending order, and each row's place among them."""
    names, code = np.unique(np.array(table["source"].to_pylist(), dtype=object), return_inverse=True)
    return names.tolist(), code


def _sums(lang: str, names: list[str], value: np.ndarray, pairs: np.ndarray) -> pa.Table:
    """Rows ``lang, a, b, value`` of the marked pairs of an upper triangle."""
    x, y = np.nonzero(pairs)
    at = pa.array(names, pa.string())
    return pa.table({"lang": pa.array([lang] * x.size, pa.string()), "a": at.take(pa.array(x)), "b": at.take(pa.array(y)), "value": pa.array(value[x, y], pa.int64())})


def _apart(table: pa.Table, names: list[str], code: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rate without occurrences and block of every source."""
    low, block = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    low[code], block[code] = _column(table, "low"), 0 if same else _column(table, "block")
    return low, block


def _joint(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Joint cells of one chunk and pair of blocks: rows ``word, source, block, p, low, bits``."""
    names, code = _sources(table)
    same = key[2].as_py() == key[3].as_py()
    low, block = _apart(table, names, code, same)
    word, p, bits = _column(table, "word"), _column(table, "p"), _column(table, "bits").view(np.uint64)
    order = np.lexsort((code, word))
    code, word, p, bits = code[order], word[order], p[order], bits[order]
    value = np.zeros((len(names), len(names)), np.int64)
    met = np.zeros(value.shape, dtype=bool)
    ends = np.append(np.flatnonzero(np.diff(word)) + 1, word.size)
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        c, q, w = code[a:b], p[a:b], bits[a:b]
        cuts = np.append(np.flatnonzero(np.diff(c)) + 1, c.size)
        for x, y in zip([0, *cuts[:-1]], cuts, strict=True):  # the levels x..y of one source against those of all later ones
            g = c[x]
            both = w[x:y, None] & w[None, y:]
            i, j = np.nonzero(both)
            if not same:
                other = block[c[y + j]] != block[g]
                i, j = i[other], j[other]
            h, here, there = c[y + j], q[x + i], q[y + j]
            cell = gap(here, there) - gap(here, low[h]) - gap(low[g], there) + gap(low[g], low[h])
            np.add.at(value[g], h, cell * np.bitwise_count(both[i, j]).astype(np.int64))
            met[g, h] = True
    return _sums(key[0].as_py(), names, value, met)


def _alone(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """What pairs of sources have by their levels' sizes: rows ``source, block, low, kept, levels`` of one pair of blocks."""
    names, code = _sources(table)
    same = key[1].as_py() == key[2].as_py()
    low, block = _apart(table, names, code, same)
    kept = int(_column(table, "kept").max())
    value = np.zeros((len(names), len(names)), np.int64)
    held = np.zeros(len(names), np.int64)
    for g, levels in zip(code, table["levels"].to_pylist(), strict=True):
        for x in levels or ():  # level by level against all sources
            value[g] += x["n"] * gap(np.int64(x["p"]), low)
            held[g] += x["n"]
    value = value + value.T + (kept - held[:, None] - held[None, :]) * gap(low[:, None], low[None, :])
    pairs = np.triu(np.ones(value.shape, dtype=bool), 1)
    return _sums(key[0].as_py(), names, value, pairs if same else pairs & (block[:, None] != block[None, :]))


def _in_pairs(rows: DataFrame) -> DataFrame:
    """Every row once for each pair ``i, j`` of source blocks that its block is part of."""
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")


def _ranked(rows: DataFrame, part: str, most: int | None) -> DataFrame:
    """Ranks by value within (lang, source); with a limit, every task first keeps its own best rows."""
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, chunk_bits: int = CHUNK_BITS, source_block: int = SOURCE_BLOCK) -> DataFrame:
    """How far the sources of a language differ in their words: rows ``lang, source, part, item, value, rank``.

    Null texts, languages and sources are empty texts.  Terms are runs of letters and non-ASCII characters, A-Z lower-cased.
    A language keeps the V terms that at least ``min_docs`` of its documents have; a document is a row, repeated or not.
    Every occurring (lang, source), and each language, gives a kept term with c occurrences the rate
    ``p = 1 + floor(10^9 (c + 2) / (N + 2 V))``, N its occurrences of kept terms, and two rates the value
    ``f = floor((p - q)^2 / (p + q))``.

    ``part = 'pair'``: for each other source of the language f summed over all kept terms (0 if none is kept).
    ``part = 'term'``: the ``top_terms`` kept terms with occurrences here and a rate above the language's, with f against that.
    ``rank`` counts from 1 within group and part, by value descending, then item ascending (UTF-8).
    A language with one source has no pairs; an empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    root = scratch_path(spark, "divergence")
    word = lambda c, name: F.coalesce(docs[c].cast("string"), F.lit("")).alias(name)
    src = docs.select(word(lang_col, "lang"), word(source_col, "source"), word(text_col, "text"))

    # Counts of every (lang, source, term); then kept terms with their sources, numbered with frequent ones first.
    parts = src.mapInArrow(_count_terms, "lang string, source string, term string, n bigint, docs bigint")
    counts = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("held"))
    terms = terms.where(F.col("docs") >= min_docs).select("lang", "term", "total", "held")
    terms.write.parquet(f"{root}/kept")
    terms = spark.read.parquet(f"{root}/kept").repartitionByRange("lang", F.col("total").desc(), "term").sortWithinPartitions("lang", F.col("total").desc(), "term")
    terms.withColumn("id", F.monotonically_increasing_id()).write.parquet(f"{root}/terms")
    terms = spark.read.parquet(f"{root}/terms")

    # Totals of languages and groups (those without terms too).
    langs = src.select("lang").distinct().join(terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total")), "lang", "left")
    each = terms.select("lang", "term", "total", "id", F.inline("held"))
    groups = src.select("lang", "source").distinct()
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / source_block).cast("int").alias("blocks"))
    groups = groups.join(each.groupBy("lang", "source").agg(F.sum("n").alias("group_total")), ["lang", "source"], "left").join(langs.join(blocks, "lang"), "lang")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    groups = groups.select("lang", "source", zero("group_total").alias("group_total"), zero("kept").alias("kept"), zero("lang_total").alias("lang_total"), "blocks", F.pmod(F.xxhash64("source"), "blocks").cast("int").alias("block"))
    groups.withColumn("low", rate(F.lit(0).cast("bigint"), F.col("group_total"), F.col("kept"))).write.parquet(f"{root}/groups")
    groups = spark.read.parquet(f"{root}/groups")

    # A group's totals are found by several tasks, so that one with a third of all rows is split.
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = each.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "salt"])
    each = each.withColumn("p", rate(F.col("n"), F.col("group_total"), F.col("kept")))

    # Bitsets: one row for each word of 64 terms, group and count.
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("id", F.lit(64)).cast("int"))
    chunk, place = F.call_function("shiftright", F.col("id"), F.lit(chunk_bits)), F.call_function("shiftright", F.col("id"), F.lit(6))
    levels = each.groupBy("lang", chunk.alias("chunk"), place.alias("word"), "source", "n", "p", "low", "block", "blocks").agg(F.bit_or(bit).alias("bits"))
    levels.write.parquet(f"{root}/levels")
    levels = spark.read.parquet(f"{root}/levels")
    pairs = "lang string, a string, b string, value bigint"
    joint = _in_pairs(levels).select("lang", "chunk", "i", "j", "word", "source", "block", "p", "low", "bits").groupBy("lang", "chunk", "i", "j").applyInArrow(_joint, pairs)

    sizes = levels.groupBy("lang", "source", "p").agg(F.sum(F.bit_count("bits")).alias("n")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("levels"))
    sized = groups.join(sizes, ["lang", "source"], "left").select("lang", "source", "block", "blocks", "low", "kept", "levels")
    alone = _in_pairs(sized).groupBy("lang", "i", "j").applyInArrow(_alone, pairs)

    value = joint.union(alone).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    value = value.select("lang", "value", F.inline(sides))

    q = rate(F.col("total"), F.col("lang_total"), F.col("kept"))
    over = each.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    return _ranked(value, "pair", None).union(_ranked(over, "term", top_terms))
