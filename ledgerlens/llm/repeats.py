"""Suffix-array dedup: passages that repeat across documents, found with sparse suffix arrays.

1.  Of each text only the suffixes at minimiser positions are retained: in every window of ``WIDTH`` consecutive 8-word
    grams the one with the smallest hash (content selects it, so equal passages retain equal positions).  A passage of 50
    words holds the minimiser of its first window with at least ``50 - WIDTH + 1`` further words, the suffix's prefix.
2.  The suffixes are sorted (by prefix hash, over the whole corpus) and neighbours compared: a suffix whose prefix stands
    alone is no part of a repeat.
3.  Each remaining match is extended left and right to all 50-word passages around it, which are sorted and compared with
    their neighbours in turn; those found in two documents are joined to maximal spans.

Sorted rows are small (hashes and positions); a passage in a third of all documents is a long run of them, which a task
reads as a stream.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import textbytes as B

PASSAGE = 50
GRAM = 8
WIDTH = 24


def minimisers(h: np.ndarray, first: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``width`` grams that lie in one text, and the position of the leftmost smallest gram of each."""
    starts = np.flatnonzero(B.inside(first, width + gram - 1))
    if not starts.size:
        return starts, starts
    g = B.windows(h, gram)
    best, span = np.arange(g.size), 1
    while span * 2 <= width:
        best = _better(g, best, span)
        span *= 2
    left, right = best[starts], best[starts + width - span]
    return starts, np.where(g[right] < g[left], right, left)


def _better(g: np.ndarray, best: np.ndarray, span: int) -> np.ndarray:
    left, right = best[:-span], best[span:]
    return np.where(g[right] < g[left], right, left)


def _words(part: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    buf, off = B.raw(part.column(column))
    low = B.LOWER[buf]
    start, end, first = B.tokens(low, off, B.WORD)
    return B.hashes(low, start, end), first


def _suffixes(passage: int, width: int, gram: int):
    """Retained suffixes of every text as (prefix, id, doc, pos), from columns id, doc, text."""

    def run(batches):
        for batch in batches:
            for part in B.slices(batch, "text"):
                h, first = _words(part, 2)
                _, pos = minimisers(h, first, width, gram)
                pos = np.unique(pos)
                prefix = passage - width + 1
                pos = pos[B.inside(first, prefix)[np.minimum(pos, max(0, h.size - prefix))] & (pos <= h.size - prefix)] if h.size >= prefix else pos[:0]
                doc = np.searchsorted(first, pos, "right") - 1
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(B.windows(h, prefix)[pos].view(np.int64)), part.column(0).take(at), part.column(1).take(at), pa.array((pos - first[doc]).astype(np.int32))], names=["prefix", "id", "doc", "pos"])

    return run


def _matched(batches):
    """Suffixes with an equal neighbour.  The first and last row of a partition may have one in the next partition, so they stay too."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        p = batch.column(0).to_numpy()
        same = p[1:] == p[:-1]
        keep = np.concatenate([[True if last is None else bool(carried)], same])
        keep[:-1] |= same
        carried = keep[-1]
        last = batch.slice(batch.num_rows - 1)
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1])).select(["id", "doc", "pos"])
    if last is not None:
        yield last.select(["id", "doc", "pos"])


def _passages(passage: int, width: int, gram: int):
    """All passages around the matched suffixes: columns id, doc, text, at (positions) to hash, check, id, doc, pos."""

    def run(batches):
        for batch in batches:
            for part in B.slices(batch, "text"):
                h, first = _words(part, 2)
                starts, pos = minimisers(h, first, width, gram)
                ok = np.flatnonzero(B.inside(first, passage)[np.minimum(starts, max(0, h.size - passage))] & (starts <= h.size - passage)) if h.size >= passage else starts[:0]
                starts, pos = starts[ok], pos[ok]
                at = part.column(3)
                matched = np.repeat(first[:-1], at.value_lengths().to_numpy()) + at.flatten().to_numpy()
                flag = np.zeros(h.size + 1, dtype=bool)
                flag[matched] = True
                starts = starts[flag[pos]]
                doc = np.searchsorted(first, starts, "right") - 1
                take = pa.array(doc)
                full = B.windows(h, passage)[starts] if starts.size else np.zeros(0, np.uint64)
                check = B.windows(B.mix(h), passage)[starts] if starts.size else full
                yield pa.RecordBatch.from_arrays([pa.array(full.view(np.int64)), pa.array(check.astype(np.uint32).view(np.int32)), part.column(0).take(take), part.column(1).take(take), pa.array((starts - first[doc]).astype(np.int32))], names=["hash", "check", "id", "doc", "pos"])

    return run


def _in_two(batches):
    """Passages whose run of equal neighbours holds two documents; columns hash, check, id, doc, pos, sorted by hash, check, doc."""
    held: pa.Table | None = None  # the open run so far if it is of one document, else its last row
    two = False
    for batch in batches:
        if not batch.num_rows:
            continue
        skip = 0 if held is None else held.num_rows
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        h, c, d = (table[k].to_numpy() for k in ("hash", "check", "doc"))
        edge = np.concatenate([[0], np.flatnonzero((h[1:] != h[:-1]) | (c[1:] != c[:-1])) + 1, [h.size]])
        run_two = d[edge[:-1]] != d[edge[1:] - 1]
        given = skip if two else 0  # rows given out before
        if two and edge[1] > 0:
            run_two[0] = True
        keep = np.repeat(run_two, np.diff(edge))
        keep[:given] = False
        if not run_two[-1]:
            held, two = table.slice(edge[-2]), False
        else:
            held, two = table.slice(h.size - 1), True
        for out in table.filter(pa.array(keep)).select(["id", "doc", "pos"]).to_batches():
            yield out


def _spans(passage: int):
    """Passage starts of each document joined to word spans: columns id, at to id, n_repeated, spans."""

    def run(batches):
        for batch in batches:
            spans, counts = [], []
            for at in batch.column(1).to_pylist():
                out: list[list[int]] = []
                for a in sorted(at):
                    if out and a <= out[-1][1]:
                        out[-1][1] = a + passage
                    else:
                        out.append([a, a + passage])
                spans.append(out)
                counts.append(sum(b - a for a, b in out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=["id", "n_repeated", "spans"])

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Passages that repeat across documents: ``id_col, n_repeated, spans`` for every document that has one.

    A word (lower-cased run of digits, a-z and non-ASCII characters) is repeated if it lies in ``passage`` consecutive words
    that also stand in another document.  ``spans``: maximal word ranges ``[begin, end)`` of such passages; ``n_repeated``:
    their words.  Repeats within one document do not count.  Documents without a repeat, and texts that are null, empty or
    shorter than ``passage`` words, have no row.  Rows that repeat both id and text are one document, with one row; rows
    with one id and different texts are different ones.  Other columns are not read.
    """
    if not gram + width - 1 <= passage:
        raise ValueError("a passage must hold a whole window of grams")
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("doc"), F.col(text_col).alias("text")).where("text is not null")
    id_type = src.schema["id"].dataType.simpleString()
    root = scratch_path(spark, "repeats")
    src.mapInArrow(_suffixes(passage, width, gram), f"prefix bigint, id {id_type}, doc bigint, pos int").write.parquet(f"{root}/suffixes")
    suffixes = spark.read.parquet(f"{root}/suffixes").repartitionByRange("prefix", "doc", "pos").sortWithinPartitions("prefix", "doc", "pos")
    matched = suffixes.mapInArrow(_matched, f"id {id_type}, doc bigint, pos int")
    positions = matched.groupBy("doc").agg(F.collect_set("pos").alias("at"))
    texts = src.join(positions, "doc").select("id", "doc", "text", "at")
    passages = texts.mapInArrow(_passages(passage, width, gram), f"hash bigint, check int, id {id_type}, doc bigint, pos int")
    passages = passages.repartition("hash").sortWithinPartitions("hash", "check", "doc")
    found = passages.mapInArrow(_in_two, f"id {id_type}, doc bigint, pos int")
    starts = found.groupBy("id", "doc").agg(F.collect_set("pos").alias("at")).select("id", "at")
    return starts.mapInArrow(_spans(passage), f"id {id_type}, n_repeated bigint, spans array<array<bigint>>").withColumnRenamed("id", id_col)
