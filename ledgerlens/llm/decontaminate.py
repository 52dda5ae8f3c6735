"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams against the token windows of every document.

Documents are read once and never shuffled.  The windows are broadcast in blocks of at
most ``BLOCK_BYTES`` of benchmark text; a larger benchmark takes several blocks, which a
task loads one after another for each batch of documents.  A hash hit is always verified word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as B

WINDOW = 10
BLOCK_BYTES = 16 << 20
FILTER_BITS = 22


def _item_windows(texts: list[bytes], items: list, size: int) -> dict[int, dict[bytes, set]]:
    """Window length -> joined window -> items that hold it; an item of fewer words is one window."""
    found: dict[int, dict[bytes, set]] = {}
    for item, text in zip(items, texts, strict=True):
        buf = B.LOWER[np.frombuffer(text, dtype=np.uint8)]
        start, end, _ = B.tokens(buf, np.array([0, buf.size]), B.WORD)
        low = buf.tobytes()
        words = [low[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            found.setdefault(n, {}).setdefault(b" ".join(words[i : i + n]), set()).add(item)
    return found


class WindowSet:
    """Sorted hashes of one window length, a bit filter before them, and the windows themselves for verification."""

    def __init__(self, size: int, windows: dict[bytes, set]):
        self.size, self.windows = size, windows
        keys = list(windows)
        joined = np.frombuffer(b" ".join(keys), dtype=np.uint8)
        start, end, _ = B.tokens(joined, np.array([0, joined.size]), B.WORD)
        h = B.hashes(joined, start, end).reshape(-1, size)
        self.hashes = np.sort(np.array([B.windows(x, size)[0] for x in h], dtype=np.uint64))
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Indices of words where a window may begin."""
        w = B.windows(h, self.size)
        at = np.flatnonzero(self.filter[w >> np.uint64(64 - FILTER_BITS)] & B.inside(first, self.size))
        if not at.size:
            return at
        pos = np.minimum(np.searchsorted(self.hashes, w[at]), self.hashes.size - 1)
        return at[self.hashes[pos] == w[at]]


def _scan(buf, off, sets: list[WindowSet]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set]]:
    """Words of all texts (starts, ends, first word of each text), which words are hit, and the items hit in each text."""
    low = B.LOWER[buf]
    start, end, first = B.tokens(low, off, B.WORD)
    h = B.hashes(low, start, end)
    hit = np.zeros(start.size, dtype=bool)
    items: list[set] = [set() for _ in range(off.size - 1)]
    for s in sets:
        for i in s.hits(h, first).tolist():
            words = [low[start[k] : end[k]].tobytes() for k in range(i, i + s.size)]
            owners = s.windows.get(b" ".join(words))
            if owners:
                hit[i : i + s.size] = True
                items[int(np.searchsorted(first, i, "right")) - 1].update(owners)
    return start, end, first, hit, items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, block_bytes: int):
    """The benchmark's windows as broadcasts of bounded size."""
    bench = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    sc = benchmark.sparkSession.sparkContext
    for k in range(n):
        rows = bench.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()
        found = _item_windows([r.text.encode() for r in rows], [r.item for r in rows], size)
        yield sc.broadcast([WindowSet(m, w) for m, w in sorted(found.items())])


def _sets(block, blocks) -> list[WindowSet]:
    """A block's windows; of several blocks only one is held in memory at a time."""
    return block.value if len(blocks) == 1 else block.load_from_path(block._path)


def _merged(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of set flags as (begin, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _report(sets_of_blocks):
    def run(batches):
        for batch in batches:
            for part in B.slices(batch, "text"):
                buf, off = B.raw(part.column(1))
                hit, items = None, None
                for block in sets_of_blocks:
                    start, end, first, h, it = _scan(buf, off, _sets(block, sets_of_blocks))
                    hit = h if hit is None else hit | h
                    items = it if items is None else [a | b for a, b in zip(items, it, strict=True)]
                counted = np.concatenate([[0], np.cumsum(hit)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(first)),
                        pa.array(counted[first[1:]] - counted[first[:-1]]),
                        pa.array([sorted(x for x in i if x is not None) for i in items], pa.list_(pa.string())),
                        pa.array([[list(s) for s in _merged(hit[a:b])] if items[k] else [] for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True))], pa.list_(pa.list_(pa.int64()))),
                    ],
                    names=["id", "n_words", "n_hit", "items", "spans"],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Overlap of every document with the benchmark: ``id_col, n_words, n_hit, items, spans``.

    Texts are lower-cased (A-Z); words are runs of digits, a-z and non-ASCII characters.  A window is ``window``
    consecutive words of an item (an item of fewer, but not none, is one window); a document word inside any
    occurrence of a window is hit.  ``items``: sorted ids of items with occurring windows; ``spans``: hit word
    ranges ``[begin, end)``.  One row per input row, repeated rows included.  A null or empty text has no words and
    no hits; null benchmark texts have no windows, items with a null id hit words but are not listed.
    An empty benchmark hits nothing.  Other columns are not read.
    """
    blocks = list(_blocks(benchmark, item_col, item_text, window, block_bytes))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])
    return src.mapInArrow(_report(blocks), out).withColumnRenamed("id", id_col)


def _cut(sets_of_blocks, text_index: int, drop_share: float):
    def run(batches):
        for batch in batches:
            for part in B.slices(batch, batch.schema.names[text_index]):
                buf, off = B.raw(part.column(text_index))
                hit = None
                for block in sets_of_blocks:
                    start, end, first, h, _ = _scan(buf, off, _sets(block, sets_of_blocks))
                    hit = h if hit is None else hit | h
                keep, texts = np.ones(part.num_rows, dtype=bool), part.column(text_index)
                dirty = np.flatnonzero(np.add.reduceat(np.concatenate([hit, [False]]).astype(np.int64), np.minimum(first[:-1], hit.size)) * (np.diff(first) > 0))
                if dirty.size:
                    texts = texts.to_pylist()
                    for d in dirty.tolist():
                        a, b = int(first[d]), int(first[d + 1])
                        if hit[a:b].mean() > drop_share:
                            keep[d] = False
                            continue
                        out, at = [], int(off[d])
                        for x, y in _merged(hit[a:b]):
                            out.append(buf[at : start[a + x]].tobytes())
                            at = int(end[a + y - 1])
                        out.append(buf[at : off[d + 1]].tobytes())
                        texts[d] = b"".join(out).decode()
                    texts = pa.array(texts, part.schema.field(text_index).type)
                cols = [texts if i == text_index else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema).filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, drop_share: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents (all columns, in order) without benchmark passages.

    Hit spans (see ``contamination``), from the first to the last hit word, are removed from the text; a document with
    more than ``drop_share`` of its words hit is removed.  Untouched texts stay as they are, nulls and empty texts too.
    """
    blocks = list(_blocks(benchmark, item_col, item_text, window, block_bytes))
    names = [f"c{i}" for i in range(len(docs.columns))]  # any column names, also repeated ones
    at = docs.columns.index(text_col)
    src = docs.toDF(*names)
    return src.mapInArrow(_cut(blocks, at, drop_share), src.schema).toDF(*docs.columns)


