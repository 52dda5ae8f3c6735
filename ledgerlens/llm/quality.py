"""Quality classifier: a factorisation machine over hashed words and structure statistics.

The score adds a bias, a weight for each feature and low-rank pairwise interactions, which the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) makes linear in the number of features.
It is fitted on a bounded sample of labelled rows (``MAX_FIT_ROWS``, the documented bound); every whole text is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as B

BUCKET_BITS = 15
RANK = 8
MAX_FIT_ROWS = 8192
EPOCHS = 10  # passes over the sample; more of a small one, for at least so many steps
STEPS = 1000
BATCH = 48
THRESHOLD = 0.7

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"!?-()"]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True
STATS = ("log_bytes", "log_words", "word_bytes", "distinct", "symbols", "digits", "capitals", "stops", "lines", "spaces", "wide", "top_word")


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (c[off[1:]] - c[off[:-1]]).astype(np.float64)


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words of every text as (where each text's begin, buckets, values of unit length), and a matrix of statistics."""
    low = B.LOWER[buf]
    start, end, first = B.tokens(low, off, B.WORD)
    n = np.diff(first)
    doc = np.repeat(np.arange(n.size), n)
    bucket = (B.hashes(low, start, end) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    cell, count = np.unique((doc << BUCKET_BITS) | bucket, return_counts=True)
    at = np.searchsorted(cell, np.arange(n.size + 1) << BUCKET_BITS)
    value = np.sqrt(count)
    norm = np.sqrt(np.maximum(n, 1))[cell >> BUCKET_BITS]  # squares of the values add up to the number of words
    size, words = np.diff(off).astype(np.float64), np.maximum(n, 1)
    per = np.maximum(size, 1)
    most = np.zeros(n.size)
    np.maximum.at(most, cell >> BUCKET_BITS, count)
    inside = np.concatenate([[0], np.cumsum(end - start)])
    stats = np.stack(
        [
            np.log1p(size) / 10,
            np.log1p(n) / 10,
            (inside[first[1:]] - inside[first[:-1]]) / words / 10,
            np.diff(at) / words,
            _sums(_SYMBOL[buf], off) / per * 10,
            _sums((buf >= 48) & (buf <= 57), off) / per * 10,
            _sums((buf >= 65) & (buf <= 90), off) / per * 10,
            _sums(_STOP[buf], off) / words * 5,
            _sums(buf == 10, off) / words * 5,
            _sums(buf == 32, off) / words,
            _sums(buf >= 128, off) / per * 5,
            most / words * 5,
        ],
        1,
    )
    return at, cell & ((1 << BUCKET_BITS) - 1), value / norm, stats


class Machine:
    """Bias, weights and factors; features are the buckets, then the statistics (standardised)."""

    def __init__(self):
        size = (1 << BUCKET_BITS) + len(STATS)
        self.bias = 0.0
        self.weight = np.zeros(size)
        self.factor = np.random.RandomState(11).normal(0, 0.01, (size, RANK))
        self.mean, self.scale = np.zeros(len(STATS)), np.ones(len(STATS))

    def join(self, at, bucket, value, stats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Statistics appended to each text's hashed words, so that every text has features."""
        k, n = len(STATS), len(stats)
        scaled = np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(k)
        own = np.diff(at)
        begin = at + np.arange(n + 1) * k
        i, x = np.empty(begin[-1], np.int64), np.empty(begin[-1])
        word = np.repeat(begin[:-1] - at[:-1], own) + np.arange(at[-1])
        i[word], x[word] = bucket, value
        tail = (begin[:-1] + own)[:, None] + np.arange(k)
        i[tail], x[tail] = (1 << BUCKET_BITS) + np.arange(k), scaled
        return begin, i, x

    def raw(self, begin, i, x):
        """Log-odds of every text, and the factor sums that the gradient needs."""
        vx = self.factor[i] * x[:, None]
        total = np.add.reduceat(vx, begin[:-1])
        pairs = 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), begin[:-1]))
        return self.bias + np.add.reduceat(self.weight[i] * x, begin[:-1]) + pairs, total

    def score(self, at, bucket, value, stats) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.join(at, bucket, value, stats))[0], -30, 30)))

    def fit(self, at, bucket, value, stats, label: np.ndarray) -> None:
        """Logistic loss, AdaGrad steps over small batches in a fixed order."""
        self.mean, self.scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
        begin, i, x = self.join(at, bucket, value, stats)
        share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        sw, sv, sb = np.full(self.weight.shape, 1e-6), np.full(self.factor.shape, 1e-6), 1e-6
        order, n = np.random.RandomState(5), len(label)
        batches = max(1, n // BATCH)
        for _ in range(max(EPOCHS, -(-STEPS // batches))):
            for pick in np.array_split(order.permutation(n), batches):
                own = begin[pick + 1] - begin[pick]
                b = np.concatenate([[0], np.cumsum(own)])
                src = np.repeat(begin[pick] - b[:-1], own) + np.arange(b[-1])
                bi, bx = i[src], x[src]
                z, total = self.raw(b, bi, bx)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[pick]) / len(pick)
                each = np.repeat(g, own)
                used, slot = np.unique(bi, return_inverse=True)
                gw = np.bincount(slot, each * bx, used.size) + 1e-5 * self.weight[used]
                dv = (each * bx)[:, None] * (np.repeat(total, own, 0) - self.factor[bi] * bx[:, None])
                gv = np.stack([np.bincount(slot, dv[:, f], used.size) for f in range(RANK)], 1) + 1e-5 * self.factor[used]
                sw[used] += gw**2
                sv[used] += gv**2
                sb += g.sum() ** 2
                self.weight[used] -= 0.1 * gw / np.sqrt(sw[used])
                self.factor[used] -= 0.02 * gv / np.sqrt(sv[used])
                self.bias -= 0.1 * g.sum() / np.sqrt(sb)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_FIT_ROWS) -> Machine:
    """Fit on at most ``max_rows`` labelled documents: those with the smallest hash of their id.

    Null labels are ignored; a document labelled more than once takes the rounded mean.  Labelled ids without a document
    are ignored, null texts count as empty.  A document id that repeats gives a row for each, up to ``2 * max_rows`` rows in
    all (the part of the bound that such ids fill; by ascending id as text).  Without any label the machine gives 1/2 everywhere.  Features are made by the tasks; the driver gets at most ``max_rows`` sparse rows.
    """
    spark = docs.sparkSession
    want = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    want = want.groupBy("id").agg(F.round(F.avg("y")).alias("y"))
    want = want.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(max_rows).collect()
    machine = Machine()
    if not want:
        return machine
    picked = spark.createDataFrame([(r.id, r.y) for r in want], T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("y", T.DoubleType())]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")  # at most max_rows ids
    spelled = rows.select("id", "y", "text").mapInArrow(_spell, "id string, y double, bucket binary, value binary, stats binary")
    got = spelled.orderBy("id", "y").limit(2 * max_rows).toArrow()
    if not got.num_rows:
        return machine
    buckets = [np.frombuffer(b, np.int32) for b in got["bucket"].to_pylist()]
    at = np.concatenate([[0], np.cumsum([b.size for b in buckets])])
    value = np.frombuffer(b"".join(got["value"].to_pylist()), np.float32).astype(np.float64)
    stats = np.frombuffer(b"".join(got["stats"].to_pylist()), np.float64).reshape(-1, len(STATS))
    machine.fit(at, np.concatenate(buckets).astype(np.int64), value, stats, got["y"].to_numpy())
    return machine


def _spell(batches):
    for batch in batches:
        for part in B.slices(batch, "text"):
            at, bucket, value, stats = features(*B.raw(part.column(2)))
            cut = lambda v, kind: [v[a:b].astype(kind).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.string()), part.column(1), pa.array(cut(bucket, np.int32), pa.binary()), pa.array(cut(value, np.float32), pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())],
                names=["id", "y", "bucket", "value", "stats"],
            )


def score_quality(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``score_col`` in 0 to 1: how likely label 1 is.

    One row per input row, in place, without a shuffle.  Null and empty texts are scored by their statistics alone.
    A column of that name that ``docs`` has already is replaced.  Only the text is an input of the score.
    """
    if score_col == text_col:
        raise ValueError("the score would replace the text")
    docs = docs.drop(score_col)
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # fixed size: 2^15 buckets of rank 8
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    src = docs.toDF(*names)

    def run(batches):
        for batch in batches:
            for part in B.slices(batch, names[at]):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sent.value.score(*features(*B.raw(part.column(at)))))], names=[*names, "out"])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField("out", T.DoubleType())])).toDF(*docs.columns, score_col)
