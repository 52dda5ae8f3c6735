"""Centroid clustering with Ptolemaic pivots.

Vectors become integer vectors, so distances, sums and centroids are exact and do not depend on how rows are dealt out.
A few fixed pivots are taken from the first centroids.  Every vector keeps its distances to the pivots, computed once.  For
a centroid c and pivots p, q, Ptolemy's inequality gives

    d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q),

and the largest of these bounds over all pivot pairs, rounded down, is compared with the best exact distance so far.  Only
centroids whose bound does not exceed it are checked, by exact integer distances.

Tasks hold the centroids and one batch of vectors.  A round sends, for each batch and cluster, one row of sums, which Spark
adds up; the driver receives one row for each cluster.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

CLUSTERS, DIM, ROUNDS, SCALE = 16, 64, 3, 64
PIVOTS = 6
LIMIT = 1 << 27  # integers are held within this, so that a squared distance of 64 components fits in a long
SLACK = 1e-12  # far above the rounding errors of a bound, far below the gaps that matter
LONGEST = (1 << 63) - 1


def integers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component, as integers within ``LIMIT``."""
    whole = lambda x: F.floor(x.cast("double") * scale)
    return F.transform(vector, lambda x: F.greatest(F.least(whole(x), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))


def complete(vector: Column, dim: int = DIM) -> Column:
    """Whether a vector has exactly ``dim`` components, none null, infinite or not a number."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, fine), F.lit(False))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` to one vector or to the rows of ``b``."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def pick_pivots(seeds: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to ``n`` distinct seeds, each the farthest from those before it."""
    chosen = [0]
    while len(chosen) < n:
        near = np.min([squared(seeds, seeds[c]) for c in chosen], axis=0)
        if not near.max():
            break
        chosen.append(int(near.argmax()))
    return seeds[chosen]


def lower_bounds(near: np.ndarray, centres: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Ptolemaic lower bounds of the distances of vectors to centroids, never above the true ones.

    ``near``: distances of vectors to pivots, ``centres``: of centroids to pivots, ``pivots``: of pivots to each other.
    """
    out = np.zeros((len(near), len(centres)))
    for p in range(len(pivots)):
        for q in range(p + 1, len(pivots)):
            a, b = near[:, p, None] * centres[:, q], near[:, q, None] * centres[:, p]
            np.maximum(out, (np.abs(a - b) - SLACK * (a + b)) / pivots[p, q], out=out)
    return out * (1 - SLACK)


def nearest(vectors: np.ndarray, near: np.ndarray, centroids: np.ndarray, centres: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of and squared distance to each vector's nearest centroid (ties: the smaller number), and how many were checked."""
    bounds = lower_bounds(near, centres, pivots)
    first = bounds.argmin(1)
    best, cluster, checked = squared(vectors, centroids[first]), first.copy(), np.ones(len(vectors), np.int32)
    for k in range(len(centroids)):
        rows = np.flatnonzero((bounds[:, k] <= np.sqrt(best) * (1 + SLACK)) & (first != k))
        d = squared(vectors[rows], centroids[k])
        checked[rows] += 1
        better = (d < best[rows]) | ((d == best[rows]) & (k < cluster[rows]))
        best[rows[better]], cluster[rows[better]] = d[better], k
    return cluster, best, checked


def _matrix(col: pa.Array, kind) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(col), -1)


def _measure(pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1), np.int64)
                near = np.sqrt(np.stack([squared(v, p) for p in pivots], 1).astype(np.float64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(pivots)), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["id", "v", "near"])

    return run


class _Assign:
    """Nearest centroids of batches with columns id, v, near: the rows, or the sums of each cluster."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray, sums: bool):
        far = lambda rows: np.sqrt(np.stack([squared(rows, p) for p in pivots], 1).astype(np.float64))
        self.centroids, self.centres, self.pivots, self.sums = centroids, far(centroids), far(pivots), sums

    def __call__(self, batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1), np.int64)
            cluster, best, checked = nearest(v, _matrix(batch.column(2), np.float64), self.centroids, self.centres, self.pivots)
            if self.sums:
                got = np.unique(cluster)
                total = np.concatenate([v[cluster == k].sum(0) for k in got])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(got.size + 1, dtype=np.int32) * v.shape[1]), pa.array(total))
                yield pa.RecordBatch.from_arrays([pa.array(got.astype(np.int32)), pa.array(np.bincount(cluster)[got]), lists], names=["cluster", "n", "total"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(best), pa.array(checked)], names=["id", "cluster", "distance", "n_checked"])


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """Clusters of integer vectors: one row per kept vector with ``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_checked``.

    Vectors with exactly ``dim`` components, none null or non-finite, are kept; a component x becomes ``floor(scale * x)``.
    The first centroids are the ``clusters`` kept vectors with the smallest SHA-256 of ``1:<id>`` (lower-case hex; a null id is
    empty), of equal ids the smaller vector first; fewer vectors make fewer centroids.  Each round assigns every vector to the
    nearest centroid (squared distance; ties: smaller number) and replaces each non-empty centroid by the exact
    ``floor(sum / count)`` of its vectors.  Then vectors are assigned once more.

    ``distance``: squared, to the vector's centroid; ``cluster_inertia``, ``inertia``: summed over its cluster and over all;
    ``centroid_sha256``: of the centroid's components joined by commas; ``n_checked``: centroids whose distance was computed,
    the others being out of reach by their lower bounds.  Rows repeated with one id are vectors of their own; null ids stay.
    Integers beyond ``LIMIT`` count as ``LIMIT``, and sums beyond a long as the largest long.  Other columns are not read.
    A table without kept vectors gives no rows.
    """
    spark = vectors.sparkSession
    root = scratch_path(spark, "centroids")
    kept = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("x")).where(complete(F.col("x"), dim))
    kept = kept.select("id", integers(F.col("x"), scale).alias("v"))
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    seeds = kept.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(clusters).collect()  # as many rows as clusters
    kind = kept.schema["id"].dataType.simpleString()
    if not seeds:
        none = "cast(null as int) cluster, 0L distance, 0L cluster_inertia, 0L inertia, '' centroid_sha256, 0 n_checked"
        return kept.selectExpr(f"id as `{id_col}`", *none.split(", ")).where("false")
    centroids = np.array([r.v for r in seeds], dtype=np.int64)
    fixed = pick_pivots(centroids, pivots)
    kept.mapInArrow(_measure(fixed), f"id {kind}, v array<int>, near array<double>").write.parquet(f"{root}/vectors")
    kept = spark.read.parquet(f"{root}/vectors")

    for _ in range(rounds):
        sums = kept.mapInArrow(_Assign(centroids, fixed, sums=True), "cluster int, n bigint, total array<bigint>")
        parts = [F.sum(F.col("total")[i].cast("decimal(19,0)")).alias(f"s{i}") for i in range(dim)]
        after = centroids.copy()
        for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *parts).collect():  # one row for each cluster
            after[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dim)]
        centroids = after

    rows = "cluster int, distance bigint, n_checked int"
    kept.mapInArrow(_Assign(centroids, fixed, sums=False), f"id {kind}, {rows}").write.parquet(f"{root}/assigned")
    assigned = spark.read.parquet(f"{root}/assigned")
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}
    hexed = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    each = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    held = [min(sums.get(k, 0), LONGEST) for k in range(len(centroids))]
    return assigned.select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        each(held).cast("bigint").alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), LONGEST)).cast("bigint").alias("inertia"),
        each(hexed).alias("centroid_sha256"),
        "n_checked",
    )
