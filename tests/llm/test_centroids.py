"""Centroid clustering against a plain version; bounds never exceed distances."""

import random

import numpy as np
from brute import centroids as plain

from ledgerlens.llm.centroids import cluster_vectors, lower_bounds, nearest, pick_pivots, squared

SCHEMA = "vec_id bigint, embedding array<float>, cluster string, distance double, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", 0.5, 1) for i, v in rows], SCHEMA)


def tidy(rows):
    return sorted(map(repr, rows))


def test_equals_plain_version(spark):
    rng = random.Random(9)
    mids = [[rng.uniform(-0.4, 0.4) for _ in range(64)] for _ in range(10)]
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32(x + rng.gauss(0, 0.05) for x in mids[i % 10])) for i in range(300)]
    rows += [(300 + i, f32(mids[0])) for i in range(150)]  # a hot vector
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, rows[8][1])]
    rows += [(600, None), (601, []), (602, [0.1] * 63), (603, [0.1] * 65), (604, [None] + [0.1] * 63), (605, [float("nan")] + [0.1] * 63), (606, [float("inf")] + [0.1] * 63)]
    rows += [(607, f32([1e30, -1e30] * 32)), (608, f32([1e30, -1e30] * 32)), (609, [0.0] * 64)]
    got = cluster_vectors(frame(spark, rows).repartition(4))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_checked"]
    assert tidy(tuple(r)[:-1] for r in got.collect()) == tidy(plain(rows))


def test_few_equal_and_no_vectors(spark):
    for rows in ([(1, [0.5] * 64)] * 3, [(i, [float(i % 2)] * 64) for i in range(20)], [(i, [(-1.0) ** (i * j) for j in range(64)]) for i in range(4)]):
        assert tidy(tuple(r)[:-1] for r in cluster_vectors(frame(spark, rows)).collect()) == tidy(plain(rows))
    for empty in (frame(spark, [(1, None)]), frame(spark, [(1, [0.5] * 64)]).where("false")):
        got = cluster_vectors(empty)
        assert got.count() == 0 and got.dtypes == cluster_vectors(frame(spark, [(1, [0.5] * 64)])).dtypes


def test_parameters(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(5)]) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, x array<double>")
    got = cluster_vectors(df, "i", "x", clusters=7, dim=5, rounds=6, scale=1000, pivots=3)
    assert tidy(tuple(r)[:-1] for r in got.collect()) == tidy(plain(rows, 7, 5, 6, 1000))


def test_bounds_and_pruning():
    rng = np.random.default_rng(4)
    for span in (3, 1 << 10, 1 << 27):  # few distinct distances with many ties, and the largest integers
        v = rng.integers(-span, span + 1, (400, 64))
        c = rng.integers(-span, span + 1, (16, 64))
        v[:50] = c[rng.integers(0, 16, 50)]
        fixed = pick_pivots(c)
        far = lambda rows: np.sqrt(np.stack([squared(rows, p) for p in fixed], 1).astype(float))  # noqa: B023, E731
        exact = np.stack([squared(v, x) for x in c], 1)
        assert (lower_bounds(far(v), far(c), far(fixed)) <= np.sqrt(exact.astype(float))).all()
        cluster, best, checked = nearest(v, far(v), c, far(c), far(fixed))
        assert (best == exact.min(1)).all() and (cluster == exact.argmin(1)).all() and checked.min() >= 1
    # Far clusters are out of reach: few distances are computed.
    c = np.concatenate([np.eye(16, 64), np.zeros((0, 64))]).astype(np.int64) * 1000
    v = np.repeat(c, 20, 0) + rng.integers(-5, 6, (320, 64))
    fixed = pick_pivots(c, 6)
    far = lambda rows: np.sqrt(np.stack([squared(rows, p) for p in fixed], 1).astype(float))
    assert nearest(v, far(v), c, far(c), far(fixed))[2].mean() < 11
