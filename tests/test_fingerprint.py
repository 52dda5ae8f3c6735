"""The dataset fingerprint has all bits of its rows' fingerprints, is free of order, and can be merged and kept with a version."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import text as X
from ledgerlens.schema import LEDGER
from ledgerlens.session import scratch_path
from ledgerlens.sources import collection as C


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "text string")


def test_all_bits_are_summed(spark):
    values = [f"row {i}" for i in range(500)] + ["row 7"] * 3
    digests = [hashlib.md5(v.encode()).digest() for v in values]
    want = "-".join(str(sum(int.from_bytes(d[4 * k : 4 * k + 4], "big") for d in digests)) for k in range(4))
    got = X.dataset_fingerprint(frame(spark, values).repartition(7)).first()
    assert (got.n_rows, got.fp_sum) == (503, want)
    assert X.dataset_fingerprint(frame(spark, [])).first().fp_sum == "0-0-0-0"


def test_swapped_rows_are_seen(spark):
    base = [f"row {i}" for i in range(200)]
    seen = {X.dataset_fingerprint(frame(spark, rows)).first().fp_sum for rows in (base, base[1:] + ["row x"], base[:-1] + ["row 0"], base[1:] + base[1:2])}
    assert len(seen) == 4
    # Two rows that agree in their first 32 bits, which a narrower sum would take for one another.
    by, pair = {}, None
    for i in range(400_000):
        key = hashlib.md5(f"c{i}".encode()).digest()[:4]
        if key in by:
            pair = by[key], i
            break
        by[key] = i
    a, b = (X.dataset_fingerprint(frame(spark, [*base, f"c{i}"])).first() for i in pair)
    assert a.fp_sum != b.fp_sum and a.fp_sum.split("-")[0] == b.fp_sum.split("-")[0]


def test_parts_merge(spark):
    values = [f"row {i}" for i in range(300)]
    parts = [X.fingerprint_parts(frame(spark, values[a:b])) for a, b in ((0, 100), (100, 100), (100, 300))]
    merged = X.merge_fingerprints(parts[0].union(parts[1]).union(parts[2]))
    whole = X.fingerprint_parts(frame(spark, values[::-1]))
    assert merged.dtypes == whole.dtypes and merged.first() == whole.first()
    assert X.fingerprint_of(merged).first() == X.dataset_fingerprint(frame(spark, values)).first()


@pytest.mark.parametrize("kept", [True, False])
def test_kept_with_a_version(spark, kept):
    root = scratch_path(spark, "ledger")
    rows = [(dt.datetime(2024, 1, 1 + i % 28), f"d{i}", i + 0.25, "Food", "Expense" if i % 3 else None) for i in range(60)]
    ledger = spark.createDataFrame(rows, LEDGER)
    assert not C.same_as_current(ledger, root)
    version = C.replace_ledger(ledger, root, fingerprint=kept)
    assert C.path_exists(spark, C.fingerprint_path(version)) == kept
    assert C.same_as_current(ledger.repartition(9), root)
    for other in (ledger.where("Description <> 'd3'"), ledger.union(ledger.limit(1)), ledger.withColumn("Type", F.lit("Income")), ledger.withColumn("Amount", F.col("Amount") + 1)):
        assert not C.same_as_current(other, root)
    assert C.read_current_ledger(spark, root).count() == 60
