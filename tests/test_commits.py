"""Appends count once and as a whole, whoever dies when; reading own files infers nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.schema import LEDGER
from ledgerlens.session import scratch_path
from ledgerlens.sources import collection as C
from ledgerlens.sources import commits as K

DAY = dt.datetime(2024, 1, 1, 12, 30, 0, 123456)


def ledger(spark, n=20, at=0):
    return spark.createDataFrame([(DAY, f"d{i}", i + 0.5, "Food", "Expense") for i in range(at, at + n)], LEDGER)


def names(spark, path):
    return sorted(r.Description for r in C.read_collection(spark, path).collect())


@pytest.fixture
def inferences(monkeypatch):
    """Paths that a read without a schema was asked for."""
    from pyspark.sql import DataFrameReader

    asked, real, schema = [], DataFrameReader.json, DataFrameReader.schema

    def with_schema(self, s):
        self.known = True
        return schema(self, s)

    def json_(self, path, *a, **k):
        if not getattr(self, "known", False):
            asked.append(path)
        return real(self, path, *a, **k)

    monkeypatch.setattr(DataFrameReader, "schema", with_schema)
    monkeypatch.setattr(DataFrameReader, "json", json_)
    return asked


def test_a_batch_counts_once(spark):
    path = scratch_path(spark, "coll")
    assert C.append_collection(ledger(spark), path, batch="upload 1") == 20
    assert C.append_collection(ledger(spark), path, batch="upload 1") == 0
    assert C.append_collection(ledger(spark), path, batch="upload 2") == 20  # another batch, same rows
    assert C.append_collection(ledger(spark), path) == 20  # no name: an append of its own
    assert len(names(spark, path)) == 60 and len(K.commits(spark, path)) == 3


def test_a_run_that_died_while_writing(spark):
    path = scratch_path(spark, "coll")
    rows = ledger(spark, 40).repartition(4)
    bad = rows.withColumn("Amount", F.when(F.col("Description") == "d33", F.raise_error(F.lit("lost"))).otherwise(F.col("Amount")))
    with pytest.raises(Exception, match="lost"):
        C.append_collection(bad, path, batch="b")
    assert C.read_collection(spark, path).count() == 0
    assert C.append_collection(rows, path, batch="b") == 40 and C.append_collection(rows, path, batch="b") == 0
    assert len(names(spark, path)) == 40


@pytest.mark.parametrize("idempotent", [False, True])
def test_a_run_that_died_before_its_commit(spark, monkeypatch, idempotent):
    path = scratch_path(spark, "coll")

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(C, "commit", dies)
        with pytest.raises(RuntimeError, match="killed"):
            C.append_collection(ledger(spark), path, batch="b", idempotent=idempotent)
    assert C.read_collection(spark, path).count() == 0  # written, not committed
    assert C.append_collection(ledger(spark), path, batch="b", idempotent=idempotent) == 20
    assert len(names(spark, path)) == 20


def test_an_unfinished_manifest_does_not_count(spark):
    path = scratch_path(spark, "coll")
    for left in (b"", b'{"batch": "b", "fol'):
        fs, p = C.fs_and_path(spark, K._manifest(path, "b"))
        out = fs.create(p, True)
        out.write(bytearray(left))
        out.close()
        assert K.find_commit(spark, path, "b") is None and K.commits(spark, path) == []
    assert C.append_collection(ledger(spark), path, batch="b") == 20
    assert C.append_collection(ledger(spark), path, batch="b") == 0 and len(names(spark, path)) == 20


def test_the_faster_of_two_writers_stays(spark, monkeypatch):
    path = scratch_path(spark, "coll")
    first = K.Commit("b", "x", 1, False, T.StructType([]).json())
    assert K.commit(spark, path, first) and not K.commit(spark, path, K.Commit("b", "y", 2, False, "{}"))
    assert K.commits(spark, path) == [first]


def test_records_sent_again_are_left_out(spark):
    path = scratch_path(spark, "coll")
    assert C.append_collection(ledger(spark, 20), path, idempotent=True) == 20
    assert C.append_collection(ledger(spark, 20), path, idempotent=True) == 0
    assert C.append_collection(ledger(spark, 30, at=10), path, idempotent=True) == 20  # ten of them are known
    assert names(spark, path) == sorted(f"d{i}" for i in range(40))
    assert C.append_collection(ledger(spark, 20), path) == 20  # random ids: no check
    assert C.read_collection(spark, path, keep_id=True).select(C.ID).distinct().count() == 60


def test_own_files_are_read_without_inference(spark, inferences):
    path = scratch_path(spark, "coll")
    C.append_collection(ledger(spark), path)
    more = spark.createDataFrame([(DAY, "y", 2, 7, [1.5], (1, "q"), None)], "Date timestamp_ntz, Description string, Amount int, user_id long, a array<double>, s struct<z:int,b:string>, e array<int>")
    C.append_collection(more, path)
    C.append_collection(ledger(spark).where("false").withColumn("no_key", F.lit(1)), path)
    df = C.read_collection(spark, path)
    assert inferences == []
    got = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert got == {"Date": "timestamp_ntz", "Description": "string", "Amount": "double", "Category": "string", "Type": "string", "a": "array<double>", "e": "string", "s": "struct<b:string,z:bigint>", "user_id": "bigint"}
    whole = spark.read.option("timestampNTZFormat", C.TS_FORMAT).json([c.folder for c in K.commits(spark, path) if c.records])
    assert {f.name: f.dataType for f in whole.schema.fields if f.name not in (C.ID, "Date")} == {f.name: f.dataType for f in df.schema.fields if f.name != "Date"}
    assert df.where("Description = 'y'").first().s.z == 1 and df.where("Description = 'd3'").first().Date == DAY


def test_inference_is_for_files_of_others_only(spark, inferences):
    path = scratch_path(spark, "coll")
    C.append_collection(ledger(spark), path)
    spark.createDataFrame([("2024-01-02", "w", "much", True)], "Date string, Description string, Amount string, Flag boolean").write.mode("append").json(path)
    df = C.read_collection(spark, path)
    assert inferences == [[path]]
    assert dict(df.dtypes)["Amount"] == "string" and dict(df.dtypes)["Flag"] == "boolean" and df.count() == 21
    maps = spark.createDataFrame([(DAY, "m", 1.0, {"k": 2})], "Date timestamp_ntz, Description string, Amount double, kinds map<string,int>")
    C.append_collection(maps, path)  # a map's keys are known from its values only
    inferences.clear()
    df = C.read_collection(spark, path)
    assert len(inferences) == 1 and len(inferences[0]) == 2 and df.where("kinds.k = 2").count() == 1


def test_widening_follows_inference():
    L, D, S, B, N = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType()
    assert [K.wider(L, D), K.wider(B, L), K.wider(N, B), K.wider(S, L), K.wider(T.ArrayType(L), T.ArrayType(D)), K.wider(T.ArrayType(L), L)] == [D, S, B, S, T.ArrayType(D), S]
    assert K.json_type(T.MapType(S, L)) is None and K.json_type(T.ArrayType(T.MapType(S, L))) is None
    a, b = T.StructType([T.StructField("x", L), T.StructField("n", N)]), T.StructType([T.StructField("b", B), T.StructField("x", D)])
    assert K.settled(K.merged(a, b)) == T.StructType([T.StructField("b", B), T.StructField("n", S), T.StructField("x", D)])
