"""Record collections, ledger versions and CSV folders on shared storage."""

import datetime as dt
import gzip

import pytest
from support import SF01, explain, nodes
from pyspark.sql import functions as F

from ledgerlens.schema import LEDGER, SYNC_COMMIT
from ledgerlens.session import scratch_path
from ledgerlens.sources import adapters as A
from ledgerlens.sources.collection import (
    ID,
    append_collection,
    current_ledger_path,
    read_collection,
    read_current_ledger,
    replace_ledger,
)
from ledgerlens.sources.csv import read_ledger_csv, write_csv


def test_append_counts_and_file_limit(spark):
    led = A.ledger_events(spark, SF01)
    path = scratch_path(spark, "coll")
    n = append_collection(led, path, max_records_per_file=SYNC_COMMIT)
    assert n == led.count() == 10000
    files = [f for f in read_collection(spark, path).inputFiles() if f.endswith(".json")]
    assert len(files) >= 25  # at most 400 records per file
    back = read_collection(spark, path, keep_id=True)
    assert back.select(ID).distinct().count() == n


def test_idempotent_ids_repeat(spark):
    led = A.ledger_events(spark, SF01)
    p1, p2 = scratch_path(spark, "coll"), scratch_path(spark, "coll")
    append_collection(led, p1, idempotent=True)
    append_collection(led.repartition(7), p2, idempotent=True)
    a = read_collection(spark, p1, keep_id=True).select(ID)
    b = read_collection(spark, p2, keep_id=True).select(ID)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_missing_required_column_rejected(spark):
    led = A.ledger_events(spark, SF01).drop("Amount")
    try:
        append_collection(led, scratch_path(spark, "coll"))
    except ValueError as e:
        assert "Amount" in str(e)
    else:
        raise AssertionError("expected a validation error")


def test_empty_collection(spark):
    df = read_collection(spark, scratch_path(spark, "never-written"))
    assert df.schema == LEDGER and df.count() == 0


def test_key_union_and_types(spark):
    path = scratch_path(spark, "coll")
    d = dt.datetime(2024, 1, 1, 12, 30, 0, 123456)
    a = spark.createDataFrame([(d, "x", 1.5, "Food", "Expense")], LEDGER)
    b = spark.createDataFrame([(d, "y", 2.0, 7)], "Date timestamp_ntz, Description string, Amount double, user_id long")
    append_collection(a, path)
    append_collection(b, path)
    got = {r.Description: r for r in read_collection(spark, path).collect()}
    assert set(got["x"].asDict()) == {"Date", "Description", "Amount", "Category", "Type", "user_id"}
    assert got["x"].Date == d and got["y"].Type is None and got["y"].user_id == 7 and got["x"].user_id is None


def test_replace_ledger_versions(spark):
    root = scratch_path(spark, "ledger")
    assert current_ledger_path(spark, root) is None
    p1 = replace_ledger(A.ledger_events(spark, SF01), root)
    p2 = replace_ledger(A.ledger_events(spark, SF01).where(F.col("Category") == "signup"), root)
    assert p2 > p1 and current_ledger_path(spark, root) == p2
    assert read_current_ledger(spark, root).count() == A.ledger_events(spark, SF01).where(F.col("Category") == "signup").count()


def test_csv_folder_round_trip(spark):
    raw = A.dirty_orders(spark, SF01).repartition(4)
    path = write_csv(raw, scratch_path(spark, "upload"))
    up = read_ledger_csv(spark, path)
    assert up.count() == 15000
    assert up.columns == ["Date", "Description", "Amount", "Category", "Type", "Order_Key"]
    # exact headers (sync contract): the messy names stay and the Date column is not found
    try:
        read_ledger_csv(spark, path, normalize=False)
    except ValueError as e:
        assert "Missing columns" in str(e)
    else:
        raise AssertionError("expected missing columns")


def test_month_partitioned_ledger_prunes(spark):
    from support import explain

    from ledgerlens.operators import metrics as M

    root = scratch_path(spark, "ledger")
    replace_ledger(A.ledger(spark, SF01), root, partition_by_month=True)
    led = read_current_ledger(spark, root)
    assert "month_key" in led.columns
    sl = M.month_slice(led, "2001-11")
    plan = explain(sl)
    assert "PartitionFilters: [isnotnull(month_key" in plan and "(month_key#" in plan
    assert sl.count() == M.month_slice(A.ledger(spark, SF01), "2001-11").count()


def test_month_partitioned_write_few_files_hot_month_split(spark):
    from ledgerlens.schema import DATE

    led = A.ledger(spark, SF01)
    # one month holds about a third of all rows
    hot = F.when(F.pmod(F.xxhash64(*led.columns), F.lit(3)) == 0, F.lit("2001-11-15").cast("timestamp_ntz"))
    # spread over 8 tasks, as a large scan is (AQE splits a hot partition along map outputs)
    skewed = led.withColumn(DATE, F.coalesce(hot, F.col(DATE))).repartition(8)
    files = lambda p: (
        spark.read.parquet(p).select("month_key", F.input_file_name().alias("f")).distinct().groupBy("month_key").count().withColumnRenamed("count", "n").collect()
    )
    path = replace_ledger(skewed, scratch_path(spark, "ledger"), partition_by_month=True)
    per_month = {r.month_key: r.n for r in files(path)}
    # files follow the data, not the number of write tasks
    assert max(n for m, n in per_month.items() if m != "2001-11") == 1
    assert spark.read.parquet(path).count() == skewed.count()
    # with a small advisory size the hot month is split over several tasks (files)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        path = replace_ledger(skewed, scratch_path(spark, "ledger"), partition_by_month=True)
        per_month = {r.month_key: r.n for r in files(path)}
        assert per_month["2001-11"] > 1
        assert spark.read.parquet(path).count() == skewed.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_collection_read_merges_the_keys_of_all_writers(spark):
    path = scratch_path(spark, "coll")
    d = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([(d, "x", 1, None, 3)], "Date timestamp_ntz, Description string, Amount int, Category string, n long")
    b = spark.createDataFrame([(d, "y", 2.5, "z")], "Date timestamp_ntz, Description string, Amount double, n string")
    foreign = spark.createDataFrame([("2024-01-02", "w", 4.0, "Shop")], "Date string, Description string, Amount double, Merchant string")
    append_collection(a, path, required=("Date", "Description", "Amount"))
    append_collection(b, path, required=("Date", "Description", "Amount"))
    foreign.write.mode("append").json(path)
    df = read_collection(spark, path)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert types == {"Date": "timestamp_ntz", "Description": "string", "Amount": "double", "Category": "string", "Merchant": "string", "n": "string"}
    got = sorted((r.Description, r.Amount, r.n, r.Merchant, r.Date.day) for r in df.collect())
    assert got == [("w", 4.0, None, "Shop", 2), ("x", 1.0, "3", None, 1), ("y", 2.5, "z", None, 1)]


def test_collection_of_another_writer(spark):
    path = scratch_path(spark, "foreign")
    spark.createDataFrame([("2024-01-01", "x", 1.5)], "Date string, Description string, Amount double").write.json(path)
    r = read_collection(spark, path).first()
    assert r.Date == dt.datetime(2024, 1, 1) and r.Amount == 1.5


def test_csv_parts_with_other_headers(spark, tmp_path):
    """Parts whose columns are ordered, spelled or extended differently give the ledger that uniform parts give."""
    rows = [(f"2024-01-{i + 1:02d}", f"d{i}, \"q\"", f"{i}.5", "Food" if i % 2 else "Salary") for i in range(20)]
    even, odd = tmp_path / "even", tmp_path / "odd [1]"
    spark.createDataFrame(rows, "Date string, Description string, Amount string, Category string").repartition(4).write.option("header", True).option("escape", '"').csv(str(even))
    odd.mkdir()
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    orders = [("Date,Description,Amount,Category", (0, 1, 2, 3)), (" category ,AMOUNT,description,date", (3, 2, 1, 0)), ('"Amount",Category,Date,Description', (2, 3, 0, 1)), ("\ufeffDescription,Date,Category,Amount", (1, 0, 3, 2))]
    for k, (header, order) in enumerate(orders):
        body = "\n".join(",".join(quoted(r[i]) for i in order) for r in rows[k * 5 : k * 5 + 5])
        (odd / f"part {k}{{}}.csv").write_text(f"{header}\n{body}\n")
    (odd / "z-empty.csv").write_text("")
    (odd / "_hidden.csv").write_text("no,header\n")
    pattern = str(odd).replace("[", "\\[").replace("]", "\\]")
    for multiline in (False, True):
        want = read_ledger_csv(spark, str(even), multiline=multiline)
        got = read_ledger_csv(spark, pattern, multiline=multiline)
        assert got.schema == want.schema and sorted(got.collect()) == sorted(want.collect())
    assert nodes(explain(got), "Scan") == 4 and nodes(explain(want), "Scan") == 1  # one scan for each distinct header


def test_csv_parts_with_more_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Description,Amount,Category\n2024-01-01,salary,1,Food\n")
    (tmp_path / "b.csv").write_text("Type,Date,Category,Amount,Description,Shop\nGift,2024-01-02,Food,2,y,s\n")
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("\n\nCategory,Date,Description,Amount\nFood,2024-01-03,z,3\n")
    df = read_ledger_csv(spark, str(tmp_path))
    assert df.columns == ["Date", "Description", "Amount", "Category", "Type", "Shop"]
    assert sorted((r.Description, r.Amount, r.Type, r.Shop) for r in df.collect()) == [("salary", 1.0, "Income", None), ("y", 2.0, "Gift", "s"), ("z", 3.0, "Expense", None)]
    (tmp_path / "d.csv").write_text("Date,Amount,Category\n2024-01-04,4,Food\n")  # one part without a required column rejects the upload
    with pytest.raises(ValueError, match="Missing columns: Description"):
        read_ledger_csv(spark, str(tmp_path))
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.csv").write_text("Category,Date,Description,Amount\nFood,2024-01-03,z,3,9\n")
    (tmp_path / "e" / "y.csv").write_text("Date,Category,Description,Amount\n2024-01-03,Food,z,3\n")
    with pytest.raises(Exception, match="more fields than the header"):
        read_ledger_csv(spark, str(tmp_path / "e")).collect()
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.csv").write_text("")
    with pytest.raises(ValueError, match="No header"):
        read_ledger_csv(spark, str(tmp_path / "f"))


def test_csv_is_scanned_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Description,Amount,Category\n2024-01-01,x,1,Food\n2024-01-02,short,2\n")
    df = read_ledger_csv(spark, str(tmp_path))
    assert nodes(explain(df), "Scan") == 1
    assert df.count() == 2 and {r.Description: r.Category for r in df.collect()} == {"x": "Food", "short": None}


def test_csv_with_line_breaks_and_long_fields(spark, tmp_path):
    long = "z" * (1 << 20)
    (tmp_path / "a.csv").write_text(f'Date,Description,Amount,Category\n2024-01-01,"two\nlines",1,Food\n2024-01-02,"{long}, x",2,Food\n')
    got = [r.Description for r in read_ledger_csv(spark, str(tmp_path), multiline=True).orderBy("Date").collect()]
    assert got == ["two\nlines", f"{long}, x"]
    (tmp_path / "b.csv").write_text('Date,Description,Amount,Category\n2024-01-01,"two\nlines",1,Food,\n')
    with pytest.raises(Exception, match="more fields than the header"):
        read_ledger_csv(spark, str(tmp_path / "b.csv"), multiline=True).collect()


def test_csv_list_of_date_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Description,Amount,Category\n03/02/2024,x,1,Food\n5 Jan 2024,y,1,Food\n2024-03-01,z,1,Food\n,w,1,Food\n")
    formats = ["yyyy-MM-dd", "d MMM yyyy", "dd/MM/yyyy"]
    got = {r.Description: r.Date for r in read_ledger_csv(spark, str(tmp_path), date_format=formats).collect()}
    assert got == {"x": dt.datetime(2024, 2, 3), "y": dt.datetime(2024, 1, 5), "z": dt.datetime(2024, 3, 1), "w": None}
    with pytest.raises(Exception):
        read_ledger_csv(spark, str(tmp_path), date_format=formats[:2]).collect()
