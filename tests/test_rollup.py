"""Every measure gives the same from a ledger and from its rollup, which lies beside the ledger's version."""

import datetime as dt
import random
import shutil

import pytest
from oracle_check import compare
from support import explain

from ledgerlens.operators import metrics as M
from ledgerlens.plans import dashboard
from ledgerlens.schema import LEDGER
from ledgerlens.sources.collection import current_ledger_path, read_current_ledger, read_current_rollup, replace_ledger, rollup_path

MEASURES = {
    "kpi_totals": M.kpi_totals,
    "txn_count": M.txn_count,
    "monthly_net": M.monthly_net,
    "distinct_months": M.distinct_months,
    "expense_by_category": lambda x: M.expense_by_category(x),
    "top_expense_category": M.top_expense_category,
    "default_month": lambda x: M.default_month(x, dt.datetime(2026, 1, 1)),
    "month_distribution": lambda x: M.month_distribution(x, "2024-02"),
    "month_distribution_of_expenses": lambda x: M.month_distribution(x, dt.date(2024, 3, 5), ["Expense"]),
    "category_share": M.category_share,
    "category_frequency": M.category_frequency,
    "top_categories": M.top_categories,
}


def rows(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        day = None if rng.random() < 0.05 else dt.datetime(2023 + i % 2, 1 + rng.randrange(12), 1 + rng.randrange(28), rng.randrange(24))
        amount = rng.choice([round(rng.uniform(-900, 900), 2), 10.005, 1e17, float("nan"), None, 0.1])
        out.append((day, f"d{i}", amount, rng.choice(["Food", "food", "Rent", "É", "", None]), rng.choice(["Income", "Expense", "Expense", "Gift", None])))
    return out


@pytest.fixture(scope="module")
def ledger(spark):
    return spark.createDataFrame(rows(), LEDGER).repartition(5)


@pytest.mark.parametrize("name", sorted(MEASURES))
def test_same_from_ledger_and_rollup(ledger, name):
    rollup = M.build_rollup(ledger)
    assert M.is_rollup(rollup) and not M.is_rollup(ledger)
    a, b = MEASURES[name](ledger), MEASURES[name](rollup)
    assert a.dtypes == b.dtypes
    ok, why = compare(b.toPandas(), a.toPandas())
    assert ok, why


def test_empty_ledger(spark):
    none = spark.createDataFrame([], LEDGER)
    for name, measure in MEASURES.items():
        ok, why = compare(measure(M.build_rollup(none)).toPandas(), measure(none).toPandas())
        assert ok, (name, why)


def test_rollups_merge(spark, ledger):
    more = spark.createDataFrame(rows(150, 8), LEDGER)
    merged = M.merge_rollups(M.build_rollup(ledger).union(M.build_rollup(more)))
    whole = M.build_rollup(ledger.union(more))
    assert merged.dtypes == whole.dtypes
    ok, why = compare(merged.toPandas(), whole.toPandas())
    assert ok, why


def test_rollup_follows_the_version(spark, ledger, tmp_path):
    root = str(tmp_path / "ledger")
    assert read_current_rollup(spark, root).count() == 0
    replace_ledger(ledger, root)
    assert read_current_rollup(spark, root).agg({"n": "sum"}).first()[0] == ledger.count()
    replace_ledger(ledger.limit(7), root, partition_by_month=True)
    version = current_ledger_path(spark, root)
    assert read_current_ledger(spark, root).count() == 7
    assert M.txn_count(read_current_rollup(spark, root)).first()[0] == 7
    # A version whose rollup was not finished, or never written, is summed up when it is read.
    shutil.rmtree(rollup_path(version).removeprefix("file:"))
    assert M.txn_count(read_current_rollup(spark, root)).first()[0] == 7
    replace_ledger(ledger.limit(5), root, rollup=False)
    assert M.txn_count(read_current_rollup(spark, root)).first()[0] == 5


def test_views_read_the_ledger_for_rows_only(spark, ledger, tmp_path):
    root = str(tmp_path / "ledger")
    replace_ledger(ledger, root)
    views = dashboard.open_views(spark, root)
    for name, df in views.items():
        files = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
        reads_rows = name in ("recent_activity", "category_drilldown")
        assert files and all(f.startswith("v-" if reads_rows else "r-") for f in files), (name, files)
        plan = explain(df)
        assert ("Amount" in plan) == reads_rows, name
    plain = {**dashboard.home(ledger), **dashboard.analytics(ledger, category=dashboard.resolve_top_category(ledger))}
    assert plain.keys() == views.keys()
    for name, df in plain.items():
        ok, why = compare(views[name].toPandas(), df.toPandas())
        assert ok, (name, why)
