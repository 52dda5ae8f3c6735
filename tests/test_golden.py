"""Golden values: the generated demo ledger and the adapters over the shared tables."""

import datetime as dt

import pytest
from support import SF001, SF01
from pyspark.sql import functions as F

from ledgerlens.functions.clean import infer_type
from ledgerlens.functions.labels import currency
from ledgerlens.operators import metrics as M
from ledgerlens.sources import adapters as A
from ledgerlens.sources.demo import demo_ledger

AS_OF = dt.datetime(2024, 6, 30, 9, 15)


@pytest.fixture(scope="module")
def demo(spark):
    return demo_ledger(spark, 30, AS_OF).cache()


def test_demo_shape(demo):
    rows = demo.orderBy("Date").collect()
    assert len(rows) == 30
    assert rows[-1]["Date"] == AS_OF
    assert rows[0]["Date"] == AS_OF - dt.timedelta(days=29)
    assert [r["Description"] for r in rows[:10]] == [
        "Salary", "Rent", "Groceries", "Uber", "Netflix", "Dividends", "Gym", "Dining Out", "Flight", "Consulting",
    ]


def test_demo_totals(demo):
    r = M.kpi_totals(demo).first()
    assert (r.income, r.expense, r.balance, r.txn_count) == (19950.0, 8820.0, 11130.0, 30)


def test_demo_expense_by_category(demo):
    got = {r.Category: r.amount for r in M.expense_by_category(demo).collect()}
    assert got == {"Rental": 6000, "Travel": 1335, "Grocery": 900, "Food": 360, "Health": 180, "Entertainment": 45}


def test_demo_top_expense(demo):
    r = M.top_expense_category(demo).first()
    assert (r.Category, r.amount) == ("Rental", 6000.0)


def test_demo_all_type_sums(demo):
    got = {r.Category: r.amount for r in M.category_share(demo).collect()}
    assert got == {
        "Income": 15000, "Rental": 6000, "Business": 4500, "Travel": 1335, "Grocery": 900,
        "Investments": 450, "Food": 360, "Health": 180, "Entertainment": 45,
    }


def test_demo_top_frequency(demo):
    got = [(r.Category, r.txn_count, r.amount) for r in M.top_categories(demo).orderBy("rank").collect()]
    assert got == [("Travel", 6, 1335.0), ("Business", 3, 4500.0), ("Entertainment", 3, 45.0)]


def test_demo_inferred_type(demo):
    inferred = infer_type(demo.drop("Type")).collect()
    original = {(r.Description, r.Date): r.Type for r in demo.collect()}
    for r in inferred:
        expect = "Expense" if r.Description == "Consulting" else original[(r.Description, r.Date)]
        assert r.Type == expect


def test_demo_balance_currency(demo):
    r = M.kpi_totals(demo).select(currency(F.col("balance")).alias("t")).first()
    assert r.t == "₹11,130"


def test_demo_recent(demo):
    got = [r.Description for r in M.recent_activity(demo, 3).orderBy("rank").collect()]
    assert got == ["Consulting", "Flight", "Dining Out"]


@pytest.mark.parametrize(
    "sf,rows,income,expense,top,top3,months,max_date",
    [
        (SF001, 6000, 105232161.64, 212132595.67, ("PROMO", 39622355.79),
         [("PROMO", 1164), ("ECONOMY", 1066), ("MEDIUM", 985)], 83, dt.datetime(2001, 11, 4)),
        (SF01, 60000, 1065841923.13, 2117414348.50, ("MEDIUM", 368999484.28),
         [("MEDIUM", 10576), ("STANDARD", 10254), ("LARGE", 10223)], 83, dt.datetime(2001, 11, 4)),
    ],
)
def test_ledger_adapter_golden(spark, sf, rows, income, expense, top, top3, months, max_date):
    led = A.ledger(spark, sf)
    k = M.kpi_totals(led).first()
    assert k.txn_count == rows
    assert k.income == pytest.approx(income, abs=0.005)
    assert k.expense == pytest.approx(expense, abs=0.005)
    t = M.top_expense_category(led).first()
    assert t.Category == top[0] and t.amount == pytest.approx(top[1], abs=0.005)
    assert [(r.Category, r.txn_count) for r in M.top_categories(led).orderBy("rank").collect()] == top3
    assert M.monthly_net(led).count() == months
    assert M.default_month(led).first().default_date == max_date


def test_events_latest(spark):
    got = M.recent_activity(A.ledger_events(spark, SF01), 3).orderBy("rank").collect()
    ev = A.table(spark, SF01, "events").select("ts", "event_id")
    ids = {r.ts: r.event_id for r in ev.collect()}
    assert [ids[r.Date] for r in got] == [9999, 9998, 9997]
