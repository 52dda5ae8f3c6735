"""Edge semantics on tiny inline inputs (nulls, dirty text, ties, empty frames, k > corpus)."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import clean, labels, text
from ledgerlens.operators import metrics as M
from ledgerlens.operators.conversation import append_answers, pending_turns
from ledgerlens.operators.knn import knn
from ledgerlens.operators.prompts import assemble_context, build_prompts, system_context, with_system_context
from ledgerlens.schema import LEDGER, NO_DATA
from ledgerlens.sources.csv import missing_columns, normalize_name, read_ledger_csv

HEADER = " date ,DESCRIPTION,Amount,category\n"
DIRTY = (
    "2024-01-01,Monthly SALARY,5000,Work\n"
    "2024-01-02,Nonprofit gift, 12 ,Charity\n"
    '2024-01-03,Lunch,"1,200",Food\n'
    "2024-01-04,Cab,12d,Travel\n"
    "2024-01-05,Refund,inf,Misc\n"
    "2024-01-06,Huge,1e400,Misc\n"
    ",Gum,-7.25,NA\n"
    "2024-01-09,Short\n"
)


def write(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body)
    return str(p)


def test_dirty_csv(spark, tmp_path):
    df = read_ledger_csv(spark, write(tmp_path, "dirty.csv", HEADER + DIRTY))
    assert df.columns == ["Date", "Description", "Amount", "Category", "Type"]
    got = {r.Description: r for r in df.collect()}
    assert got["Monthly SALARY"].Amount == 5000 and got["Monthly SALARY"].Type == "Income"
    assert got["Nonprofit gift"].Amount == 12 and got["Nonprofit gift"].Type == "Income"
    for d in ("Lunch", "Cab", "Refund", "Huge", "Short"):
        assert got[d].Amount == 0.0, d
    assert got["Lunch"].Type == "Expense"
    gum = got["Gum"]
    assert gum.Date is None and gum.Amount == -7.25 and gum.Category is None and gum.Type == "Expense"
    assert got["Short"].Category is None
    assert got["Monthly SALARY"].Date == dt.datetime(2024, 1, 1)


def test_garbage_date_rejects_load(spark, tmp_path):
    df = read_ledger_csv(spark, write(tmp_path, "bad.csv", HEADER + "garbage,Bad,1,Food\n"))
    with pytest.raises(Exception):
        df.select("Amount").collect()


def test_long_row_rejects_load(spark, tmp_path):
    df = read_ledger_csv(spark, write(tmp_path, "long.csv", HEADER + "2024-01-01,Ok,1,Food\n2024-01-08,Extra,1,Food,5\n"))
    with pytest.raises(Exception):
        df.select("Amount").collect()


def test_trailing_empty_field_rejects_load(spark, tmp_path):
    df = read_ledger_csv(spark, write(tmp_path, "trail.csv", HEADER + "2024-01-01,Ok,1,Food\n2024-01-02,Ok,1,Food,\n"))
    with pytest.raises(Exception, match="more fields than the header"):
        df.select("Amount").collect()


def test_delimiters_inside_quotes_are_not_fields(spark, tmp_path):
    body = '2024-01-01,"Dinner, drinks",1,Food\n2024-01-02,"He said ""a,b""",2,\n2024-01-03,Short,3\n'
    got = {r.Description: r for r in read_ledger_csv(spark, write(tmp_path, "quoted.csv", HEADER + body)).collect()}
    assert set(got) == {"Dinner, drinks", 'He said "a,b"', "Short"}
    assert got["Short"].Category is None and got["Dinner, drinks"].Amount == 1.0


def test_byte_order_mark_header(spark, tmp_path):
    p = tmp_path / "bom.csv"
    p.write_bytes("\ufeffDate,Description,Amount,Category\n2024-01-01,x,1,Food\n".encode("utf-8"))
    r = read_ledger_csv(spark, str(p)).first()
    assert r.Date == dt.datetime(2024, 1, 1) and r.Amount == 1.0


def test_duplicate_headers_rejected(spark, tmp_path):
    with pytest.raises(ValueError, match="Duplicate"):
        read_ledger_csv(spark, write(tmp_path, "dup.csv", "Date,date ,Description,Amount,Category\n2024-01-01,x,y,1,z\n"))


def test_missing_category_listed(spark, tmp_path):
    with pytest.raises(ValueError, match="Missing columns: Category"):
        read_ledger_csv(spark, write(tmp_path, "nocat.csv", "Date,Description,Amount\n2024-01-01,x,1\n"))
    # the sync contract does not require Category and fills it with null
    df = read_ledger_csv(spark, write(tmp_path, "nocat2.csv", "Date,Description,Amount\n2024-01-01,x,1\n"), normalize=False)
    assert df.first().Category is None


def test_header_rules():
    assert normalize_name(" amount_inr ") == "Amount_Inr"
    assert normalize_name("DESCRIPTION") == "Description"
    assert missing_columns(["Date", "Amount"]) == ["Category", "Description"]


SPELLINGS = {
    "5000": 5000.0, " 12 ": 12.0, "-7.25": -7.25, "+3": 3.0, ".5": 0.5, "5.": 5.0, "1e3": 1000.0, "2E-2": 0.02,
    "1,200": 0.0, "12d": 0.0, "₹500": 0.0, "(100)": 0.0, "0x10": 0.0, "1_000": 0.0, "inf": 0.0, "1e400": 0.0, "nan": 0.0,
}


def test_amount_spellings(spark):
    df = spark.createDataFrame([(k,) for k in SPELLINGS], "raw string")
    got = {r.raw: r.Amount for r in df.select("raw", clean.amount_expr(F.col("raw")).alias("Amount")).collect()}
    assert got == SPELLINGS


def ledger_rows(spark, rows):
    return spark.createDataFrame(rows, LEDGER)


def test_empty_ledger(spark):
    empty = spark.createDataFrame([], LEDGER)
    k = M.kpi_totals(empty).first()
    assert (k.income, k.expense, k.balance, k.txn_count) == (0.0, 0.0, 0.0, 0)
    t = M.top_expense_category(empty).first()
    assert (t.Category, t.amount) == ("None", 0.0)
    assert M.monthly_net(empty).count() == 0
    assert M.top_categories(empty).count() == 0
    assert M.default_month(empty, dt.datetime(2024, 5, 2)).first().month_key == "2024-05"


def test_null_categories_only(spark):
    d = dt.datetime(2024, 1, 1)
    led = ledger_rows(spark, [(d, "a", 5.0, None, "Expense"), (d, "b", 7.0, None, "Expense")])
    t = M.top_expense_category(led).first()
    assert (t.Category, t.amount) == ("None", 0.0)
    assert M.expense_by_category(led).count() == 0


def test_ties_and_unknown_types(spark):
    d = dt.datetime(2024, 1, 1)
    led = ledger_rows(
        spark,
        [
            (d, "a", 10.0, "Beta", "Expense"),
            (d, "b", 10.0, "Alpha", "Expense"),
            (d, "c", 99.0, "Gamma", "Transfer"),
            (None, "d", 1.0, "Gamma", "Income"),
        ],
    )
    assert M.top_expense_category(led).first().Category == "Alpha"
    k = M.kpi_totals(led).first()
    assert (k.income, k.expense, k.txn_count) == (1.0, 20.0, 4)
    assert [r.Category for r in M.top_categories(led).orderBy("rank").collect()] == ["Gamma", "Alpha", "Beta"]
    # a row without a date has no month (and is not in the monthly chart)
    assert M.monthly_net(led).count() == 1
    # recent: null dates last, ties by the other columns
    assert [r.Description for r in M.recent_activity(led, 4).orderBy("rank").collect()] == ["a", "b", "c", "d"]


def test_month_label_year_collision(spark):
    led = ledger_rows(
        spark,
        [(dt.datetime(2023, 1, 5), "a", 1.0, "x", "Income"), (dt.datetime(2024, 1, 5), "b", 2.0, "x", "Income")],
    )
    got = [(r.month_key, r.label) for r in M.monthly_net(led).collect()]
    assert got == [("2023-01", "Jan"), ("2024-01", "Jan")]


def test_month_slice_bounds(spark):
    led = ledger_rows(
        spark,
        [
            (dt.datetime(2024, 1, 31, 23, 59, 59), "in", 1.0, "x", "Income"),
            (dt.datetime(2024, 2, 1), "out", 1.0, "x", "Income"),
            (dt.datetime(2024, 1, 1), "in2", 1.0, "x", "Income"),
        ],
    )
    assert sorted(r.Description for r in M.month_slice(led, dt.date(2024, 1, 17)).collect()) == ["in", "in2"]
    assert sorted(r.Description for r in M.month_slice(led, "2024-02").collect()) == ["out"]


def test_share_zero_total(spark):
    d = dt.datetime(2024, 1, 1)
    led = ledger_rows(spark, [(d, "a", 5.0, "x", "Income"), (d, "b", -5.0, "y", "Expense")])
    assert all(r.share is None for r in M.category_share(led).collect())


def test_display_columns(spark):
    df = spark.createDataFrame(
        [(11130.0, "Expense", "Food & Drinks"), (-1234.0, None, None), (2.5, "Income", "Air travel"), (3.5, "x", "Pay")],
        "a double, t string, c string",
    )
    got = df.select(
        labels.currency(F.col("a")).alias("cur"),
        labels.sign(F.col("t")).alias("sign"),
        labels.icon_class(F.col("c"), F.col("t")).alias("icon"),
    ).collect()
    assert [r.cur for r in got] == ["₹11,130", "₹-1,234", "₹2", "₹4"]
    assert [r.sign for r in got] == ["-", "+", "+", "+"]
    assert [r.icon for r in got] == ["food", "other", "travel", "other"]


def test_row_text(spark):
    rows = [
        (dt.datetime(2024, 1, 1), "Rent", 2000.0, "Rental", "Expense"),
        (dt.datetime(2024, 1, 1, 0, 0, 7, 100), "Big", 1e7, None, "Income"),
        (None, None, 12.35, "x", "Income"),
    ]
    got = [r.text for r in text.row_text(spark.createDataFrame(rows, LEDGER)).collect()]
    assert got == [
        "Date: 2024-01-01 00:00:00, Description: Rent, Amount: 2000.0, Category: Rental",
        "Date: 2024-01-01 00:00:07.000100, Description: Big, Amount: 10000000.0, Category: nan",
        "Date: NaT, Description: nan, Amount: 12.35, Category: x",
    ]


def test_knn_small_corpus(spark):
    corpus = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [0.0, 1.0])], "row_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [0.0, 0.0])], "query_id long, embedding array<float>")
    got = [(r.rank, r.row_id, r.distance) for r in knn(q, corpus, 5).orderBy("rank").collect()]
    assert got == [(1, 0, 0.0), (2, 2, 1.0), (3, 1, 25.0)]


def test_context_and_prompt(spark):
    hits = spark.createDataFrame([(1, 2, "second"), (1, 1, "first")], "query_id long, rank long, text string")
    queries = spark.createDataFrame([(1, "q1"), (2, "q2")], "query_id long, question string")
    ctx = {r.query_id: r.context for r in assemble_context(hits, queries).collect()}
    assert ctx == {1: "first\nsecond", 2: NO_DATA}
    p = build_prompts(queries.join(assemble_context(hits, queries), "query_id")).where("query_id = 2").first().prompt
    assert p == "You are a helpful financial assistant.\nTransaction Data:\nNo data found.\n\nUser Question: q2"
    as_of = dt.datetime(2024, 6, 30, 12, 0, 1)
    assert system_context(as_of).startswith("Today's Date is 2024-06-30 12:00:01. Assume queries about 'this month' refer to June.")
    q = spark.createDataFrame([("How much?",)], "t string").select(with_system_context(F.col("t"), as_of).alias("q")).first().q
    assert q.endswith("(₹).\n\nUser Query: How much?")


def test_conversation_ops(spark):
    conv = spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "spend?"), (2, 0, "user", "x"), (2, 1, "assistant", "y")],
        "conv_id long, turn long, role string, text string",
    )
    pend = pending_turns(conv).collect()
    assert [(r.conv_id, r.turn, r.text) for r in pend] == [(1, 2, "spend?")]
    answers = spark.createDataFrame([Row(conv_id=1, turn=2, text="You spent 5")])
    out = append_answers(conv, answers)
    assert out.count() == 6
    assert out.where("conv_id = 1 AND turn = 3").first().role == "assistant"
    assert pending_turns(out).count() == 0


def test_pending_turns_edges(spark):
    rows = [(None, 1, "user", "no id"), (None, 0, "assistant", "z"), (3, None, "user", "no turn"), (4, 2, "user", None), (4, None, "assistant", "y")]
    rows += [(5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "assistant", "c"), (5, 1, "user", "a"), (6, 1, None, "no role"), (7, 1, "assistant", "q"), (7, 0, "user", "q")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(((r.conv_id, r.turn, r.text) for r in pending_turns(conv).collect()), key=str)
    assert got == sorted([(None, 1, "no id"), (4, 2, None), (5, 1, "a")], key=str)
    assert pending_turns(conv.where("false")).count() == 0


def test_embed_cached_empty_and_null_inputs(spark):
    from ledgerlens.operators.embed import embed_cached, fill_cache_counts
    from ledgerlens.session import scratch_path

    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fill_cache_counts(empty, scratch_path(spark, "cache")) == (0, 0)
    out, n = embed_cached(empty, scratch_path(spark, "cache"))
    assert n == 0 and out.count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, text string")
    out, n = embed_cached(nulls, scratch_path(spark, "cache"))
    assert n == 0 and out.count() == 0  # a row without text gets no vector
