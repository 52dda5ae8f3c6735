"""Plan shape: pushdown, pruning, top-k operators, no cross join, no Python in native paths."""

import datetime as dt

import pytest
from support import SF01, explain, nodes
from pyspark.sql import functions as F

from ledgerlens.functions.clean import infer_type
from ledgerlens.operators import metrics as M
from ledgerlens.operators.knn import knn
from ledgerlens.sources import adapters as A


def test_month_slice_pushes_range(spark):
    plan = explain(M.month_slice(A.ledger(spark, SF01), dt.date(2001, 11, 1)))
    assert "GreaterThanOrEqual(l_shipdate,2001-11-01T00:00)" in plan
    assert "LessThan(l_shipdate,2001-12-01T00:00)" in plan


def test_scan_is_pruned(spark):
    plan = explain(M.kpi_totals(A.ledger(spark, SF01)))
    assert "ReadSchema: struct<l_partkey:bigint,l_extendedprice:double,l_returnflag:string>" in plan
    assert nodes(plan, "Scan parquet") == 2


def test_recent_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in explain(M.recent_activity(A.ledger(spark, SF01)))


def test_kpi_is_one_partial_aggregate(spark):
    plan = explain(M.kpi_totals(A.ledger(spark, SF01)))
    assert nodes(plan, "HashAggregate") == 2  # partial + final, one scan
    assert "SortMergeJoin" not in plan or "BroadcastHashJoin" in plan


def test_no_python_in_native_ops(spark):
    for df in (infer_type(A.dirty_part(spark, SF01).drop("raw_amount").drop("Type")), M.monthly_net(A.ledger(spark, SF01))):
        plan = explain(df)
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_top_category_rows_broadcast_bounded(spark):
    plan = explain(M.top_category_rows(A.ledger(spark, SF01)))
    assert "BroadcastExchange" in plan and "LeftSemi" in plan


def test_knn_has_no_cross_join(spark):
    e = A.table(spark, SF01, "embeddings")
    df = knn(e.select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("row_id"), "embedding"), 5, corpus_blocks=4)
    plan = explain(df)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "FlatMapCoGroupsInArrow" in plan
    assert "WindowGroupLimit" in plan


def test_knn_broadcast_corpus_not_shuffled(spark):
    e = A.table(spark, SF01, "embeddings")
    df = knn(e.select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("row_id"), "embedding"), 5)
    plan = explain(df)
    assert "MapInArrow" in plan and "FlatMapCoGroupsInArrow" not in plan
    # the only exchange is the per-query merge of the top-k candidates
    exchanges = [line for line in plan.splitlines() if line.startswith("Arguments: hashpartitioning") or "RoundRobinPartitioning" in line]
    assert len(exchanges) == 1 and "query_id" in exchanges[0], exchanges


def test_rag_batch_plan(spark):
    import datetime as dt

    from ledgerlens.plans import rag
    from ledgerlens.session import scratch_path

    led = A.ledger(spark, SF01)
    done = rag.ingest(led, scratch_path(spark, "index"), scratch_path(spark, "cache"))
    df = rag.rag_batch(A.table(spark, SF01, "conversations"), spark.read.parquet(done.path), dt.datetime(2026, 1, 1))
    plan = explain(df)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan  # no row-at-a-time UDFs
    assert "MapInArrow" in plan
    # a small question batch is broadcast: the corpus is scanned in place, not shuffled
    assert "FlatMapCoGroupsInArrow" not in plan


@pytest.fixture(scope="module")
def wide_index(spark):
    """An index in as many files as there are cores, so that it is not spread."""
    from ledgerlens.plans import rag
    from ledgerlens.session import scratch_path

    done = rag.ingest(A.ledger(spark, SF01), scratch_path(spark, "index"), scratch_path(spark, "cache"))
    spark.read.parquet(done.path).repartition(spark.sparkContext.defaultParallelism).write.parquet(done.path + "-parts")
    return spark.read.parquet(done.path + "-parts")


def few_per_broadcast(monkeypatch, n):
    from ledgerlens.operators import knn as K

    monkeypatch.setattr(K.knn, "__defaults__", tuple(n if x == K.QUERY_BLOCK_ROWS else x for x in K.knn.__defaults__))


def test_many_questions_do_not_move_the_index(spark, wide_index, monkeypatch):
    """More questions than a broadcast may have: the index is still not shuffled."""
    from ledgerlens.plans import rag

    docs = A.table(spark, SF01, "documents").limit(200)
    questions = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    want = sorted(map(tuple, rag.retrieve(questions, wide_index).collect()))
    few_per_broadcast(monkeypatch, 50)
    df = rag.retrieve(questions, wide_index)
    plan = explain(df)
    assert "FlatMapCoGroupsInArrow" not in plan
    exchanges = [line for line in plan.splitlines() if line.startswith("Arguments: hashpartitioning") or "RoundRobinPartitioning" in line]
    assert len(exchanges) == 1 and "query_id" in exchanges[0], exchanges
    assert sorted(map(tuple, df.collect())) == want and len(want) == 1000


def test_many_conversations_do_not_move_the_index(spark, wide_index, monkeypatch):
    """The prompts of more conversations than a broadcast may have questions, in one part and in several."""
    from ledgerlens.plans import rag

    ask = lambda: rag.rag_batch(A.table(spark, SF01, "conversations"), wide_index, dt.datetime(2026, 1, 1))
    want = sorted(map(tuple, ask().collect()))
    for n in (20, 5):  # parts hold four times as many
        few_per_broadcast(monkeypatch, n)
        df = ask()
        assert "FlatMapCoGroupsInArrow" not in explain(df)
        assert sorted(map(tuple, df.collect())) == want and len(want) == 46
        monkeypatch.undo()
