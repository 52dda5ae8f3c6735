"""Dashboard and retrieval compositions end to end on small inputs."""

import datetime as dt

from support import SF001

from ledgerlens.plans import dashboard, rag
from ledgerlens.session import scratch_path
from ledgerlens.sources import adapters as A
from ledgerlens.sources.csv import read_ledger_csv


def test_home_and_analytics(spark):
    led = A.ledger(spark, SF001)
    home = dashboard.home(led)
    assert set(home) == {"kpi_totals", "monthly_net", "top_expense_category", "recent_activity"}
    assert home["recent_activity"].count() == 3
    top = dashboard.resolve_top_category(led)
    views = dashboard.analytics(led, category=top)
    assert views["category_drilldown"].count() == led.where(f"Category = '{top}'").count()
    assert views["top_categories"].count() == 3
    assert abs(sum(r.share for r in views["month_distribution"].collect()) - 1.0) < 1e-12
    # no category chosen -> nothing shown
    assert dashboard.analytics(led)["category_drilldown"].count() == 0


def test_ingest_and_rag_batch(spark):
    led = A.ledger(spark, SF001)
    cache = scratch_path(spark, "cache")
    first = rag.ingest(led, scratch_path(spark, "index"), cache)
    assert first.rows == led.count() and 0 < first.embedded <= first.rows
    again = rag.ingest(led, scratch_path(spark, "index"), cache)
    assert again.embedded == 0 and again.rows == first.rows
    index = spark.read.parquet(first.path)
    assert index.count() == first.rows and index.where("embedding IS NULL").count() == 0
    conv = A.table(spark, SF001, "conversations")
    out = rag.rag_batch(conv, index, dt.datetime(2026, 1, 1), k=5)
    pend = out.collect()
    assert len(pend) > 0
    for r in pend:
        assert r.prompt.startswith("You are a helpful financial assistant.\nTransaction Data:\n")
        assert r.context.count("\n") == 4  # five hits, newline-joined
        assert "User Query: " in r.question


def test_explicit_date_format(spark, tmp_path):
    p = tmp_path / "eu.csv"
    p.write_text("Date,Description,Amount,Category\n13/02/2024,x,1,Food\n01/02/2024,y,2,Food\n")
    got = {r.Description: r.Date for r in read_ledger_csv(spark, str(p), date_format="dd/MM/yyyy").collect()}
    assert got == {"x": dt.datetime(2024, 2, 13), "y": dt.datetime(2024, 2, 1)}


def test_empty_ledger_retrieval(spark):
    from ledgerlens.schema import LEDGER, NO_DATA

    empty = spark.createDataFrame([], LEDGER)
    done = rag.ingest(empty, scratch_path(spark, "index"), scratch_path(spark, "cache"))
    assert done.rows == 0 and done.embedded == 0
    index = spark.read.parquet(done.path)
    conv = A.table(spark, SF001, "conversations")
    out = rag.rag_batch(conv, index, dt.datetime(2026, 1, 1)).collect()
    assert len(out) > 0 and all(r.context == NO_DATA for r in out)


def test_no_pending_questions(spark):
    led = A.ledger(spark, SF001)
    done = rag.ingest(led, scratch_path(spark, "index"), scratch_path(spark, "cache"))
    conv = A.table(spark, SF001, "conversations").limit(0)
    out = rag.rag_batch(conv, spark.read.parquet(done.path), dt.datetime(2026, 1, 1))
    assert out.columns == ["conv_id", "turn", "question", "context", "prompt"]
    assert out.count() == 0


def test_ingest_small_ledger_large_cache(spark):
    from support import SF01, explain

    from ledgerlens.operators.embed import HashingEmbedder, cached_vectors, model_id, read_cache
    from ledgerlens.schema import TASK_DOCUMENT

    small = A.ledger(spark, SF001)
    shared = scratch_path(spark, "cache")
    rag.ingest(A.ledger(spark, SF01), scratch_path(spark, "index"), shared)  # a cache about 10x this ledger
    narrowed = rag.ingest(small, scratch_path(spark, "index"), shared)
    fresh = rag.ingest(small, scratch_path(spark, "index"), scratch_path(spark, "cache"))
    rows = lambda p: sorted((r.text, r.fp, tuple(r.embedding)) for r in spark.read.parquet(p).collect())
    assert narrowed.rows == fresh.rows and rows(narrowed.path) == rows(fresh.path)
    # the large slice is narrowed to this ledger's fingerprints; a slice of the ledger's size is not
    texts = spark.read.parquet(fresh.path).select("fp")
    big = read_cache(spark, shared, model_id(HashingEmbedder()), TASK_DOCUMENT)
    assert cached_vectors(texts, big, fresh.rows).count() == texts.distinct().count() < big.count()
    assert "LeftSemi" not in explain(cached_vectors(texts, big, big.count()))
