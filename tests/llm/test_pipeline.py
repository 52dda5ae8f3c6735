"""The pipeline stage by stage against plain versions of each stage."""

import pytest
from brute import contamination, jaccard, words
from pyspark.sql import functions as F
from samples import AWKWARD

import corpus_pipeline
from ledgerlens.llm import pieces
from ledgerlens.llm.queries import PIECE_MODEL, QUERIES

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding"]
    read = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]

    good = stage["quality classifier"](spark, docs, D)
    accepted = {r.doc_id for r in QUERIES["op9_quality_classifier"](spark, D).where("predicted = 1").collect()}
    before, texts = read(docs), read(good)
    assert good.columns == docs.columns and texts == {k: v for k, v in before.items() if k in accepted}

    single = stage["exact dedup"](spark, docs, D)
    groups = {}
    for i, t in before.items():
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append(i)
    keep = {min(g, key=lambda i: (-len(before[i] or ""), i)) for g in groups.values()}
    assert single.columns == docs.columns and read(single) == {k: before[k] for k in keep}

    near = stage["n-gram Jaccard join"](spark, docs, D)
    rows = list(before.items())
    keep = {c for c, _ in jaccard(rows)}
    assert near.columns == docs.columns and read(near) == {k: before[k] for k in keep}

    clean = stage["benchmark decontamination"](spark, docs, D)
    found = dict(zip(before, contamination(before.values(), bench), strict=True))
    after = read(clean)
    assert set(after) == {k for k, (n, hit, _) in found.items() if hit <= n / 2}
    for k, t in after.items():
        n, hit, _ = found[k]
        assert (t == before[k]) if not hit else len(words(t)) == n - hit
    assert clean.columns == docs.columns

    coded = {r.doc_id: r.ids for r in stage["SentencePiece encoding"](spark, docs, D).collect()}
    library = pieces.PieceModel(PIECE_MODEL).processor
    assert coded == {k: library.encode(t or "") for k, t in before.items()}


CLASH = ["quality_score", "score", "ids", "n_ids", "row", "key", "recipe", "r1", "again", "c0", "id", "out"]


@pytest.fixture(scope="module")
def awkward_dir(spark, awkward, tmp_path_factory):
    """Tables whose documents have nulls, repeated rows, long texts and columns with the names that stages use."""
    d = str(tmp_path_factory.mktemp("awkward"))
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for c in CLASH:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (0, 1, 0), (4, 0, None), (5, 0, 0), (6, 1, 0), (None, 1, 1), (99, 0, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "with some words in it"), (2, None), (None, "x"), (3, "")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_awkward_documents(spark, awkward_dir):
    docs = spark.read.parquet(f"{awkward_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, awkward_dir)
        rows = out.collect()
        if name == "SentencePiece encoding":
            assert len(rows) == len(AWKWARD) and {len(r.ids) for r in rows if r.doc_id == 1} == {0} and {r.ids for r in rows if r.doc_id == 2} == {None}
            continue
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        for r in rows:  # other columns stay with their rows
            assert all(r[c] == f"{c} {'null' if r.doc_id is None else r.doc_id}" for c in CLASH)
        ids = sorted((r.doc_id for r in rows), key=str)
        if name == "exact dedup":
            assert ids == [0, 4, 5, 6, 7, None]
        if name == "n-gram Jaccard join":
            assert ids == [0, 1, 2, 4, 5, 6, 7, None]
        if name == "benchmark decontamination":  # five of twelve words are hit
            assert [r.text for r in rows if r.doc_id == 0] == ["The first text,  that repeat. The first text."]
        assert stage(spark, docs.where("false"), awkward_dir).columns == docs.columns
        assert stage(spark, docs.where("false"), awkward_dir).count() == 0
    out = corpus_pipeline.run(spark, awkward_dir)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_ids"] and out.count() <= 6


def test_no_documents(spark, awkward_dir, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{awkward_dir}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = corpus_pipeline.run(spark, D)
    assert 0 < out.count() < docs.count() and out.select("doc_id").distinct().count() == out.count()
