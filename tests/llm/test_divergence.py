"""Source divergence against a plain version: joint cells, zeros by complement, blocks of sources, awkward tables."""

import random

import pytest
from brute import divergence as plain
from samples import AWKWARD

from ledgerlens.llm.divergence import audit_sources

SCHEMA = "text string, lang string, source string, value int, rank string, term int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def sample():
    rng = random.Random(11)
    pool = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{'é' * (i % 3)}" for i in range(200)]
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "en", "en", "de", "", None])
        source = "hot" if rng.random() < 0.35 else rng.choice(["a", "b", "é", "Z", "", None])
        words = [pool[min(199, int(rng.expovariate(0.03)))] for _ in range(rng.randrange(60))]
        rows.append((rng.choice([" ", ", 1", "\n"]).join(w.title() if rng.random() < 0.3 else w for w in words), lang, source))
    rows += [rows[3]] * 12  # a repeated row
    rows += [(None, "en", "no terms"), ("", "en", "no terms"), ("123 456", "en", "digits"), ("only here", "fr", "few"), ("and there", "fr", "more"), ("one source", "es", "s")]
    rows += [("aa " * 40000 + "ba", "en", "long"), (None, None, None)]
    return rows


def tidy(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("sizes", [{}, {"chunk_bits": 6, "source_block": 2}])
def test_equals_plain_version(spark, sizes):
    rows = sample()
    got = audit_sources(frame(spark, rows).repartition(3), **sizes)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert tidy(got.collect()) == tidy(plain(rows))


def test_thresholds(spark):
    rows = sample()[:120]
    assert tidy(audit_sources(frame(spark, rows), min_docs=1, top_terms=2).collect()) == tidy(plain(rows, 1, 2))
    none = audit_sources(frame(spark, rows), min_docs=1000).collect()  # no term is kept: pairs of value 0 only
    assert tidy(none) == tidy(plain(rows, 1000)) and {(r.part, r.value) for r in none} == {("pair", 0)}


def test_awkward_and_empty(awkward, nothing):
    rows = [(t, "en", "s") for _, t in AWKWARD]
    assert tidy(audit_sources(awkward, min_docs=2).collect()) == tidy(plain(rows, 2)) == []
    assert tidy(audit_sources(awkward, source_col="row", lang_col="doc_id", min_docs=1).collect()) == tidy(plain([(t, "" if i is None else str(i), "x") for i, t in AWKWARD], 1))
    assert audit_sources(nothing).count() == 0
