"""The pipeline's stages one by one, on nulls, empties, repeats and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tests.llm import brute
from tests.llm.test_llm import DOCS, EXTRA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the river and the hill are old and the road to the town is long for a man with a cart as it was"


@pytest.fixture(scope="module")
def odd(spark):
    long_text = "\n".join(f"{PROSE} number {k} of the {k * 7} days" for k in range(3000))
    rows = [(i, t, "en", f"s{i % 3}", None) for i, t in DOCS[:30]]
    rows += [(100, PROSE, "en", "a", 1), (100, PROSE, "en", "a", 1), (101, PROSE, None, None, None), (None, PROSE + " again", None, "a", 2), (None, None, None, None, None), (102, "", "en", "a", 0), (103, long_text, "en", "b", len(long_text))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, odd, name, stage):
    last = name == corpus_pipeline.STAGES[-1][0]
    columns = corpus_pipeline.COLUMNS + ["copy"] * last
    out = stage(spark, odd, DATA)
    assert out.columns == columns
    crowded = odd.withColumns({c: F.lit("7") for c in EXTRA})
    assert sorted(map(str, stage(spark, crowded, DATA).collect())) == sorted(map(str, out.collect()))
    none = stage(spark, odd.limit(0), DATA)
    assert none.columns == columns and none.count() == 0


def test_decisions(spark, odd):
    by = dict(corpus_pipeline.STAGES)
    kept = by["quality rules"](spark, odd, DATA)
    assert kept.filter("doc_id = 100").count() == 2 and kept.filter("text = '' or text is null").count() == 0
    lines = by["line dedup"](spark, odd, DATA)
    assert lines.count() == odd.count() and lines.filter("n_chars <> length(text)").count() == 0
    near = by["n-gram Jaccard join"](spark, odd, DATA)
    ids = {r["doc_id"] for r in near.collect()}
    assert 100 in ids and 101 not in ids and near.filter("doc_id is null").count() == 2
    assert {i for i in ids if i is not None and i < 100} == {c for *_, c in brute.components([(i, t) for i, t in DOCS[:30]])}
