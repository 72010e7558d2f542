"""The pipeline's stages on columns with awkward names, nulls, repeats and no rows."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
NAMES = ["_key", "_row", "a b", "size", "rate", "_rate", "copies", "n", "sid", "least", "score", "d.source", "tick`ed"]
FILTERS = [(name, stage) for name, stage in corpus_pipeline.STAGES if name != "packing"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    base = "the quick brown fox jumps over the lazy dog and then it goes home to sleep for a long time"
    texts = [base, base, None, "", "  ", base + " again", "mail me at someone@example.org because I am always there for you", "12 34 !!"]
    out = [(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    return out + [(None, base, None, None, None), (None, None, None, None, None), out[0]]


@pytest.mark.parametrize("name, stage", FILTERS, ids=[n for n, _ in FILTERS])
def test_other_columns(spark, name, stage):
    docs = spark.createDataFrame(rows(), SCHEMA)
    wide = docs
    for k, extra in enumerate(NAMES):
        wide = wide.withColumn(extra, wide["doc_id"] * 0 + k)
    got = stage(spark, wide, SF)
    assert got.columns == [*docs.columns, *NAMES]
    assert sorted(repr(tuple(r[:5])) for r in got.collect()) == sorted(repr(tuple(r)) for r in stage(spark, docs, SF).collect())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_no_rows(spark, name, stage):
    docs = spark.createDataFrame([], SCHEMA)
    got = stage(spark, docs, SF)
    assert got.count() == 0
    assert name == "packing" or got.columns == docs.columns


def test_whole_pipeline_without_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
