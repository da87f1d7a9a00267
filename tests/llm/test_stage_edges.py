"""Every stage of the pipeline on odd rows: nulls, empty and very long texts, repeated rows, empty tables, other columns."""

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, `__id` int, label int, y int, score double, row string"
EXTRA = ("h", 1, 2, 3, 0.5, "r")
TEXTS = [None, "", " \n ", "one", "You are fine today and so is everyone here in town.", "w " * 40_000, "You are fine today and so is everyone here in town."]
ROWS = [(i, t, "en", "a" if i % 2 else None, None, *EXTRA) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", None, None, *EXTRA), (None, "no id but some words in it", None, None, None, *EXTRA), (3, "another text under an id that is taken already", "en", "a", 5, *EXTRA)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (4, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(spark, docs, folder)
    rows = out.collect()
    if name == "packing":
        assert len(rows) == len(ROWS) and {"doc_id", "batch", "position"} <= set(out.columns)
    else:
        assert out.columns == docs.columns
        given = {tuple(r) for r in docs.collect()}
        assert {tuple(r) for r in rows} <= given
    if name == "near_duplicates":
        kept = sorted(((r.doc_id, (r.text or "").strip()[:8]) for r in rows), key=str)
        assert kept == sorted([(0, ""), (3, "one"), (3, "another "), (4, "You are "), (5, "w w w w "), (None, "no id bu")], key=str)
    assert stage(spark, docs.limit(0), folder).collect() == []


def test_whole_pipeline(spark, folder):
    assert all(r.batch >= 0 for r in corpus_pipeline.run(spark, folder).collect())
