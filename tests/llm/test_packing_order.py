"""Packing in the order of the mixing stage's shuffle."""

import corpus_pipeline
from textloom.llm import mixing, packing


def test_batches_follow_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_ROWS", 200)
    rows = [(i, "a b c d", "en", "hot", 7) for i in range(900)] + [(1000 + i, "a b c d", "en", "small", 7) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixing.mix(docs)
    shuffled = [r.doc_id for r in mixed.orderBy("__order", "doc_id", "__copy").collect()]
    packed = corpus_pipeline.pack_batches(spark, mixed.drop("__copy", "__order"), "").orderBy("batch", "position").collect()
    assert [r.doc_id for r in packed] == shuffled


def test_copies_of_a_document_are_spread(spark):
    rows = [(i, "w " * 1000) for i in range(200)] + [(1000, "w " * 1000)] * 64 + [(None, "w " * 1000)] * 3
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    batches = {}
    for r in got:
        batches.setdefault(r.batch, []).append(r.doc_id)
    # 267 documents in batches of 16: 64 neighbours would fill four or five.
    assert sum(1000 in b for b in batches.values()) > 10 and max(b.count(1000) for b in batches.values()) < 12
