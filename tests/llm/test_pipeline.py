"""The pipeline against its stages' decisions, taken one by one by the operators' scores."""

from test_near_copies import groups_of

import corpus_pipeline
from textloom.llm import mixing, packing, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_against_their_scores(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    assert ids(clean) == ids(toxicity.toxicity(docs, labels).filter("score < 0.5"))
    good = corpus_pipeline.drop_poor(spark, clean, SF)
    assert ids(good) == ids(quality.quality(clean, labels).filter("score >= 0.5"))
    assert 0 < good.count() < clean.count() < docs.count()
    single = corpus_pipeline.drop_near_duplicates(spark, good, SF)
    rows = sorted((r.doc_id, r.text) for r in good.select("doc_id", "text").collect())
    assert ids(single) == sorted(rows[i][0] for i, x in enumerate(groups_of([t for _, t in rows])) if i == x)
    mixed = corpus_pipeline.mix_sources(spark, single, SF)
    assert mixed.columns == docs.columns and ids(mixed) == ids(mixing.mix(single))
    want = sorted(map(tuple, packing.pack(mixed).select("doc_id", "n_tokens", "bucket").collect()))
    assert sorted((r.doc_id, r.n_tokens, r.bucket) for r in corpus_pipeline.run(spark, SF).collect()) == want
