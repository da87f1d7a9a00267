"""The registered screening reads the texts, not the ids."""

from test_voice import PARTS

from textloom import catalog
from textloom.plans.samples import TEXTS


def test_status_and_profiles_follow_the_detector(spark, tmp_path):
    machine = next(t for i, t in TEXTS if "delve" in t.lower() or "leverage" in t.lower() or "robust" in t.lower())
    machine = "\n\n".join([machine] * (1 + 120 // len(machine.split())))
    ids = [7, 14, 21, 28, 42, 49]  # multiples of 7, none spoken
    rows = [(i, "\n\n".join([PARTS[k % 4]] * (20 + k)), "src1") for k, i in enumerate(ids)] + [(101 + i, machine, "src1") for i in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    (got,) = catalog.queries()["corpus_status"](spark, str(tmp_path)).collect()
    assert (got.sample_count, got.usable_count, got.flagged_count) == (8, 6, 2) and "2 samples" in got.reasons
    (samples,) = {r.samples for r in catalog.queries()["profile_bands"](spark, str(tmp_path)).collect()}
    assert samples == 6
