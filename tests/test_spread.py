"""Narrow inputs are dealt out over all cores; large ones and streams are left alone."""

from textloom.functions import spread
from textloom.functions.spread import spread as deal


def test_small_inputs_only(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id", "repeat('w ', 50) AS text").coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    cores = spark.sparkContext.defaultParallelism
    sizes = [len(p) for p in deal(one).rdd.glom().collect()]
    assert len(sizes) == cores and min(sizes) > 0 and sum(sizes) == 1000
    stream = spark.readStream.schema(one.schema).parquet(f"{tmp_path}/one")
    assert deal(stream) is stream
    monkeypatch.setattr(spread, "SMALL", 10)
    assert deal(one) is one
