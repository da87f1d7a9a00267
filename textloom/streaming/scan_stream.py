"""The scan over a stream of documents. Every operator it uses is a projection of a row, so it holds no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textloom.plans import scan


def scan_stream(docs: DataFrame, **options) -> DataFrame:
    """A streaming DataFrame of documents with the columns of scan.scan()."""
    return scan.scan(docs, **options)


def write_parquet(scanned: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Scan what is there and end; start again to go on from the checkpoint."""
    return scanned.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
