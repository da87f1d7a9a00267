"""Work per row that outweighs its bytes: a narrow input is dealt out before it."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes for each core below which an input is dealt out: a scan splits larger ones well enough by itself.
SMALL = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if the optimizer's estimate of its size is small; a large one, or a stream, as it is.

    Rules over a text cost seconds a megabyte, and a file of one row group is read by one task whatever its splits.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL else df
