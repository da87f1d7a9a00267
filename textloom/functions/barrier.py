"""A projection that filters above it can't be pushed through.

Catalyst pushes a predicate through projections by writing out their expressions in it. Over several stages of text
rules that repeats them without end; a one-row generator keeps the predicate where it is. The same goes for the
predicate that Catalyst infers below an explode, so computed arrays are settled before they are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """The columns keep of df, and the made ones."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in made.items()]))))
