"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the epoch; its mean repetition rate is that share over its own size. A document's
number of copies inverts the Poisson distribution of that mean at a uniform number hashed from the seed and the
document, so that it is the same in every run and needs no state. Copies are spread over the output by a hash order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import cut, shuffle_width

#: Means above this are drawn as a sum of draws of an equal part each.
MOST_MEAN = 32.0
#: Terms of the distribution that are added up; beyond them lies less than a double tells from 1.
TERMS = 128
_SCALE = float(1 << 52)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts, joined by '|'."""
    head = F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary")), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / _SCALE


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.5, epoch: float = 1.0) -> DataFrame:
    """(source, n, rate): each source's rows and mean repetition rate, null being a source of its own.

    The target share of a source is its weight over the sum of weights. Sources without a stated weight get none; with
    no weights stated, every source weighs its number of rows to the power alpha (1: as they come, 0: all alike). The
    epoch has epoch times as many rows as docs.
    """
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        told = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        sizes = sizes.join(told, "source", "left").fillna(0.0, ["weight"])
    whole = sizes.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))  # one row
    share = F.try_divide(F.col("weight"), F.col("all_weight"))
    return sizes.join(F.broadcast(whole), F.lit(True)).select("source", "n", F.coalesce(share * F.col("all_n") * F.lit(float(epoch)) / F.col("n"), F.lit(0.0)).alias("rate"))


def order(doc_id: Column, copy: Column, seed: int = 11) -> Column:
    """The place of a copy in the global shuffle, in (0, 1)."""
    return uniform(F.lit(seed), doc_id, copy, F.lit("order"))


#: Sources up to this number are broadcast, at some 1.1 kB each; beyond it they meet the documents in a salted join.
MOST_BROADCAST, SALTS = 10_000, 32


def _with_means(docs: DataFrame, mean: DataFrame, id_col: str, source_col: str, most_broadcast: int) -> DataFrame:
    """Every row of docs with the __parts and __sums of its source; no source, however large, is one task's."""
    same = F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col("__source"))
    if mean.count() <= most_broadcast:
        return docs.join(F.broadcast(mean), same)
    salted = mean.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("__own", F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("__own") == F.col("__salt")))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.5, epoch: float = 1.0, seed: int = 11, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """docs with every row replaced by its copies, in shuffled order, with columns __copy (from 0) and __order added.

    All columns are kept. Rows that repeat an id are drawn alike; a null id is an id. A source of weight zero is left
    out, as its target says. An empty table gives an empty result. Columns of docs named as the added ones are an error.
    __order is even over (0, 1), so copies are dealt to their place in the order without a sample of them: rows are
    shuffled once.
    """
    clash = {"__copy", "__order", "__source", "__parts", "__sums", "__draws", "__n", "__own", "__salt"} & set(docs.columns)
    if clash:
        raise ValueError(f"docs already has {sorted(clash)}")
    mean = rates(docs, source_col, weights, alpha, epoch).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_MEAN)).cast("int"))
    mean = mean.withColumn("mean", F.col("rate") / F.col("parts"))
    # Running sums of the distribution: term k is the one before times mean / k.
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("sums"))
    grow = lambda acc, k: F.struct((acc["p"] * F.col("mean") / k).alias("p"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + acc["p"] * F.col("mean") / k)).alias("sums"))
    mean = mean.withColumn("__sums", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, grow, lambda acc: acc["sums"]))
    mean = cut(mean.select(F.col("source").alias("__source"), F.col("parts").alias("__parts"), "__sums"))
    met = _with_means(docs, mean, id_col, source_col, most_broadcast)
    # The draws are a column of their own, so that each is hashed once and not again for every term.
    met = met.withColumn("__draws", F.transform(F.sequence(F.lit(0), F.col("__parts") - 1), lambda part: uniform(F.lit(seed), F.col(f"`{id_col}`"), part)))
    copies = F.aggregate("__draws", F.lit(0), lambda a, u: a + F.size(F.filter("__sums", lambda c: c < u)))
    out = met.withColumn("__n", copies).filter("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    out = out.withColumn("__order", order(F.col(f"`{id_col}`"), F.col("__copy"), seed)).select(*[docs[f"`{c}`"] for c in docs.columns], "__copy", "__order")
    width = shuffle_width(docs.sparkSession)
    return out.repartitionById(width, F.floor(F.col("__order") * width).cast("int")).sortWithinPartitions("__order", f"`{id_col}`", "__copy")


#: op6's rows in DuckDB's SQL, with the defaults of mix().
ORACLE_SQL = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS weight FROM documents GROUP BY source),
whole AS (SELECT sum(n)::BIGINT AS all_n, sum(weight) AS all_weight FROM sizes),
rates AS (SELECT source, weight / all_weight * all_n * 1.0::DOUBLE / n AS rate FROM sizes, whole),
means AS (SELECT source, greatest(1, ceil(rate / {MOST_MEAN}::DOUBLE))::INTEGER AS parts, rate / greatest(1, ceil(rate / {MOST_MEAN}::DOUBLE)) AS mean FROM rates),
terms AS (
  SELECT source, parts, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM means
  UNION ALL SELECT source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM terms WHERE k < {TERMS}
),
sums AS (SELECT source, parts, list(c ORDER BY k) AS cs FROM terms GROUP BY source, parts),
draws AS (
  SELECT d.doc_id, d.source, d.text, s.cs, (('0x' || substr(md5('11|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || part::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / {_SCALE}::DOUBLE AS u, d.row
  FROM (SELECT doc_id, source, text, row_number() OVER () AS row FROM documents) d JOIN sums s ON d.source IS NOT DISTINCT FROM s.source, unnest(range(s.parts)) AS t(part)
),
counts AS (SELECT row, doc_id, source, text, sum(len(list_filter(cs, lambda c: c < u)))::BIGINT AS n FROM draws GROUP BY row, doc_id, source, text)
SELECT doc_id, source, md5(text) AS text_md5, i::INTEGER AS copy, (('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, 'null') || '|' || i::VARCHAR || '|order'), 1, 13))::BIGINT::DOUBLE + 0.5) / {_SCALE}::DOUBLE AS shuffle_key
FROM counts, unnest(range(n)) AS t(i)
"""
