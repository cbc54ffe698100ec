"""Mixing sources to target weights by capped water-filling.

Every source has a weight and may be used `max_epochs` times at most. The wanted total is shared in proportion to the
weights; sources above their cap are clamped to it and what they leave is shared again among the others, until no source
is above. A source's target is then met by whole repetitions of all its documents and one seeded fractional repetition:
documents fall into 65,536 hash buckets, and buckets are taken in order up to the one that brings the sum nearest to the
target. The choice hangs on the seed, doc_id and size alone, so reruns agree. DataFrame functions only; per source at
most 65,536 partial sums are ever sorted, whatever its number of documents, and the water level is found from a few
global sums.

No row is taken more than max_epochs times (rounded up).

Defined cases: a null source is a source of its own, last in order; null and empty texts have size 0; repeated rows share
one decision; rows without doc_id are told apart by their size only; an empty table gives an empty table; extra columns of
any name are kept by `mix` and ignored by `mix_plan`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, cut, spread

WEIGHTS = (3.0, 1.0, 2.0)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket(doc_id: Column, size: Column, seed: str) -> Column:
    """0 to 65,535."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), size.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("int")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds place, from 0, in the order of source, nulls last, without gathering all sources in one task."""
    spread = cut(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()))
    before = spread.groupBy("part").count().withColumn("before", F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    inside = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    joined = spread.withColumn("inside", inside).join(before.select("part", "before"), "part")
    return joined.withColumn("place", (F.coalesce("before", F.lit(0)) + F.col("inside") - 1).cast("long")).drop("part", "before", "inside")


def targets(sizes: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """From (source, source_size): adds target. Weights repeat over the sources in order."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    caps = cut(_ranked(sizes).withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs))
    whole = caps.agg(F.sum("source_size"), F.sum("weight")).first()
    total, level, clamped = share * (whole[0] or 0), 0.0, -1
    if whole[1]:
        level = total / whole[1]
    while True:  # the level only rises, so every round clamps further sources or is the last
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        n, held, free = caps.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == clamped or not free:
            break
        clamped, level = n, (total - (held or 0.0)) / free
    return caps.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight"))).drop("place", "weight", "cap")


def _thresholds(slim: DataFrame, share: float, max_epochs: float, weights: Sequence[float]) -> DataFrame:
    """Per source: source_size, target, whole repetitions, and the last bucket of the fractional one."""
    sums = cut(slim.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    goals = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), share, max_epochs, weights)
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goals = cut(goals.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    upto = F.sum("size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    ladder = sums.withColumn("middle", upto - F.col("size") / 2)
    last = (
        ladder.alias("a")
        .join(goals.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
        .groupBy(F.col("b.source").alias("source"))
        .agg(F.max(F.when(F.col("middle") <= F.col("rest"), F.col("bucket"))).alias("last"))
    )
    both = goals.alias("a").join(last.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    return cut(both.select("a.*", F.coalesce("b.last", F.lit(-1)).alias("last")))


def _copies(rows: DataFrame, limits: DataFrame, max_epochs: float) -> DataFrame:
    """rows have source and bucket; adds source_size, target and copies."""
    both = rows.alias("a").join(limits.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    copies = F.least(F.col("b.whole") + F.when(F.col("a.bucket") <= F.col("b.last"), 1).otherwise(0), F.lit(math.ceil(max_epochs)))
    return both.select("a.*", "b.source_size", "b.target", copies.cast("long").alias("copies"))


def _slim(df: DataFrame, doc_id: str, source: str, text: str, seed: str) -> DataFrame:
    texts = spread(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")))
    rows = texts.select("doc_id", "source", words(F.col("text")).alias("size"))
    return rows.withColumn("bucket", bucket(F.col("doc_id"), F.col("size"), seed))


def mix_plan(df: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: Sequence[float] = WEIGHTS, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per row of df: doc_id, source, size, source_size, target, copies, taken."""
    slim = cut(_slim(df, doc_id, source, text, seed))
    out = _copies(slim, _thresholds(slim, share, max_epochs, weights), max_epochs)
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("bucket")


def mix(df: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: Sequence[float] = WEIGHTS, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of df, each as often as the mix takes it, with all their columns."""
    limits = _thresholds(cut(_slim(df, doc_id, source, text, seed)), share, max_epochs, weights)
    size = words(F.col(text))
    rows = spread(df).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(source).alias("source"), bucket(F.col(doc_id), size, seed).alias("bucket"))
    again = F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))
    return _copies(rows, limits, max_epochs).select("row", again).select("row.*")
