"""Token accounting: percentiles, calibration and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def nearest_rank(column: str, share: float) -> Column:
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})")


def percentiles(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[nearest_rank(column, s).alias(n) for n, s in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95))], F.max(column).alias("most"), F.count("*").alias("n"))


def kth_largest(rows: DataFrame, column: str, by: list[str], k: int) -> DataFrame:
    """Per group the k-th largest value and how many reach it."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(column)))
    at = rows.withColumn("_rank", rank).groupBy(*by).agg(F.max(F.when(F.col("_rank") == k, F.col(column))).alias("threshold"))
    return rows.join(at, by).groupBy(*by, "threshold").agg(F.count_if(F.col(column) >= F.col("threshold")).alias("fires"))


def context_tier(tokens: Column, low: int = 100_000, high: int = 200_000) -> Column:
    return F.when(tokens <= low, "low").when(tokens <= high, "medium").otherwise("high")


def calibration(rows: DataFrame, estimate: str, usage: str, threshold: int, by: list[str]) -> DataFrame:
    """Per group: upper median of estimate / usage, fires by either measure, late and early ones, and churn."""
    est, use = F.col(estimate) >= threshold, F.col(usage) >= threshold
    # A little over a half takes the upper one of two middle values.
    middle = F.expr(f"percentile_disc(0.500000001) WITHIN GROUP (ORDER BY {estimate} / {usage})")
    out = rows.groupBy(*by).agg(middle.alias("median_ratio"), F.count_if(est).alias("est_fires"), F.count_if(use).alias("usage_fires"), F.count_if(use & ~est).alias("late"), F.count_if(est & ~use).alias("early"))
    return out.select(*by, "median_ratio", "est_fires", "usage_fires", "late", "early", F.when(F.col("est_fires") > 0, F.col("usage_fires") / F.col("est_fires")).alias("churn"))
