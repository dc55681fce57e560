"""Usage ledgers: totals, weighted cost, running spend, streaks, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def totals(df: DataFrame, measures: list[str], by: list[str] = ()) -> DataFrame:
    """Calls and sums of measures (0 for none), overall or by columns."""
    g = df.groupBy(*by)
    return g.agg(F.count(F.lit(1)).alias("n_calls"), *[F.coalesce(F.sum(m), F.lit(0)).alias(f"sum_{m}") for m in measures])


def weighted(weights: dict[str, str]) -> Column:
    """Sum of columns times exact decimal weights, rounded half to even; nulls count as 0."""
    total = F.lit(0).cast("decimal(38,4)")
    for name, w in weights.items():
        total = (total + F.coalesce(F.col(name).cast("decimal(28,0)"), F.lit(0)) * F.lit(w).cast("decimal(8,4)")).cast("decimal(38,4)")
    return F.bround(total, 0).cast("bigint")


def hit_share(hit: str, miss: str, digits: int = 3) -> Column:
    """hit / (hit + miss), rounded, 0 where both are 0."""
    h, m = F.coalesce(F.col(hit), F.lit(0)), F.coalesce(F.col(miss), F.lit(0))
    return F.coalesce(F.round(F.try_divide(h.cast("double"), (h + m).cast("double")), digits), F.lit(0.0))


def streaks(df: DataFrame, by: list[str], order: list[str], failed: Column, least: int) -> DataFrame:
    """Stretches of at least ``least`` failures in a row: by, first and last of the first order column, length.

    Rows are numbered within ``by``; a stretch is a run of failures with the
    same difference between that number and the number among failures.
    """
    w = W.partitionBy(*by).orderBy(*order)
    f = df.withColumn("__f", failed).withColumn("__n", F.row_number().over(w)).filter("__f")
    f = f.withColumn("__g", F.col("__n") - F.row_number().over(w))
    return f.groupBy(*by, "__g").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("length")).filter(F.col("length") >= least).drop("__g")


def smoothed(df: DataFrame, by: list[str], order: str, observed: str, start: float, keep: float = 0.7, low: float = 1.0, high: float = 8.0) -> DataFrame:
    """(by, value): an exponential mean folded in order; a step out of (low, high) is not taken; rounded to 4 digits each step.

    One array a key; null observations are skipped.
    """
    items = df.filter(F.col(observed).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(observed).cast("double").alias("x")))).alias("__i"))

    def step(acc: Column, e: Column) -> Column:
        blend = F.round(acc * F.lit(keep) + e["x"] * F.lit(1 - keep), 4)
        return F.when((blend > low) & (blend < high), blend).otherwise(acc)

    return items.select(*by, F.aggregate("__i", F.lit(start), step).alias("value"))
