"""Work queues over entities: multi-key top k, cross-tabs, packing, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def next_items(df: DataFrame, where: list[Column], order: list[Column], limit: int = 0) -> DataFrame:
    """Rows that meet all conditions (null meets none), in order, the first ``limit`` (0: all)."""
    for c in where:
        df = df.filter(F.coalesce(c, F.lit(False)))
    df = df.orderBy(*order) if order else df
    return df.limit(limit) if limit else df


def counts_by(df: DataFrame, keys: dict[str, Column], out: str = "n_rows") -> DataFrame:
    """Rows by key expressions."""
    return df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count(F.lit(1)).alias(out))


def progress(df: DataFrame, by: Column, name: str, status: Column, settled: tuple[str, ...], moving: tuple[str, ...]) -> DataFrame:
    """Totals by key: all, settled, in flight and to do."""
    s = F.count_if(status.isin(*settled))
    m = F.count_if(status.isin(*moving))
    n = F.count(F.lit(1))
    return df.groupBy(by.alias(name)).agg(n.alias("n_total"), s.alias("n_settled"), m.alias("n_moving"), (n - s - m).alias("n_todo"))


def pack(df: DataFrame, by: list[str], order: list[str], packable: Column, skipped: Column, size: int) -> DataFrame:
    """Batches of neighbouring packable rows, at most ``size`` each; others stand alone and end a batch.

    Skipped rows are left out and end none. Gives ``batch`` (from 1 within
    ``by``): barriers are counted, rows between two barriers are numbered and
    cut by size.
    """
    w = W.partitionBy(*by).orderBy(*order)
    rows = df.filter(~F.coalesce(skipped, F.lit(False))).withColumn("__p", F.coalesce(packable, F.lit(False)))
    island = rows.withColumn("__b", F.sum((~F.col("__p")).cast("int")).over(w))
    w2 = W.partitionBy(*by, "__b", "__p").orderBy(*order)
    cut = island.withColumn("__k", F.when(F.col("__p"), F.floor((F.row_number().over(w2) - 1) / size)).otherwise(F.lit(-1)))
    starts = F.coalesce((F.lag("__b").over(w) != F.col("__b")) | (F.lag("__k").over(w) != F.col("__k")), F.lit(True))
    return cut.withColumn("__s", starts.cast("int")).withColumn("batch", F.sum("__s").over(w)).drop("__p", "__b", "__k", "__s")


def best_of(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, for groups of a bounded size; the rank limit is applied before the shuffle."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def named_like(df: DataFrame, name: str, part: str) -> DataFrame:
    """Rows whose name holds a text, in any case; ``%`` and ``_`` in it are plain characters."""
    return df.filter(F.contains(F.lower(F.col(name)), F.lit(part.lower())))


def missing_from(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table doesn't hold."""
    return df.join(other.select(key).distinct(), key, "left_anti")
