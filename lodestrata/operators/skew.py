"""Joins that survive hot keys.

A key is hot when it holds more than a fair share, 1/P, of the rows (P shuffle
partitions), so there are fewer than P hot keys whatever the input: that list
alone is broadcast. A hot key's rows are salted as many ways as it holds fair
shares, and the other side's rows of that key are repeated so often: all
repeats together are fewer than 2 P rows for each row a key has there. A null
key joins nothing and is spread like a hot one. Nothing is dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.shared import default_partitions

SALT = "__salt"


def hot_keys(df: DataFrame, keys: list[str], total: int | None = None) -> list[tuple]:
    """(key columns, ways) of the keys with more than a fair share of all rows; ``total`` is their number where it is known."""
    parts = default_partitions(df.sparkSession)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    whole = F.lit(total) if total is not None else df.count()
    ways = F.ceil(F.col("__n") * parts / F.greatest(F.lit(whole), F.lit(1))).cast("int")
    return [tuple(r) for r in counts.select(*keys, ways.alias("__ways")).filter("__ways > 1").collect()]


def salted(left: DataFrame, right: DataFrame, keys: list[str], hot: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt that only differs from 0 for the hot keys of ``left`` and for null keys."""
    if not hot:
        return left.withColumn(SALT, F.lit(0)), right.withColumn(SALT, F.lit(0))
    from pyspark.sql.types import IntegerType, StructField, StructType

    spark = left.sparkSession
    schema = StructType([*left.select(*keys).schema.fields, StructField("__ways", IntegerType())])
    known = [r for r in hot if None not in r[:-1]]
    empty = any(None in r[:-1] for r in hot)
    listed = F.broadcast(spark.createDataFrame(known, StructType([StructField(f.name, f.dataType, True) for f in schema.fields])))
    others = [c for c, t in left.dtypes if c not in keys and not t.startswith(("map", "variant"))]
    spread = F.xxhash64(*others) if others else F.monotonically_increasing_id()
    void = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
    ways = F.when(void, F.lit(default_partitions(spark) if empty else 1)).otherwise(F.coalesce("__ways", F.lit(1)))
    a = left.join(listed, keys, "left").withColumn(SALT, F.pmod(spread, ways).cast("int")).drop("__ways")
    b = right.join(listed, keys, "left").withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce("__ways", F.lit(1)) - 1))).drop("__ways")
    return a, b


def equal(left: str, right: str, keys: list[str]) -> Column:
    """The condition that two aliased sides agree in keys and salt."""
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{k}") == F.col(f"{right}.{k}") for k in [*keys, SALT]])


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on ``keys`` (inner, left, left_semi or left_anti), hot keys of ``left`` salted."""
    a, b = salted(left, right, keys, hot_keys(left, keys))
    return a.join(b, [*keys, SALT], how).drop(SALT)


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, bucket: Column, out: str) -> DataFrame:
    """Append the sum of ``value`` over earlier rows of the group, without holding a group in one task.

    ``bucket`` numbers stretches of the order: a row of a lower bucket comes
    before one of a higher bucket. Totals of buckets are summed first, then
    rows within their bucket; no window holds more than one bucket's rows or
    one group's buckets.
    """
    from pyspark.sql import Window as W

    rows = df.withColumn("__bucket", bucket)
    totals = rows.groupBy(*group, "__bucket").agg(F.sum(value).alias("__sum"))
    ahead = W.partitionBy(*group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(*group, "__bucket", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__base"))
    inside = W.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumn("__local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(base, [*group, "__bucket"]).withColumn(out, F.col("__base") + F.col("__local")).drop("__bucket", "__base", "__local")
