"""Facts with sources and confidence: current rows, best claims, guarded writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """The latest version of each key: ``columns`` of the row with the highest ``version``.

    Rows with a null key are left out; a null version is the oldest. Versions
    of a hot key are combined before the shuffle. Rows that tie on the version
    yield the greatest value tuple, so the result does not depend on order.
    """
    row = F.struct(F.col(version).alias("v"), *[F.col(c) for c in columns])
    latest = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("__row"))
    return latest.select(key, *[F.col(f"__row.{c}").alias(c) for c in columns])


def best_claim(df: DataFrame, key: list[str], value: str, confidence: str, tie: list[str]) -> DataFrame:
    """For each key the claim of highest confidence; ties by ``tie`` ascending, then the value."""
    order = F.struct((-F.coalesce(F.col(confidence), F.lit(0.0))).alias("c"), *[F.col(t) for t in tie], F.col(value).alias("__v"))
    return df.groupBy(*key).agg(F.min(order).alias("__o")).select(*key, F.col("__o.__v").alias(value), (-F.col("__o.c")).alias(confidence))


def unambiguous(df: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys claimed by exactly one owner, with that owner."""
    return df.groupBy(key).agg(F.min(owner).alias(owner), F.max(owner).alias("__hi"), F.count(owner).alias("__n")).filter((F.col("__n") > 0) & (F.col(owner) == F.col("__hi"))).select(key, owner)


def guarded(updates: DataFrame, existing: DataFrame, keys: list[str], status: str, protected: tuple[str, ...]) -> DataFrame:
    """Updates that touch no row whose status is protected."""
    held = existing.filter(F.col(status).isin(*protected)).select(*keys)
    return updates.join(held, keys, "left_anti")


def partial_upsert(existing: DataFrame, updates: DataFrame, keys: list[str], supplied: list[str]) -> DataFrame:
    """Rows of ``existing`` with the supplied columns overwritten, new keys added.

    Only ``supplied`` columns change; a supplied null does overwrite. Columns
    not supplied stay, and are null in new rows. ``updates`` has one row a key.
    """
    u = updates.select(*keys, *[F.col(c).alias(f"__u_{c}") for c in supplied], F.lit(True).alias("__hit"))
    joined = existing.join(u, keys, "full")

    def pick(c: str) -> Column:
        if c in keys:
            return F.col(c)
        return F.when(F.col("__hit"), F.col(f"__u_{c}")).otherwise(F.col(c)).alias(c) if c in supplied else F.col(c)

    return joined.select(*[pick(c) for c in existing.columns])


def last_update(updates: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """One update a key: the last by ``sequence``."""
    rest = [c for c in updates.columns if c not in keys]
    row = F.struct(F.col(sequence).alias("__s"), *[F.col(c).alias(c) for c in rest])
    return updates.groupBy(*keys).agg(F.max(row).alias("__r")).select(*keys, *[F.col(f"__r.{c}") for c in rest])
