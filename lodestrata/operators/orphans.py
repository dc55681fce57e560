"""References to records that do not exist.

References are grouped by the null mask of their key columns; each mask is
anti-joined on the columns that are not null, as the declared match rule asks:

* ``simple``: a reference with any null key column refers to nothing and is
  never an orphan;
* ``partial``: the non-null columns must agree with some record;
* ``full``: a reference with some but not all key columns null is an orphan.

A reference whose key columns are all null is never an orphan. Records may be
live for a span of time; then a reference is an orphan unless a record of its
key was live at the reference's own time.

Hot keys of the references are salted (see ``skew``); no row is dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.skew import equal, hot_keys, salted

MATCHES = ("simple", "partial", "full")


def null_mask(cols: list[str]) -> Column:
    """Bit i is set where the i-th key column is null."""
    return reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(cols)])


def live_at(at: Column, since: Column, until: Column) -> Column:
    """Live from ``since`` on and before ``until``; a null bound or time excludes nothing."""
    return F.coalesce(since <= at, F.lit(True)) & F.coalesce(at < until, F.lit(True))


def orphan_references(
    refs: DataFrame,
    records: DataFrame,
    keys: list[str],
    record_keys: list[str] | None = None,
    match: str = "simple",
    at: str | None = None,
    since: str | None = None,
    until: str | None = None,
) -> DataFrame:
    """The rows of ``refs`` whose key names no (live) row of ``records``.

    ``keys`` of ``refs`` answer to ``record_keys`` of ``records`` (same names
    if not given). With ``at`` (column of ``refs``), ``since`` and ``until``
    (columns of ``records``) only records live at that time count. Columns of
    the same name on both sides don't clash: only keys and bounds of
    ``records`` are used. Repeated references come out as often as they are
    there. No records: every checkable reference is an orphan.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    names = record_keys or keys
    slim = [f"__k{i}" for i in range(len(keys))]
    timed = at is not None
    bounds = [F.col(since).alias("__since"), F.col(until).alias("__until")] if timed else []
    right_all = records.select(*[F.col(c).alias(s) for c, s in zip(names, slim)], *bounds)
    left_all = refs.select("*", *[F.col(c).alias(s) for c, s in zip(keys, slim)], null_mask(keys).alias("__mask"))
    parts = []
    for mask in range((1 << len(keys)) - 1):
        own = left_all.filter(F.col("__mask") == mask)
        if mask and match == "simple":
            continue
        if mask and match == "full":
            parts.append(own.select(*refs.columns))
            continue
        on = [s for i, s in enumerate(slim) if not mask >> i & 1]
        right = right_all.select(*on, *(["__since", "__until"] if timed else [])).filter(reduce(lambda a, b: a & b, [F.col(s).isNotNull() for s in on]))
        left, right = salted(own, right if timed else right.distinct(), on, hot_keys(own.select(*on), on))
        left, right = left.alias("l"), right.alias("r")
        cond = equal("l", "r", on)
        if timed:
            cond = cond & live_at(F.col(f"l.{at}"), F.col("r.__since"), F.col("r.__until"))
        parts.append(left.join(right, cond, "left_anti").select(*[F.col(f"l.{c}") for c in refs.columns]))
    return reduce(DataFrame.unionAll, parts) if parts else refs.limit(0)


def orphan_reason(orphans: DataFrame, records: DataFrame, key: str, at: str, record_key: str, since: str, until: str) -> DataFrame:
    """Append why: ``missing`` (no record), ``early`` (record arrives later) or ``deleted``.

    ``records`` holds at most one row for a key.
    """
    r = records.select(F.col(record_key).alias("__key"), F.col(since).alias("__since"), F.col(until).alias("__until"))
    why = F.when(F.col("__key").isNull(), "missing").when(F.col("__since") > F.col(at), "early").otherwise("deleted")
    return orphans.join(r, F.col(key) == F.col("__key"), "left").withColumn("reason", why).drop("__key", "__since", "__until")
