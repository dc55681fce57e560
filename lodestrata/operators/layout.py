"""Ordered intervals in structures: overlap, gaps, citations, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNSIZED = 4


def overlaps(fields: DataFrame, owner: str, offset: str, size: str) -> DataFrame:
    """Fields that begin before the one before them ends; a null or zero size counts as 4."""
    w = W.partitionBy(owner).orderBy(offset, *[c for c in fields.columns if c not in (owner, offset)])
    held = F.coalesce(F.nullif(F.col(size), F.lit(0)), F.lit(UNSIZED))
    end = F.lag(F.col(offset) + held).over(w)
    return fields.withColumn("previous_end", end).filter(F.col(offset) < F.col("previous_end"))


def gaps(fields: DataFrame, owner: str, offset: str, size: str) -> DataFrame:
    """Bytes free before the next field: owner, offset, end, gap; no row for the last field or where none are free."""
    w = W.partitionBy(owner).orderBy(offset, *[c for c in fields.columns if c not in (owner, offset)])
    end = F.col(offset) + F.coalesce(F.nullif(F.col(size), F.lit(0)), F.lit(UNSIZED))
    following = F.lead(offset).over(w)
    return fields.select(owner, F.col(offset).alias("offset"), end.alias("end"), (following - end).alias("gap")).filter("gap > 0")


def unevidenced(fields: DataFrame, evidence: DataFrame, field: str) -> DataFrame:
    """Fields that no evidence names."""
    return fields.join(evidence.select(field).filter(F.col(field).isNotNull()).distinct(), field, "left_anti")


def cited(fields: DataFrame, evidence: DataFrame, field: str, owner: str, by: str) -> DataFrame:
    """Distinct (owner, by): which functions are cited for a structure."""
    return evidence.select(field, by).filter(F.col(by).isNotNull()).join(fields.select(field, owner), field).select(owner, by).distinct()


def place_fields(rows: DataFrame, owner: str, order: str, offset: str, size: str, emit: str) -> DataFrame:
    """Offsets for fields in order: a given one resets the cursor, others follow on; padding takes space only."""
    items = rows.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(offset).cast("bigint").alias("at"), F.col(size).cast("bigint").alias("size"), F.col(emit).alias("emit")))).alias("__i"))
    start = F.struct(F.lit(0).cast("bigint").alias("cursor"), F.array().cast("array<struct<o:int,at:bigint,size:bigint,emit:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = F.coalesce(x["at"], acc["cursor"])
        row = F.struct(x["o"].cast("int").alias("o"), at.alias("at"), x["size"].alias("size"), x["emit"].alias("emit"))
        return F.struct((at + x["size"]).alias("cursor"), F.concat(acc["out"], F.array(row)).alias("out"))

    placed = items.withColumn("__p", F.aggregate("__i", start, step)["out"])
    ends = F.array_max(F.transform("__p", lambda x: x["at"] + x["size"]))
    return placed.select(owner, ends.alias("total"), F.explode("__p").alias("p")).filter("p.emit").select(owner, F.col("p.o").alias(order), F.col("p.at").alias("offset"), F.col("p.size").alias("size"), "total")


def render_header(fields: DataFrame, owner: str, offset: str, size: str, ctype: str, name: str) -> DataFrame:
    """(owner, header): each structure as text with padding and an assertion for each offset."""
    w = W.partitionBy(owner).orderBy(offset)
    held = F.coalesce(F.nullif(F.col(size), F.lit(0)), F.lit(UNSIZED))
    before = F.coalesce(F.lag(F.col(offset) + held).over(w), F.lit(0))
    pad = F.col(offset) - before
    label = F.coalesce(F.col(name), F.format_string("unk_%X", F.col(offset)))
    text = F.concat(
        F.when(pad > 0, F.format_string("  uint8_t _pad%X[%d];\n", before.cast("bigint"), pad.cast("bigint"))).otherwise(""),
        F.format_string("  %s %s; // +0x%X\n", F.col(ctype), label, F.col(offset).cast("bigint")),
    )
    check = F.format_string("static_assert(offsetof(S%d, %s) == 0x%X);\n", F.col(owner).cast("bigint"), label, F.col(offset).cast("bigint"))
    rows = fields.select(owner, F.col(offset).alias("__o"), text.alias("__t"), check.alias("__c"))
    whole = rows.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("__o", "__t", "__c"))).alias("r"))
    join = lambda part: F.array_join(F.transform("r", lambda x: x[part]), "")
    return whole.select(owner, F.concat(F.format_string("struct S%d {\n", F.col(owner).cast("bigint")), join("__t"), F.lit("};\n"), join("__c")).alias("header"))
