"""Near-duplicate families: opcode shingles, MinHash, banded LSH, components.

The hash of a shingle comes in two modes: ``portable`` (the first 64 bits of
its MD5, unsigned, permuted modulo 2^64 in exact decimals, the same in any
engine) and ``fast`` (Spark's own 64-bit hash, seeded per row). Sequences with
equal shingle sets share one signature, so copies are hashed and banded once
and join their family as one class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import let
from lodestrata.operators.graph import components, number_in_order
from lodestrata.operators.skew import skew_join
from lodestrata.shared import store

HASHES, BANDS = 32, 8
MODULUS = "18446744073709551616"
STEP = "11400714819323198485"


def opcodes(body: Column) -> Column:
    """Mnemonics of the comment lines of a listing, in order."""
    return F.regexp_extract_all(body, F.lit(r"(?md)^[ \t]*// ?([a-z][a-z0-9_.]*)"), F.lit(1))


def shingle_set(items: Column, size: int = 3) -> Column:
    """Distinct windows of ``size`` items; a shorter sequence is one shingle, an empty one has none."""
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(items) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(items, i, F.lit(size)), " "))
    return F.when(F.size(items) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(windows))


def base_hash(shingle: Column) -> Column:
    """The first 64 bits of the MD5 as an unsigned decimal."""
    return F.conv(F.substring(F.md5(shingle.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def minhash(shingles: Column, hashes: int = HASHES, mode: str = "fast") -> Column:
    """The least of each of ``hashes`` permutations; zeros for no shingles."""
    rows = F.sequence(F.lit(0), F.lit(hashes - 1))
    if mode == "fast":
        return let(shingles, lambda all_: F.transform(rows, lambda i: F.coalesce(F.array_min(F.transform(all_, lambda s: F.xxhash64(s, i))), F.lit(0).cast("bigint"))))
    wide = "decimal(38,0)"

    def row(bases: Column, i: Column) -> Column:
        odd, shift = (i * 2 + 1).cast("decimal(4,0)"), i.cast("decimal(4,0)") * F.lit(STEP).cast("decimal(20,0)")
        moved = F.transform(bases, lambda h: F.pmod((h * odd).cast(wide) + shift.cast(wide), F.lit(MODULUS).cast(wide)).cast("decimal(20,0)"))
        return F.coalesce(F.array_min(moved), F.lit(0).cast("decimal(20,0)"))

    return let(F.transform(shingles, base_hash), lambda bases: F.transform(rows, lambda i: row(bases, i)))


def buckets(signature: Column, hashes: int = HASHES, bands: int = BANDS) -> Column:
    """The bucket key of each band: its number and its rows."""
    rows = hashes // bands
    return let(signature.cast("array<string>"), lambda sig: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.concat_ws(":", b.cast("string"), F.array_join(F.slice(sig, b * rows + 1, F.lit(rows)), ","))))


def jaccard_estimate(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def families(df: DataFrame, id: str, items: str, least: int = 6, mode: str = "fast", hashes: int = HASHES, bands: int = BANDS) -> DataFrame:
    """(id, root, family_id, size): rows that share a bucket, directly or through others.

    Rows of fewer than ``least`` items have no family. A row alone is a family
    of one. Families are numbered from 1 by their least id. Links run from the
    least id of a bucket to each of the others, so they grow with the rows.
    """
    rows = df.filter(F.size(items) >= least).select(F.col(id).alias("node"), F.col(items).alias("__s")).dropDuplicates(["node"])
    shape = rows.withColumn("shape", F.sha2(F.array_join(F.array_sort(shingle_set(F.col("__s"))), "\n"), 256))
    shaped, _ = store(shape, "shapes")
    heads = shaped.groupBy("shape").agg(F.min("node").alias("head"), F.min_by("__s", "node").alias("__s"))
    signed = heads.select("head", F.explode(buckets(minhash(shingle_set(F.col("__s")), hashes, mode), hashes, bands)).alias("bucket"))
    keyed, _ = store(signed, "buckets")
    firsts = keyed.groupBy("bucket").agg(F.min("head").alias("first"))
    links = skew_join(keyed, firsts, ["bucket"]).select(F.col("first").alias("a"), F.col("head").alias("b"))
    roots = components(links, "a", "b")
    # Classes of copies and families may be large, so their keys are salted.
    classes = skew_join(shaped.select("node", "shape"), heads.select("shape", "head"), ["shape"])
    member = skew_join(classes.select("node", "head"), roots.select(F.col("node").alias("head"), "root"), ["head"], "left").select("node", F.coalesce("root", "head").alias("root"))
    sizes = member.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    numbered = number_in_order(sizes, "root", "family_id")
    return skew_join(member, numbered, ["root"]).select(F.col("node").alias(id), "root", F.col("family_id").cast("bigint").alias("family_id"), "size")
