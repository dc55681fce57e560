"""Schemas that drift between files.

Rows are loaded once as path-value maps with raw types and stored; path and
type statistics are aggregated by file (combined before the shuffle, so a file
or feed with a third of all rows costs no more than another); each file is
compared with the one before it; and typed columns are projected from the
maps, with a report of every value that could not be cast.

Whether a new path carries on the figure of one that is gone is decided from
the data (``figure_pairs``): the two never stand in one record of the whole
corpus, and their values are distributed alike. How alike their names are
decides between several such paths only.

Defined results: a record that is unreadable, or has no object at the root,
has no fields but its file still counts as a file; a field that is only ever
null has no type, is never ``retyped`` and carries on no figure; nothing is
compared for the first file of a feed; repeated rows change counts, never
changes of shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.shared import store

KINDS = ("string", "list", "number", "boolean", "integer")
#: How far two spellings of one figure may lie apart beside what chance explains: in standard deviations, and in shares of zeros.
APART, ZEROS_APART = 0.35, 0.2


def number_of(cell: Column) -> Column:
    """The number a cell stands for, as text: of a list of one its item; null or unreadable text stays so."""
    return F.when(cell["kind"] == "list", F.regexp_extract(cell["raw"], r"^\[\s*\"?([-+0-9.eE]+)\"?\s*\]$", 1)).otherwise(F.trim(cell["raw"]))


def path_statistics(maps: DataFrame, file: list[str], leaves: str = "leaves") -> DataFrame:
    """Per file and path: records that have it, values by kind, the type, and sums that make a sketch of its values.

    The type is the kind of the values that are not null; a file that mixes
    kinds has the first of string, list, number, boolean, integer. The sketch
    counts numbers, whole numbers of 0, and sums of the logarithms of the
    others; of texts that are no numbers it sums the lengths.
    """
    cells = maps.select(*file, F.explode(leaves).alias("path", "cell"))
    kind, value = F.col("cell.kind"), number_of(F.col("cell")).try_cast("double")
    size = F.floor(F.abs(value))
    log = F.when(value.isNotNull() & (size >= 1), F.log(size + 1)).when(value.isNull() & (kind != "null"), F.log(F.char_length("cell.raw") + F.lit(1.0)))
    stats = cells.groupBy(*file, "path").agg(
        F.count(F.lit(1)).alias("records"),
        *[F.count_if(kind == k).alias(f"n_{k}") for k in (*KINDS, "null")],
        F.count(value).alias("n_numbers"),
        F.count_if(size < 1).alias("n_zeros"),
        F.count(log).alias("n_logs"),
        F.coalesce(F.sum(log), F.lit(0.0)).alias("logs"),
        F.coalesce(F.sum(log * log), F.lit(0.0)).alias("squares"),
    )
    order = F.coalesce(*[F.when(F.col(f"n_{k}") > 0, F.lit(k)) for k in KINDS])
    return stats.withColumn("type", order)


def path_sketches(stats: DataFrame) -> DataFrame:
    """One row a path over the whole corpus: n, share of zeros, mean and variance of logs, and whether it holds numbers."""
    total = stats.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("records", "n_null", "n_numbers", "n_zeros", "n_logs", "logs", "squares")])
    n, k = F.col("records") - F.col("n_null"), F.greatest(F.col("n_logs"), F.lit(1))
    mean = F.col("logs") / k
    return total.filter(n > 0).select("path", F.struct(n.alias("n"), (F.col("n_numbers") * 2 >= n).alias("numeric"), (F.col("n_zeros") / n).alias("zeros"), F.col("n_logs").alias("k"), mean.alias("mean"), F.greatest(F.col("squares") / k - mean * mean, F.lit(0.0)).alias("var")).alias("sketch"))


def apart(a: Column, b: Column) -> tuple[Column, Column]:
    """(whether two sketches may be of one figure, how far they lie apart)."""
    both = F.greatest(a["k"] + b["k"], F.lit(1))
    sd = F.greatest(F.sqrt((a["var"] * a["k"] + b["var"] * b["k"]) / both), F.lit(0.3))
    some = (a["k"] > 0) & (b["k"] > 0)
    far = F.when(some, F.abs(a["mean"] - b["mean"]) / sd).otherwise(0.0)
    chance = F.when(some, F.sqrt(1 / F.greatest(a["k"], F.lit(1)) + 1 / F.greatest(b["k"], F.lit(1)))).otherwise(0.0)
    zeros = F.abs(a["zeros"] - b["zeros"])
    alike = (a["numeric"] == b["numeric"]) & (far <= APART + 2 * chance) & (zeros <= ZEROS_APART + F.sqrt(1 / a["n"] + 1 / b["n"]))
    return alike, far + zeros


def name_words(path: Column) -> Column:
    """The words of a path, cut at dots, underscores and capitals."""
    return F.array_distinct(F.split(F.lower(F.regexp_replace(path, "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+"))


def name_distance(a: Column, b: Column) -> Column:
    """1 less the share of their words that two paths have in common."""
    x, y = name_words(a), name_words(b)
    return 1 - F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def figure_pairs(pairs: DataFrame, maps: DataFrame, stats: DataFrame, leaves: str = "leaves") -> DataFrame:
    """Of the distinct (gone, new) in ``pairs`` those that may name one figure: gone, new, distance, names.

    Records are first merged to the distinct sets of paths they have, which
    are few; a pair that stands in one of them is out.
    """
    asked = pairs.select("gone", "new").distinct()
    shapes = maps.select(F.array_sort(F.map_keys(leaves)).alias("shape")).filter(F.size("shape") > 1).distinct()
    met = shapes.select("shape", F.explode("shape").alias("gone")).join(asked, "gone").filter(F.array_contains("shape", F.col("new"))).select("gone", "new").distinct()
    sketches = path_sketches(stats)
    a, b = sketches.select(F.col("path").alias("gone"), F.col("sketch").alias("a")), sketches.select(F.col("path").alias("new"), F.col("sketch").alias("b"))
    alike, far = apart(F.col("a"), F.col("b"))
    return asked.join(met, ["gone", "new"], "left_anti").join(a, "gone").join(b, "new").filter(alike).select("gone", "new", far.alias("distance"), name_distance(F.col("gone"), F.col("new")).alias("names"))


def file_sequence(df: DataFrame, feed: str, number: str) -> DataFrame:
    """Every file with the one before it in its feed, null for the first."""
    files = df.select(feed, number).filter(F.col(number).isNotNull()).distinct()
    return files.withColumn("before", F.lag(number).over(W.partitionBy(feed).orderBy(number)))


def shape_changes(maps: DataFrame, feed: str, number: str, leaves: str = "leaves") -> DataFrame:
    """Every change of shape: feed, file, field, change, old_field, old_type, new_type.

    ``maps`` is read several times, so it should be a stored table. ``renamed``
    pairs a field that is gone with one that is new in the same file and may
    name the same figure; pairs are taken one to one, first those whose values
    lie nearest (in steps of half a deviation), then whose names do. A file's
    fields are as many as its schema has, however many its rows.
    """
    seq = file_sequence(maps, feed, number)
    full, _ = store(path_statistics(maps, [feed, number], leaves), "statistics")
    stats = full.select(feed, number, "path", "type")
    now = stats.join(seq.filter(F.col("before").isNotNull()), [feed, number]).select(feed, number, "path", F.col("type").alias("new_type"), F.lit(True).alias("is_now"))
    after = seq.filter(F.col("before").isNotNull()).select(feed, F.col(number).alias("__next"), F.col("before").alias(number))
    then = stats.join(after, [feed, number]).select(feed, F.col("__next").alias(number), "path", F.col("type").alias("old_type"), F.lit(True).alias("was_then"))
    both = now.join(then, [feed, number, "path"], "full")
    change = F.when(F.col("was_then").isNull(), "added").when(F.col("is_now").isNull(), "removed").when(F.col("new_type") != F.col("old_type"), "retyped")
    cases = both.withColumn("change", change).filter(F.col("change").isNotNull()).select(feed, number, F.col("path").alias("field"), "change", "old_type", "new_type")
    key = [feed, number]
    gone = cases.filter("change = 'removed'").select(*key, F.col("field").alias("gone"), F.col("old_type").alias("gone_type"))
    fresh = cases.filter("change = 'added'").select(*key, F.col("field").alias("new"), F.col("new_type").alias("fresh_type"))
    pairs, _ = store(gone.join(fresh, key), "pairs")
    known = pairs.join(figure_pairs(pairs, maps, full, leaves), ["gone", "new"])
    ranked = F.array_sort(F.collect_list(F.struct(F.floor(F.col("distance") * 2).alias("d"), "names", "distance", "gone", "new", "gone_type", "fresh_type")))
    taken = F.aggregate(
        ranked,
        F.array().cast("array<struct<gone:string,new:string,gone_type:string,fresh_type:string>>"),
        lambda acc, p: F.when(F.exists(acc, lambda t: (t["gone"] == p["gone"]) | (t["new"] == p["new"])), acc).otherwise(F.concat(acc, F.array(F.struct(p["gone"], p["new"], p["gone_type"], p["fresh_type"])))),
    )
    moved = known.groupBy(*key).agg(taken.alias("t")).select(*key, F.explode("t").alias("t")).select(*key, "t.*")
    renamed = moved.select(*key, F.col("new").alias("field"), F.lit("renamed").alias("change"), F.col("gone").alias("old_field"), F.col("gone_type").alias("old_type"), F.col("fresh_type").alias("new_type"))
    used = moved.select(*key, F.col("gone").alias("field"), F.lit("removed").alias("change")).unionAll(moved.select(*key, "new", F.lit("added")))
    rest = cases.join(used, [*key, "field", "change"], "left_anti").withColumn("old_field", F.lit(None).cast("string"))
    return rest.select(*key, "field", "change", "old_field", "old_type", "new_type").unionByName(renamed)


def spellings(changes: DataFrame, wanted: list[str]) -> dict[str, list[str]]:
    """For each wanted path, all paths that renames, one after another, make spellings of its figure.

    Only the distinct pairs of renamed paths are brought to the driver: they
    are words of the schema, not rows of the data.
    """
    pairs = changes.filter("change = 'renamed'").select("old_field", "field").distinct().collect()
    near: dict[str, set[str]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = {}
    for path in wanted:
        seen, ahead = {path}, [path]
        while ahead:
            fresh = near.get(ahead.pop(), set()) - seen
            seen |= fresh
            ahead.extend(fresh)
        found[path] = sorted(seen)
    return found


def with_strays(known: dict[str, list[str]], maps: DataFrame, leaves: str = "leaves") -> dict[str, list[str]]:
    """``known`` spellings, and to each figure the paths no rename leads to that may name it (``figure_pairs`` with all of its paths).

    A path that may name several figures goes to the nearest, as in ``shape_changes``.
    """
    stats = path_statistics(maps, [], leaves)
    spark = maps.sparkSession
    listed = [(w, p) for w, paths in known.items() for p in paths]
    ours = spark.createDataFrame(listed, "figure string, gone string")
    strays = stats.select(F.col("path").alias("new")).join(ours.select(F.col("gone").alias("new")), "new", "left_anti")
    asked = strays.select("new", F.explode(F.array(*[F.lit(p) for _, p in listed])).alias("gone"))
    found = figure_pairs(asked, maps, stats, leaves).join(ours, "gone").collect()
    held = {r["gone"] for r in stats.select(F.col("path").alias("gone")).join(ours, "gone").collect()}
    need = {w: sum(p in held for p in paths) for w, paths in known.items()}
    near: dict[str, list[tuple]] = {}
    for new in {r["new"] for r in found}:
        for w, n in need.items():
            own = [(int(r["distance"] * 2), r["names"], r["distance"], w) for r in found if r["new"] == new and r["figure"] == w]
            if n and len(own) == n:
                near.setdefault(new, []).append(min(own))
    out = {w: list(paths) for w, paths in known.items()}
    for new, own in near.items():
        out[min(own)[-1]].append(new)
    return {w: sorted(paths) for w, paths in out.items()}


def typed_columns(maps: DataFrame, figures: dict[str, list[str]], target: str = "bigint", leaves: str = "leaves") -> DataFrame:
    """One column for each figure, whatever its path or type in the file, and the failed casts.

    ``figures`` maps a column name to the paths of its figure. Of several in a
    record the first by path that is not null counts. A text is cast, a list
    of one number is that number; anything else that is not null is null in
    the column and listed in ``failed_casts`` with its path, kind and raw
    value. Columns of ``maps`` that bear a new column's name go.
    """

    def cast(v: Column) -> Column:
        text = number_of(v)
        exact = text.try_cast("decimal(38,6)")
        return F.when(exact == F.floor(exact), exact.try_cast(target)) if target == "bigint" else text.try_cast(target)

    every = [p for paths in figures.values() for p in paths]
    entries = F.array_sort(F.filter(F.map_entries(leaves), lambda e: (e["value"]["kind"] != "null") & e["key"].isin(*every)), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
    keyed = F.transform(entries, lambda e: F.struct(e["key"].alias("path"), e["value"]["kind"].alias("kind"), e["value"]["raw"].alias("raw"), cast(e["value"]).alias("n")))
    df = maps.withColumn("__cells", F.coalesce(keyed, F.array().cast("array<struct<path:string,kind:string,raw:string,n:" + target + ">>")))

    def first_of(paths: list[str]) -> Column:
        return F.get(F.filter("__cells", lambda c: c["path"].isin(*paths)), F.lit(0))["n"]

    cols = [first_of(paths).alias(name) for name, paths in figures.items()]
    failed = F.transform(F.filter("__cells", lambda c: c["n"].isNull()), lambda c: F.struct(c["path"].alias("path"), c["kind"].alias("kind"), c["raw"].alias("raw")))
    others = [c for c in maps.columns if c not in (leaves, "failed_casts", *figures)]
    return df.select(*others, *cols, failed.alias("failed_casts"))
