"""Graphs as edge tables: closure, degrees, components, communities.

Loops write each round to the shared folder, so lineage stays short and a
lost executor costs one round. Hubs are salted wherever edges are joined on a
node; counts and minima are combined before every shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators.skew import SALT, hot_keys, salted, skew_join
from lodestrata.shared import discard, store, store_counted


def degrees(edges: DataFrame, node: str, out: str = "degree") -> DataFrame:
    """Edges at each node, multiplicity kept."""
    return edges.filter(F.col(node).isNotNull()).groupBy(node).agg(F.count(F.lit(1)).alias(out))


def neighbours(edges: DataFrame, src: str, dst: str, kind: str) -> DataFrame:
    """Distinct neighbours both ways: node, other, direction, kind (the greatest of several)."""
    out = edges.select(F.col(src).alias("node"), F.col(dst).alias("other"), F.lit("out").alias("direction"), F.col(kind).alias("kind"))
    back = edges.select(F.col(dst).alias("node"), F.col(src).alias("other"), F.lit("in").alias("direction"), F.col(kind).alias("kind"))
    both = out.unionAll(back).filter(F.col("node").isNotNull() & F.col("other").isNotNull())
    return both.groupBy("node", "other", "direction").agg(F.max("kind").alias("kind"))


def closure(edges: DataFrame, seeds: DataFrame, src: str, dst: str, max_depth: int = 0) -> DataFrame:
    """Nodes reached from the seeds with their least number of hops: node, depth.

    ``max_depth`` over 0 stops there. Null ends and seeds are ignored; seeds
    without edges are reached at depth 0. A seed list may hold repeats.
    """
    spark = edges.sparkSession
    arcs, arcs_at = store(edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("node"), F.col(dst).alias("to")).distinct(), "arcs")
    hot = hot_keys(arcs, ["node"])
    first = seeds.select(F.col(seeds.columns[0]).alias("node")).filter("node is not null").distinct().withColumn("depth", F.lit(0))
    frontier, path = store(first, "reached")
    paths, depth = [path], 0
    schema = frontier.schema
    while not max_depth or depth < max_depth:
        depth += 1
        left, right = salted(arcs, frontier.select("node"), ["node"], hot)
        found = left.join(right, ["node", SALT]).select(F.col("to").alias("node")).distinct()
        seen = spark.read.schema(schema).parquet(*paths)
        fresh = found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        frontier, path = store(fresh, "reached")
        paths.append(path)
        if not frontier.limit(1).count():
            break
    return spark.read.schema(schema).parquet(*paths)


def stop_reasons(edges: DataFrame, reached: DataFrame, src: str, dst: str, kind: str, stops: tuple[str, ...], runtime: DataFrame, blind: str, max_depth: int = 0) -> DataFrame:
    """Why a closure stopped: kind, n_stopped.

    For each kind of ``stops`` the distinct (expanded caller, callee); as
    ``runtime`` those of other kinds to nodes of ``runtime`` (one column);
    ``blind`` edges have no target, so each counts, from all reached callers.
    """
    ends = edges.select(F.col(src).alias("node"), F.col(dst).alias("to"), F.col(kind).alias("kind"))
    hit = skew_join(ends, reached.select("node", "depth"), ["node"])
    unseen = hit.filter(F.col("kind") == blind).groupBy("kind").agg(F.count(F.lit(1)).alias("n_stopped"))
    grown = hit.filter(F.col("depth") < max_depth) if max_depth else hit
    aimed = grown.filter((F.col("kind") != blind) & F.col("to").isNotNull()).select("node", "to", "kind").distinct()
    other = aimed.filter(~F.col("kind").isin(*stops)).select("node", "to").distinct()
    late = skew_join(other, runtime.select(F.col(runtime.columns[0]).alias("to")).distinct(), ["to"], "left_semi")
    seen = aimed.filter(F.col("kind").isin(*stops)).unionByName(late.withColumn("kind", F.lit("runtime")))
    return seen.groupBy("kind").agg(F.count(F.lit(1)).alias("n_stopped")).unionByName(unseen)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node of each connected component, by alternating large and small stars.

    Each round points every node's larger neighbours at its least neighbour,
    then its smaller ones; rounds grow with the logarithm of a component's
    size. A node in no edge, or only in an edge to itself, is its own root.
    """
    spark = edges.sparkSession
    raw = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    nodes, nodes_at = store(raw.select(F.col("u").alias("node")).unionAll(raw.select("v")).distinct(), "nodes")
    arcs, at = store(raw.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")

    def stars(pairs: DataFrame, n: int, whole: bool) -> DataFrame:
        """One star round over about ``n`` arcs; ``whole`` looks both ways and moves the larger neighbours."""
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if whole else pairs
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        left, right = salted(both, least, ["u"], hot_keys(both, ["u"], n))
        j = left.join(right, ["u", SALT])
        moved = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if whole else j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(j.select("u", F.col("m").alias("v")))
        return moved.filter("u <> v").distinct()

    def mark(pairs: DataFrame) -> tuple:
        r = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    before = mark(arcs)
    while before[0]:
        large, large_at = store(stars(arcs, 2 * before[0], True), "stars")
        small, small_at = store(stars(large, before[0], False), "stars")
        now = mark(small)
        discard(spark, at, large_at)
        arcs, at = small, small_at
        if now == before:
            break
        before = now
    return nodes.join(arcs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("root"))


def propagate_labels(edges: DataFrame, a: str, b: str, half, rounds: int = 12) -> DataFrame:
    """(node, label, converged): communities by label propagation in half steps.

    The graph is undirected, with multiplicity, without self-loops. In each
    round the nodes of one half (``half(node)`` true), then the others, take
    the label most frequent among their neighbours and, once, themselves;
    ties go to the lowest label. It stops when a round changes nothing.
    """
    raw = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = raw.select(F.col(a).alias("node"), F.col(b).alias("other")).unionAll(raw.select(F.col(b).alias("node"), F.col(a).alias("other")))
    arcs, _ = store(both.groupBy("node", "other").agg(F.count(F.lit(1)).alias("n")), "arcs")
    hot = hot_keys(arcs, ["other"])
    labels, at = store(arcs.select("node").distinct().withColumn("label", F.col("node")).withColumn("moved", F.lit(False)), "labels")
    steady = False
    for _ in range(rounds):
        for side in (True, False):
            mine = half(F.col("node")) == F.lit(side)
            left, right = salted(arcs.filter(mine), labels.select(F.col("node").alias("other"), "label"), ["other"], hot)
            votes = left.join(right, ["other", SALT]).select("node", "label", "n").unionAll(labels.filter(mine).select("node", "label", F.lit(1).cast("bigint")))
            tally = votes.groupBy("node", "label").agg(F.sum("n").alias("n"))
            best = tally.groupBy("node").agg(F.max(F.struct(F.col("n"), (-F.col("label")).alias("low"))).alias("x")).select("node", (-F.col("x.low")).alias("next"))
            following = labels.join(best, "node", "left").select("node", F.coalesce("next", "label").alias("label"), (F.coalesce(F.col("next") != F.col("label"), F.lit(False)) | (F.lit(not side) & F.col("moved"))).alias("moved"))
            new, new_at, seen = store_counted(following, "labels", moved=F.count_if("moved"))
            discard(edges.sparkSession, at)
            labels, at = new, new_at
        if not seen["moved"]:
            steady = True
            break
    return labels.select("node", "label", F.lit(steady).alias("converged"))


def community_summary(edges: DataFrame, labels: DataFrame, a: str, b: str, least: int = 1) -> DataFrame:
    """label, size, internal, external, cohesion. An edge between two communities is external on both sides."""
    own = labels.select("node", "label")
    sizes = own.groupBy("label").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    kept = own.join(sizes.select("label"), "label", "left_semi")
    ends = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))

    def joined(df: DataFrame, at: str, name: str) -> DataFrame:
        left, right = salted(df, kept.select(F.col("node").alias(at), F.col("label").alias(name)), [at], hot_keys(df, [at]))
        return left.join(right, [at, SALT], "left").drop(SALT)

    both = joined(joined(ends, "a", "la"), "b", "lb").select("la", "lb")
    inner = both.filter("la = lb").groupBy(F.col("la").alias("label")).agg(F.count(F.lit(1)).alias("internal"))
    cross = both.filter("not (la <=> lb)")
    outer = cross.select(F.col("la").alias("label")).unionAll(cross.select("lb")).filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("external"))
    s = sizes.join(inner, "label", "left").join(outer, "label", "left").select("label", "size", F.coalesce("internal", F.lit(0)).alias("internal"), F.coalesce("external", F.lit(0)).alias("external"))
    return s.withColumn("cohesion", F.coalesce(F.try_divide(F.col("internal").cast("double"), (F.col("internal") + F.col("external")).cast("double")), F.lit(0.0)))


def saturating_score(terms: dict[str, tuple[float, float]], digits: int | None = 3) -> Column:
    """Sum of weight times min(1, value / saturation) over columns, nulls as 0, capped at 1, rounded."""
    total = F.lit(0.0)
    for name, (weight, top) in terms.items():
        total = total + F.lit(weight) * F.least(F.lit(1.0), F.coalesce(F.col(name).cast("double"), F.lit(0.0)) / F.lit(top))
    capped = F.least(F.lit(1.0), total)
    return capped if digits is None else F.round(capped, digits)


def size_fit(size: Column, best: int, width: int) -> Column:
    """1 at the best size, falling to 0 at ``width`` from it."""
    return F.lit(1.0) - F.least(F.lit(1.0), F.abs(size - best).cast("double") / width)


def number_in_order(df: DataFrame, order: str, out: str, start: int = 1) -> DataFrame:
    """Consecutive numbers by a unique column, without gathering the rows in one task.

    Rows are range-partitioned and stored with their partition; counts of the
    partitions (one each) give the offsets.
    """
    kept, _ = store(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()), "ranges")
    counts = kept.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    ahead = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("__p", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__base"))
    local = kept.withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy(order)))
    return local.join(F.broadcast(base), "__p").withColumn(out, F.col("__base") + F.col("__r") + F.lit(start - 1)).drop("__p", "__r", "__base")


def seed_list(lines: DataFrame, text: str) -> DataFrame:
    """Distinct addresses of seed lines: ``#`` comments go, tokens are split at blanks and commas, unreadable ones are dropped."""
    from lodestrata.functions.scalars import address_of

    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "#.*$", "")
    tokens = lines.select(F.explode(F.split(bare, r"[\s,]+")).alias("t"))
    return tokens.select(address_of(F.col("t")).alias("node")).filter("node is not null").distinct()
