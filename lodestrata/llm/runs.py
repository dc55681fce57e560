"""Runs of identical consecutive events, by pointer doubling.

Every event that continues the event before it in its sequence points to it.
Pointers are then replaced by their pointers' pointers in self-joins of the
pointer table, until all reach the start of their run: a run of L events takes
log2 L rounds. A pointer carries what it skips (events, least and greatest
measure), so the last event of a run ends up with all of its run.

The event before is found without holding a sequence in one task: sequences
are cut into blocks of the order column, a block's first event takes the last
event of the nearest earlier block, and that search over blocks is cut into
blocks of blocks in turn, as often as the span of the order column asks.

In a round each event is pointed to by at most one other, so the self-joins
are one to one and no key is hot. Events that nothing points to at the
round's distance are never looked up again and leave the table; so each round
holds runs of more than 2^round events only. Every round is written to the
shared folder.

Defined results: copies of an event (same sequence and order value) count
once, with the least item and measure among them that is not null; an event
without a sequence or order value is left out; an event with a null item is
in no run and ends the one before it; measures that are null count as none;
runs shorter than ``least`` are left out; an empty table gives no runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.shared import discard, store, store_counted


def latest_before(blocks: DataFrame, sequence: list[str], value: str, span: int) -> DataFrame:
    """(sequence, block, before): for each block the ``value`` of the nearest earlier block of its sequence, null for the first.

    ``blocks`` has one row a block. No window holds more than ``span`` (over 1) rows.
    """
    reach = blocks.agg(F.min("block").alias("a"), F.max("block").alias("b")).first()
    if reach["a"] is None or reach["b"] - reach["a"] < span:
        w = W.partitionBy(*sequence).orderBy("block")
        return blocks.select(*sequence, "block", F.lag(value).over(w).alias("before"))
    wide = blocks.withColumn("__inner", F.col("block")).withColumn("block", F.floor(F.col("block") / span))
    w = W.partitionBy(*sequence, "block").orderBy("__inner")
    own = wide.select(*sequence, "block", "__inner", F.lag(value).over(w).alias("__near"))
    outer = latest_before(wide.groupBy(*sequence, "block").agg(F.max_by(value, "__inner").alias(value)), sequence, value, span)
    return own.join(outer, [*sequence, "block"]).select(*sequence, F.col("__inner").alias("block"), F.coalesce("__near", "before").alias("before"))


def double(links: DataFrame) -> DataFrame:
    """(last, start, n, low, high) of each run.

    ``links`` has id, ptr, n, low, high and ``last`` (nothing points here).
    """
    spark = links.sparkSession
    table, at = store(links.withColumn("open", F.lit(True)), "pointers")
    rounds: list[str] = []
    left = {"open": 1}
    while left["open"]:
        a, b = table.filter("open").alias("a"), table.alias("b")
        j = a.join(b, F.col("a.ptr") == F.col("b.id"), "left")
        moved = F.struct(
            F.col("a.id").alias("id"),
            F.coalesce("b.ptr", "a.ptr").alias("ptr"),
            (F.col("a.n") + F.coalesce("b.n", F.lit(0))).alias("n"),
            F.least("a.low", "b.low").alias("low"),
            F.greatest("a.high", "b.high").alias("high"),
            F.col("a.last").alias("last"),
            F.coalesce("b.open", F.lit(False)).alias("open"),
        )
        kept = F.when(~F.col("b.open"), F.struct(*[F.col(f"b.{c}").alias(c) for c in table.columns]))
        step = j.select(F.explode(F.filter(F.array(moved, kept), lambda x: x.isNotNull())).alias("x")).select("x.*")
        following, now, left = store_counted(step, "pointers", open=F.count_if("open"))
        if not rounds:
            discard(spark, at)
        table = following
        rounds.append(now)
    # The last event of a run is looked up by none, so it is done in the table of one round only.
    return spark.read.schema(table.schema).parquet(*rounds).filter("last and not open").select(F.col("id").alias("last"), F.col("ptr").alias("start"), "n", "low", "high")


def collapse_runs(events: DataFrame, sequence: list[str], order: str, item: str, measure: str | None = None, block: int = 16384, least: int = 2) -> DataFrame:
    """One row for each run of at least ``least`` (2 or more) events: sequence, item, first, last, n, duration.

    ``item`` and ``order`` are longs; ``item`` is equal for events that are
    identical, or near enough by the caller's spelling. ``duration`` is the
    greatest minus the least measure in the run, null without one.
    ``block`` is the span of the order column that one task handles at once.
    """
    seq = [f"__s{i}" for i in range(len(sequence))]
    value = F.col(measure).cast("bigint") if measure else F.lit(None).cast("bigint")
    slim = events.select(*[F.col(c).alias(s) for c, s in zip(sequence, seq)], F.col(order).cast("bigint").alias("at"), F.col(item).cast("bigint").alias("item"), value.alias("measure"))
    slim = slim.filter(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*seq, "at"]]))
    # One exchange serves the dropping of copies, the window and the blocks.
    laid = slim.withColumn("block", F.floor(F.col("at") / block)).repartition(*seq, "block")
    once = laid.groupBy(*seq, "block", "at").agg(F.min("item").alias("item"), F.min("measure").alias("measure")).withColumn("id", F.monotonically_increasing_id())
    w = W.partitionBy(*seq, "block").orderBy("at")
    same = lambda near: F.coalesce(F.col("item") == near, F.lit(False))
    seen = once.select("*", F.lag("id").over(w).alias("prior"), same(F.lag("item").over(w)).alias("follows"), same(F.lead("item").over(w)).alias("goes_on"), F.lead("id").over(w).isNull().alias("closes"))
    marked, _ = store(seen.filter(F.col("follows") | F.col("goes_on") | F.col("closes") | F.col("prior").isNull()), "events")
    tails = marked.filter("closes").select(*seq, "block", F.struct("id", "item").alias("tail"))
    before = latest_before(tails, seq, "tail", max(block, 1024)).filter("before is not null")
    heads = marked.filter("prior is null").join(before, [*seq, "block"])
    crossed, _ = store(heads.filter(same(F.col("before.item"))).select("id", F.col("before.id").alias("ptr"), "measure", "goes_on", "closes"), "crossings")
    links = marked.filter("follows").select("id", F.col("prior").alias("ptr"), "measure", "goes_on", "closes").unionByName(crossed)
    onward = crossed.select(F.col("ptr").alias("id"), F.lit(True).alias("__on"))
    closing = links.filter("closes").join(onward, "id", "left").withColumn("last", F.col("__on").isNull()).drop("__on")
    whole = links.filter("not closes").withColumn("last", ~F.col("goes_on")).unionByName(closing)
    runs = double(whole.select("id", "ptr", F.lit(1).cast("bigint").alias("n"), F.col("measure").alias("low"), F.col("measure").alias("high"), "last"))
    final = marked.filter(F.col("follows") | F.col("prior").isNull()).select(F.col("id").alias("last"), F.col("at").alias("__last"))
    first = marked.filter(~F.col("follows")).select(F.col("id").alias("start"), *seq, "item", F.col("at").alias("__first"), "measure")
    found = runs.join(final, "last").join(first, "start").withColumn("n", F.col("n") + 1).filter(F.col("n") >= least)
    span: Column = F.greatest("high", "measure") - F.least("low", "measure")
    return found.select(*[F.col(s).alias(c) for c, s in zip(sequence, seq)], "item", F.col("__first").alias("first"), F.col("__last").alias("last"), "n", span.alias("duration"))
