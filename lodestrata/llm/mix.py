"""Mixing sources to target weights.

Sizes are tokens. The tokens of a mix are shared out to its sources by weight;
what a source can't hold under its cap of repeats, or can't because it has no
document, is shared out again to the others by their weights.

The documents of a source, in a shuffled order, are cut into blocks of equal
tokens: the source's tokens are divided by a whole number of blocks that comes
nearest to ``size``, and a document belongs to the block its middle lies in.
For every mix, slots are numbered from 0; the golden-ratio point of each slot,
a low-discrepancy sequence, is mapped through the cumulative numbers of blocks
to a source, so every stretch of the schedule holds the sources in their
shares. Slots are ranked within their source; slot k of a source takes its
block k mod blocks, in round k div blocks. In the last round of a source only
documents whose middle lies before the tokens still wanted are taken, so a
source misses its tokens by half a document at most. The sequence may give a
source a few slots less than it has blocks; those blocks follow at the end.

A round takes a document once and there are no more rounds than the cap, so no
document occurs more often than the cap allows.

``size`` is the largest document if not given, so that any document fits a
block. All rankings are two-level (stretches first, then rows within a
stretch), so no task holds a whole source or schedule, and nothing but two
sums is brought to the driver.

Defined results: weights that are null, negative or 0 and caps below 1 take
no part; rows of one mix and source are summed, with their least cap;
documents without a source belong to none; documents of no tokens are never
chosen; the total of a mix is its ratio times the tokens of all documents,
those without a source included; it falls short only where all sources of the
mix are at their caps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators.skew import running_total
from lodestrata.shared import store, store_counted

GOLDEN = 0.6180339887498949
STRETCH = 65_536


def golden_point(slot: Column) -> Column:
    """The fractional part of slot times the golden ratio."""
    x = slot.cast("double") * F.lit(GOLDEN)
    return x - F.floor(x)


def targets(mix: DataFrame, key: str, source: str, weight: str, cap: str, ratio: str) -> DataFrame:
    """One row for each mix and source of positive weight: weight, cap, ratio, share."""
    rows = mix.filter((F.col(weight) > 0) & (F.coalesce(F.col(cap), F.lit(1)) >= 1) & F.col(source).isNotNull() & F.col(ratio).isNotNull())
    each = rows.groupBy(key, source).agg(F.sum(weight).alias("weight"), F.min(F.coalesce(F.col(cap), F.lit(1))).alias("cap"), F.max(ratio).alias("ratio"))
    whole = W.partitionBy(key)
    return each.withColumn("share", F.col("weight") / F.sum("weight").over(whole))


def shared_out(goals: DataFrame, held: DataFrame, key: str, source: str, total: int) -> DataFrame:
    """Append ``held`` (tokens of the source) and ``wanted``: the tokens to take, what is over a source's limit going to the others.

    Sources are filled in the order of limit over weight: those that reach
    their limits come first, the others share the rest by weight.
    """
    g = goals.join(held, source, "left").withColumn("held", F.coalesce("held", F.lit(0)))
    g = g.withColumn("limit", F.col("held") * F.col("cap")).withColumn("fill", F.col("limit") / F.col("weight"))
    before = W.partitionBy(key).orderBy("fill", source).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(key).orderBy("fill", source).rowsBetween(W.currentRow, W.unboundedFollowing)
    rest = F.col("ratio") * F.lit(float(total)) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    g = g.withColumn("level", rest / F.sum("weight").over(after))
    # The level of the first source that isn't full; those after it are lower.
    free = F.max(F.when(F.col("fill") >= F.col("level"), F.col("level"))).over(W.partitionBy(key))
    wanted = F.when(free.isNull() | (F.col("fill") < free), F.col("limit")).otherwise(F.least(F.col("limit"), F.round(F.col("weight") * free).cast("bigint")))
    return g.withColumn("wanted", wanted).drop("fill", "level", "limit")


def schedule(needs: DataFrame, key: str, source: str) -> DataFrame:
    """(mix, source, turn, slot) for the ``turns`` of each mix and source."""
    upto = W.partitionBy(key).orderBy(source).rowsBetween(W.unboundedPreceding, W.currentRow)
    spans = needs.filter("turns > 0").withColumn("__upto", F.sum("turns").over(upto))
    mixes = spans.groupBy(key).agg(F.sum("turns").alias("slots"), F.array_sort(F.collect_list(F.struct("__upto", F.col(source).alias("s"), "turns"))).alias("ends"))
    part = mixes.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / STRETCH))).alias("part")).repartition(key, "part")
    last = F.least(F.col("slots") - 1, F.col("part") * STRETCH + (STRETCH - 1))
    slots = part.select(key, "slots", "ends", F.explode(F.sequence(F.col("part") * STRETCH, last)).alias("slot"))
    at = golden_point(F.col("slot")) * F.col("slots")
    chosen = F.get(F.filter("ends", lambda e: e["__upto"] > at), F.lit(0))
    placed = slots.select(key, "slot", chosen.alias("c")).select(key, F.col("c.s").alias(source), "slot", F.lit(1).alias("one"))
    turns = running_total(placed, [key, source], ["slot"], "one", F.floor(F.col("slot") / STRETCH), "turn").drop("one")
    # Blocks for which the sequence has no slot follow at the end.
    given = turns.groupBy(key, source).agg(F.count(F.lit(1)).alias("given"))
    late = needs.filter("turns > 0").join(given, [key, source], "left").withColumn("given", F.coalesce("given", F.lit(0))).filter("given < turns")
    over = late.select(key, source, F.explode(F.sequence(F.col("given"), F.col("turns") - 1)).alias("turn"))
    numbered = over.join(mixes.select(key, "slots"), key).withColumn("slot", F.col("slots") + F.row_number().over(W.partitionBy(key).orderBy("turn", source)) - 1)
    kept = turns.join(needs.select(key, source, "turns"), [key, source]).filter("turn < turns")
    return kept.select(key, source, "turn", "slot").unionByName(numbered.select(key, source, "turn", "slot"))


def blocks(docs: DataFrame, held: DataFrame, id: str, source: str, tokens: str, size: int, stretches: int, seed: int) -> DataFrame:
    """Documents of a source in shuffled order: append ``middle`` (tokens before their middle), ``block`` and ``n_blocks``."""
    order = F.shiftrightunsigned(F.xxhash64(F.col(id), F.lit(seed)), 1)
    bucket = F.floor(order.cast("double") / (2.0**63 / stretches))
    placed = running_total(docs.withColumn("__place", order), [source], ["__place", id], tokens, bucket, "__start").drop("__place")
    sized = placed.join(held, source).withColumn("n_blocks", F.greatest(F.lit(1), F.round(F.col("held") / size)).cast("bigint"))
    middle = F.col("__start") + F.col(tokens) / 2
    return sized.withColumn("middle", middle).withColumn("block", F.floor(middle * F.col("n_blocks") / F.col("held"))).drop("__start", "held")


def mix_sources(
    docs: DataFrame, mix: DataFrame, id: str, source: str, tokens: str, key: str = "mix_id", weight: str = "weight", cap: str = "max_repeats", ratio: str = "size_ratio", size: int | None = None, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """The selection, a row for each occurrence (mix, slot, id, source, tokens, round), and the report of shares.

    ``size`` is the tokens of a block, the largest document if not given.
    """
    slim, _, facts = store_counted(
        docs.select(F.col(id).alias("__id"), F.col(source).alias("__source"), F.col(tokens).cast("bigint").alias("__tokens")), "sizes", t=F.coalesce(F.sum("__tokens"), F.lit(0)), n=F.count(F.lit(1)), top=F.max("__tokens")
    )
    size = size or max(1, facts["top"] or 1)
    known = slim.filter(F.col("__source").isNotNull() & (F.col("__tokens") > 0))
    held, _ = store(known.groupBy("__source").agg(F.sum("__tokens").alias("held")), "held")
    goals = targets(mix, key, source, weight, cap, ratio).withColumnRenamed(source, "__source")
    goals, _ = store(shared_out(goals, held, key, "__source", facts["t"]), "goals")
    placed, _ = store(blocks(known, held, "__id", "__source", "__tokens", size, max(1, facts["n"] // 20_000), seed), "blocks")
    n_blocks = F.greatest(F.lit(1), F.round(F.col("held") / size)).cast("bigint")
    full = F.floor(F.col("wanted") / F.greatest("held", F.lit(1)))
    needs = goals.filter("wanted > 0").select(key, "__source", full.alias("full"), (F.col("wanted") - full * F.col("held")).alias("rest"), n_blocks.alias("n_blocks"), "held")
    needs = needs.withColumn("turns", F.col("full") * F.col("n_blocks") + F.ceil(F.col("rest") * F.col("n_blocks") / F.col("held")))
    turns = schedule(needs, key, "__source").join(needs.select(key, "__source", "n_blocks", "full", "rest"), [key, "__source"])
    turns = turns.select(key, "__source", "slot", F.floor(F.col("turn") / F.col("n_blocks")).alias("round"), (F.col("turn") % F.col("n_blocks")).alias("block"), "full", "rest")
    # A block's documents are bounded by its tokens, so no (source, block) is hot.
    taken = turns.join(placed.drop("n_blocks"), ["__source", "block"]).filter((F.col("round") < F.col("full")) | (F.col("middle") < F.col("rest")))
    chosen = taken.select(key, "slot", F.col("__id").alias(id), F.col("__source").alias(source), F.col("__tokens").alias("tokens"), F.col("round").cast("int").alias("round"))
    chosen, _ = store(chosen, "chosen")
    reached = chosen.groupBy(key, source).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows"), (F.max("round") + 1).alias("most_times"))
    own = W.partitionBy(key)
    report = (
        goals.withColumnRenamed("__source", source)
        .join(reached, [key, source], "left")
        .select(
            key,
            source,
            F.col("share").alias("target_share"),
            F.round(F.col("share") * F.col("ratio") * F.lit(float(facts["t"]))).cast("bigint").alias("target_tokens"),
            F.col("wanted").alias("wanted_tokens"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
            F.coalesce("most_times", F.lit(0)).alias("most_times"),
            F.col("cap").alias("max_repeats"),
            F.col("held").alias("held_tokens"),
        )
        .withColumn("share_reached", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(own)), F.lit(0.0)))
        .withColumn("limited", F.when(F.col("held_tokens") == 0, "no documents").when(F.col("held_tokens") * F.col("max_repeats") < F.col("target_tokens"), "repeats").otherwise(""))
    )
    return chosen, report
