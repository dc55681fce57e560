"""Usage from provider event lines and transcripts.

Bodies are JSON lines of no dependable shape; figures are taken by path as
text and cast where they can be, so a changed type costs a null and no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def figure(body: str, *paths: str) -> Column:
    """The first of several JSON paths that holds a whole number, as a long; 0 without."""
    tries = [F.get_json_object(body, p).try_cast("decimal(38,6)").try_cast("bigint") for p in paths]
    return F.coalesce(*tries, F.lit(0).cast("bigint"))


def session_usage(events: DataFrame, file: list[str], order: str, body: str = "body") -> DataFrame:
    """One row a file of the first dialect: model and session of its start, usage and cost of its last result.

    Files without a result have null usage; unreadable lines count for nothing.
    """
    kind = F.get_json_object(body, "$.type")
    rows = events.select(*file, F.col(order).alias("o"), kind.alias("kind"), body)
    result = F.struct(
        "o",
        figure(body, "$.usage.input_tokens").alias("input_tokens"),
        figure(body, "$.usage.cache_read_input_tokens").alias("cache_read_tokens"),
        figure(body, "$.usage.cache_creation_input_tokens").alias("cache_write_tokens"),
        figure(body, "$.usage.output_tokens").alias("output_tokens"),
        F.get_json_object(body, "$.total_cost_usd").try_cast("decimal(18,6)").alias("cost_usd"),
        F.get_json_object(body, "$.is_error").alias("is_error"),
    )
    start = F.struct("o", F.get_json_object(body, "$.model").alias("model"), F.get_json_object(body, "$.session_id").alias("session_id"))
    g = rows.groupBy(*file).agg(F.min(F.when(F.col("kind") == "system", start)).alias("s"), F.max(F.when(F.col("kind") == "result", result)).alias("r"))
    return g.select(*file, "s.model", "s.session_id", *[F.col(f"r.{c}") for c in ("input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens", "cost_usd")], (F.col("r.is_error") == "true").alias("failed"))


def turn_usage(events: DataFrame, keep: list[str], body: str = "body") -> DataFrame:
    """One row a finished turn of the second dialect: fresh input without cached tokens, output with reasoning."""
    turns = events.filter(F.get_json_object(body, "$.type") == "turn.completed")
    cached = figure(body, "$.usage.cached_input_tokens")
    fresh = F.greatest(figure(body, "$.usage.input_tokens") - cached, F.lit(0).cast("bigint"))
    output = figure(body, "$.usage.output_tokens") + figure(body, "$.usage.reasoning_output_tokens")
    return turns.select(*keep, fresh.alias("input_tokens"), cached.alias("cache_read_tokens"), output.alias("output_tokens"))


def transcript_usage(lines: DataFrame, session: list[str], at: str, body: str = "body", since: str | None = None, until: str | None = None) -> DataFrame:
    """Sums by session over assistant records with a usage, dated within both ends; undated ones are kept."""
    usage = F.get_json_object(body, "$.message.usage")
    rows = lines.filter((F.get_json_object(body, "$.type") == "assistant") & usage.isNotNull() & (usage != "{}"))
    day = F.to_date(at)
    if since:
        rows = rows.filter(day.isNull() | (day >= F.lit(since).cast("date")))
    if until:
        rows = rows.filter(day.isNull() | (day <= F.lit(until).cast("date")))
    g = lambda p: F.sum(figure(body, f"$.message.usage.{p}"))
    return rows.groupBy(*session).agg(
        F.count(F.lit(1)).alias("n_records"), g("input_tokens").alias("input_tokens"), g("output_tokens").alias("output_tokens"), g("cache_read_input_tokens").alias("cache_read_tokens"), F.min(at).alias("first_at"), F.max(at).alias("last_at")
    )
