"""Session logs folded into verdicts, controls, weakest coverage, staleness.

The fold is a reduction, not a walk: for each address of a log the line
numbers of its events decide the outcome, so it is one aggregation whatever
the length of a log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import split_lines

#: The forms of log lines.
ADDRESS = r"(?i)\bsub_([0-9a-f]{8})\b"
COUNTS = r"(?i)\bsub_[0-9a-f]{8}\b.*?compared[=: ]+(\d+).*?skipped[=: ]+(\d+)"
DIVERGED = r"(?i)\bsub_[0-9a-f]{8}\b.*?\bdiverge\w*\b(.*)$"
OVERFLOW = r"(?i)\bsub_[0-9a-f]{8}\b.*?\boverflow\b"
CLEAN = r"(?i)\bsub_[0-9a-f]{8}\b.*?\b(?:clean|verified|no divergence)\b"
TOTAL = r"(?i)\b(\d+)\s+total calls\b"
DETAIL = 300


def log_events(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, n, addr, compared, skipped, event, detail): the lines of logs that name an address or a total."""
    rows = df.select(id, F.posexplode(split_lines(F.col(text))).alias("n", "line")).withColumn("line", F.trim("line"))
    event = F.when(F.col("line").rlike(DIVERGED), "diverged").when(F.col("line").rlike(OVERFLOW), "overflow").when(F.col("line").rlike(CLEAN), "clean")
    detail = F.trim(F.regexp_extract("line", DIVERGED, 1))
    return rows.select(
        id,
        "n",
        F.conv(F.nullif(F.regexp_extract("line", ADDRESS, 1), F.lit("")), 16, 10).cast("bigint").alias("addr"),
        F.nullif(F.regexp_extract("line", COUNTS, 1), F.lit("")).try_cast("bigint").alias("compared"),
        F.nullif(F.regexp_extract("line", COUNTS, 2), F.lit("")).try_cast("bigint").alias("skipped"),
        event.alias("event"),
        F.substring(F.when(F.col("line").rlike(DIVERGED), F.when(detail == "", F.col("line")).otherwise(detail)), 1, DETAIL).alias("detail"),
        F.nullif(F.regexp_extract("line", TOTAL, 1), F.lit("")).try_cast("bigint").alias("total"),
    ).filter("addr is not null or total is not null")


def fold_log(events: DataFrame, id: str) -> DataFrame:
    """One verdict for each log and address.

    Counts are those of the last count line. The result is that of the last
    ``diverged`` or ``overflow`` line; a ``clean`` line after an overflow makes
    it ``verified`` again, after a divergence it doesn't; without any of them a
    positive count or a clean line makes it ``verified``. Verified with nothing
    compared is ``uncalled``.
    """
    own = events.filter(F.col("addr").isNotNull() & (F.col("compared").isNotNull() | F.col("event").isNotNull()))
    at = lambda cond: F.max(F.when(cond, F.col("n")))
    g = own.groupBy(id, "addr").agg(
        F.max(F.when(F.col("compared").isNotNull(), F.struct("n", "compared", "skipped"))).alias("c"),
        F.max(F.when(F.col("event") == "diverged", F.struct("n", "detail"))).alias("d"),
        at(F.col("event") == "overflow").alias("o"),
        at(F.col("event") == "clean").alias("k"),
        F.max(F.coalesce("compared", F.lit(0))).alias("any"),
    )
    never = F.lit(-1)
    d, o, k = F.coalesce("d.n", never), F.coalesce("o", never), F.coalesce("k", never)
    raw = F.when((d >= 0) & (d > o), "diverged").when((o >= 0) & (k > o), "verified").when(o >= 0, "overflow").when((k >= 0) | (F.col("any") > 0), "verified").otherwise("uncalled")
    compared = F.coalesce("c.compared", F.lit(0).cast("bigint"))
    result = F.when((raw == "verified") & (compared == 0), "uncalled").otherwise(raw)
    return g.select(id, "addr", result.alias("result"), compared.alias("compared"), F.coalesce("c.skipped", F.lit(0).cast("bigint")).alias("skipped"), F.col("d.detail").alias("detail"))


def log_totals(events: DataFrame, id: str) -> DataFrame:
    """The greatest total named in each log."""
    return events.filter("total is not null").groupBy(id).agg(F.max("total").alias("calls_total"))


def trust(controls: DataFrame, verdicts: DataFrame, id: str) -> DataFrame:
    """(id, trusted, missed): a session is trusted if it applied a control and every applied control diverged."""
    applied = controls.filter("applied").select(id, "addr").distinct()
    caught = verdicts.filter(F.col("result") == "diverged").select(id, "addr", F.lit(1).alias("hit"))
    g = applied.join(caught, [id, "addr"], "left").groupBy(id).agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    return controls.select(id).distinct().join(g, id, "left").select(id, F.coalesce(F.col("n") == F.col("hits"), F.lit(False)).alias("trusted"), F.coalesce(F.col("n") - F.col("hits"), F.lit(0)).alias("missed"))


def recordable(verdicts: DataFrame, trusted: DataFrame, controls: DataFrame, id: str) -> DataFrame:
    """Verdicts of trusted sessions, without those of control addresses."""
    good = trusted.filter("trusted").select(id)
    return verdicts.join(good, id, "left_semi").join(controls.select(id, "addr").distinct(), [id, "addr"], "left_anti")


def weakest(verdicts: DataFrame, sessions: DataFrame, id: str, result: str = "verified") -> DataFrame:
    """(addr, sessions, least): the least coverage of each address over trusted sessions with that result, null as 0."""
    good = sessions.filter("trusted").select(id)
    return verdicts.filter(F.col("result") == result).join(good, id, "left_semi").groupBy("addr").agg(F.count(F.lit(1)).alias("n_sessions"), F.min(F.coalesce("compared", F.lit(0))).alias("least"))


def stale(rows: DataFrame, build: str, latest: DataFrame) -> DataFrame:
    """Rows built by another build than the one that ``latest`` (one row, one column) names, or by none."""
    one = latest.select(F.col(latest.columns[0]).alias("__latest"))
    return rows.join(F.broadcast(one), ~F.col(build).eqNullSafe(F.col("__latest"))).drop("__latest")


def decided(functions: DataFrame, least: DataFrame, calls: int = 100, per_line: float = 1.0) -> DataFrame:
    """(addr, calls, lines, decision): ``held`` under ``calls`` calls or under ``per_line`` calls a line, else ``promoted``.

    ``functions``: addr and the line counts of its forms, of which the first
    that is neither null nor 0 counts (1 if none); ``least`` as of ``weakest``.
    Functions without coverage are left out.
    """
    forms = [F.nullif(F.col(c), F.lit(0)) for c in functions.columns if c != "addr"]
    j = functions.withColumn("lines", F.coalesce(*forms, F.lit(1))).join(least.select("addr", F.col("least").alias("calls")), "addr")
    held = (F.col("calls") < calls) | (F.col("calls") / F.col("lines") < per_line)
    return j.select("addr", "calls", "lines", F.when(held, "held").otherwise("promoted").alias("decision"))


def conclusive(result: str = "result", compared: str = "compared"):
    """Whether a verdict says anything: compared, and verified, diverged or partial."""
    return (F.coalesce(F.col(compared), F.lit(0)) > 0) & F.col(result).isin("verified", "diverged", "partial")
