"""Structured Streaming forms of three batch operators. All are additions: the batch forms are the reference."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.functions.shipping import ship

ship(__name__)


def live_trace_counts(calls: DataFrame, by: list[str], addr: str, order: str, thread: str) -> DataFrame:
    """Running calls, first place and thread there, by profile and address (update or complete mode)."""
    first = F.min(F.struct(F.col(order).alias("o"), F.col(thread).alias("t")))
    g = calls.filter(F.col(addr).isNotNull()).groupBy(*by, addr).agg(F.count(F.lit(1)).alias("n_calls"), first.alias("f"))
    return g.select(*by, addr, "n_calls", F.col("f.o").alias("first_seq"), F.col("f.t").alias("first_thread"))


def windowed_usage(events: DataFrame, at: str, by: list[str], measures: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sums of measures in event-time windows; rows later than ``late`` are dropped by the watermark."""
    g = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by)
    sums = g.agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(m).alias(f"sum_{m}") for m in measures])
    return sums.select(F.col("w.start").alias("window_start"), *by, "n_rows", *[f"sum_{m}" for m in measures])


def live_verdicts(events: DataFrame, id: str) -> DataFrame:
    """The verdict of each (log, address) so far, from the rows of ``log_events`` as they arrive (update mode).

    State is three numbers and a detail for each key: the last counts and the
    last line of each outcome.
    """
    names = ["d", "o", "k", "c", "compared", "skipped", "detail"]
    state = "d bigint, o bigint, k bigint, c bigint, compared bigint, skipped bigint, detail string"
    kinds = dict(events.dtypes)
    out = f"`{id}` {kinds[id]}, addr bigint, result string, compared bigint, skipped bigint, detail string"

    def fold(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(names, held.get)) if held.exists else {"d": -1, "o": -1, "k": -1, "c": -1, "compared": 0, "skipped": 0, "detail": None}
        for f in frames:
            for row in f.sort_values("n").itertuples():
                n = int(row.n)
                if pd.notna(row.compared) and n > s["c"]:
                    s |= {"c": n, "compared": int(row.compared), "skipped": int(row.skipped)}
                if row.event == "diverged" and n > s["d"]:
                    s |= {"d": n, "detail": row.detail}
                if row.event == "overflow":
                    s["o"] = max(s["o"], n)
                if row.event == "clean":
                    s["k"] = max(s["k"], n)
        held.update(tuple(s[x] for x in names))
        if s["d"] >= 0 and s["d"] > s["o"]:
            result = "diverged"
        elif s["o"] >= 0:
            result = "verified" if s["k"] > s["o"] else "overflow"
        else:
            result = "verified" if s["k"] >= 0 or s["compared"] > 0 else "uncalled"
        if result == "verified" and not s["compared"]:
            result = "uncalled"
        yield pd.DataFrame([(*key, result, s["compared"], s["skipped"], s["detail"])], columns=[id, "addr", "result", "compared", "skipped", "detail"])

    rows = events.filter(F.col("addr").isNotNull() & (F.col("compared").isNotNull() | F.col("event").isNotNull()))
    return rows.groupBy(id, "addr").applyInPandasWithState(fold, out, state, "update", GroupStateTimeout.NoTimeout)
