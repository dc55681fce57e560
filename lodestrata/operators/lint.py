"""Answer lint: every problem of a row at once, as an array of findings.

Checks are data: a name, a severity, a condition and a message. A condition
that is null finds nothing. The checks here are those of shape (addresses,
braces, windows and their budgets); callers add their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import address_of


@dataclass(frozen=True)
class Check:
    name: str
    condition: Column
    message: Column
    severity: str = "error"


def shape_checks(addr: str = "addr", expected: str = "expected", code: str = "code", windows: str = "windows", note: str = "note", spans: int = 32, total_bytes: int = 32768) -> list[Check]:
    """Checks of an answer: ``windows`` is an array of structs with ``base`` and ``len``."""
    text = F.coalesce(F.col(code), F.lit(""))
    opened, closed = F.regexp_count(text, F.lit(r"\{")), F.regexp_count(text, F.lit(r"\}"))
    held = F.aggregate(F.coalesce(F.col(windows), F.array().cast("array<struct<base:string,len:bigint>>")), F.lit(0).cast("bigint"), lambda a, w: a + F.coalesce(w["len"], F.lit(0)))
    n = F.coalesce(F.size(windows), F.lit(0))
    got = address_of(F.col(addr))
    return [
        Check("addr", got.isNull(), F.concat(F.lit("not an address: "), F.coalesce(addr, F.lit("null")))),
        Check("other_addr", got != F.col(expected), F.format_string("answered for sub_%08X", got)),
        Check("code", F.trim(text) == "", F.lit("the body is empty")),
        Check("braces", opened != closed, F.format_string("%d open, %d close", opened, closed)),
        Check("window_spans", n > spans, F.format_string("%d spans", n)),
        Check("window_bytes", held > total_bytes, F.format_string("%d bytes", held)),
        Check("window_length", F.exists(windows, lambda w: w["len"] <= 0), F.lit("a window of no length")),
        Check("window_base", F.exists(windows, lambda w: F.coalesce(w["base"], F.lit("")) == ""), F.lit("a window without a base")),
        Check("note_length", F.char_length(note) > 300, F.lit("the note is too long"), "warn"),
    ]


def lint(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Append ``issues`` (name, severity, message) and ``ok`` (no error among them)."""
    each = F.array(*[F.when(F.coalesce(c.condition, F.lit(False)), F.struct(F.lit(c.name).alias("name"), F.lit(c.severity).alias("severity"), c.message.alias("message"))) for c in checks])
    return df.withColumn("issues", F.filter(each, lambda x: x.isNotNull())).withColumn("ok", ~F.exists("issues", lambda x: x["severity"] == "error"))
