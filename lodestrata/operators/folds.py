"""Ordered folds a built-in can't express: constants a code body builds in registers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.functions.shipping import ship

ship(__name__)

#: The forms of instruction comments.
OP = re.compile(r"^[ \t]*// ?([a-z][a-z0-9_.]*)[ \t]*([^\n]*)$", re.M)
INDEXED = re.compile(r"^(-?\w+)\((r\d+)\)$")
MASK = 0xFFFFFFFF


def integer(text: str) -> int | None:
    try:
        return int(text, 0)
    except ValueError:
        return None


def lower_half(v: int) -> int:
    """The number from -2^15 up that equals ``v`` modulo 2^16."""
    return (v + 0x8000) % 0x10000 - 0x8000


def constants(body: str | None) -> list[int]:
    """Addresses and constants in order, each once.

    A load of an upper half starts a value; adding or or-ing a lower half, or
    a memory access through a known register, completes one; any other write
    forgets the register.
    """
    known: dict[str, int] = {}
    found: dict[int, None] = {}
    for op, rest in OP.findall(body or ""):
        args = [a.strip() for a in rest.split(",")] if rest.strip() else []
        target = args[0] if args and re.fullmatch(r"r\d+", args[0]) else None
        value = None
        if op in ("lis", "lil") and target and (n := integer(args[-1])) is not None:
            known[target] = (n << 16) & MASK
            continue
        if op in ("addi", "addic", "subi", "ori") and len(args) == 3 and args[1] in known and (n := integer(args[2])) is not None:
            step = n & 0xFFFF if op == "ori" else lower_half(-n if op == "subi" else n)
            value = known[args[1]] | step if op == "ori" else (known[args[1]] + step) & MASK
            known[target] = value
        elif len(args) == 2 and (m := INDEXED.match(args[1])):
            if m[2] in known and (n := integer(m[1])) is not None:
                value = (known[m[2]] + lower_half(n)) & MASK
            if target and not op.startswith("st"):
                known.pop(target, None)
        elif target and not op.startswith(("cmp", "st", "b", "mt")):
            known.pop(target, None)
        if value is not None:
            found.setdefault(value)
    return list(found)


def fold_constants(df: DataFrame, id: str, body: str) -> DataFrame:
    """(id, values): the constants of each body, in Arrow batches, no shuffle."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [constants(b) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.int64()))], [id, "values"])

    return df.select(id, body).mapInArrow(walk, f"`{id}` {dict(df.dtypes)[id]}, values array<bigint>")
