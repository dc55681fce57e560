"""Structured answers: shapes, defaults, pairing with what was asked, rendering.

An answer is JSON text of one record, a list of records, or an object with a
list under ``ports``. A null field takes its default, as an absent one does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import address_of, let

WINDOW = "struct<base:string,deref:array<bigint>,offset:bigint,len:bigint,length:bigint,why:string>"
RECORD = f"struct<addr:string,name:string,code:string,note:string,blocked:boolean,confidence:double,windows:array<{WINDOW}>,result_registers:array<string>>"


def records(payload: Column) -> Column:
    """The records of an answer in order; null where it can't be read."""

    def read(t: Column) -> Column:
        inner = F.coalesce(F.get_json_object(t, "$.ports"), t)
        return F.when(inner.startswith("["), F.from_json(inner, f"array<{RECORD}>")).when(inner.startswith("{"), F.array(F.from_json(inner, RECORD)))

    return let(F.trim(payload), read)


def with_defaults(r: Column) -> Column:
    """A record with the defaults of its missing fields; addr as a number, null if unreadable."""
    none = F.lit("")
    window = lambda w: F.struct(F.coalesce(w["base"], none).alias("base"), F.coalesce(w["deref"], F.array().cast("array<bigint>")).alias("deref"), F.coalesce(w["offset"], F.lit(0)).alias("offset"), F.coalesce(w["length"], w["len"], F.lit(0)).alias("len"), F.coalesce(w["why"], none).alias("why"))
    number = r["addr"].try_cast("decimal(38,0)").try_cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.struct(
        F.coalesce(address_of(r["addr"]), F.when(F.char_length(r["addr"]) > 8, number)).alias("addr"),
        *[F.coalesce(r[c], none).alias(c) for c in ("name", "code", "note")],
        F.coalesce(r["blocked"], F.lit(False)).alias("blocked"),
        F.coalesce(F.transform(r["windows"], window), F.array().cast("array<struct<base:string,deref:array<bigint>,offset:bigint,len:bigint,why:string>>")).alias("windows"),
        F.coalesce(r["result_registers"], F.array().cast("array<string>")).alias("result_registers"),
    )


def answers(df: DataFrame, id: str, payload: str) -> DataFrame:
    """(id, pos, fields of the record): one row a record."""
    rows = df.select(id, F.posexplode(records(F.col(payload))).alias("pos", "r")).filter("r is not null")
    return rows.withColumn("a", with_defaults(F.col("r"))).select(id, "pos", "a.*")


def paired(df: DataFrame, id: str, asked: str, payload: str) -> DataFrame:
    """(id, pos, asked, answer): records zipped to the addresses asked for, by position; none where the numbers differ."""
    got = df.withColumn("__r", records(F.col(payload))).filter(F.size("__r") == F.size(asked))
    pairs = got.withColumn("__p", F.arrays_zip(F.col(asked).alias("asked"), F.col("__r").alias("r"))).select(id, F.posexplode("__p").alias("pos", "p"))
    return pairs.select(id, "pos", F.col("p.asked").alias("asked"), with_defaults(F.col("p.r")).alias("answer"))


#: The words of the generated text.
LOAD, START, REGISTER = "LOAD_U32", "ctx.%s.u32", {"r": "Gpr", "f": "Fpr", "v": "Vr"}
RETURNS, NO_RETURN = {"r3": "kReturnR3", "f1": "kReturnF1", "fp1": "kReturnF1"}, "kReturnNone"


def address_expression(w: Column, load: str = LOAD) -> Column:
    """The address a window stands for as text: all loads open before its base, each step of ``deref`` closes one, its offset comes last."""

    def plus(n: Column) -> Column:
        return F.when(n == 0, F.lit("")).otherwise(F.concat(F.lit(" + "), n.cast("string")))

    closed = F.array_join(F.transform(w["deref"], lambda step: F.concat(plus(step), F.lit(")"))), "")
    return F.concat(F.repeat(F.lit(f"{load}("), F.size(w["deref"])), F.format_string(START, w["base"]), closed, plus(w["offset"]))


def result_mask(registers: Column) -> Column:
    """The registers to compare as text, the word for none where none is known."""
    returns = F.create_map(*[F.lit(x) for pair in RETURNS.items() for x in pair])
    banks = F.create_map(*[F.lit(x) for pair in REGISTER.items() for x in pair])
    named = F.transform(registers, lambda r: F.lower(F.trim(r)))
    numbered = F.filter(named, lambda r: F.try_element_at(returns, r).isNotNull() | r.rlike(f"^[{''.join(REGISTER)}][0-9]+$"))
    words = F.transform(numbered, lambda r: F.coalesce(F.try_element_at(returns, r), F.concat(F.try_element_at(banks, F.substring(r, 1, 1)), F.lit("("), F.substr(r, F.lit(2)), F.lit(")"))))
    return F.coalesce(F.nullif(F.array_join(words, " | "), F.lit("")), F.lit(NO_RETURN))


def render(answer: Column) -> Column:
    """A record as the text of an artifact: note, address, body, windows, mask."""
    spans = F.transform(answer["windows"], lambda w: F.concat(F.lit("  spec.write("), address_expression(w), F.lit(", "), w["len"].cast("string"), F.lit(");"), F.when(w["why"] != "", F.concat(F.lit("  // "), w["why"])).otherwise("")))
    note = F.when(answer["note"] != "", F.concat(F.lit("// "), F.substring(F.replace(answer["note"], F.lit("\n"), F.lit(" ")), 1, 300), F.lit("\n"))).otherwise("")
    return F.concat(note, F.format_string("// sub_%08X\n", answer["addr"]), answer["code"], F.lit("\n"), F.array_join(spans, "\n"), F.lit("\n// "), result_mask(answer["result_registers"]), F.lit("\n"))


def strict_schema(schema: dict) -> dict:
    """A JSON schema in which every property is required and optional ones may be null, at any depth."""
    if not isinstance(schema, dict):
        return schema
    out = {k: ({n: strict_schema(p) for n, p in v.items()} if k in ("properties", "$defs") else [strict_schema(x) for x in v] if k in ("anyOf", "oneOf", "allOf") else strict_schema(v) if k == "items" else v) for k, v in schema.items() if k != "default"}
    if "properties" in out:
        asked = set(schema.get("required", ()))
        for name, p in out["properties"].items():
            if name not in asked:
                kind = p.get("type")
                out["properties"][name] = p | {"type": [*kind, "null"] if isinstance(kind, list) else [kind, "null"]} if kind and kind != "null" else p if kind else {"anyOf": [p, {"type": "null"}]}
        out |= {"required": list(out["properties"]), "additionalProperties": False}
    return out
