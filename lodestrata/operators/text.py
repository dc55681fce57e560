"""Text views: normalising, summarising, eliding, collapsing, budgeting, packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.scalars import let, split_lines, token_estimate
from lodestrata.operators.skew import skew_join

#: Spelling of decompiler types by width.
WIDTH_TYPES = {"undefined8": "u64", "undefined4": "u32", "undefined2": "u16", "undefined1": "u8", "undefined": "u8", "ulonglong": "u64", "longlong": "s64", "uint": "u32", "ushort": "u16", "uchar": "u8", "byte": "u8"}
DECLARATION = r"^\s*(?:[A-Za-z_]\w*\s+)+\**\w+(?:\s*\[\d+\])?;\s*$"
FRAME_HELPERS = r"__(?:save|rest|keep)_?\w*"


def normalise_c(text: Column) -> Column:
    """C without blank and declaration lines, types spelled by width."""
    kept = F.filter(split_lines(text), lambda x: (F.trim(x) != "") & ~(x.rlike(DECLARATION) & ~x.rlike(r"^\s*(?:return|goto)\b")))
    out = F.array_join(kept, "\n")
    for a, b in WIDTH_TYPES.items():
        out = F.regexp_replace(out, rf"\b{a}\b", b)
    return out


def annotate(text: Column, names: Column) -> Column:
    """Append to each line the names of the offsets it adds, ``+ 0x10)``, from a map of hex text to name; each once."""
    def one(line: Column) -> Column:
        found = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(line, F.lit(r"\+ (0x[0-9a-f]+|\d+)\)"), F.lit(1)), lambda k: F.try_element_at(names, k)), lambda x: x.isNotNull()))
        return F.when(F.size(found) > 0, F.concat(line, F.lit(" // "), F.array_join(found, ", "))).otherwise(line)

    return F.array_join(F.transform(split_lines(text), one), "\n")


def signature(text: Column) -> Column:
    """The first line that is neither blank nor comment, where it looks like a function head; else empty."""
    first = F.get(F.filter(split_lines(text), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^(?:/[/*]|\*)")), F.lit(0))
    return F.coalesce(F.when(first.rlike(r"^[A-Za-z_][\w\s*]*\w\s*\([^;]*\)?\s*\{?\s*$"), F.trim(first)), F.lit(""))


def usable(text: Column) -> Column:
    """Not blank and without the mark of a failed decompilation."""
    return (F.trim(F.coalesce(text, F.lit(""))) != "") & ~F.coalesce(text, F.lit("")).contains("halt_baddata")


def unresolved_branch(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"(?i)\b(?:unrecovered|UNRECOVERED_JUMPTABLE|goto code_r0x)")


def elide(text: Column, most: int) -> Column:
    """At most ``most`` lines: the head two thirds, one mark of what is left out, the tail."""
    head = 2 * (most - 1) // 3
    tail = most - 1 - head

    def cut(ls: Column) -> Column:
        mark = F.format_string("... %d lines elided ...", F.size(ls) - head - tail)
        return F.when(F.size(ls) <= most, ls).otherwise(F.concat(F.slice(ls, F.lit(1), F.lit(head)), F.array(mark), F.slice(ls, F.size(ls) - tail + 1, F.lit(tail))))

    return F.array_join(let(split_lines(text), cut), "\n")


def summary(text: Column, enough: int = 260, most: int = 300) -> Column:
    """The prose of a note: no blanks and headings, up to a code fence or enough characters, joined, capped."""
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("done"))

    def step(acc: Column, line: Column) -> Column:
        t = F.trim(line)
        fence = t.startswith("```")
        skip = (t == "") | t.startswith("#")
        joined = F.when(acc["s"] == "", t).otherwise(F.concat(acc["s"], F.lit(" "), t))
        s = F.when(acc["done"] | fence | skip, acc["s"]).otherwise(joined)
        return F.struct(s.alias("s"), (acc["done"] | fence | (F.char_length(s) > enough)).alias("done"))

    return F.substring(F.aggregate(split_lines(text), start, step)["s"], 1, most)


def citations(text: Column) -> Column:
    """Distinct addresses a text names as ``sub_`` and eight hex digits, in order, as numbers."""
    return F.transform(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\bsub_([0-9A-Fa-f]{8})\b"), F.lit(1)), lambda x: F.upper(x))), lambda x: F.conv(x, 16, 10).cast("bigint"))


def lenient_json(text: Column) -> Column:
    """The outermost braces of a text that may hold prose or fences around them; null without."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def collapse_listing(df: DataFrame, id: str, body: str, names: DataFrame) -> DataFrame:
    """(id, text): a listing as its mnemonics, frame helpers dropped, branch targets named.

    ``names`` has ``addr`` and ``name``, one row an address.
    """
    rows = df.select(id, F.posexplode(F.regexp_extract_all(body, F.lit(r"(?md)^[ \t]*// ?([a-z][a-z0-9_.]*[^\n]*)"), F.lit(1))).alias("n", "op"))
    target = F.conv(F.nullif(F.regexp_extract("op", r"0x([0-9a-fA-F]{8})", 1), F.lit("")), 16, 10).cast("bigint")
    named = rows.withColumn("addr", target).join(names.select("addr", "name"), "addr", "left")
    text = F.when(F.col("name").isNotNull(), F.regexp_replace("op", F.lit(r"0x[0-9a-fA-F]{8}"), F.col("name"))).otherwise(F.col("op"))
    kept = named.filter(~F.coalesce(F.col("name").rlike(f"^{FRAME_HELPERS}$"), F.lit(False))).select(id, "n", text.alias("t"))
    return kept.groupBy(id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n").alias("text"))


def within_budget(df: DataFrame, by: list[str], order: list[str], text: str, budget: int) -> DataFrame:
    """Rows in order while the estimated tokens before them stay below the budget."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("tokens_before", F.coalesce(F.sum(token_estimate(F.col(text))).over(w), F.lit(0))).filter(F.col("tokens_before") < budget)


def packet_facts(functions: DataFrame, edges: DataFrame, constants: DataFrame, addr: str, most_constants: int = 8, most_siblings: int = 2) -> DataFrame:
    """(addr, n_indirect, constants, siblings) for ``packets``.

    ``functions``: addr, name, status, family_id, hot; ``constants``: addr, value.
    Constants that are functions are named; siblings are the hottest ported
    functions of the same family.
    """
    names = functions.select(F.col(addr).alias("value"), "name")
    least = constants.distinct().withColumn("rn", F.row_number().over(W.partitionBy(addr).orderBy("value"))).filter(F.col("rn") <= most_constants)
    named = skew_join(least, names, ["value"], "left").withColumn("t", F.concat(F.format_string("0x%08X", "value"), F.coalesce(F.concat(F.lit(" ("), "name", F.lit(")")), F.lit(""))))
    values = named.groupBy(addr).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "t"))), lambda x: x["t"]), " ").alias("constants"))
    indirect = edges.filter(F.col("kind") == "indirect").groupBy(F.col("caller").alias(addr)).agg(F.count(F.lit(1)).alias("n_indirect"))
    ported = functions.filter(F.col("status").isin("verified", "promoted") & F.col("family_id").isNotNull())
    rank = F.row_number().over(W.partitionBy("family_id").orderBy(F.coalesce("hot", F.lit(0)).desc(), addr))
    spelled = F.concat(F.format_string("sub_%08X", F.col(addr)), F.coalesce(F.concat(F.lit(" ("), "name", F.lit(")")), F.lit("")))
    first = ported.withColumn("rn", rank).filter(F.col("rn") <= most_siblings + 1).groupBy("family_id").agg(F.array_sort(F.collect_list(F.struct("rn", F.col(addr).alias("a"), spelled.alias("t")))).alias("kin"))
    others = F.slice(F.filter("kin", lambda x: x["a"] != F.col(addr)), 1, most_siblings)
    kin = skew_join(functions.filter(F.col("family_id").isNotNull()).select(addr, "family_id"), first, ["family_id"]).select(addr, F.array_join(F.transform(others, lambda x: x["t"]), " ").alias("siblings"))
    return functions.select(addr).join(indirect, addr, "left").join(values, addr, "left").join(kin, addr, "left").select(addr, "n_indirect", "constants", F.nullif("siblings", F.lit("")).alias("siblings"))


def marked(edges: DataFrame, functions: DataFrame, addr: str) -> DataFrame:
    """Edges with the status of the callee in its name: ``[ported]`` or a gate."""
    status = functions.select(F.col(addr).alias("callee"), F.when(F.col("status").isin("verified", "promoted"), " [ported]").when(F.col("status").isin("gate1", "gate2", "gate3"), F.concat(F.lit(" ["), "status", F.lit("]"))).alias("mark"))
    return skew_join(edges, status.filter("mark is not null"), ["callee"], "left").withColumn("callee_name", F.concat("callee_name", F.coalesce("mark", F.lit("")))).drop("mark")


def packets(functions: DataFrame, edges: DataFrame, bodies: DataFrame, addr: str, most_tokens: int, most_callees: int = 12, facts: DataFrame | None = None, keep_last: bool = False) -> DataFrame:
    """(addr, packet, tokens, dropped): head, callees by kind and site, the body; the body goes when over budget.

    With ``facts`` (see ``packet_facts``) lines of constants and siblings and
    the number of indirect calls follow. With ``keep_last`` the body goes only
    where another remains: the column ``c`` of ``bodies``, if there is one.

    ``functions``: addr, name, lines, tier; ``edges``: caller, callee, callee_name,
    kind, site_line; ``bodies``: addr, body. One wide join instead of a lookup
    for each part.
    """
    ranked = edges.filter(~F.col("kind").isin("helper", "indirect")).select("caller", "callee", "callee_name", "kind", "site_line").distinct()
    rn = F.row_number().over(W.partitionBy("caller").orderBy("kind", "site_line", "callee", "callee_name"))
    top = ranked.withColumn("rn", rn).filter(F.col("rn") <= most_callees)
    names = top.groupBy(F.col("caller").alias(addr)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "callee_name"))), lambda x: x["callee_name"]), " ").alias("callees"))
    j = functions.join(names, addr, "left").join(bodies, addr, "left")
    head = F.concat(F.lit("FUNCTION "), F.coalesce("name", F.format_string("sub_%08X", F.col(addr))), F.lit(" lines="), F.coalesce(F.col("lines").cast("string"), F.lit("?")), F.lit(" tier="), F.coalesce("tier", F.lit("?")))
    base = F.concat(head, F.lit("\nCALLEES "), F.coalesce("callees", F.lit("")))
    if facts is not None:
        j = j.join(facts, addr, "left")
        line = lambda label, c: F.coalesce(F.concat(F.lit(f"\n{label} "), c), F.lit(""))
        base = F.concat(base, F.coalesce(F.concat(F.lit(" | "), F.col("n_indirect").cast("string"), F.lit(" indirect")), F.lit("")), line("CONSTANTS", "constants"), line("SIBLINGS", "siblings"))
    if "c" in j.columns:
        base = F.concat(base, F.coalesce(F.concat(F.lit("\n\n"), "c"), F.lit("")))
    full = F.concat(base, F.lit("\n\n"), F.coalesce("body", F.lit("")))
    over = token_estimate(full) > most_tokens
    if keep_last:
        over = over & (F.col("c").isNotNull() if "c" in j.columns else F.lit(False))
    text = F.when(over, base).otherwise(full)
    return j.select(addr, text.alias("packet"), token_estimate(text).alias("tokens"), F.when(over & F.col("body").isNotNull(), F.array(F.lit("body"))).otherwise(F.array().cast("array<string>")).alias("dropped"))
