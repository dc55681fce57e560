"""Readers of line-oriented files into typed tables.

Every reader gives a plain DataFrame with the file's path where that matters.
Lines are numbered within their file with windows over one file at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.scalars import address_of, hex8, split_lines
from lodestrata.operators import text as views
from lodestrata.operators.layout import place_fields

#: Sizes of the types a layout header may use.
TYPE_SIZES = {"u8": 1, "s8": 1, "uint8_t": 1, "int8_t": 1, "char": 1, "bool": 1, "u16": 2, "s16": 2, "uint16_t": 2, "int16_t": 2, "u32": 4, "s32": 4, "uint32_t": 4, "int32_t": 4, "float": 4, "int": 4, "ptr": 4, "void*": 4, "u64": 8, "s64": 8, "uint64_t": 8, "int64_t": 8, "double": 8, "vec4": 16}


def whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, text): each file as one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def line_table(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, n, line), n from 0."""
    return files.select(path, F.posexplode(split_lines(F.col(text))).alias("n", "line"))


def listing_functions(files: DataFrame, start: str, id: str = "path", text: str = "text") -> DataFrame:
    """Functions of a listing: id, addr, first, n_lines, body.

    A line that matches ``start`` (its group: the address) opens a function
    and closes one still open; it ends where braces, counted from there,
    balance after the first; one that never does has 0 lines.
    """
    rows = line_table(files, id, text)
    head = F.nullif(F.regexp_extract("line", start, 1), F.lit(""))
    inside = W.partitionBy(id).orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    seg = rows.withColumn("head", head).withColumn("seg", F.count("head").over(inside)).filter("seg > 0")
    here = W.partitionBy(id, "seg").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    opened, closed = F.regexp_count("line", F.lit(r"\{")), F.regexp_count("line", F.lit(r"\}"))
    depth = seg.withColumn("opened", F.sum(opened).over(here)).withColumn("depth", F.sum(opened - closed).over(here))
    ended = depth.withColumn("end", F.min(F.when((F.col("opened") > 0) & (F.col("depth") <= 0), F.col("n"))).over(W.partitionBy(id, "seg")))
    kept = ended.filter("end is null or n <= end")
    g = kept.groupBy(id, "seg").agg(F.max("head").alias("head"), F.min("n").alias("first"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("b"))
    return g.select(id, F.conv("head", 16, 10).cast("bigint").alias("addr"), F.col("first"), F.coalesce(F.col("end") - F.col("first") + 1, F.lit(0)).alias("n_lines"), F.array_join(F.transform("b", lambda x: x["line"]), "\n").alias("body"))


def call_edges(functions: DataFrame, id: str = "path") -> DataFrame:
    """Call sites of listing functions: caller, callee (0 if indirect), callee_name, kind, site_line.

    A direct site is a ``bl`` comment; its name is the call token on one of the
    three lines below it, or else the name any site of that address has, the
    first by place; indirect sites are ``bctrl`` comments.
    """
    rows = functions.select(id, F.col("addr").alias("caller"), "first", F.posexplode(F.split("body", "\n")).alias("k", "line")).withColumn("n", F.col("first") + F.col("k"))
    w = W.partitionBy(id, "caller", "first").orderBy("n")
    token = F.nullif(F.regexp_extract("line", r"^\s*([A-Za-z_]\w*)\s*\(\s*\w+\s*,", 1), F.lit(""))
    sites = rows.withColumn("token", token).withColumn("name", F.coalesce(*[F.lead("token", i).over(w) for i in (1, 2, 3)]))
    to = F.conv(F.nullif(F.regexp_extract("line", r"//\s*bl\s+0x([0-9A-Fa-f]{8})", 1), F.lit("")), 16, 10).cast("bigint")
    indirect = F.col("line").rlike(r"//\s*bctrl\b")
    calls = sites.withColumn("callee", F.when(indirect, F.lit(0).cast("bigint")).otherwise(to)).filter("callee is not null")
    known = calls.filter("name is not null and callee <> 0").groupBy("callee").agg(F.min_by("name", F.struct(id, "n")).alias("first_name"))
    named = calls.join(known, "callee", "left")
    final = F.when(F.col("callee") == 0, "(indirect)").otherwise(F.coalesce("name", "first_name"))
    return named.withColumn("callee_name", final).select(id, "caller", "callee", "callee_name", edge_kind(F.col("callee"), F.col("callee_name")).alias("kind"), F.col("n").cast("int").alias("site_line"))


def edge_kind(callee: Column, name: Column) -> Column:
    """indirect, unresolved (no name), import, helper or direct by the prefix of the name."""
    s = F.coalesce(name, F.lit(""))
    return F.when(callee == 0, "indirect").when(s == "", "unresolved").when(s.startswith("__imp__"), "import").when(s.startswith("__"), "helper").otherwise("direct")


def names(files: DataFrame) -> DataFrame:
    """(addr, name) of ``addr,name`` lines or ``"addr" = "name"`` lines; other lines are skipped."""
    rows = line_table(files)
    csv = r"^\s*([^,#=\"]+?)\s*,\s*([^,]+?)\s*$"
    toml = r"^\s*\"([^\"]+)\"\s*=\s*\"([^\"]+)\""
    pick = lambda i: F.coalesce(F.nullif(F.regexp_extract("line", toml, i), F.lit("")), F.nullif(F.regexp_extract("line", csv, i), F.lit("")))
    return rows.select(address_of(pick(1)).alias("addr"), pick(2).alias("name")).filter("addr is not null and name is not null")


def trace_lines(files: DataFrame) -> DataFrame:
    """(path, seq, addr, thread): tab-separated call lines; comments, blanks and lines without an address are skipped.

    The address is the first token of eight hex digits; the thread the first
    other token that is no number, at most 40 characters; seq counts the lines kept.
    """
    rows = line_table(files).filter((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    tokens = F.filter(F.transform(F.split("line", r"\t"), lambda x: F.trim(x)), lambda x: x != "")
    found = rows.withColumn("t", tokens).withColumn("a", F.get(F.filter("t", lambda x: hex8(x).isNotNull() & (x.rlike("[A-Fa-f]") | (F.size("t") == 1) | x.startswith("8"))), F.lit(0))).filter("a is not null")
    thread = F.get(F.filter("t", lambda x: (x != F.col("a")) & hex8(x).isNull() & x.try_cast("double").isNull()), F.lit(0))
    return found.select("path", F.row_number().over(W.partitionBy("path").orderBy("n")).cast("bigint").alias("seq"), address_of(F.col("a")).alias("addr"), F.substring(thread, 1, 40).alias("thread"))


def trace_counts(calls: DataFrame, by: list[str], addr: str = "addr", order: str = "seq", thread: str = "thread") -> DataFrame:
    """Calls, first place and the thread at that place, by profile and address."""
    first = F.min(F.struct(F.col(order).alias("o"), F.col(thread).alias("t")))
    g = calls.filter(F.col(addr).isNotNull()).groupBy(*by, addr).agg(F.count(F.lit(1)).alias("n_calls"), first.alias("f"))
    return g.select(*by, addr, "n_calls", F.col("f.o").alias("first_seq"), F.nullif("f.t", F.lit("")).alias("first_thread"))


def layout_header(files: DataFrame, preamble: int = 14) -> tuple[DataFrame, DataFrame]:
    """Structures of a C header: fields (path, struct, n, offset, size, ctype, name, total) and citations (path, struct, addr).

    ``struct Name {`` opens one, ``}`` closes it. A field is ``type name;`` or
    ``type name[n];`` with an optional ``+0xNN`` in a comment; without one it
    follows the field before. ``_pad`` and ``_unknown`` fields take space
    only. Citations are the addresses in the ``preamble`` lines above.
    """
    rows = line_table(files)
    opens = F.nullif(F.regexp_extract("line", r"^\s*(?:typedef\s+)?struct\s+(\w+)\s*\{", 1), F.lit(""))
    upto = W.partitionBy("path").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = rows.withColumn("opens", opens).withColumn("struct", F.last("opens", ignorenulls=True).over(upto)).withColumn("closes", F.col("line").rlike(r"^\s*\}"))
    inside = W.partitionBy("path", "struct").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    body = marked.filter("struct is not null and opens is null").withColumn("shut", F.max(F.col("closes").cast("int")).over(inside)).filter("shut = 0")
    shape = r"^\s*(?:const\s+)?([A-Za-z_]\w*\s*\**)\s*(\w+)\s*(?:\[(\w+)\])?\s*;"
    ctype = F.regexp_replace(F.regexp_extract("line", shape, 1), r"\s+", "")
    size = F.create_map(*[x for k, v in TYPE_SIZES.items() for x in (F.lit(k), F.lit(v))])
    many = F.regexp_extract("line", shape, 3)
    count = F.coalesce(F.when(many.startswith("0x"), F.conv(F.substring(many, 3, 16), 16, 10).cast("bigint")).otherwise(many.try_cast("bigint")), F.lit(1).cast("bigint"))
    at = F.conv(F.nullif(F.regexp_extract("line", r"\+0x([0-9A-Fa-f]+)", 1), F.lit("")), 16, 10).cast("bigint")
    fields = body.filter(F.col("line").rlike(shape)).select("path", "struct", "n", ctype.alias("ctype"), F.regexp_extract("line", shape, 2).alias("name"), at.alias("at"), (F.coalesce(F.when(ctype.endswith("*"), F.lit(4)), F.try_element_at(size, ctype), F.lit(4)) * count).alias("size"))
    keyed = fields.withColumn("owner", F.struct("path", "struct")).withColumn("emit", ~F.col("name").rlike("^_(?:pad|unknown)"))
    placed = place_fields(keyed, "owner", "n", "at", "size", "emit").select("owner", "n", "offset", "total")
    out = keyed.join(placed, ["owner", "n"]).select("path", "struct", "n", "offset", "size", "ctype", "name", "total")
    above = W.partitionBy("path").orderBy("n").rowsBetween(-preamble, -1)
    heads = marked.withColumn("addrs", F.array_distinct(F.flatten(F.collect_list(views.citations(F.col("line"))).over(above)))).filter("opens is not null")
    cited = heads.select("path", "struct", F.explode("addrs").alias("addr")).distinct()
    return out, cited


QUEUE_RECORD = "struct<status:string,tier:string,gate:string,gate1_reason:string,calls:struct<boot:bigint,play:bigint,map:bigint>,lines:int,thread:string,attempts:int,note:string,addr:string>"


def queue_json(files: DataFrame, text: str = "text") -> DataFrame:
    """Records of a queue file: a map by address or a list, bare or under ``functions``; missing keys are null."""
    inner = F.coalesce(F.get_json_object(text, "$.functions"), F.col(text))
    as_map = F.from_json(inner, f"map<string,{QUEUE_RECORD}>")
    as_list = F.from_json(inner, f"array<{QUEUE_RECORD}>")
    listed = F.trim(inner).startswith("[")
    pairs = F.when(listed, F.transform(as_list, lambda r: F.struct(r["addr"].alias("key"), r.alias("value")))).otherwise(F.map_entries(as_map))
    return files.select(F.explode(pairs).alias("e")).select(address_of(F.coalesce("e.key", "e.value.addr")).alias("addr"), F.col("e.value").alias("record")).filter("addr is not null")


def notes(files: DataFrame) -> DataFrame:
    """(addr, note) of files named ``sub_XXXXXXXX.md``."""
    return files.select(address_of(F.regexp_extract("path", r"(sub_[0-9A-Fa-f]{8})\.md$", 1)).alias("addr"), views.summary(F.col("text")).alias("note")).filter("addr is not null")


def decompiled(files: DataFrame) -> DataFrame:
    """(addr, signature, usable, unresolved, n_lines) of files named ``sub_XXXXXXXX.c``."""
    t = F.col("text")
    return files.select(address_of(F.regexp_extract("path", r"(sub_[0-9A-Fa-f]{8})\.c$", 1)).alias("addr"), views.signature(t).alias("signature"), views.usable(t).alias("usable"), views.unresolved_branch(t).alias("unresolved"), F.size(split_lines(t)).alias("n_lines")).filter("addr is not null")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kind, sha256) of binary files, the kind by magic."""
    b = spark.read.format("binaryFile").load(path)
    magic = F.hex(F.substring("content", 1, 4))
    return b.select("path", "length", F.when(magic == "58455832", "xex2").when(magic == "7F454C46", "elf").otherwise("raw").alias("kind"), F.sha2("content", 256).alias("sha256"))
