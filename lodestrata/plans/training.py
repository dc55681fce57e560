"""Queries of the general training-data problems over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.jsontree import with_leaf_map
from lodestrata.functions.scalars import plain, unsigned32
from lodestrata.operators import drift, nested, orphans
from lodestrata.operators.evidence import current_rows
from lodestrata.shared import store, table

#: Figures of the usage objects that the typed table has a column for, by one path of each.
FIGURES = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "cached_input_tokens", "reasoning_output_tokens")


def usage_maps(spark: SparkSession, d: str) -> DataFrame:
    """The path-value maps of the usage objects, parsed once and stored."""
    rows = table(spark, d, "provider_event").select("event_id", "feed", "file_no", "line_no", "body")
    return store(with_leaf_map(rows, "body", "usage"), "usage")[0]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of shape of the usage objects between the files of a feed."""
    return drift.shape_changes(usage_maps(spark, d), "feed", "file_no").select("feed", "file_no", "field", "change").distinct()


def _typed(spark: SparkSession, d: str) -> DataFrame:
    maps = usage_maps(spark, d)
    known = drift.spellings(drift.shape_changes(maps, "feed", "file_no"), [f"usage.{f}" for f in FIGURES])
    known = drift.with_strays(known, maps)
    return drift.typed_columns(maps.filter(F.col("leaves").isNotNull()), {f: known[f"usage.{f}"] for f in FIGURES})


def p1_usage(spark: SparkSession, d: str) -> DataFrame:
    """One consistent row of usage figures for each record, with its failed casts."""
    return _typed(spark, d).withColumn("failed_casts", F.to_json("failed_casts")).distinct()


def p1_casts(spark: SparkSession, d: str) -> DataFrame:
    """Values of the figures that could not be cast, by feed, path and kind."""
    bad = _typed(spark, d).select("feed", "event_id", F.explode("failed_casts").alias("f")).select("feed", "event_id", "f.*").distinct()
    return bad.groupBy("feed", "path", "kind").agg(F.count(F.lit(1)).alias("n_failed"), F.min("raw").alias("example"))


def all_references(spark: SparkSession, d: str) -> DataFrame:
    """The references of three tables as ref_table, ref_id, addr (modulo 2^32), at."""
    spec = [("xref", "xref_id", "callee", "noted_at"), ("field_evidence", "id", "function_addr", "created_at"), ("port", "port_id", "addr", "updated_at")]
    parts = [
        table(spark, d, t).select(F.lit(t).alias("ref_table"), F.col(i).alias("ref_id"), F.nullif(unsigned32(F.col(a)), F.lit(0).cast("bigint")).alias("addr"), F.col(at).alias("at"))
        for t, i, a, at in spec
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def all_records(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that exist, and from when to when: functions by their current row, runtime symbols for ever."""
    functions = table(spark, d, "guest_function").select(unsigned32(F.col("addr")).alias("addr"), "imported_at", "retired_at", "updated_at")
    current = current_rows(functions, "addr", "updated_at", ["imported_at", "retired_at"])
    always = F.lit(None).cast("timestamp_ntz")
    symbols = table(spark, d, "runtime_symbol").select(unsigned32(F.col("addr")).alias("addr"), always.alias("imported_at"), always.alias("retired_at"))
    return current.select("addr", F.col("imported_at").cast("timestamp_ntz"), F.col("retired_at").cast("timestamp_ntz")).unionAll(symbols)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = all_references(spark, d).withColumn("at", F.col("at").cast("timestamp_ntz"))
    return orphans.orphan_references(refs, all_records(spark, d), ["addr"], match="simple", at="at", since="imported_at", until="retired_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """References whose address neither table held at their time."""
    return _orphans(spark, d).select("ref_table", "ref_id").distinct()


def p3_periods(spark: SparkSession, d: str) -> DataFrame:
    """Orphans by table, month and reason: n_orphans."""
    found = _orphans(spark, d).distinct()
    why = orphans.orphan_reason(found, current_rows(all_records(spark, d), "addr", "imported_at", ["retired_at", "imported_at"]), "addr", "at", "addr", "imported_at", "retired_at")
    return why.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("period"), "reason").agg(F.count(F.lit(1)).alias("n_orphans"))


def p3_named(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose callee, by address and name as far as either is given, is no version of a function and no runtime symbol."""
    named = lambda t, a, n: table(spark, d, t).select(F.nullif(unsigned32(F.col(a)), F.lit(0).cast("bigint")).alias("addr"), F.nullif(F.col(n), F.lit("")).alias("name"))
    known = named("guest_function", "addr", "name").unionAll(named("runtime_symbol", "addr", "name"))
    refs = table(spark, d, "xref").select("xref_id", F.nullif(unsigned32(F.col("callee")), F.lit(0).cast("bigint")).alias("addr"), F.nullif("callee_name", F.lit("")).alias("name")).distinct()
    return orphans.orphan_references(refs, known, ["addr", "name"], match="partial")


def body_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "provider_event").filter(plain(F.col("provider")) == "claude").select("event_id", "body")
    return nested.nodes(rows, "body", ("structured_output",))


def body_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables of all schema paths of the bodies, stored."""
    return store(nested.tables(body_nodes(spark, d), "event_id"), "tables")[0]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts, costs and addresses of the bodies, each by its event and its place or name there."""
    t = body_tables(spark, d)
    texts = nested.text_blocks(t, "event_id").select("event_id", F.lit("text").alias("child"), F.col("item").cast("string").alias("item"))
    costs = nested.keyed_costs(t, "event_id").select("event_id", F.lit("cost").alias("child"), "item")
    addrs = nested.addresses(t, "event_id").select("event_id", F.lit("addr").alias("child"), "item")
    return texts.unionAll(costs.unionAll(addrs).distinct())


def _linked(rows: DataFrame, *cols) -> DataFrame:
    return rows.select("event_id", nested.dewey(F.col("label")).alias("label"), nested.dewey(F.col("parent")).alias("parent"), *cols)


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of texts: event_id, label, parent, item, text."""
    return _linked(nested.text_blocks(body_tables(spark, d), "event_id"), "item", "text")


def p5_costs(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of costs: event_id, label, parent, model, cost."""
    return _linked(nested.keyed_costs(body_tables(spark, d), "event_id"), F.col("item").alias("model"), F.col("cost").cast("double").alias("cost"))


def p5_addresses(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of addresses: event_id, label, parent, addr."""
    return _linked(nested.addresses(body_tables(spark, d), "event_id"), F.col("item").alias("addr"))


def p5_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every flat table by its schema path: its rows, how many hang on a row of another table, its columns."""
    # Names and places alone are counted; values need not be carried to the rows.
    t = store(nested.whole_tables(body_nodes(spark, d).withColumn("raw", F.lit(None).cast("string")), "event_id"), "tables")[0]
    rows = t.groupBy("schema_path").agg(F.count(F.lit(1)).alias("n_rows"), F.count("parent").alias("n_linked"))
    names = t.select("schema_path", F.explode(F.map_keys("fields")).alias("name")).distinct().groupBy("schema_path").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("fields"))
    return rows.join(names, "schema_path", "left").withColumn("fields", F.coalesce("fields", F.lit("")))


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by schema path and kind, of each event once."""
    n = body_nodes(spark, d).select("event_id", "label", "schema_path", "kind").distinct()
    return n.groupBy("schema_path", "kind").agg(F.count(F.lit(1)).alias("n_nodes"))


QUERIES = {f.__name__: f for f in (p1_found, p1_usage, p1_casts, p3_found, p3_periods, p3_named, p5_found, p5_texts, p5_costs, p5_addresses, p5_tables, p5_nodes)}

_RECORDS = "cur AS (SELECT addr & 4294967295 AS a, arg_max(imported_at, updated_at) AS since, max(updated_at) AS v FROM guest_function GROUP BY 1), ret AS (SELECT DISTINCT addr & 4294967295 AS a, retired_at AS until, updated_at AS v FROM guest_function), live AS (SELECT a, since, until FROM cur JOIN ret USING (a, v))"
_REFS = "refs AS (SELECT 'xref' AS ref_table, xref_id AS ref_id, callee & 4294967295 AS a, noted_at AS ts FROM xref UNION ALL SELECT 'field_evidence', id, function_addr & 4294967295, created_at FROM field_evidence UNION ALL SELECT 'port', port_id, addr & 4294967295, updated_at FROM port)"
_ORPHANS = f"WITH {_RECORDS}, {_REFS}, orph AS (SELECT DISTINCT ref_table, ref_id, refs.a, ts, CASE WHEN live.a IS NULL THEN 'missing' WHEN since > ts THEN 'early' ELSE 'deleted' END AS reason FROM refs LEFT JOIN live USING (a) WHERE refs.a IS NOT NULL AND refs.a <> 0 AND refs.a NOT IN (SELECT addr & 4294967295 FROM runtime_symbol) AND (live.a IS NULL OR since > ts OR until <= ts))"
SQL = {
    "p3_named": """WITH k AS (SELECT nullif(addr & 4294967295, 0) AS a, nullif(name, '') AS n FROM guest_function UNION SELECT nullif(addr & 4294967295, 0), nullif(name, '') FROM runtime_symbol), r AS (SELECT DISTINCT xref_id, nullif(callee & 4294967295, 0) AS addr, nullif(callee_name, '') AS name FROM xref)
 SELECT * FROM r WHERE (addr IS NOT NULL AND name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE a = addr AND n = name)) OR (addr IS NULL AND name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE n = name)) OR (addr IS NOT NULL AND name IS NULL AND NOT EXISTS (SELECT 1 FROM k WHERE a = addr))""",
    "p3_found": f"{_ORPHANS} SELECT DISTINCT ref_table, ref_id FROM orph",
    "p3_periods": f"{_ORPHANS} SELECT ref_table, strftime(ts, '%Y-%m') AS period, reason, count(*) AS n_orphans FROM orph GROUP BY ALL",
}
