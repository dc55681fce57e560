"""Queries of the core operators, bound to the domain tables, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.scalars import address_of, plain, split_lines, token_estimate, unsigned32
from lodestrata.operators import census, evidence, folds, graph, layout, ledger, similarity, text, verdicts, workqueue
from lodestrata.shared import table
from lodestrata.sources import events, files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- shared derivations, as DataFrames and as SQL ------------------------------------------------

FUNCTION_COLUMNS = ["name", "lifted_lines", "vmx128", "seed", "subsystem_id", "status", "gate", "tier", "difficulty", "family_id", "hot", "retired_at", "corpus_depth"]


def functions(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "guest_function").withColumn("addr", unsigned32(F.col("addr")))
    return evidence.current_rows(f, "addr", "updated_at", FUNCTION_COLUMNS)


def edges(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "xref").select("xref_id", "caller", "callee", "callee_name", "kind", "site_line").distinct()
    return x.withColumns({"caller": unsigned32(F.col("caller")), "callee": F.nullif(unsigned32(F.col("callee")), F.lit(0).cast("bigint"))})


def direct(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).filter((F.col("kind") == "direct") & F.col("callee").isNotNull())


def trace(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "trace")
    place = F.col("capture_id") * F.lit(1 << 32) + F.col("seq")
    return t.select("profile", place.alias("seq"), plain(F.col("thread")).alias("thread"), address_of(F.col("function")).alias("addr"))


CUR = "cur AS (SELECT * EXCLUDE (rn, addr), addr & 4294967295 AS addr FROM (SELECT *, row_number() OVER (PARTITION BY addr & 4294967295 ORDER BY updated_at DESC) AS rn FROM guest_function) WHERE rn = 1)"
EDGE = "e AS (SELECT DISTINCT xref_id, caller & 4294967295 AS caller, nullif(callee & 4294967295, 0) AS callee, callee_name, kind, site_line FROM xref), de AS (SELECT * FROM e WHERE kind = 'direct' AND callee IS NOT NULL)"
TRACE = """t AS (SELECT profile, capture_id * 4294967296 + seq AS seq, lower(trim(thread, chr(32) || chr(9) || chr(10) || chr(13))) AS thread,
 CASE WHEN regexp_full_match(s, '(0x|sub_)?[0-9a-f]{8}') THEN ('0x' || right(s, 8))::BIGINT END AS addr
 FROM (SELECT *, lower(trim(function, chr(32) || chr(9) || chr(10) || chr(13))) AS s FROM trace))"""


# --- traces --------------------------------------------------------------------------------------


@query(f"WITH {TRACE}, f AS (SELECT profile, addr, count(*) AS n_calls, min(seq) AS first_seq FROM t WHERE addr IS NOT NULL GROUP BY ALL) SELECT f.profile, f.addr, n_calls, first_seq, min(t.thread) AS first_thread FROM f JOIN t ON t.profile = f.profile AND t.addr = f.addr AND t.seq = f.first_seq GROUP BY ALL")
def trace_counts(spark, d):
    return files.trace_counts(trace(spark, d), ["profile"])


@query(f"WITH {TRACE}, g AS (SELECT addr, count(*) FILTER (profile = 'boot') AS calls_boot, count(*) FILTER (profile = 'play') AS calls_play, count(*) FILTER (profile = 'map') AS calls_map FROM t WHERE addr IS NOT NULL GROUP BY 1) SELECT *, greatest(calls_boot, calls_play, calls_map) AS hot FROM g")
def trace_pivot_hot(spark, d):
    g = trace(spark, d).filter("addr is not null").groupBy("addr").agg(*[F.count_if(F.col("profile") == p).alias(f"calls_{p}") for p in ("boot", "play", "map")])
    return g.withColumn("hot", F.greatest("calls_boot", "calls_play", "calls_map"))


@query(f"WITH {TRACE} SELECT thread, count(*) AS n_rows, count(DISTINCT addr) AS n_functions FROM t GROUP BY 1")
def trace_thread_hist(spark, d):
    return trace(spark, d).groupBy("thread").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("addr").alias("n_functions"))


# --- graph ---------------------------------------------------------------------------------------


@query(f"WITH {EDGE} SELECT callee AS node, count(*) AS degree FROM de GROUP BY 1")
def degree_in(spark, d):
    return graph.degrees(direct(spark, d).withColumnRenamed("callee", "node"), "node")


@query(f"WITH {EDGE} SELECT kind, count(*) AS n_rows FROM e GROUP BY 1")
def edge_kind_hist(spark, d):
    return workqueue.counts_by(edges(spark, d), {"kind": F.col("kind")})


@query(f"WITH {EDGE} SELECT node, other, direction, max(kind) AS kind FROM (SELECT caller AS node, callee AS other, 'out' AS direction, kind FROM e UNION ALL SELECT callee, caller, 'in', kind FROM e) WHERE node IS NOT NULL AND other IS NOT NULL GROUP BY ALL")
def neighbours(spark, d):
    return graph.neighbours(edges(spark, d), "caller", "callee", "kind")


def followed(spark, d):
    """Edges that a closure follows: resolved, to no helper or import."""
    symbols = table(spark, d, "runtime_symbol").select(unsigned32(F.col("addr")).alias("callee"))
    return direct(spark, d).join(symbols, "callee", "left_anti")


def reached(spark, d):
    return graph.closure(followed(spark, d), functions(spark, d).filter("seed").select("addr"), "caller", "callee", 3)


FOLLOW = f"{CUR}, {EDGE}, fe AS (SELECT DISTINCT caller, callee FROM de WHERE callee NOT IN (SELECT addr & 4294967295 FROM runtime_symbol)), l0 AS (SELECT DISTINCT addr AS node, 0 AS depth FROM cur WHERE seed), "
FOLLOW += ", ".join(f"l{i} AS (SELECT node, min(depth) AS depth FROM (SELECT * FROM l{i - 1} UNION ALL SELECT callee, {i} FROM fe JOIN l{i - 1} ON caller = node) GROUP BY 1)" for i in (1, 2, 3))


def runtime(spark, d):
    """Targets of the runtime: symbols, and functions flagged import or helper."""
    flagged = evidence.current_rows(table(spark, d, "guest_function").withColumn("addr", unsigned32(F.col("addr"))), "addr", "updated_at", ["is_import", "is_helper"]).filter("is_import or is_helper").select("addr")
    return table(spark, d, "runtime_symbol").select(unsigned32(F.col("addr")).alias("addr")).filter("addr is not null").unionAll(flagged).distinct()


def reached_whole(spark, d):
    """All that the seeds reach, at any depth, over edges that have a target, are of no stopped kind and lead to no runtime target."""
    follow = edges(spark, d).filter(F.col("callee").isNotNull() & ~F.col("kind").isin(*STOPS))
    follow = follow.join(runtime(spark, d).select(F.col("addr").alias("callee")), "callee", "left_anti")
    return graph.closure(follow, functions(spark, d).filter("seed").select("addr"), "caller", "callee")


STOPS = ("helper", "import", "indirect")
WHOLE = f"""{CUR}, {EDGE}, rt AS (SELECT addr & 4294967295 AS addr FROM runtime_symbol WHERE addr IS NOT NULL UNION SELECT addr FROM cur WHERE is_import OR is_helper),
 fe AS MATERIALIZED (SELECT DISTINCT caller, callee FROM e WHERE callee IS NOT NULL AND kind NOT IN {STOPS} AND callee NOT IN (SELECT addr FROM rt)),
 cl(node, depth) USING KEY (node) AS (SELECT DISTINCT addr, 0 FROM cur WHERE seed AND addr IS NOT NULL UNION (SELECT fe.callee, min(c.depth) + 1 FROM cl c JOIN fe ON fe.caller = c.node WHERE fe.callee NOT IN (SELECT node FROM recurring.cl) GROUP BY 1))"""


@query(f"WITH RECURSIVE {WHOLE} SELECT node, depth FROM cl")
def closure_depth(spark, d):
    return reached_whole(spark, d)


@query(f"WITH {FOLLOW} SELECT node, 'max-depth' AS reason FROM l3 WHERE depth = 3")
def closure_frontier(spark, d):
    return reached(spark, d).filter("depth = 3").select("node", F.lit("max-depth").alias("reason"))


@query(
    f"""WITH RECURSIVE {WHOLE}, hit AS (SELECT e.* FROM e JOIN cl ON node = caller)
 SELECT kind, count(*) AS n_stopped FROM (SELECT DISTINCT caller, callee, kind FROM hit WHERE callee IS NOT NULL AND kind IN ('helper', 'import')
 UNION ALL (SELECT DISTINCT caller, callee, 'runtime' FROM hit WHERE kind NOT IN {STOPS} AND callee IN (SELECT addr FROM rt)) UNION ALL SELECT caller, callee, kind FROM hit WHERE kind = 'indirect') GROUP BY 1"""
)
def closure_stopped(spark, d):
    return graph.stop_reasons(edges(spark, d), reached_whole(spark, d), "caller", "callee", "kind", STOPS, runtime(spark, d), "indirect")


@query(
    f"""WITH RECURSIVE {EDGE}, ab AS MATERIALIZED (SELECT caller AS a, callee AS b FROM de UNION SELECT callee, caller FROM de),
 cc(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM ab UNION (SELECT ab.a, min(o.root) FROM recurring.cc o JOIN ab ON ab.b = o.node JOIN recurring.cc m ON m.node = ab.a WHERE o.root < m.root GROUP BY ab.a)) SELECT node, root FROM cc"""
)
def components(spark, d):
    return graph.components(direct(spark, d), "caller", "callee")


def half(node):
    return F.floor(node / 4) % 2 == 0


def labels(spark, d):
    """Labels after up to 12 rounds, fewer if a round moves nothing, and whether they settled."""
    return graph.propagate_labels(direct(spark, d), "caller", "callee", half)


def _half_steps(rounds: int) -> str:
    parts = [EDGE, "ab AS MATERIALIZED (SELECT a, b, count(*) AS n FROM (SELECT caller AS a, callee AS b FROM de WHERE caller <> callee UNION ALL SELECT callee, caller FROM de WHERE caller <> callee) GROUP BY ALL)", "s0 AS MATERIALIZED (SELECT DISTINCT a AS node, a AS label FROM ab)"]
    for i in range(1, 2 * rounds + 1):
        even = "=" if i % 2 else "<>"
        parts.append(
            f"""s{i} AS MATERIALIZED (SELECT s.node, coalesce(b.label, s.label) AS label FROM s{i - 1} s LEFT JOIN (SELECT node, label FROM (SELECT node, label, sum(n) AS n FROM
 (SELECT ab.a AS node, o.label, ab.n FROM ab JOIN s{i - 1} o ON o.node = ab.b WHERE (ab.a // 4) % 2 {even} 0 UNION ALL SELECT node, label, 1 FROM s{i - 1} WHERE (node // 4) % 2 {even} 0) GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, label) = 1) b ON b.node = s.node)"""
        )
    return ", ".join(parts) + f", lab AS (SELECT * FROM s{2 * rounds})"


LABELS = _half_steps(12).removesuffix("lab AS (SELECT * FROM s24)") + "lab AS MATERIALIZED (SELECT *, NOT EXISTS (SELECT 1 FROM s24 a JOIN s22 b USING (node) WHERE a.label <> b.label) AS converged FROM s24)"


@query(f"WITH {LABELS} SELECT node, label, converged FROM lab")
def label_propagation(spark, d):
    return labels(spark, d)


@query(
    f"""WITH {LABELS}, z AS (SELECT label, count(*) AS size FROM lab GROUP BY 1), x AS (SELECT p.label AS la, q.label AS lb FROM de LEFT JOIN lab p ON p.node = caller LEFT JOIN lab q ON q.node = callee),
 i AS (SELECT la AS label, count(*) AS n FROM x WHERE la = lb GROUP BY 1), o AS (SELECT label, count(*) AS n FROM (SELECT la AS label FROM x WHERE la IS DISTINCT FROM lb UNION ALL SELECT lb FROM x WHERE la IS DISTINCT FROM lb) WHERE label IS NOT NULL GROUP BY 1)
 SELECT label, size, coalesce(i.n, 0) AS internal, coalesce(o.n, 0) AS external, coalesce(round(i.n::DOUBLE / (coalesce(i.n, 0) + coalesce(o.n, 0)), 6), 0.0) AS cohesion, (SELECT bool_and(converged) FROM lab) AS converged FROM z LEFT JOIN i USING (label) LEFT JOIN o USING (label)"""
)
def community_summary(spark, d):
    own = labels(spark, d)
    s = graph.community_summary(direct(spark, d), own, "caller", "callee").withColumn("cohesion", F.round("cohesion", 6))
    return s.crossJoin(F.broadcast(own.select("converged").limit(1)))


@query(f"WITH {CUR} SELECT subsystem_id, count(*) AS size, count(*) FILTER (name NOT LIKE 'sub\\_%' ESCAPE '\\') AS n_named, coalesce(max(hot), 0) AS max_hot FROM cur WHERE subsystem_id IS NOT NULL GROUP BY 1")
def subsystem_rank(spark, d):
    f = functions(spark, d).filter("subsystem_id is not null")
    return f.groupBy("subsystem_id").agg(F.count(F.lit(1)).alias("size"), F.count_if(~F.col("name").startswith("sub_")).alias("n_named"), F.coalesce(F.max("hot"), F.lit(0)).alias("max_hot"))


@query(f"WITH {CUR}, {EDGE}, g AS (SELECT callee, count(*) AS degree FROM de GROUP BY 1) SELECT subsystem_id, addr, degree, rank FROM (SELECT subsystem_id, addr, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY subsystem_id ORDER BY coalesce(degree, 0) DESC, addr)::INT AS rank FROM cur LEFT JOIN g ON callee = addr WHERE subsystem_id IS NOT NULL) WHERE rank <= 12")
def subsystem_seeds(spark, d):
    g = graph.degrees(direct(spark, d).withColumnRenamed("callee", "addr"), "addr")
    f = functions(spark, d).filter("subsystem_id is not null").select("subsystem_id", "addr").join(g, "addr", "left").select("subsystem_id", "addr", F.coalesce("degree", F.lit(0)).alias("degree"))
    return workqueue.best_of(f, ["subsystem_id"], [F.col("degree").desc(), F.col("addr")], 12)


@query(f"WITH {CUR}, {LABELS}, n AS (SELECT label, subsystem_id, count(*) AS n FROM lab JOIN cur ON addr = node GROUP BY ALL), a AS (SELECT label, sum(n) AS size FROM n GROUP BY 1) SELECT label, subsystem_id, (n * 100 // size)::BIGINT AS percent, (SELECT bool_and(converged) FROM lab) AS converged FROM n JOIN a USING (label) WHERE subsystem_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, subsystem_id) = 1")
def subsystem_overlap(spark, d):
    own = labels(spark, d)
    return overlap(spark, d, own.select("node", "label")).crossJoin(F.broadcast(own.select("converged").limit(1)))


def overlap(spark, d, own):
    n = own.join(functions(spark, d).select(F.col("addr").alias("node"), "subsystem_id"), "node").groupBy("label", "subsystem_id").agg(F.count(F.lit(1)).alias("n"))
    size = n.groupBy("label").agg(F.sum("n").alias("size"))
    best = n.filter("subsystem_id is not null").groupBy("label").agg(F.max(F.struct("n", (-F.col("subsystem_id")).alias("s"))).alias("x"))
    return best.join(size, "label").select("label", (-F.col("x.s")).alias("subsystem_id"), F.floor(F.col("x.n") * 100 / F.col("size")).alias("percent"))


# --- listings, similarity, census ----------------------------------------------------------------

START = r"GUEST_BODY\(sub_([0-9A-Fa-f]{8})\)"


def listings(spark, d):
    """Function bodies in documents, with an id each."""
    docs = table(spark, d, "documents").select("doc_id", "text").distinct()
    found = files.listing_functions(docs, START, "doc_id")
    return found.withColumn("fn", F.shiftleft("doc_id", 32) + F.col("first"))


def sequences(spark, d):
    return listings(spark, d).select("fn", "addr", similarity.opcodes(F.col("body")).alias("ops"))


FN = f"""ln AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS n FROM (SELECT DISTINCT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS l FROM documents WHERE text IS NOT NULL)),
 sg AS (SELECT *, count(head) OVER (PARTITION BY doc_id ORDER BY n) AS seg FROM (SELECT *, nullif(regexp_extract(line, '{START}', 1), '') AS head FROM ln)),
 dp AS (SELECT *, sum(op) OVER w AS opened, sum(op - cl) OVER w AS depth FROM (SELECT *, len(line) - len(replace(line, '{{', '')) AS op, len(line) - len(replace(line, '}}', '')) AS cl FROM sg WHERE seg > 0) WINDOW w AS (PARTITION BY doc_id, seg ORDER BY n)),
 en AS (SELECT *, min(CASE WHEN opened > 0 AND depth <= 0 THEN n END) OVER (PARTITION BY doc_id, seg) AS last FROM dp),
 fn AS (SELECT doc_id, ('0x' || max(head))::BIGINT AS addr, min(n) AS first, coalesce(max(last) - min(n) + 1, 0) AS n_lines, string_agg(line, chr(10) ORDER BY n) AS body FROM en WHERE last IS NULL OR n <= last GROUP BY doc_id, seg),
 sq AS (SELECT doc_id * 4294967296 + first AS fn, addr, regexp_extract_all(body, '(?m)^[ \\t]*// ?([a-z][a-z0-9_.]*)', 1) AS ops FROM fn),
 sh AS (SELECT fn, addr, ops, CASE WHEN len(ops) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ops) - 2, 1) + 1), lambda i: array_to_string(list_slice(ops, i, i + 2), ' '))) END AS s FROM sq)"""
SIG = f"""{FN}, bs AS (SELECT fn, unnest(CASE WHEN len(s) = 0 THEN [NULL] ELSE s END) AS sh FROM sh WHERE len(ops) >= 6), hb AS (SELECT fn, ('0x' || substr(md5(sh), 1, 16))::UBIGINT::HUGEINT AS b FROM bs),
 mh AS (SELECT fn, i, min((b * (2 * i + 1) + i * 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM hb, (SELECT unnest(range(32)) AS i) GROUP BY ALL),
 sig AS (SELECT fn, list(h ORDER BY i) AS sig FROM mh GROUP BY 1), bk AS (SELECT fn, band || ':' || array_to_string(list_slice(sig, band * 4 + 1, band * 4 + 4), ',') AS bucket FROM sig, (SELECT unnest(range(8)) AS band))"""
FAM = f"{SIG}, lk AS (SELECT DISTINCT x.fn AS a, y.fn AS b FROM bk x JOIN bk y USING (bucket)), rc AS (SELECT a, b FROM lk UNION SELECT rc.a, lk.b FROM rc JOIN lk ON lk.a = rc.b), rt AS (SELECT a AS fn, min(b) AS root FROM rc GROUP BY 1)"


@query(f"WITH {FN} SELECT doc_id, addr, first::BIGINT AS first, n_lines::BIGINT AS n_lines FROM fn")
def listing_index(spark, d):
    return listings(spark, d).select("doc_id", "addr", F.col("first").cast("bigint").alias("first"), F.col("n_lines").cast("bigint").alias("n_lines"))


@query(f"WITH {FN} SELECT doc_id, addr AS caller, CASE WHEN coalesce(to_, '') = '' THEN 0 ELSE ('0x' || to_)::BIGINT END AS callee, count(*) AS n_sites FROM (SELECT doc_id, addr, unnest(regexp_extract_all(body, '//\\s*(?:bl\\s+0x([0-9A-Fa-f]{{8}})|bctrl\\b)', 1)) AS to_ FROM fn) GROUP BY ALL")
def listing_calls(spark, d):
    e = files.call_edges(listings(spark, d), "doc_id")
    return e.groupBy("doc_id", "caller", "callee").agg(F.count(F.lit(1)).alias("n_sites"))


@query(f"WITH {FN} SELECT fn, len(s)::BIGINT AS n_shingles, md5(array_to_string(list_sort(s), '|')) AS digest FROM sh")
def shingles(spark, d):
    s = similarity.shingle_set(F.col("ops"))
    return sequences(spark, d).select("fn", F.size(s).cast("bigint").alias("n_shingles"), F.md5(F.array_join(F.array_sort(s), "|").cast("binary")).alias("digest"))


def signatures(spark, d):
    return sequences(spark, d).filter(F.size("ops") >= 6).select("fn", similarity.minhash(similarity.shingle_set(F.col("ops")), mode="portable").alias("sig"))


@query(f"WITH {SIG} SELECT fn, array_to_string(sig, ',') AS signature FROM sig")
def minhash_sig(spark, d):
    return signatures(spark, d).select("fn", F.array_join(F.col("sig").cast("array<string>"), ",").alias("signature"))


@query(f"WITH {SIG} SELECT bucket, count(*) AS n_rows, min(fn) AS first_fn FROM bk GROUP BY 1")
def lsh_buckets(spark, d):
    b = signatures(spark, d).select("fn", F.explode(similarity.buckets(F.col("sig"))).alias("bucket"))
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"), F.min("fn").alias("first_fn"))


def all_families(spark, d):
    return similarity.families(sequences(spark, d), "fn", "ops", mode="portable")


@query(f"WITH RECURSIVE {FAM} SELECT fn, root, dense_rank() OVER (ORDER BY root) AS family_id, count(*) OVER (PARTITION BY root) AS size FROM rt")
def families(spark, d):
    return all_families(spark, d)


@query(f"WITH RECURSIVE {FAM}, z AS (SELECT root, count(*) AS size FROM rt GROUP BY 1) SELECT size, count(*) AS n_families FROM z GROUP BY 1")
def family_summary(spark, d):
    sizes = all_families(spark, d).select("root", "size").distinct()
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n_families"))


@query(f"WITH RECURSIVE {FAM} SELECT rt.fn, root, len(list_filter(list_zip(p.sig, q.sig), lambda z: z[1] = z[2])) / 32.0 AS estimate FROM rt JOIN sig p ON p.fn = rt.fn JOIN sig q ON q.fn = root")
def jaccard_est(spark, d):
    sig = signatures(spark, d)
    f = all_families(spark, d).select("fn", "root").join(sig, "fn").join(sig.select(F.col("fn").alias("root"), F.col("sig").alias("root_sig")), "root")
    return f.select("fn", "root", similarity.jaccard_estimate(F.col("sig"), F.col("root_sig")).cast("double").alias("estimate"))


#: How the listings of this corpus write stores, loads, labels and jumps.
DIALECT = census.CensusRules(
    store=r"^\s*// ?st(b|h|w|d|fs|fd)\b",
    sizes={"b": 1, "h": 2, "w": 4, "d": 8, "fs": 4, "fd": 8},
    base=r"\(r(\d+)\)",
    offset=r",(-?\d+)\(",
    write=r"(?:^\s*cx\.g\[|^\s*// ?(?!st|cmp|b|mt)[a-z]\w* r)(\d+)",
    load=r"^\s*cx\.g\[(\d+)\] = MEM32\(cx\.g\[(\d+)\](?: \+ (\d+))?\)",
    label=r"^\s*(\w+):\s*$",
    jump=r"\bgoto (\w+)\s*;",
    stack=("1",),
    entry=tuple(str(n) for n in range(3, 11)),
    blocking={"indirect call": r"//\s*bctrl\b"},
    volatile={"time base": r"//\s*mftb\b"},
)


@query()
def screen_gate(spark, d):
    """The screening verdict of every listing, with its reasons and counts."""
    s = census.screen(listings(spark, d).select("fn", "body"), "fn", "body", DIALECT)
    return s.select("fn", "verdict", F.array_join("reasons", "; ").alias("reasons"), "n_stores", "n_bytes", "n_derived", "n_loop", "n_unknown", "n_untraced", F.size("windows").alias("n_windows"))


@query(
    f"""WITH {FN}, l AS (SELECT fn, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS n FROM (SELECT doc_id * 4294967296 + first AS fn, body FROM fn)),
 s AS (SELECT fn, n, regexp_extract(line, '^\\s*// ?st(b|h|w|d|fs|fd)\\b', 1) AS form, regexp_extract(line, '\\(r(\\d+)\\)', 1) AS reg, TRY_CAST(regexp_extract(line, ',(-?\\d+)\\(', 1) AS BIGINT) AS o FROM l WHERE regexp_matches(line, '^\\s*// ?st(b|h|w|d|fs|fd)\\b')),
 w AS (SELECT DISTINCT fn, n, coalesce(nullif(regexp_extract(line, '^\\s*cx\\.g\\[(\\d+)', 1), ''), CASE WHEN regexp_matches(line, '^\\s*// ?(st|cmp|b|mt)') THEN NULL ELSE nullif(regexp_extract(line, '^\\s*// ?[a-z]\\w* r(\\d+)', 1), '') END) AS reg FROM l),
 p AS (SELECT s.fn, s.n, form, s.reg, o, max(w.n) AS seen FROM s LEFT JOIN w ON w.fn = s.fn AND w.reg = s.reg AND w.n < s.n GROUP BY ALL)
 SELECT fn, n::BIGINT AS n, form, reg, CASE WHEN reg = '1' THEN 'stack' WHEN reg = '' THEN 'unknown' WHEN seen IS NOT NULL THEN 'derived' WHEN reg IN ('3', '4', '5', '6', '7', '8', '9', '10') THEN 'entry' ELSE 'unknown' END AS base, o AS "offset" FROM p"""
)
def store_classes(spark, d):
    """Every store of the listings with what its base register is."""
    rows = census.lines(listings(spark, d).select("fn", "body"), "fn", "body")
    return census.stores(rows, "fn", DIALECT).select("fn", F.col("n").cast("bigint").alias("n"), "form", "reg", "base", "offset")


FLAGS = {"n_stores": "^st", "n_loads": "^l[bhwdfv]", "n_float": "^f|^lf|^stf", "n_indirect": "^bctrl$", "n_branches": "^b"}


@query(f"WITH {FN} SELECT fn, len(ops)::BIGINT AS n_ops, " + ", ".join(f"len(list_filter(ops, lambda x: regexp_matches(x, '{p}')))::BIGINT AS {k}" for k, p in FLAGS.items()) + " FROM sq")
def census_flags(spark, d):
    ops = F.col("ops")

    def n(pattern):
        return F.size(F.filter(ops, lambda x: x.rlike(pattern))).cast("bigint")

    return sequences(spark, d).select("fn", F.size(ops).cast("bigint").alias("n_ops"), *[n(p).alias(k) for k, p in FLAGS.items()])


@query(f"WITH {FN} SELECT op, count(*) AS n_rows FROM (SELECT unnest(ops) AS op FROM sq) GROUP BY 1")
def mnemonic_hist(spark, d):
    return sequences(spark, d).select(F.explode("ops").alias("op")).groupBy("op").agg(F.count(F.lit(1)).alias("n_rows"))


RULES = {"indirect call": r"\bbctrl\b", "memory access": r"\bMEM32\(", "jump": r"\bgoto [a-z_]+", "pointer store": r"^ *\*\(uint \*\)"}


@query("WITH ln AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS line FROM (SELECT DISTINCT doc_id, text FROM documents)) " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS rule, count(*) AS n_lines FROM ln WHERE regexp_matches(line, '{p}') GROUP BY 1" for k, p in RULES.items()))
def census_rule_hits(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text").distinct()
    return census.hits(census.lines(docs, "doc_id", "text"), RULES).groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"WITH {FN}, g AS (SELECT fn, len(ops) AS n, " + ", ".join(f"len(list_filter(ops, lambda x: regexp_matches(x, '{p}'))) AS {k}" for k, p in FLAGS.items()) + " FROM sq) SELECT fn, CASE WHEN n = 0 THEN 'empty' WHEN n_indirect > 0 THEN 'blocking' WHEN n_stores = 0 THEN 'no_stores' ELSE 'pass' END AS verdict FROM g")
def census_gate(spark, d):
    f = census_flags(spark, d)
    return f.select("fn", census.first_match([("empty", F.col("n_ops") == 0), ("blocking", F.col("n_indirect") > 0), ("no_stores", F.col("n_stores") == 0)], "pass").alias("verdict"))


@query()
def const_refs(spark, d):
    return folds.fold_constants(listings(spark, d), "fn", "body").select("fn", F.explode("values").alias("value"))


# --- work queues ---------------------------------------------------------------------------------

LETTER = "upper(regexp_replace(tier, '\\s', '', 'g'))"


def queued(spark, d):
    return functions(spark, d).withColumn("tier", F.upper(F.regexp_replace("tier", r"\s", ""))).withColumn("status", F.coalesce("status", F.lit("pending")))


@query(f"WITH {CUR} SELECT addr, {LETTER} AS tier, hot, difficulty FROM cur WHERE coalesce(status, 'pending') IN ('pending', 'divergent') AND retired_at IS NULL ORDER BY tier NULLS LAST, coalesce(hot, 0) DESC, coalesce(difficulty, 1.0), addr LIMIT 50")
def queue_next(spark, d):
    where = [F.col("status").isin("pending", "divergent"), F.col("retired_at").isNull()]
    order = [F.col("tier").asc_nulls_last(), F.coalesce("hot", F.lit(0)).desc(), F.coalesce("difficulty", F.lit(1.0)), F.col("addr")]
    return workqueue.next_items(queued(spark, d).select("addr", "tier", "hot", "difficulty", "status", "retired_at"), where, order, 50).select("addr", "tier", "hot", "difficulty")


@query(f"WITH {CUR} SELECT {LETTER} AS tier, coalesce(status, 'pending') AS status, count(*) AS n_rows FROM cur GROUP BY ALL")
def queue_report(spark, d):
    return workqueue.counts_by(queued(spark, d), {"tier": F.col("tier"), "status": F.col("status")})


@query(f"WITH {CUR}, x AS (SELECT {LETTER} AS tier, coalesce(status, 'pending') AS s FROM cur) SELECT tier, count(*) AS n_total, count(*) FILTER (s IN ('verified', 'promoted')) AS n_settled, count(*) FILTER (s IN ('drafted', 'written', 'armed')) AS n_moving, count(*) FILTER (s NOT IN ('verified', 'promoted', 'drafted', 'written', 'armed')) AS n_todo FROM x GROUP BY 1")
def queue_totals(spark, d):
    return workqueue.progress(queued(spark, d), F.col("tier"), "tier", F.col("status"), ("verified", "promoted"), ("drafted", "written", "armed"))


@query(f"WITH {CUR} SELECT coalesce(status, 'pending') AS status, count(*) AS n_rows FROM cur GROUP BY 1")
def status_counts(spark, d):
    return workqueue.counts_by(queued(spark, d), {"status": F.col("status")})


@query(f"WITH {CUR} SELECT family_id, addr, hot, row_number() OVER (PARTITION BY family_id ORDER BY coalesce(hot, 0) DESC, addr)::INT AS rank FROM cur WHERE family_id IS NOT NULL QUALIFY rank <= 5")
def siblings_topk(spark, d):
    f = functions(spark, d).filter("family_id is not null").select("family_id", "addr", "hot")
    return workqueue.best_of(f, ["family_id"], [F.coalesce("hot", F.lit(0)).desc(), F.col("addr")], 5)


@query("SELECT a AS addr, port_id, status, build_id FROM (SELECT addr & 4294967295 AS a, port_id, status, build_id, row_number() OVER (PARTITION BY addr & 4294967295 ORDER BY updated_at DESC, port_id DESC) AS rn FROM port WHERE addr IS NOT NULL) WHERE rn = 1")
def latest_row(spark, d):
    p = table(spark, d, "port").withColumn("addr", unsigned32(F.col("addr"))).withColumn("v", F.struct("updated_at", "port_id"))
    return evidence.current_rows(p, "addr", "v", ["port_id", "status", "build_id"])


@query(
    f"""WITH {CUR}, r AS (SELECT subsystem_id, addr, coalesce(lifted_lines <= 40, false) AS p, sum(CASE WHEN coalesce(lifted_lines <= 40, false) THEN 0 ELSE 1 END) OVER (PARTITION BY subsystem_id ORDER BY addr) AS b FROM cur WHERE subsystem_id IS NOT NULL AND NOT coalesce(status = 'promoted', false)),
 k AS (SELECT *, CASE WHEN p THEN (row_number() OVER (PARTITION BY subsystem_id, b, p ORDER BY addr) - 1) // 4 ELSE -1 END AS k FROM r),
 s AS (SELECT *, CASE WHEN lag(b) OVER w IS NULL OR lag(b) OVER w <> b OR lag(k) OVER w <> k THEN 1 ELSE 0 END AS s FROM k WINDOW w AS (PARTITION BY subsystem_id ORDER BY addr))
 SELECT subsystem_id, addr, (sum(s) OVER (PARTITION BY subsystem_id ORDER BY addr))::BIGINT AS batch FROM s"""
)
def batch_packing(spark, d):
    f = functions(spark, d).filter("subsystem_id is not null").select("subsystem_id", "addr", "lifted_lines", "status")
    return workqueue.pack(f, ["subsystem_id"], ["addr"], F.col("lifted_lines") <= 40, F.col("status") == "promoted", 4).select("subsystem_id", "addr", "batch")


@query(f"WITH {CUR} SELECT addr, name FROM cur WHERE name ILIKE '%cloth%'")
def search_name(spark, d):
    return workqueue.named_like(functions(spark, d).select("addr", "name"), "name", "CLOTH")


@query(f"WITH {CUR} SELECT addr, name FROM cur WHERE addr NOT IN (SELECT addr & 4294967295 FROM port WHERE addr IS NOT NULL)")
def not_ported(spark, d):
    return workqueue.missing_from(functions(spark, d).select("addr", "name"), table(spark, d, "port").select(unsigned32(F.col("addr")).alias("addr")), "addr")


@query(f"WITH {CUR}, {EDGE} SELECT kind, cur.status AS callee_status, count(*) AS n_rows FROM e LEFT JOIN cur ON cur.addr = e.callee GROUP BY ALL")
def callee_status(spark, d):
    from lodestrata.operators.skew import skew_join

    f = functions(spark, d).select(F.col("addr").alias("callee"), F.col("status").alias("callee_status"))
    return skew_join(edges(spark, d).select("xref_id", "kind", "callee"), f, ["callee"], "left").groupBy("kind", "callee_status").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"WITH {CUR} SELECT addr, floor(least(1.0, 0.4 * least(1.0, coalesce(lifted_lines, 0) / 400.0::DOUBLE) + 0.35 * least(1.0, coalesce(corpus_depth, 0) / 8.0::DOUBLE) + 0.25 * least(1.0, coalesce(hot, 0) / 1000.0::DOUBLE)) * 1000 + 0.500001)::BIGINT AS permille FROM cur")
def saturating_score(spark, d):
    s = graph.saturating_score({"lifted_lines": (0.4, 400.0), "corpus_depth": (0.35, 8.0), "hot": (0.25, 1000.0)}, digits=None)
    return functions(spark, d).select("addr", F.floor(s * 1000 + 0.500001).alias("permille"))


@query(f"WITH {CUR} SELECT addr, status, attempts FROM cur WHERE coalesce(status, 'pending') IN ('pending', 'divergent', 'thin') AND NOT (coalesce(status, 'pending') = 'divergent' AND coalesce(attempts, 0) >= 3)")
def queue_open(spark, d):
    """Open items but those that diverged three times."""
    f = evidence.current_rows(table(spark, d, "guest_function").withColumn("addr", unsigned32(F.col("addr"))), "addr", "updated_at", ["status", "attempts"])
    status = F.coalesce("status", F.lit("pending"))
    spent = (status == "divergent") & (F.coalesce("attempts", F.lit(0)) >= 3)
    return workqueue.next_items(f.select("addr", "status", "attempts"), [status.isin("pending", "divergent", "thin"), ~spent], [])


TIER_RANK = {c: i for i, c in enumerate("AUBCDEFL")}


@query(
    f"WITH {CUR} SELECT addr, {LETTER} AS tier, family_id, hot FROM cur WHERE coalesce(status, 'pending') = 'pending' AND retired_at IS NULL ORDER BY CASE {LETTER} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TIER_RANK.items()) + " ELSE 99 END, coalesce(family_id, 0), coalesce(hot, 0) DESC, coalesce(difficulty, 1.0), addr LIMIT 100"
)
def queue_families(spark, d):
    """Pending items by rank of tier, families together, unknown tiers last."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in TIER_RANK.items() for x in p]), F.col("tier")), F.lit(99))
    order = [rank, F.coalesce("family_id", F.lit(0)), F.coalesce("hot", F.lit(0)).desc(), F.coalesce("difficulty", F.lit(1.0)), F.col("addr")]
    items = queued(spark, d).select("addr", "tier", "family_id", "hot", "difficulty", "status", "retired_at")
    return workqueue.next_items(items, [F.col("status") == "pending", F.col("retired_at").isNull()], order, 100).select("addr", "tier", "family_id", "hot")


@query(f"WITH {CUR} SELECT addr, name, tier, status FROM cur WHERE addr = (SELECT min(addr) FROM cur WHERE subsystem_id = (SELECT max(subsystem_id) FROM cur))")
def point_lookup(spark, d):
    """One function by its key, the key from a scalar subquery."""
    f = functions(spark, d).select("addr", "name", "tier", "status", "subsystem_id")
    last = f.agg(F.max("subsystem_id").alias("subsystem_id"))
    key = f.join(F.broadcast(last), "subsystem_id").agg(F.min("addr").alias("addr"))
    return f.join(F.broadcast(key), "addr").select("addr", "name", "tier", "status")


@query(
    f"""WITH {CUR}, g AS (SELECT subsystem_id, count(*) AS n, max(coalesce(hot, 0)) AS hot, count(*) FILTER (name NOT LIKE 'sub\\_%' ESCAPE '\\') AS named, count(gate) AS screened, count(*) FILTER (gate IN ('pass', 'gate4')) AS good FROM cur WHERE subsystem_id IS NOT NULL GROUP BY 1),
 x AS (SELECT subsystem_id, n, 0.4::DOUBLE * CASE WHEN screened = 0 THEN 0.5::DOUBLE ELSE good::DOUBLE / screened END + 0.3::DOUBLE * least(1.0::DOUBLE, hot::DOUBLE / 100000) + 0.2::DOUBLE * (named::DOUBLE / n) + 0.1::DOUBLE * (1.0::DOUBLE - least(1.0::DOUBLE, abs(n - 400)::DOUBLE / 1200)) AS s FROM g)
 SELECT subsystem_id, n AS size, floor(s * 1000 + 0.500001)::BIGINT AS permille FROM x WHERE n BETWEEN 5 AND 5000 QUALIFY row_number() OVER (ORDER BY floor(s * 1000 + 0.500001) DESC, subsystem_id) <= 12"""
)
def subsystem_scores(spark, d):
    """The twelve best subsystems of a fitting size by share screened good, heat, names and size."""
    f = functions(spark, d).filter("subsystem_id is not null")
    g = f.groupBy("subsystem_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("hot", F.lit(0))).alias("hot"), F.count_if(~F.col("name").startswith("sub_")).alias("named"), F.count("gate").alias("screened"), F.count_if(F.col("gate").isin("pass", "gate4")).alias("good"))
    real = lambda c: F.col(c).cast("double")
    s = (
        F.lit(0.4) * F.when(F.col("screened") == 0, F.lit(0.5)).otherwise(real("good") / F.greatest("screened", F.lit(1)))
        + F.lit(0.3) * F.least(F.lit(1.0), real("hot") / 100000)
        + F.lit(0.2) * (real("named") / F.col("n"))
        + F.lit(0.1) * graph.size_fit(F.col("n"), 400, 1200)
    )
    ranked = g.filter(F.col("n").between(5, 5000)).select("subsystem_id", F.col("n").alias("size"), F.floor(s * 1000 + 0.500001).alias("permille"))
    return ranked.orderBy(F.col("permille").desc(), "subsystem_id").limit(12)


@query(f"WITH {EDGE} SELECT CASE WHEN coalesce(callee_name, '') = '' THEN 'unresolved' WHEN starts_with(callee_name, '__imp__') THEN 'import' WHEN starts_with(callee_name, '__') THEN 'helper' ELSE 'direct' END AS kind_by_name, kind, count(*) AS n_rows FROM e GROUP BY ALL")
def edge_kinds_by_name(spark, d):
    """The kind a callee's name speaks for, against the stored one."""
    return workqueue.counts_by(edges(spark, d), {"kind_by_name": files.edge_kind(F.col("callee"), F.col("callee_name")), "kind": F.col("kind")})


@query(f"WITH {EDGE}, {CUR}, w AS (SELECT addr FROM cur WHERE coalesce(hot, 0) > 0) SELECT caller, count(*) AS n_direct FROM de WHERE caller IN (SELECT addr FROM w) GROUP BY 1")
def hot_callers(spark, d):
    """Direct calls of each function that was seen running: a long list of keys is a semi-join."""
    from lodestrata.operators.skew import skew_join

    seen = functions(spark, d).filter("hot > 0").select(F.col("addr").alias("caller"))
    return graph.degrees(skew_join(direct(spark, d), seen, ["caller"], "left_semi"), "caller", "n_direct")


# --- evidence and layout -------------------------------------------------------------------------


@query("SELECT field_id, locator, confidence FROM (SELECT DISTINCT * FROM field_evidence) WHERE locator IS NOT NULL QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY coalesce(confidence, 0) DESC, created_at, id) = 1")
def evidence_best(spark, d):
    e = table(spark, d, "field_evidence").filter("locator is not null").distinct()
    return evidence.best_claim(e, ["field_id"], "locator", "confidence", ["created_at", "id"])


@query('SELECT "offset", min(struct_id) AS struct_id FROM struct_field GROUP BY 1 HAVING count(DISTINCT struct_id) = 1')
def offset_unambiguous(spark, d):
    return evidence.unambiguous(table(spark, d, "struct_field"), "offset", "struct_id")


@query("SELECT id, field_id FROM (SELECT DISTINCT id, field_id FROM field_evidence WHERE kind = 'llm') WHERE field_id NOT IN (SELECT field_id FROM struct_field WHERE status IN ('established', 'confirmed'))")
def proposal_guard(spark, d):
    e = table(spark, d, "field_evidence").filter("kind = 'llm'").select("id", "field_id").distinct()
    return evidence.guarded(e, table(spark, d, "struct_field"), ["field_id"], "status", ("established", "confirmed")).select("id", "field_id")


@query("WITH u AS (SELECT field_id, max(confidence) AS c FROM field_evidence WHERE field_id IS NOT NULL GROUP BY 1) SELECT field_id, struct_id, name, CASE WHEN u.field_id IS NOT NULL THEN u.c ELSE f.confidence END AS confidence FROM struct_field f FULL JOIN u USING (field_id)")
def partial_upsert(spark, d):
    u = table(spark, d, "field_evidence").filter("field_id is not null").groupBy("field_id").agg(F.max("confidence").alias("confidence"))
    return evidence.partial_upsert(table(spark, d, "struct_field").select("field_id", "struct_id", "name", "confidence"), u, ["field_id"], ["confidence"])


def fields(spark, d):
    return table(spark, d, "struct_field").select("struct_id", "offset", "size", "field_id")


@query('SELECT struct_id, field_id, "offset", previous_end FROM (SELECT *, lag("offset" + coalesce(nullif(size, 0), 4)) OVER (PARTITION BY struct_id ORDER BY "offset", size NULLS FIRST, field_id) AS previous_end FROM struct_field) WHERE "offset" < previous_end')
def layout_overlap(spark, d):
    return layout.overlaps(fields(spark, d), "struct_id", "offset", "size").select("struct_id", "field_id", "offset", "previous_end")


@query('SELECT * FROM (SELECT struct_id, "offset", "offset" + coalesce(nullif(size, 0), 4) AS "end", lead("offset") OVER (PARTITION BY struct_id ORDER BY "offset", size NULLS FIRST, field_id) - ("offset" + coalesce(nullif(size, 0), 4)) AS gap FROM struct_field) WHERE gap > 0')
def layout_gap(spark, d):
    return layout.gaps(fields(spark, d), "struct_id", "offset", "size")


@query("SELECT field_id, struct_id FROM struct_field WHERE field_id NOT IN (SELECT field_id FROM field_evidence WHERE field_id IS NOT NULL)")
def layout_unevidenced(spark, d):
    return layout.unevidenced(table(spark, d, "struct_field"), table(spark, d, "field_evidence"), "field_id").select("field_id", "struct_id")


@query("SELECT DISTINCT struct_id, function_addr & 4294967295 AS function_addr FROM field_evidence JOIN struct_field USING (field_id) WHERE function_addr IS NOT NULL")
def layout_citations(spark, d):
    e = table(spark, d, "field_evidence").select("field_id", unsigned32(F.col("function_addr")).alias("function_addr"))
    return layout.cited(table(spark, d, "struct_field"), e, "field_id", "struct_id", "function_addr")


@query(
    """WITH f AS (SELECT *, coalesce(nullif(size, 0), 4) AS held, coalesce(name, printf('unk_%X', "offset")) AS label FROM struct_field), p AS (SELECT *, coalesce(lag("offset" + held) OVER (PARTITION BY struct_id ORDER BY "offset"), 0) AS b FROM f)
 SELECT struct_id, 'struct S' || struct_id || ' {' || chr(10) || string_agg(CASE WHEN "offset" > b THEN printf('  uint8_t _pad%X[%d];', b, "offset" - b) || chr(10) ELSE '' END || printf('  %s %s; // +0x%X', ctype, label, "offset") || chr(10), '' ORDER BY "offset") || '};' || chr(10)
 || string_agg(printf('static_assert(offsetof(S%d, %s) == 0x%X);', struct_id, label, "offset") || chr(10), '' ORDER BY "offset") AS header FROM p GROUP BY 1"""
)
def layout_header(spark, d):
    return layout.render_header(table(spark, d, "struct_field"), "struct_id", "offset", "size", "ctype", "name")


# --- ledgers -------------------------------------------------------------------------------------


def readable(spark, d):
    return table(spark, d, "provider_event").distinct().filter(F.try_parse_json("body").isNotNull())


def turns(spark, d):
    return events.turn_usage(readable(spark, d).filter("provider = 'codex'"), ["event_id", "feed", "file_no", "line_no"])


def _fig(path: str) -> str:
    return f"coalesce(trunc(TRY_CAST(json_extract_string(body, '$.usage.{path}') AS DECIMAL(38, 6)))::BIGINT, 0)"


TURN = f"""ok AS (SELECT DISTINCT * FROM provider_event WHERE body IS NOT NULL AND json_valid(body)),
 tu AS (SELECT event_id, feed, file_no, line_no, greatest({_fig('input_tokens')} - {_fig('cached_input_tokens')}, 0) AS input_tokens, {_fig('cached_input_tokens')} AS cache_read_tokens, {_fig('output_tokens')} + {_fig('reasoning_output_tokens')} AS output_tokens FROM ok WHERE provider = 'codex' AND json_extract_string(body, '$.type') = 'turn.completed')"""


@query(f"WITH {TURN} SELECT count(*) AS n_calls, sum(input_tokens)::BIGINT AS sum_input_tokens, sum(cache_read_tokens)::BIGINT AS sum_cache_read_tokens, sum(output_tokens)::BIGINT AS sum_output_tokens FROM tu")
def ledger_totals(spark, d):
    return ledger.totals(turns(spark, d), ["input_tokens", "cache_read_tokens", "output_tokens"])


@query(f"WITH {TURN} SELECT feed, count(*) AS n_calls, sum(input_tokens)::BIGINT AS sum_input_tokens, sum(output_tokens)::BIGINT AS sum_output_tokens FROM tu GROUP BY 1")
def ledger_by_feed(spark, d):
    return ledger.totals(turns(spark, d), ["input_tokens", "output_tokens"], ["feed"])


@query(f"WITH {TURN} SELECT event_id, round_even(input_tokens * 1.0::DECIMAL(8,4) + cache_read_tokens * 0.1::DECIMAL(8,4) + output_tokens * 5.0::DECIMAL(8,4), 0)::BIGINT AS weighted FROM tu")
def cost_weighted(spark, d):
    w = ledger.weighted({"input_tokens": "1", "cache_read_tokens": "0.1", "output_tokens": "5"})
    return turns(spark, d).select("event_id", w.alias("weighted"))


@query(f"WITH {TURN}, g AS (SELECT feed, sum(cache_read_tokens)::DOUBLE AS h, sum(input_tokens)::DOUBLE AS m FROM tu GROUP BY 1) SELECT feed, CASE WHEN h + m = 0 THEN 0.0 ELSE round(h / (h + m), 3) END AS hit_share FROM g")
def cache_hit(spark, d):
    g = turns(spark, d).groupBy("feed").agg(F.sum("cache_read_tokens").alias("h"), F.sum("input_tokens").alias("m"))
    return g.select("feed", ledger.hit_share("h", "m").alias("hit_share"))


@query(f"WITH {TURN} SELECT event_id, feed, (sum(output_tokens) OVER (PARTITION BY feed ORDER BY file_no, line_no, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS spent FROM tu")
def cost_running(spark, d):
    from lodestrata.operators.skew import running_total

    t = turns(spark, d)
    before = running_total(t, ["feed"], ["file_no", "line_no", "event_id"], "output_tokens", F.col("file_no"), "before")
    return before.select("event_id", "feed", (F.col("before") + F.col("output_tokens")).alias("spent"))


@query(
    """WITH r AS (SELECT feed, file_no, line_no, event_id, coalesce(json_extract_string(body, '$.is_error') = 'true', false) AS f FROM (SELECT DISTINCT * FROM provider_event WHERE body IS NOT NULL AND json_valid(body)) WHERE json_extract_string(body, '$.type') = 'result'),
 n AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY file_no, line_no, event_id) AS n FROM r), g AS (SELECT *, n - row_number() OVER (PARTITION BY feed ORDER BY file_no, line_no, event_id) AS g FROM n WHERE f)
 SELECT feed, min(file_no) AS first, max(file_no) AS last, count(*) AS length FROM g GROUP BY feed, g HAVING count(*) >= 2"""
)
def failure_streak(spark, d):
    r = readable(spark, d).filter(F.get_json_object("body", "$.type") == "result")
    failed = F.coalesce(F.get_json_object("body", "$.is_error") == "true", F.lit(False))
    return ledger.streaks(r, ["feed"], ["file_no", "line_no", "event_id"], failed, 2)


def _text(path: str) -> str:
    return f"json_extract_string(body, '$.{path}')"


@query(
    f"""WITH {TURN}, x AS (SELECT feed, file_no, line_no AS o, {_text('type')} AS t, {_text('model')} AS model, {_text('session_id')} AS session_id, {_fig('input_tokens')} AS i, {_fig('cache_read_input_tokens')} AS r, {_fig('cache_creation_input_tokens')} AS w, {_fig('output_tokens')} AS n,
 TRY_CAST({_text('total_cost_usd')} AS DECIMAL(18, 6))::DOUBLE AS cost, {_text('is_error')} = 'true' AS bad FROM ok WHERE provider = 'claude'),
 a AS (SELECT * FROM x WHERE t = 'system' QUALIFY row_number() OVER (PARTITION BY feed, file_no ORDER BY o) = 1), z AS (SELECT * FROM x WHERE t = 'result' QUALIFY row_number() OVER (PARTITION BY feed, file_no ORDER BY o DESC) = 1)
 SELECT f.feed, f.file_no, a.model, a.session_id, z.i AS input_tokens, z.r AS cache_read_tokens, z.w AS cache_write_tokens, z.n AS output_tokens, z.cost AS cost_usd, z.bad AS failed FROM (SELECT DISTINCT feed, file_no FROM x) f LEFT JOIN a USING (feed, file_no) LEFT JOIN z USING (feed, file_no)"""
)
def session_usage(spark, d):
    return events.session_usage(readable(spark, d).filter("provider = 'claude'"), ["feed", "file_no"], "line_no").withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query("SELECT event_type, count(*) AS n_rows, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS sum_k FROM events GROUP BY 1")
def json_props(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.get_json_object("props", "$.k").try_cast("bigint")).alias("sum_k"))


@query(SQL["session_usage"].replace(" SELECT f.feed, f.file_no,", ", su AS (SELECT f.feed, f.file_no,") + ") SELECT model, count(*) AS n_sessions, sum(coalesce(input_tokens, 0))::BIGINT AS sum_input_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS sum_output_tokens, sum(round(coalesce(cost_usd, 0) * 1000000)::BIGINT)::BIGINT AS micro_usd FROM su GROUP BY 1")
def ledger_by_model(spark, d):
    """Sessions, tokens and cost of each model."""
    s = session_usage(spark, d).withColumn("micro", F.round(F.coalesce("cost_usd", F.lit(0.0)) * 1_000_000).cast("bigint"))
    g = ledger.totals(s, ["input_tokens", "output_tokens", "micro"], ["model"])
    return g.select("model", F.col("n_calls").alias("n_sessions"), "sum_input_tokens", "sum_output_tokens", F.col("sum_micro").alias("micro_usd"))


@query(f"WITH {TURN}, {CUR}, w AS (SELECT sum(input_tokens * 10 + cache_read_tokens + output_tokens * 50)::BIGINT AS t FROM tu), v AS (SELECT count(*) AS n FROM cur WHERE status IN ('verified', 'promoted', 'thin')) SELECT n AS n_verified, t AS weighted_tenths, CASE WHEN n > 0 THEN round(t::DOUBLE / 10 / n, 1) END AS per_verified FROM w, v")
def per_verified(spark, d):
    """Weighted tokens for each verified function."""
    w = turns(spark, d).agg(F.sum(F.col("input_tokens") * 10 + F.col("cache_read_tokens") + F.col("output_tokens") * 50).alias("weighted_tenths"))
    v = functions(spark, d).agg(F.count_if(F.col("status").isin("verified", "promoted", "thin")).alias("n_verified"))
    return w.join(F.broadcast(v)).select("n_verified", "weighted_tenths", F.round(F.try_divide(F.col("weighted_tenths").cast("double") / 10, F.col("n_verified")), 1).alias("per_verified"))


# --- session logs --------------------------------------------------------------------------------


def log_events(spark, d):
    return verdicts.log_events(table(spark, d, "documents").select("doc_id", "text").distinct(), "doc_id", "text")


def folded(spark, d):
    return verdicts.fold_log(log_events(spark, d), "doc_id")


LOG = r"""ln AS (SELECT doc_id, trim(unnest(l), ' ') AS line, unnest(range(len(l))) AS n FROM (SELECT DISTINCT doc_id, string_split_regex(text, '\r\n|\n|\r') AS l FROM documents WHERE text IS NOT NULL)),
 ev AS (SELECT doc_id, n, line, TRY_CAST('0x' || nullif(regexp_extract(line, '(?i)\bsub_([0-9a-f]{8})\b', 1), '') AS BIGINT) AS addr, TRY_CAST(nullif(regexp_extract(line, '(?i)\bsub_[0-9a-f]{8}\b.*?compared[=: ]+(\d+).*?skipped[=: ]+(\d+)', 1), '') AS BIGINT) AS compared,
 TRY_CAST(nullif(regexp_extract(line, '(?i)\bsub_[0-9a-f]{8}\b.*?compared[=: ]+(\d+).*?skipped[=: ]+(\d+)', 2), '') AS BIGINT) AS skipped,
 CASE WHEN regexp_matches(line, '(?i)\bsub_[0-9a-f]{8}\b.*?\bdiverge\w*\b') THEN 'diverged' WHEN regexp_matches(line, '(?i)\bsub_[0-9a-f]{8}\b.*?\boverflow\b') THEN 'overflow' WHEN regexp_matches(line, '(?i)\bsub_[0-9a-f]{8}\b.*?\b(?:clean|verified|no divergence)\b') THEN 'clean' END AS event, substr(coalesce(nullif(trim(regexp_extract(line, '(?i)\bsub_[0-9a-f]{8}\b.*?\bdiverge\w*\b(.*)$', 1), ' '), ''), line), 1, 300) AS detail FROM ln),
 fd AS (SELECT doc_id, addr, arg_max(compared, n) FILTER (compared IS NOT NULL) AS compared, arg_max(skipped, n) FILTER (compared IS NOT NULL) AS skipped, coalesce(max(n) FILTER (event = 'diverged'), -1) AS d, arg_max(detail, n) FILTER (event = 'diverged') AS detail, coalesce(max(n) FILTER (event = 'overflow'), -1) AS o, coalesce(max(n) FILTER (event = 'clean'), -1) AS k, max(coalesce(compared, 0)) AS a
 FROM ev WHERE addr IS NOT NULL AND (compared IS NOT NULL OR event IS NOT NULL) GROUP BY ALL),
 vd AS (SELECT doc_id, addr, CASE WHEN r = 'verified' AND compared = 0 THEN 'uncalled' ELSE r END AS result, compared, skipped, detail FROM (SELECT doc_id, addr, detail, coalesce(compared, 0) AS compared, coalesce(skipped, 0) AS skipped, CASE WHEN d >= 0 AND d > o THEN 'diverged' WHEN o >= 0 AND k > o THEN 'verified' WHEN o >= 0 THEN 'overflow' WHEN k >= 0 OR a > 0 THEN 'verified' ELSE 'uncalled' END AS r FROM fd))"""


@query(f"WITH {LOG} SELECT * FROM vd")
def log_fold(spark, d):
    return folded(spark, d)


@query(f"WITH {LOG} SELECT result, count(*) AS n_rows, sum(compared)::BIGINT AS sum_compared FROM vd GROUP BY 1")
def verdict_hist(spark, d):
    return folded(spark, d).groupBy("result").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("compared").alias("sum_compared"))


def controls(v: DataFrame) -> DataFrame:
    """A set of controls for these logs: addresses divisible by 5 words, applied where skipped is even."""
    return v.filter(F.col("addr") % 20 == 0).select("doc_id", "addr", (F.col("skipped") % 2 == 0).alias("applied"))


CONTROL = "ct AS (SELECT doc_id, addr, skipped % 2 = 0 AS applied FROM vd WHERE addr % 20 = 0), tr AS (SELECT c.doc_id, coalesce(bool_and(v.result = 'diverged') FILTER (c.applied), false) AS trusted, count(*) FILTER (c.applied AND v.result <> 'diverged') AS missed FROM ct c JOIN vd v ON v.doc_id = c.doc_id AND v.addr = c.addr GROUP BY 1)"


@query(f"WITH {LOG}, {CONTROL} SELECT * FROM tr")
def session_trust(spark, d):
    v = folded(spark, d)
    return verdicts.trust(controls(v), v, "doc_id")


@query(f"WITH {LOG} SELECT addr, count(*) AS n_sessions, min(compared) AS least FROM vd WHERE result = 'verified' AND doc_id NOT IN (SELECT doc_id FROM vd WHERE result = 'diverged') GROUP BY 1")
def weakest_coverage(spark, d):
    v = folded(spark, d)
    bad = v.filter("result = 'diverged'").select("doc_id").distinct()
    clean = v.select("doc_id").distinct().join(bad, "doc_id", "left_anti").withColumn("trusted", F.lit(True))
    return verdicts.weakest(v, clean, "doc_id")


@query(
    f"""WITH {LOG}, {CUR}, lc AS (SELECT addr, min(compared) AS calls FROM vd WHERE result = 'verified' AND doc_id NOT IN (SELECT doc_id FROM vd WHERE result = 'diverged') GROUP BY 1), x AS (SELECT addr, calls, coalesce(nullif(lifted_lines, 0), nullif(ghidra_lines, 0), 1) AS lines FROM cur JOIN lc USING (addr))
 SELECT addr, calls, lines, CASE WHEN calls < 100 OR calls / lines::DOUBLE < 1.0 THEN 'held' ELSE 'promoted' END AS decision FROM x"""
)
def promote(spark, d):
    """Which functions their weakest trusted coverage promotes."""
    f = evidence.current_rows(table(spark, d, "guest_function").withColumn("addr", unsigned32(F.col("addr"))), "addr", "updated_at", ["lifted_lines", "ghidra_lines"])
    return verdicts.decided(f.select("addr", "lifted_lines", "ghidra_lines"), weakest_coverage(spark, d))


@query("SELECT DISTINCT port_id, build_id FROM port WHERE build_id IS DISTINCT FROM (SELECT max(build_id) FROM port)")
def stale_ports(spark, d):
    p = table(spark, d, "port").select("port_id", "build_id").distinct()
    return verdicts.stale(p, "build_id", p.agg(F.max("build_id").alias("latest")))


# --- texts ---------------------------------------------------------------------------------------


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query("SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, round(length(text) / 3.1::DOUBLE))::INT END AS tokens FROM documents")
def token_estimates(spark, d):
    return documents(spark, d).select("doc_id", token_estimate(F.col("text")).cast("int").alias("tokens"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def hash_text(spark, d):
    return documents(spark, d).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT DISTINCT doc_id, ('0x' || unnest(regexp_extract_all(text, '\\bsub_([0-9A-Fa-f]{8})\\b', 1)))::BIGINT AS addr FROM documents")
def extract_citations(spark, d):
    return documents(spark, d).select("doc_id", F.explode(text.citations(F.col("text"))).alias("addr")).distinct()


@query("WITH l AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r') AS l FROM documents)) SELECT doc_id, CASE WHEN len(l) <= 12 THEN array_to_string(l, chr(10)) ELSE array_to_string(list_concat(l[1:7], ['... ' || (len(l) - 11) || ' lines elided ...'], l[len(l) - 3:]), chr(10)) END AS view FROM l")
def elide_middle(spark, d):
    return documents(spark, d).select("doc_id", text.elide(F.col("text"), 12).alias("view"))


def _widths(sql: str) -> str:
    for a, b in text.WIDTH_TYPES.items():
        sql = f"regexp_replace({sql}, '\\b{a}\\b', '{b}', 'g')"
    return sql


TEXT_LINES = "ll AS (SELECT doc_id, text, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, text, string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r') AS l FROM documents))"


@query(
    f"""WITH {TEXT_LINES}, x AS (SELECT doc_id, trim(unnest(l), ' ') AS t, unnest(range(len(l))) AS n FROM ll), f AS (SELECT doc_id, min(n) AS stop FROM x WHERE starts_with(t, '```') GROUP BY 1),
 k AS (SELECT x.doc_id, n, t, sum(len(t) + 1) OVER (PARTITION BY x.doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS before FROM x LEFT JOIN f USING (doc_id) WHERE t <> '' AND NOT starts_with(t, '#') AND (stop IS NULL OR n < stop))
 SELECT d.doc_id, coalesce(left(string_agg(k.t, ' ' ORDER BY k.n), 300), '') AS note FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id AND (before IS NULL OR before <= 260) GROUP BY d.doc_id"""
)
def note_summaries(spark, d):
    return documents(spark, d).select("doc_id", text.summary(F.col("text")).alias("note"))


@query(
    f"""WITH {TEXT_LINES}, c AS (SELECT doc_id, text, l, list_filter(CASE WHEN len(l) > 0 THEN [ltrim(l[1], ' ')] || l[2:] ELSE l END, lambda x: trim(x, ' ') <> '' AND NOT regexp_matches(trim(x, ' '), '^(?:/[/*]|\\*)'))[1] AS head FROM ll WHERE text LIKE '%undefined8%')
 SELECT doc_id, CASE WHEN regexp_matches(head, '^[A-Za-z_][\\w\\s*]*\\w\\s*\\([^;]*\\)?\\s*\\{{?\\s*$') THEN trim(head, ' ') ELSE '' END AS signature, trim(text, ' ') <> '' AND text NOT LIKE '%halt_baddata%' AS usable,
 regexp_matches(text, '(?i)\\b(?:unrecovered|UNRECOVERED_JUMPTABLE|goto code_r0x)') AS unresolved, md5({_widths("array_to_string(list_filter(l, lambda x: trim(x, ' ') <> '' AND NOT (regexp_matches(x, '" + text.DECLARATION + "') AND NOT regexp_matches(x, '^\\s*(?:return|goto)\\b'))), chr(10))")}) AS digest FROM c"""
)
def c_views(spark, d):
    t = F.col("text")
    c = documents(spark, d).filter(t.contains("undefined8"))
    plain_c = text.normalise_c(t)
    return c.select("doc_id", text.signature(F.ltrim(t)).alias("signature"), text.usable(t).alias("usable"), text.unresolved_branch(t).alias("unresolved"), F.md5(plain_c.cast("binary")).alias("digest"))


@query()
def packet_views(spark, d):
    f = functions(spark, d).select("addr", "name", F.col("lifted_lines").alias("lines"), "tier", "status", "family_id", "hot")
    bodies = listings(spark, d).groupBy("addr").agg(F.min("body").alias("body"))
    constants = folds.fold_constants(bodies, "addr", "body").select("addr", F.explode("values").alias("value"))
    calls = edges(spark, d)
    facts = text.packet_facts(f, calls, constants, "addr")
    return text.packets(f, text.marked(calls, f, "addr"), bodies, "addr", 6000, facts=facts, keep_last=True).select("addr", "packet", "tokens", F.size("dropped").alias("n_dropped"))


@query()
def answer_records(spark, d):
    from lodestrata.operators import answers

    rows = readable(spark, d).filter("provider = 'claude'").select("event_id", F.get_json_object("body", "$.structured_output").alias("payload"))
    a = answers.answers(rows.filter("payload is not null"), "event_id", "payload")
    return a.select("event_id", "pos", "addr", F.size("windows").alias("n_windows"), F.get(F.transform("windows", answers.address_expression), F.lit(0)).alias("first_window"))
