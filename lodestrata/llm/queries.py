"""Queries of the training-data problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.scalars import address_of, plain, source_key, unsigned32
from lodestrata.llm.bpe import VOCABULARY, encode_corpus
from lodestrata.llm.mix import mix_sources
from lodestrata.llm.runs import collapse_runs
from lodestrata.llm.spam import connectives, spam_pages, spam_scores, word_uses
from lodestrata.llm.topn import top_n
from lodestrata.operators.evidence import current_rows
from lodestrata.shared import table


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    cols = ["subsystem_id", "tier", "hot", "retired_at"]
    f = table(spark, d, "guest_function").select(unsigned32(F.col("addr")).alias("addr"), "updated_at", *cols)
    live = current_rows(f, "addr", "updated_at", cols)
    letter = F.upper(F.regexp_replace("tier", r"[\s\p{Z}]+", ""))
    live = live.filter(F.col("retired_at").isNull() & F.col("subsystem_id").isNotNull()).withColumn("tier", letter)
    live = live.filter(F.col("tier").isin(*"ABCDEFLU")).select("subsystem_id", "tier", "addr", "hot")
    return top_n(live, ["subsystem_id", "tier"], ["hot"], ["addr"], 10)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The ten hottest live functions of each subsystem and tier."""
    return _ranked(spark, d).select("subsystem_id", "tier", "addr")


def p2_top_hot(spark: SparkSession, d: str) -> DataFrame:
    """The same with their heat."""
    return _ranked(spark, d)


def _trace(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "trace")
    thread = plain(F.col("thread"))
    return t.select("capture_id", F.when(thread != "", thread).alias("thread"), "seq", address_of(F.col("function")).alias("addr"), "cycles")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one function in a thread of a capture, by first and last seq."""
    runs = collapse_runs(_trace(spark, d), ["capture_id", "thread"], "seq", "addr")
    return runs.select("capture_id", "thread", F.col("first").alias("first_seq"), F.col("last").alias("last_seq"))


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    """The same with function, number of events and duration in cycles."""
    runs = collapse_runs(_trace(spark, d), ["capture_id", "thread"], "seq", "addr", "cycles")
    return runs.select("capture_id", "thread", F.col("item").alias("addr"), F.col("first").alias("first_seq"), F.col("last").alias("last_seq"), F.col("n").alias("n_events"), F.col("duration").alias("duration_cycles"))


def p6_ids(spark: SparkSession, d: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and token ids of every document."""
    return encode_corpus(table(spark, d, "documents").select("doc_id", "text"), "text", vocabulary=vocabulary)


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", source_key(F.col("source")).alias("source"), "text")
    sized = encode_corpus(docs, "text", "tokens", sizes_only=True)
    mix = table(spark, d, "mix_target").withColumn("source", source_key(F.col("source")))
    return mix_sources(sized, mix, "doc_id", "source", "tokens")


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every mix in the order of its schedule, a row for each occurrence."""
    return _mixed(spark, d)[0].select("mix_id", "slot", "doc_id", "source", "tokens", "round")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source in every mix."""
    return _mixed(spark, d)[1]


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", source_key(F.col("source")).alias("host"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are search keywords, bare links or tags for the greater part."""
    return spam_pages(_pages(spark, d), "doc_id", "text", "host").distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """The evidence for every document with a text."""
    return spam_scores(_pages(spark, d), "doc_id", "text", "host")


def p8_connectives(spark: SparkSession, d: str) -> DataFrame:
    """The words that mostly join sentences in this corpus, with their uses."""
    return connectives(word_uses(table(spark, d, "documents").select("text"), "text"))


QUERIES = {f.__name__: f for f in (p2_found, p2_top_hot, p4_found, p4_runs, p6_ids, p7_selection, p7_shares, p8_found, p8_scores, p8_connectives)}
_CURRENT = "cur AS (SELECT a, s, regexp_replace(upper(t), '\\s', '', 'g') AS t, h FROM (SELECT addr & 4294967295 AS a, subsystem_id AS s, tier AS t, hot AS h, retired_at AS r FROM guest_function QUALIFY row_number() OVER (PARTITION BY addr & 4294967295 ORDER BY updated_at DESC) = 1) WHERE r IS NULL AND s IS NOT NULL AND h IS NOT NULL)"
_TOP = f"WITH {_CURRENT} SELECT s AS subsystem_id, t AS tier, a AS addr, h AS hot FROM cur WHERE t IN ('A', 'B', 'C', 'D', 'E', 'F', 'L', 'U') QUALIFY row_number() OVER (PARTITION BY s, t ORDER BY h DESC, a) <= 10"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_RUNS = f"""WITH n AS (SELECT capture_id, seq, thread, min(addr) AS addr, min(cycles) AS cycles FROM (SELECT capture_id, seq, nullif(lower(trim(thread, {_BLANKS})), '') AS thread, CASE WHEN regexp_full_match(s, '(0x|sub_)?[0-9a-f]{{8}}') THEN ('0x' || right(s, 8))::BIGINT END AS addr, cycles FROM (SELECT *, lower(trim(function, {_BLANKS})) AS s FROM trace)) WHERE thread IS NOT NULL GROUP BY ALL),
 l AS (SELECT *, lag(addr) OVER (PARTITION BY capture_id, thread ORDER BY seq) AS p FROM n), g AS (SELECT *, sum(CASE WHEN addr = p THEN 0 ELSE 1 END) OVER (PARTITION BY capture_id, thread ORDER BY seq) AS g FROM l)
 SELECT capture_id, thread, min(addr) AS addr, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_events, max(cycles) - min(cycles) AS duration_cycles FROM g WHERE addr IS NOT NULL GROUP BY capture_id, thread, g HAVING count(*) > 1"""
SQL: dict[str, str] = {
    "p2_found": f"SELECT subsystem_id, tier, addr FROM ({_TOP})",
    "p2_top_hot": _TOP,
    "p4_found": f"SELECT capture_id, thread, first_seq, last_seq FROM ({_RUNS})",
    "p4_runs": _RUNS,
    "p8_connectives": r"""WITH p AS (SELECT unnest(string_split_regex(text, '[\r\n\x0b\x0c\x{85}\x{2028}\x{2029}]+|<[^<>]*>')) AS line FROM documents WHERE text IS NOT NULL),
 q AS (SELECT unnest(string_split_regex(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS piece FROM p), w AS (SELECT piece, regexp_extract_all(lower(piece), '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*') AS words FROM q),
 u AS (SELECT len(words) >= 5 AND regexp_matches(piece, '^\s*\p{Lu}') AND regexp_matches(piece, '[.!?]\s*$') AS s, unnest(words) AS word FROM w)
 SELECT word, count(*) AS n, count(*) FILTER (s) AS n_sentence FROM u GROUP BY 1 HAVING count(*) >= 20 AND 100 * count(*) FILTER (s) >= 55 * count(*) AND NOT regexp_full_match(word, '\p{N}+')""",
}
