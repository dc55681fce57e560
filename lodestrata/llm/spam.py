"""Keyword-stuffed and link-list pages.

1. Two vocabularies are learned from the whole corpus: the words that join
   sentences (``connectives``: most of their uses lie in pieces that begin with
   a capital and end as a sentence) and the endings of host names
   (``endings``: last labels of the hosts of full links).
2. Every text is scanned whole (``segments``): prose and data on one side,
   list items, stuffed sentences, links and tags on the other. That is the
   list-density evidence.
3. The phrases of the items and stuffed sentences of all pages are exploded
   into shingles of ``size`` words (a shorter phrase is its own shingle) and
   the distinct hosts of each are counted.
4. A phrase counts as replicated where at least half of its shingles stand on
   ``hosts`` hosts or more. A page is spam when replicated phrases, bare links
   and tags make up more than ``least`` of its characters.

A page with fewer than ``SHINGLE`` phrases is no list, its items count as
prose; its stuffed sentences, links and tags count. Links and tags that merely
end a text (at most ``few`` of both, with less of keywords than of prose)
don't count. The shingle table is aggregated by (shingle, host) before the
shuffle, and a shingle on a third of all pages is salted in the join back.

Shingles have two words, not five: keyword lists put the same few words
together anew, so of their five-word windows few stand anywhere else
(measured in the README).

Defined results: a null or empty text is no page and never spam; a page
without a host counts as the host ``""``; repeated texts are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.shipping import ship
from lodestrata.llm.segments import scan
from lodestrata.operators.skew import skew_join
from lodestrata.shared import store

ship(__name__)

SHINGLE = 5
PIECE = r"[\r\n\x0b\x0c\x85  ]+|<[^<>]*>|(?<=[.!?])\s+"
WORDS = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
#: At most so many learned words and endings are brought to the driver, the most frequent first.
MOST_WORDS, MOST_ENDINGS = 5000, 2000
SEGMENT = pa.list_(pa.struct([("kind", pa.string()), ("phrase", pa.string()), ("weight", pa.int32())]))


def word_uses(texts: DataFrame, text: str) -> DataFrame:
    """(word, n, n_sentence): uses of every word, and uses in pieces shaped like a sentence of five words or more."""
    pieces = texts.select(F.explode(F.split(F.col(text), PIECE)).alias("piece"))
    words = pieces.select("piece", F.regexp_extract_all(F.lower("piece"), F.lit(WORDS), F.lit(0)).alias("words"))
    shaped = (F.size("words") >= 5) & F.col("piece").rlike(r"^\s*\p{Lu}") & F.col("piece").rlike(r"[.!?]\s*$")
    return words.select(shaped.alias("s"), F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if("s").alias("n_sentence"))


def connectives(uses: DataFrame, share: float = 0.55, least: int = 20) -> DataFrame:
    """The words of ``word_uses`` that mostly join sentences: used ``least`` times or more, ``share`` of them in sentences."""
    return uses.filter((F.col("n") >= least) & (100 * F.col("n_sentence") >= round(100 * share) * F.col("n")) & ~F.col("word").rlike(r"^\p{N}+$"))


def endings(texts: DataFrame, text: str, least: int = 3) -> DataFrame:
    """(ending, n): last labels of the hosts of full links."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"https?://[^\s/<>()\"']*\.([a-z]{2,})\b"), F.lit(1))
    return texts.select(F.explode(found).alias("ending")).groupBy("ending").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def frequent(df: DataFrame, word: str, most: int) -> frozenset[str]:
    """The words of a learned vocabulary; never more than ``most``."""
    return frozenset(r[0] for r in df.orderBy(F.col("n").desc(), word).limit(most).select(word).collect())


def evidence(df: DataFrame, id: str, text: str, host: str) -> DataFrame:
    """List-density evidence of each page: host, the weight of prose and data, and all segments."""
    pages = df.select(F.col(id), F.col(text).alias("text"), F.col(host).alias("host"))
    words = frequent(connectives(word_uses(pages, "text")), "word", MOST_WORDS)
    ends = frequent(endings(pages, "text"), "ending", MOST_ENDINGS)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, page, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if page:
                    told, found = scan(page, words, ends)
                    rows.append((key, at or "", told, [{"kind": k, "phrase": p, "weight": w} for k, p, w in found]))
            cols = list(zip(*rows)) if rows else [[] for _ in range(4)]
            types = [batch.schema.field(0).type, pa.string(), pa.int64(), SEGMENT]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "host", "prose", "segments"])

    return pages.mapInArrow(walk, f"id {dict(df.dtypes)[id]}, host string, prose bigint, segments array<struct<kind:string,phrase:string,weight:int>>")


def phrase_shingles(phrase: Column, size: int) -> Column:
    """The phrase itself up to ``size`` words, else its windows of ``size`` words."""
    words = F.split(phrase, " ")
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))
    return F.when(F.size(words) <= size, F.array(phrase)).otherwise(windows)


def replicated_shingles(phrases: DataFrame, hosts: int, size: int) -> DataFrame:
    """(shingle, n_hosts): shingles of (host, phrase) that stand on ``hosts`` distinct hosts or more."""
    pieces = phrases.select("host", F.explode(F.array_distinct(phrase_shingles(F.col("phrase"), size))).alias("shingle")).distinct()
    return pieces.groupBy("shingle").agg(F.count(F.lit(1)).alias("n_hosts")).filter(F.col("n_hosts") >= hosts)


def spam_scores(df: DataFrame, id: str, text: str, host: str, hosts: int = 2, few: int = 8, size: int = 2) -> DataFrame:
    """Each page's evidence and ``score``, the share of its characters that is spam."""
    found, _ = store(evidence(df, id, text, host).withColumn("page", F.monotonically_increasing_id()), "pages")
    worded = F.filter("segments", lambda s: s["kind"].isin("item", "stuffed"))
    phrases = found.select("page", "host", F.posexplode(worded).alias("pos", "s")).select("page", "host", "pos", F.col("s.phrase").alias("phrase"), F.col("s.weight").alias("weight"))
    wide = replicated_shingles(phrases, hosts, size).select("shingle", F.lit(1).alias("wide"))
    pieces = phrases.select("page", "pos", "weight", F.explode(phrase_shingles(F.col("phrase"), size)).alias("shingle"))
    judged = skew_join(pieces, wide, ["shingle"], "left").groupBy("page", "pos").agg(F.max("weight").alias("weight"), F.avg(F.coalesce("wide", F.lit(0))).alias("part"))
    backed = judged.filter(F.col("part") >= 0.5).groupBy("page").agg(F.collect_set("pos").alias("backed"))
    total = lambda keep, of="segments": F.aggregate(F.filter(of, keep), F.lit(0).cast("bigint"), lambda a, x: a + x["weight"])
    j = found.join(backed, "page", "left").withColumn("worded", worded)
    kept = F.filter("worded", lambda s, i: F.array_contains(F.coalesce("backed", F.array().cast("array<int>")), i))
    n_phrases = F.aggregate("worded", F.lit(0), lambda a, s: a + F.greatest(F.lit(1), F.floor(F.size(F.split(s["phrase"], " ")) / 3)).cast("int"))
    listed = n_phrases >= SHINGLE
    j = j.withColumn("kept", kept).withColumns(
        {
            "links": total(lambda s: s["kind"] == "link"),
            "tags": total(lambda s: s["kind"] == "tag"),
            "n_marks": F.size(F.filter("segments", lambda s: s["kind"].isin("link", "tag"))),
            "words": total(lambda s: F.lit(True), "worded"),
            "replicated": total(lambda s: (s["kind"] == "stuffed") | listed, "kept"),
            "whole": F.col("prose") + total(lambda s: F.lit(True)),
        }
    )
    tail = (F.col("n_marks") <= few) & (F.col("words") < F.col("prose"))
    marked = F.col("replicated") + F.when(tail, F.lit(0)).otherwise(F.col("links") + F.col("tags"))
    score = F.coalesce(F.try_divide(marked, F.col("whole")), F.lit(0.0))
    return j.select(F.col("id").alias(id), "prose", "links", "tags", "words", "replicated", "n_marks", score.alias("score"))


def spam_pages(df: DataFrame, id: str, text: str, host: str, least: float = 0.5, **options) -> DataFrame:
    """The ids of pages that are spam for the greater part."""
    return spam_scores(df, id, text, host, **options).filter(F.col("score") > least).select(id)
