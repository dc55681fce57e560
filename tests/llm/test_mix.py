from collections import Counter

from pyspark.sql import functions as F

from lodestrata.llm import bpe, mix, queries
from lodestrata.llm.mix import mix_sources, targets
from lodestrata.shared import store

DOCS = "doc_id long, source string, tokens long"
MIX = "mix_id int, source string, weight double, max_repeats int, size_ratio double"


def corpus(spark):
    rows = [(i, "big", 50 + i % 11) for i in range(2000)] + [(10_000 + i, "small", 40) for i in range(50)] + [(20_000, "one", 700), (30_000, None, 1000), (30_001, "big", 0), (30_002, "big", None)]
    return spark.createDataFrame(rows, DOCS), rows


def test_shares_and_caps(spark):
    docs, rows = corpus(spark)
    mix = spark.createDataFrame([(1, "big", 6.0, 2, 0.5), (1, "small", 2.0, 4, 0.5), (1, "absent", 2.0, 4, 0.5), (1, "none", 0.0, 4, 0.5), (1, "null", None, 4, 0.5), (2, "small", 1.0, 1, 0.1), (2, "one", 1.0, 3, 0.1), (3, "big", 1.0, 0, 0.1)], MIX)
    chosen, report = mix_sources(docs, mix, "doc_id", "source", "tokens", size=64)
    got = chosen.collect()
    size = {r[0]: (r[1], r[2]) for r in rows}
    assert all(size[r.doc_id] == (r.source, r.tokens) for r in got)
    times = Counter((r.mix_id, r.doc_id) for r in got)
    assert all(n <= {"big": 2, "small": 4 if m == 1 else 1, "one": 3}[size[doc][0]] for (m, doc), n in times.items())
    assert len({(r.mix_id, r.doc_id, r.round) for r in got}) == len(got)
    total = sum(r[2] or 0 for r in rows)
    by = {(r.mix_id, r.source): r for r in report.collect()}
    assert set(by) == {(1, "big"), (1, "small"), (1, "absent"), (2, "small"), (2, "one")}
    # What the absent and the capped source leave goes to the other one.
    assert abs(by[1, "big"].tokens - (0.5 * total - 8000)) <= 30 and by[1, "big"].limited == ""
    assert by[1, "absent"].tokens == 0 and by[1, "absent"].limited == "no documents"
    assert by[1, "small"].tokens == 4 * 2000 and by[1, "small"].limited == "repeats"
    assert by[2, "one"].tokens == 3 * 700
    for (m, s), r in by.items():
        assert r.tokens == sum(x.tokens for x in got if (x.mix_id, x.source) == (m, s))


def test_shares_blocks_and_schedule(spark):
    docs, rows = corpus(spark)
    mix = spark.createDataFrame([(1, "big", 3.0, 9, 0.6), (1, "small", 1.0, 30, 0.6), (2, "big", 1.0, 9, 0.3), (2, "one", 1.0, 50, 0.3)], MIX)
    chosen, report = mix_sources(docs, mix, "doc_id", "source", "tokens", size=1000)
    total = sum(r[2] or 0 for r in rows)
    for r in report.collect():
        assert abs(r.tokens - r.target_tokens) <= 350, r
        assert abs(r.share_reached - r.target_share) < 0.01, r
    got = chosen.filter("mix_id = 1").collect()
    filled = Counter()
    source = {}
    for r in got:
        filled[r.slot] += r.tokens
        assert source.setdefault(r.slot, r.source) == r.source
    last = {s: max(x for x in source if source[x] == s) for s in ("big", "small")}
    assert all(900 <= n <= 1100 for s, n in filled.items() if s not in last.values())
    for k in range(10, len(source), 10):  # any beginning of the schedule holds the shares
        first = [s for s in sorted(source)[:k]]
        assert abs(sum(source[s] == "big" for s in first) / k - 0.75) < 0.2
    assert abs(sum(filled.values()) - 0.6 * total) < 200


def test_same_selection_each_time(spark):
    docs, _ = corpus(spark)
    mix = spark.createDataFrame([(1, "big", 1.0, 1, 0.2)], MIX)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(mix_sources(docs, mix, "doc_id", "source", "tokens")[0]) == key(mix_sources(docs.repartition(7), mix, "doc_id", "source", "tokens")[0])


def test_empty(spark):
    docs, _ = corpus(spark)
    mix = spark.createDataFrame([(1, "big", 1.0, 1, 0.2)], MIX)
    for d, m in ((docs.limit(0), mix), (docs, mix.limit(0))):
        chosen, report = mix_sources(d, m, "doc_id", "source", "tokens")
        assert chosen.count() == 0 and report.count() in (0, 1)
    assert targets(mix.limit(0), "mix_id", "source", "weight", "max_repeats", "size_ratio").count() == 0


def test_no_stored_row_of_the_selection_grows_with_the_corpus(spark, tmp_path, monkeypatch):
    stored = []
    for module in (bpe, mix):
        monkeypatch.setattr(module, "store", lambda df, label: (stored.append(store(df, label)), stored[-1])[1])
    spark.createDataFrame([(i, f"text {i} of some", "a" if i % 3 else "b") for i in range(600)], "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "m", 0.5, "a", 1.0, 2), (1, "m", 0.5, "b", 1.0, 2)], "mix_id int, mix_name string, size_ratio double, source string, weight double, max_repeats int").write.parquet(str(tmp_path / "mix_target.parquet"))
    chosen = queries.p7_selection(spark, str(tmp_path)).collect()
    assert {r.source for r in chosen} == {"a", "b"}
    for table, _ in stored:
        kinds = dict(table.dtypes)
        assert not [k for k in kinds.values() if k.startswith("array<array")]
        assert all(r[0] <= 20 for c, k in kinds.items() if k.startswith("array") for r in table.select(F.max(F.size(c))).collect())
