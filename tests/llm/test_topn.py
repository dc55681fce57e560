import random
from heapq import merge

from lodestrata.llm.loser_tree import LoserTree
from lodestrata.llm.topn import seek_groups, top_n


def test_loser_tree_merges():
    rnd = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rnd.randrange(20) for _ in range(rnd.randrange(6))) for _ in range(k)]
        tree, got = LoserTree(runs), []
        while (x := tree.pop()) is not None:
            got.append(runs[x[0]][x[1]])
        assert got == list(merge(*runs))


def brute(rows, n):
    groups = {}
    for r in rows:
        if r[2] is not None:
            groups.setdefault(r[:2], []).append(r)
    high = lambda r: (-r[2], r[3] is None, r[3] or 0)
    return sorted((x for g in groups.values() for x in sorted(g, key=high)[:n]), key=str)


SCHEMA = "g long, t string, hot long, addr long"


def test_against_brute_force_with_a_hot_group(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 1, 2, None]), rnd.choice(["A", "B", None]), rnd.choice([None, *range(5)]), i) for i in range(3000)]
    for runs, fan in ((1, 32), (4, 32), (9, 2)):
        df = spark.createDataFrame(rows, SCHEMA).repartition(runs)
        got = top_n(df, ["g", "t"], ["hot"], ["addr"], 10, fan_in=fan)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 10)


def test_seek_over_batches():
    import pyarrow as pa

    rnd = random.Random(4)
    groups = sorted(rnd.choices(range(12), [1, 40, 1, 9, 9, 30, 1, 1, 1, 1, 1, 5], k=300))
    rows = [(g, i) for i, g in enumerate(groups)]
    for cut in (1, 3, 7, 300):
        batches = [pa.RecordBatch.from_pylist([{"g": g, "i": i} for g, i in rows[a : a + cut]]) for a in range(0, 300, cut)]
        got = [(r["g"], r["i"]) for b in seek_groups(iter(batches), ["g"], 5) for r in b.to_pylist()]
        assert got == [(g, i) for k, (g, i) in enumerate(rows) if k < 5 or groups[k - 5] != g]


def test_edges(spark):
    rows = [(1, "A", 5, None), (1, "A", 5, 3), (1, "A", 5, 3), (1, "A", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, top_n(df, ["g"], ["hot"], ["addr"], 2).collect())) == [(1, "A", 5, 3)] * 2
    assert top_n(df, ["g"], ["hot"], ["addr"], 0).count() == 0
    assert top_n(df.limit(0), ["g"], ["hot"], ["addr"], 3).count() == 0
    assert top_n(df, ["g"], ["hot"], ["addr"], 9).columns == df.columns


def test_text_scores_and_clashing_names(spark):
    rows = [("g", "x" * 50_000, 1, "r1"), ("g", "b", 2, "r2"), ("g", "a", 3, "r3")]
    df = spark.createDataFrame(rows, "g string, s string, run int, mix string")
    assert [r.mix for r in top_n(df, ["g"], ["s"], ["run"], 2).collect()] == ["r1", "r2"]
