import random

from lodestrata.operators import graph, similarity


def test_closure_of_a_chain(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 2), (1, 3), (4, None), (None, 9)], "a long, b long")
    s = spark.createDataFrame([(1,), (1,), (None,)], "x long")
    got = {r.node: r.depth for r in graph.closure(e, s, "a", "b").collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}
    assert {r.node for r in graph.closure(e, s, "a", "b", 1).collect()} == {1, 2, 3}
    assert graph.closure(e, s.limit(0), "a", "b").count() == 0


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {n: find(n) for n in parent}


def test_two_cliques_part_at_the_bridge(spark):
    clique = lambda k: [(k + i, k + j) for i in range(6) for j in range(i)]
    e = spark.createDataFrame(clique(0) + clique(100) + [(0, 100), (3, 3)], "a long, b long")
    labels = graph.propagate_labels(e, "a", "b", lambda n: n % 2 == 0)
    sets = {}
    for r in labels.collect():
        assert r.converged
        sets.setdefault(r.label, set()).add(r.node)
    assert sorted(map(sorted, sets.values())) == [list(range(6)), list(range(100, 106))]
    s = {r.label: r for r in graph.community_summary(e, labels, "a", "b").collect()}
    assert all(x.external == 1 for x in s.values())
    assert sorted(x.internal for x in s.values()) == [15, 16]


def test_families(spark):
    ops = "lwz addi stw bl cmpwi beq li blr".split()
    rows = [(1, ops), (2, ops), (3, ["or", "and", "xor", "nor", "srawi", "mulli", "neg"]), (4, ["lwz"]), (5, []), (6, ops[:-1] + ["mr", "blr"])]
    df = spark.createDataFrame(rows, "id long, ops array<string>")
    for mode in ("fast", "portable"):
        got = {r.id: (r.family_id, r.size) for r in similarity.families(df, "id", "ops", mode=mode).collect()}
        assert got[1][0] == got[2][0] == 1 and got[3] == (max(v[0] for v in got.values()), 1) and {4, 5}.isdisjoint(got)


def test_number_in_order(spark):
    df = spark.range(500).selectExpr("(id * 37) % 1000 as x")
    got = sorted((r.n, r.x) for r in graph.number_in_order(df, "x", "n").collect())
    assert [n for n, _ in got] == list(range(1, 501)) and [x for _, x in got] == sorted(x for _, x in got)


def test_seed_list(spark):
    df = spark.createDataFrame([("sub_82000000, 0x82000004 # 82000008",), ("bad 82000000",), (None,), ("",)], "t string")
    assert sorted(r.node - 0x82000000 for r in graph.seed_list(df, "t").collect()) == [0, 4]
