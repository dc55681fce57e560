"""Queries that do the whole job, against brute force on the smallest tables."""

from collections import Counter, defaultdict

import __spark_entry__ as entry
from lodestrata.operators import graph, text
from lodestrata.plans import corpus

D = "/root/testdata/sf0.001"


def test_labels_are_propagated_until_they_settle(spark):
    near = defaultdict(list)
    for r in corpus.direct(spark, D).collect():
        if r.caller is not None and r.caller != r.callee:
            near[r.caller].append(r.callee)
            near[r.callee].append(r.caller)
    label, rounds, moved = {n: n for n in near}, 0, True
    while moved and rounds < 12:
        rounds, moved = rounds + 1, False
        for side in (0, 1):
            new = {}
            for n in near:
                if n // 4 % 2 == side:
                    votes = Counter([label[o] for o in near[n]] + [label[n]])
                    new[n] = min(votes, key=lambda k: (-votes[k], k))
            moved |= any(label[n] != k for n, k in new.items())
            label |= new
    assert rounds > 3
    q = entry.queries()
    got = q["label_propagation"](spark, D).collect()
    assert {r.node: r.label for r in got} == label and {r.converged for r in got} == {not moved}
    summary = q["community_summary"](spark, D).collect()
    assert {r.label: r.size for r in summary} == Counter(label.values()) and {r.converged for r in summary} == {not moved}


def closure_of(spark, edges, dropped=()):
    near = defaultdict(set)
    for r in edges:
        if r.callee is not None and r.kind not in ("helper", "import", "indirect") and r.callee not in dropped:
            near[r.caller].add(r.callee)
    depth = {r.addr: 0 for r in corpus.functions(spark, D).filter("seed").collect()}
    queue = list(depth)
    for n in queue:
        for o in near[n] - depth.keys():
            depth[o] = depth[n] + 1
            queue.append(o)
    return depth


def test_closure_has_no_depth_limit(spark):
    dropped = {r.addr for r in corpus.runtime(spark, D).collect()}
    want = closure_of(spark, corpus.edges(spark, D).collect(), dropped)
    assert max(want.values()) > 3
    assert {r.node: r.depth for r in entry.queries()["closure_depth"](spark, D).collect()} == want


def test_stop_reasons(spark):
    e = spark.createDataFrame([(1, 2, "helper"), (1, 2, "helper"), (3, 4, "helper"), (1, None, "indirect"), (1, None, "indirect"), (3, None, "indirect"), (9, None, "indirect"), (1, 8, "direct"), (1, 8, "direct"), (1, 3, "direct")], "a long, b long, k string")
    reached = spark.createDataFrame([(1, 0), (3, 2)], "node long, depth int")
    runtime = spark.createDataFrame([(8,)], "addr long")
    got = lambda depth: {r.kind: r.n_stopped for r in graph.stop_reasons(e, reached, "a", "b", "k", ("helper", "indirect"), runtime, "indirect", depth).collect()}
    assert got(0) == {"helper": 2, "indirect": 3, "runtime": 1}
    assert got(2) == {"helper": 1, "indirect": 3, "runtime": 1}


def test_every_indirect_edge_of_reached_callers_counts(spark):
    edges = corpus.edges(spark, D).collect()
    reached = closure_of(spark, edges, {r.addr for r in corpus.runtime(spark, D).collect()})
    got = {r.kind: r.n_stopped for r in entry.queries()["closure_stopped"](spark, D).collect()}
    assert got["indirect"] == sum(r.kind == "indirect" and r.caller in reached for r in edges)


def test_packets_keep_the_only_body_and_state_the_facts(spark):
    f = spark.createDataFrame([(1, "alpha", 9, "A", "pending", 5, 1), (2, "beta", 9, "B", "verified", 5, 3), (3, None, 9, "C", "gate2", 5, 0)], "addr long, name string, lines int, tier string, status string, family_id long, hot long")
    e = spark.createDataFrame([(1, 2, "beta", "direct", 1), (1, 3, "c", "direct", 2), (1, None, "(indirect)", "indirect", 3), (1, None, "(indirect)", "indirect", 4)], "caller long, callee long, callee_name string, kind string, site_line int")
    b = spark.createDataFrame([(1, "y" * 4000, None), (2, "y" * 4000, "int c;")], "addr long, body string, c string")
    k = spark.createDataFrame([(1, 2), (1, 255), (1, 255)], "addr long, value long")
    got = {r.addr: r for r in text.packets(f, text.marked(e, f, "addr"), b, "addr", 400, facts=text.packet_facts(f, e, k, "addr"), keep_last=True).collect()}
    assert got[1].packet == "FUNCTION alpha lines=9 tier=A\nCALLEES beta [ported] c [gate2] | 2 indirect\nCONSTANTS 0x00000002 (beta) 0x000000FF\nSIBLINGS sub_00000002 (beta)\n\n" + "y" * 4000
    assert got[1].dropped == [] and got[2].dropped == ["body"] and got[2].packet.endswith("int c;")


def test_packet_views_hold_every_listing(spark):
    views = {r.addr: r for r in entry.queries()["packet_views"](spark, D).collect()}
    bodies = {r.addr: r.body for r in corpus.listings(spark, D).groupBy("addr").agg({"body": "min"}).toDF("addr", "body").collect()}
    assert all(r.n_dropped == 0 and r.packet.endswith(bodies.get(a, "")) for a, r in views.items())
