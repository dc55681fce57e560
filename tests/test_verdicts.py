from lodestrata.operators import ledger, verdicts, workqueue
from pyspark.sql import functions as F

LOG = """session 1
[x] sub_82000000 compared=5 skipped=1
[x] sub_82000004 compared=0 skipped=2
[x] sub_82000004 clean
[x] sub_82000008 diverged at r3
[x] sub_82000008 clean
[x] sub_8200000C diverged
[x] sub_8200000C overflow
[x] sub_82000010 overflow
[x] sub_82000010 compared=9 skipped=0
12 total calls
77 total calls"""


def test_fold(spark):
    df = spark.createDataFrame([(1, LOG), (2, None), (3, ""), (4, "x" * 200_000)], "id long, text string")
    ev = verdicts.log_events(df, "id", "text")
    got = {r.addr - 0x82000000: (r.result, r.compared, r.detail) for r in verdicts.fold_log(ev, "id").collect()}
    assert got == {0: ("verified", 5, None), 4: ("uncalled", 0, None), 8: ("diverged", 0, "at r3"), 12: ("overflow", 0, "[x] sub_8200000C diverged"), 16: ("overflow", 9, None)}
    assert [r.calls_total for r in verdicts.log_totals(ev, "id").collect()] == [77]


def test_trust_and_weakest(spark):
    v = spark.createDataFrame([(1, 10, "diverged", 1), (1, 20, "verified", 50), (2, 10, "verified", 1), (2, 20, "verified", 7), (3, 20, "verified", None)], "id long, addr long, result string, compared long")
    c = spark.createDataFrame([(1, 10, True), (1, 11, False), (2, 10, True), (3, 10, False)], "id long, addr long, applied boolean")
    t = verdicts.trust(c, v, "id")
    assert {r.id: (r.trusted, r.missed) for r in t.collect()} == {1: (True, 0), 2: (False, 1), 3: (False, 0)}
    assert [(r.id, r.addr) for r in verdicts.recordable(v, t, c, "id").collect()] == [(1, 20)]
    every = t.withColumn("trusted", F.lit(True))
    assert {r.addr: r.least for r in verdicts.weakest(v, every, "id").collect()} == {10: 1, 20: 0}


def test_stale(spark):
    p = spark.createDataFrame([(1, 5), (2, 4), (3, None)], "id long, build long")
    assert sorted(r.id for r in verdicts.stale(p, "build", spark.range(5, 6)).collect()) == [2, 3]


def test_streaks_and_smoothing(spark):
    rows = [("a", i, f) for i, f in enumerate([1, 1, 0, 1, 0, 1, 1, 1])] + [("b", 1, 1), ("b", 3, 1)]
    df = spark.createDataFrame(rows, "k string, o long, f int")
    got = sorted((r.k, r.first, r.last, r.length) for r in ledger.streaks(df, ["k"], ["o"], F.col("f") == 1, 2).collect())
    assert got == [("a", 0, 1, 2), ("a", 5, 7, 3), ("b", 1, 3, 2)]
    obs = spark.createDataFrame([("a", 1, 4.0), ("a", 2, 100.0), ("a", 3, None)], "k string, o long, x double")
    assert [r.value for r in ledger.smoothed(obs, ["k"], "o", "x", 3.1).collect()] == [3.37]


def test_weighted_is_half_even(spark):
    df = spark.createDataFrame([(5, None), (15, 0), (0, 0)], "a long, b long")
    assert [r[0] for r in df.select(ledger.weighted({"a": "0.1", "b": "5"})).collect()] == [0, 2, 0]
    assert [r[0] for r in df.select(ledger.hit_share("a", "b")).collect()] == [1.0, 1.0, 0.0]


def test_packing(spark):
    marks = "pppppxpspp"
    df = spark.createDataFrame([("q", i, m) for i, m in enumerate(marks)], "k string, o long, m string")
    got = workqueue.pack(df, ["k"], ["o"], F.col("m") == "p", F.col("m") == "s", 2).orderBy("o").collect()
    assert [r.batch for r in got] == [1, 1, 2, 2, 3, 4, 5, 5, 6]


def test_queue_order_and_progress(spark):
    df = spark.createDataFrame([(1, "B", None), (2, "A", "done"), (3, None, "open"), (4, "A", "open")], "id long, t string, s string")
    got = workqueue.next_items(df, [F.col("s") != "done"], [F.col("t").asc_nulls_last(), F.col("id")])
    assert [r.id for r in got.collect()] == [4, 3]
    p = {r.t: (r.n_total, r.n_settled, r.n_todo) for r in workqueue.progress(df, F.col("t"), "t", F.col("s"), ("done",), ("open",)).collect()}
    assert p == {"A": (2, 1, 0), "B": (1, 0, 1), None: (1, 0, 0)}
