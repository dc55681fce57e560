import pytest

from lodestrata.operators.store import RunMemo, SnapshotStore


@pytest.fixture
def snap(spark, tmp_path):
    return SnapshotStore(spark, "file://" + str(tmp_path))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_partial_upsert_keeps_and_overwrites(spark, snap):
    snap.overwrite("t", spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int"))
    snap.upsert("t", spark.createDataFrame([(1, None, 9), (3, "c", 9), (3, "d", 9)], "k int, s string, seq int"), ["k"], ["s"], "seq")
    assert rows(snap.read("t").filter("k < 3")) == [(1, None, 1), (2, "b", 2)]
    assert [r.n for r in snap.read("t").filter("k = 3").collect()] == [None]


def test_append_and_insert_missing(spark, snap):
    one = spark.createDataFrame([(1, "a")], "k int, s string")
    snap.append("t", one)
    before = snap.fingerprint("t")
    snap.append("t", one)
    assert snap.fingerprint("t") != before
    snap.insert_missing("t", spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, s string"), ["k"])
    assert rows(snap.read("t")) == [(1, "a"), (1, "a"), (2, "y")]


def test_memo(spark, snap):
    snap.append("t", spark.range(1))
    memo, ran = RunMemo(snap), []
    act = lambda: ran.append(1) or len(ran)
    assert memo.run("s", {"a": 1}, ["t"], act) == (True, 1)
    assert memo.run("s", {"a": 1}, ["t"], act) == (False, 1)
    assert memo.run("s", {"a": 1}, ["t"], act, force=True)[0]
    snap.append("t", spark.range(1))
    assert memo.run("s", {"a": 1}, ["t"], act)[0]
    with pytest.raises(ZeroDivisionError):
        memo.run("f", {}, [], lambda: 1 / 0)
    assert memo.run("f", {}, [], lambda: 5) == (True, 5)
