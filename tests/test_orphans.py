from datetime import datetime as dt

from lodestrata.operators.orphans import orphan_references

REFS = "id int, a bigint, b bigint, t timestamp_ntz, since int"
RECORDS = "a bigint, b bigint, since timestamp_ntz, until timestamp_ntz, id string"


def ids(df):
    return sorted(r.id for r in df.collect())


def test_match_rules_on_partial_nulls(spark):
    refs = spark.createDataFrame([(1, 1, 1, None, 0), (2, 1, 9, None, 0), (3, None, 1, None, 0), (4, None, 9, None, 0), (5, 1, None, None, 0), (6, None, None, None, 0), (2, 1, 9, None, 0)], REFS)
    recs = spark.createDataFrame([(1, 1, None, None, "x"), (1, 1, None, None, "x"), (None, 9, None, None, "y")], RECORDS)
    find = lambda m: ids(orphan_references(refs, recs, ["a", "b"], match=m))
    assert find("simple") == [2, 2]
    assert find("partial") == [2, 2]
    recs = recs.filter("b = 1")
    assert find("partial") == [2, 2, 4]
    assert find("full") == [2, 2, 3, 4, 5]


def test_time_bounds(spark):
    at = dt(2030, 5, 1)
    refs = spark.createDataFrame([(1, 1, 0, at, 0), (2, 2, 0, at, 0), (3, 3, 0, at, 0), (4, 4, 0, at, 0), (5, 5, 0, None, 0)], REFS)
    recs = spark.createDataFrame(
        [(1, 0, dt(2030, 5, 1), None, ""), (2, 0, dt(2030, 5, 2), None, ""), (3, 0, None, dt(2030, 5, 1), ""), (4, 0, None, dt(2030, 5, 2), ""), (5, 0, dt(2031, 1, 1), None, "")], RECORDS
    )
    assert ids(orphan_references(refs, recs, ["a"], at="t", since="since", until="until")) == [2, 3]


def test_empty_tables(spark):
    refs, recs = spark.createDataFrame([], REFS), spark.createDataFrame([], RECORDS)
    assert orphan_references(refs, recs, ["a"]).count() == 0
    some = spark.createDataFrame([(1, 1, 1, None, 0)], REFS)
    assert ids(orphan_references(some, recs, ["a"])) == [1]


def test_hot_key_is_salted_and_whole(spark):
    from lodestrata.operators import skew

    refs = spark.range(60_000).selectExpr("id", "if(id % 3 = 0, 7, id) as a")
    recs = spark.createDataFrame([(7,), (8,)], "a bigint")
    assert [k[0] for k in skew.hot_keys(refs, ["a"])] == [7]
    found = orphan_references(refs, recs, ["a"])
    assert found.count() == 40_000 - 2
    assert orphan_references(refs, recs.filter("a = 8"), ["a"]).count() == 60_000 - 1


def test_running_total(spark):
    from pyspark.sql import functions as F

    from lodestrata.operators.skew import running_total

    df = spark.range(1000).selectExpr("id % 2 as g", "id as o", "id % 7 as v")
    got = running_total(df, ["g"], ["o"], "v", F.floor(F.col("o") / 100), "before").orderBy("o").collect()
    sums = {0: 0, 1: 0}
    for r in got:
        assert r.before == sums[r.g]
        sums[r.g] += r.v
