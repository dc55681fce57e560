import json
import random

from lodestrata.functions.jsontree import leaves, with_leaf_map
from lodestrata.operators import drift


def maps(spark, rows):
    df = spark.createDataFrame([(i, f, n, json.dumps(b) if isinstance(b, dict) else b) for i, (f, n, b) in enumerate(rows)], "event_id int, feed string, file_no int, body string")
    return with_leaf_map(df, "body", "usage")


def changes(m):
    return sorted((r.feed, r.file_no, r.field, r.change) for r in drift.shape_changes(m, "feed", "file_no").collect())


def test_every_kind_of_change(spark):
    u = lambda **k: {"usage": k}
    m = maps(
        spark,
        [
            ("a", 1, u(input_tokens=1, cache_read_input_tokens=5, gone=1_000_000)),
            ("a", 1, None),
            ("a", 2, u(input_tokens="1", cacheReadInputTokens=5, fresh=[1], nested={"x": None, "e": {}})),
            ("a", 2, u(input_tokens="1", cacheReadInputTokens=5, fresh=[1], nested={"x": None})),
            ("a", 2, '{"usage": {"cut": '),
            ("b", 7, u(x=1)),
            ("b", 9, u(x=1.5)),
        ],
    )
    assert changes(m) == [
        ("a", 2, "usage.cacheReadInputTokens", "renamed"),
        ("a", 2, "usage.fresh", "added"),
        ("a", 2, "usage.gone", "removed"),
        ("a", 2, "usage.input_tokens", "retyped"),
        ("a", 2, "usage.nested.x", "added"),
        ("b", 9, "usage.x", "retyped"),
    ]


def many(n, **fields):
    """Records whose fields are drawn from (low, high)."""
    rnd = random.Random(n)
    return [{"usage": {k: rnd.randint(*v) for k, v in fields.items()}} for _ in range(n)]


def test_renames_are_seen_in_the_values(spark):
    rows = [("a", 1, r) for r in many(30, alpha=(900, 9000), k=(1, 9))] + [("a", 2, r) for r in many(31, beta=(900, 9000), k=(1, 9))]
    rows += [("b", 1, r) for r in many(32, alpha=(900, 9000))] + [("b", 2, r) for r in many(33, gamma=(1, 20))]
    assert changes(maps(spark, rows)) == [("a", 2, "usage.beta", "renamed"), ("b", 2, "usage.alpha", "removed"), ("b", 2, "usage.gamma", "added")]


def test_fields_of_one_record_are_two_figures(spark):
    """Alike in name and values, but somewhere they stand side by side."""
    rows = [("a", 1, r) for r in many(30, read_tokens=(900, 9000))] + [("a", 2, r) for r in many(31, read_token=(900, 9000))]
    assert changes(maps(spark, rows)) == [("a", 2, "usage.read_token", "renamed")]
    rows += [("z", 1, r) for r in many(3, read_tokens=(900, 9000), read_token=(900, 9000))]
    assert [c[2:] for c in changes(maps(spark, rows))] == [("usage.read_token", "added"), ("usage.read_tokens", "removed")]


def test_names_decide_between_equals(spark):
    rows = [("a", 1, r) for r in many(30, cache_read=(9, 99), other_thing=(9, 99))] + [("a", 2, r) for r in many(31, cacheRead=(9, 99), otherThing=(9, 99))]
    found = drift.shape_changes(maps(spark, rows), "feed", "file_no").collect()
    assert sorted((r.old_field, r.field, r.change) for r in found) == [("usage.cache_read", "usage.cacheRead", "renamed"), ("usage.other_thing", "usage.otherThing", "renamed")]


def test_spellings_follow_renames(spark):
    rows = [("a", f, r) for f, name in enumerate(["x", "y", "z"]) for r in many(30 + f, **{name: (900, 9000)})]
    known = drift.spellings(drift.shape_changes(maps(spark, rows), "feed", "file_no"), ["usage.x", "usage.other"])
    assert known == {"usage.x": ["usage.x", "usage.y", "usage.z"], "usage.other": ["usage.other"]}


def test_unreadable_file_has_no_fields(spark):
    m = maps(spark, [("a", 1, {"usage": {"x": 1}}), ("a", 2, "garbage"), ("a", 3, {"usage": {"x": None}})])
    assert [c[1:] for c in changes(m)] == [(2, "usage.x", "removed"), (3, "usage.x", "added")]


def test_empty(spark):
    m = maps(spark, [("a", 1, None)]).limit(0)
    assert changes(m) == []


def test_typed_columns_and_failed_casts(spark):
    m = maps(
        spark,
        [
            ("a", 1, {"usage": {"input_tokens": [12], "cache": {"read_input_tokens": "7"}}}),
            ("a", 1, {"usage": {"input_tokens": 0.5, "cacheReadInputTokens": None}}),
            ("a", 1, {"usage": {"input_tokens": [1, 2], "output_tokens": "x" * 100_000}}),
        ],
    )
    got = {r.event_id: r for r in drift.typed_columns(m, {"i": ["usage.input_tokens"], "r": ["usage.cacheReadInputTokens", "usage.cache.read_input_tokens"], "o": ["usage.output_tokens"]}).collect()}
    assert (got[0].i, got[0].r, got[0].failed_casts) == (12, 7, [])
    assert got[1].i is None and got[1].failed_casts[0].raw == "0.5"
    assert {f.path for f in got[2].failed_casts} == {"usage.input_tokens", "usage.output_tokens"}


def test_leaves_of_deep_objects():
    deep = 1
    for _ in range(500):
        deep = {"k": deep}
    assert leaves(deep, "u") == [("u" + ".k" * 500, "integer", "1")]
    assert leaves({"s": "\ud800"}, "u") == [("u.s", "string", "?")]


def test_clashing_columns_and_nulls(spark):
    rows = [(None, "a", 1, 9, '{"usage": {"input_tokens": 3}}'), (2, None, None, 9, None), (3, "a", 2, 9, '{"usage": [1]}'), (3, "a", 2, 9, '{"usage": [1]}')]
    df = spark.createDataFrame(rows, "event_id int, feed string, file_no int, leaves int, body string")
    m = with_leaf_map(df, "body", "usage")
    assert changes(m) == [("a", 2, "usage.input_tokens", "removed")]
    got = drift.typed_columns(m.withColumnRenamed("file_no", "tokens"), {"tokens": ["usage.input_tokens"]}).collect()
    assert sorted(r.tokens or 0 for r in got) == [0, 0, 0, 3]
