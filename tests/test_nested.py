import json

from lodestrata.operators import nested
from lodestrata.operators.nested import ITEM
from lodestrata.plans import training


def nodes(spark, bodies):
    df = spark.createDataFrame([(i, b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)], "event_id long, body string")
    return nested.nodes(df, "body", ("structured_output",))


def tables(spark, bodies):
    return nested.tables(nodes(spark, bodies), "event_id")


def test_texts_in_reading_order(spark):
    body = {"message": {"content": [{"type": "text", "text": "a"}, {"type": "tool_result", "content": [{"type": "text", "text": ""}, {"type": "tool_result", "content": "b"}]}, {"type": "text", "text": None}, {"type": "tool_use", "input": {"text": "no"}}, {"type": "text", "text": "c"}]}}
    n = tables(spark, [body, {"message": {"content": "bare"}}, {"message": {"content": None}}, "cut {", None, ""])
    got = sorted((r.event_id, r.item, r.text) for r in nested.text_blocks(n, "event_id").collect())
    assert got == [(0, 0, "a"), (0, 1, ""), (0, 2, "b"), (0, 3, "c"), (1, 0, "bare")]


def test_repeated_records_merge(spark):
    body = {"message": {"content": [{"type": "text", "text": "a"}]}}
    df = spark.createDataFrame([(1, json.dumps(body))] * 2, "event_id long, body string")
    n = nested.tables(nested.nodes(df, "body"), "event_id")
    assert nested.text_blocks(n, "event_id").count() == 1


def test_costs_by_model(spark):
    n = tables(spark, [{"modelUsage": {"m-2.5": {"costUSD": 0.5}, "n": {"costUSD": None}, "o": {"costUSD": "0.25"}}}, {"modelUsage": [{"model": "m", "costUSD": 1}, {"model": "k", "costUSD": None}]}])
    assert sorted((r.event_id, r.item, float(r.cost)) for r in nested.keyed_costs(n, "event_id").collect()) == [(0, "m-2.5", 0.5), (0, "o", 0.25), (1, "m", 1.0)]


def test_addresses_at_any_depth(spark):
    so = {"addr": "0x8201824c", "note": {"addr_text": "82000400"}, "callees": [{"addr": -2113928116}, {"addr": None}, {"addr": "short"}, {"addr": [{"addr": " sub_82000001 "}]}]}
    n = tables(spark, [{"structured_output": so}, {"structured_output": json.dumps(so)}, {"structured_output": "prose"}, {"structured_output": []}])
    got = sorted((r.event_id, r.item) for r in nested.addresses(n, "event_id").collect())
    want = ["%08X" % (-2113928116 & 0xFFFFFFFF), "82000001", "8201824C"]
    assert got == sorted((e, w) for e in (0, 1) for w in want)


def test_dewey_parents_and_tables(spark):
    n = nodes(spark, [{"message": {"content": [{"type": "text", "text": "x"}]}}])
    rows = {r.schema_path: r for r in n.collect()}
    assert rows["message.content[].text"].parent == rows["message.content[]"].label
    t = nested.tables(n, "event_id")
    assert [(r.label, r.parent, r.fields) for r in nested.table_of(t, "event_id", "message.content[]").collect()] == [("0.0.0", "0", {"type": "text", "text": "x"})]


def test_every_object_is_a_row_of_the_table_of_its_path(spark):
    body = {"a": {"x": 1, "n": None, "b": [{"y": 2}, [{"y": 3}]], "e": {}}, "top": 5, "l": [1, 2]}
    got = {(r.schema_path, nested_label(r.label)): (nested_label(r.parent), {k: v.raw for k, v in r.fields.items()}) for r in tables(spark, [body]).collect()}
    assert got == {("a", "0"): (None, {"x": "1", "n": None}), ("a.b[]", "0.2.0"): ("0", {"y": "2"}), ("a.b[][]", "0.2.1.0"): ("0", {"y": "3"})}


def nested_label(label):
    return None if label is None else ".".join(map(str, label))


def test_clashing_columns_nulls_and_long_texts(spark):
    long = "x" * 300_000
    rows = [(1, "k", 5, '{"a": {"label": 1}}'), (2, None, None, json.dumps({"a": long})), (None, None, None, None)]
    df = spark.createDataFrame(rows, "event_id long, kind string, label int, body string")
    n = nested.nodes(df, "body")
    assert n.filter("kind = 'integer'").count() == 1
    assert [len(r.raw) for r in n.filter("event_id = 2").collect()] == [300_000]
    assert nested.nodes(df.limit(0), "body").count() == 0
    for part in (nested.text_blocks, nested.keyed_costs, nested.addresses):
        assert part(nested.tables(nested.nodes(df.limit(0), "body"), "event_id"), "event_id").count() == 0


def rebuilt(rows):
    """The record that rows of whole tables came from."""
    made = {}
    for r in sorted(rows, key=lambda r: r.label):
        nodes = [((*r.label, v.at), name, v) for name, v in r.fields.items()] if ITEM not in r.fields else [(tuple(r.label), None, r.fields[ITEM])]
        if ITEM not in r.fields:
            made[tuple(r.label)] = (r["keys"][-1] if r["keys"] else None, {})
        for label, name, v in nodes:
            made[label] = (name, [] if v.kind == "list" else v.raw if v.kind in ("string", "null") else json.loads(v.raw))
    for label in sorted(made, key=lambda x: (len(x), x)):
        if label:
            above = made[label[:-1]][1]
            above.append(made[label][1]) if isinstance(above, list) else above.__setitem__(made[label][0], made[label][1])
    return made[()][1]


def test_whole_tables_hold_the_whole_record(spark):
    bodies = [
        {"a": {"x": 1, "n": None, "b": [{"y": 2}, [{"y": 3}], "s", [], [4, [None]]], "e": {}}, "top": 5, "l": [1, 2], "none": [], "only": {"objects": {"z": "t"}}},
        {"m": {"k": {"v": 0.5}}},
        {"structured_output": json.dumps({"addr": "82000001"})},
    ]
    found = nested.whole_tables(nodes(spark, bodies), "event_id").collect()
    want = [*bodies[:2], {"structured_output": {"addr": "82000001"}}]
    assert [rebuilt([r for r in found if r.event_id == i]) for i in range(3)] == want
    labels = {(r.event_id, tuple(r.label)) for r in found}
    assert all((r.event_id, tuple(r.parent)) in labels if r.label else r.parent is None and r.schema_path == "$" for r in found)


def test_every_table_is_reported(spark, tmp_path):
    body = {"type": "assistant", "message": {"tags": ["a", "b"], "usage": {}}, "modelUsage": {"m": {"costUSD": 1}}}
    df = spark.createDataFrame([(1, "claude", json.dumps(body)), (1, "claude", json.dumps(body)), (2, "codex", "{}")], "event_id long, provider string, body string")
    df.write.parquet(str(tmp_path / "provider_event.parquet"))
    got = {r.schema_path: (r.n_rows, r.n_linked, r.fields) for r in training.p5_tables(spark, str(tmp_path)).collect()}
    assert got == {"$": (1, 0, "type"), "message": (1, 1, "tags"), "message.tags[]": (2, 2, "[]"), "message.usage": (1, 1, ""), "modelUsage": (1, 1, ""), "modelUsage.m": (1, 1, "costUSD")}
