import json

from pyspark.sql import functions as F

from lodestrata.operators import answers

ONE = {"addr": "sub_82000000", "code": "x;", "note": None, "windows": [{"base": "r3", "deref": [48, 0], "offset": 8, "len": 4, "why": "head"}], "result_registers": ["r3", "R4", "f1", "v2", "zz"]}


def test_shapes_defaults_and_rendering(spark):
    rows = [(1, json.dumps(ONE)), (2, json.dumps([ONE, {"addr": 2181038080, "windows": None}])), (3, json.dumps({"ports": [ONE]})), (4, "prose"), (5, None), (6, "[]")]
    df = spark.createDataFrame(rows, "id int, p string")
    got = answers.answers(df, "id", "p").orderBy("id", "pos").collect()
    assert [(r.id, r.pos, r.addr) for r in got] == [(1, 0, 0x82000000), (2, 0, 0x82000000), (2, 1, 2181038080), (3, 0, 0x82000000)]
    assert got[2].windows == [] and got[2].note == "" and got[2].blocked is False
    text = answers.answers(df.filter("id = 1"), "id", "p").select(answers.render(F.struct("addr", "code", "note", "windows", "result_registers"))).collect()[0][0]
    assert "spec.write(LOAD_U32(LOAD_U32(ctx.r3.u32 + 48)) + 8, 4);  // head" in text
    assert "kReturnR3 | Gpr(4) | kReturnF1 | Vr(2)" in text and text.startswith("// sub_82000000\nx;\n")


def test_pairing_needs_equal_numbers(spark):
    df = spark.createDataFrame([(1, [7, 8], json.dumps([ONE, ONE])), (2, [7], json.dumps([ONE, ONE])), (3, [7], None)], "id int, asked array<long>, p string")
    assert [(r.id, r.asked) for r in answers.paired(df, "id", "asked", "p").collect()] == [(1, 7), (1, 8)]


def test_strict_schema():
    s = answers.strict_schema({"properties": {"a": {"type": "string"}, "b": {"type": "array", "items": {"properties": {"c": {"type": "integer", "default": 1}}}}}, "required": ["a"]})
    assert s["required"] == ["a", "b"] and s["properties"]["b"]["type"] == ["array", "null"]
    assert s["properties"]["b"]["items"]["properties"]["c"] == {"type": ["integer", "null"]}


def test_packets(spark):
    from lodestrata.operators import text

    f = spark.createDataFrame([(1, "alpha", 10, "A"), (0x82000000, None, None, None)], "addr long, name string, lines int, tier string")
    e = spark.createDataFrame([(1, i, f"c{i}", "direct", 20 - i) for i in range(20)] + [(1, 5, "c5", "direct", 15), (1, 9, "__h", "helper", 1)], "caller long, callee long, callee_name string, kind string, site_line int")
    b = spark.createDataFrame([(1, "y" * 4000)], "addr long, body string")
    got = {r.addr: r for r in text.packets(f, e, b, "addr", 400, most_callees=3).collect()}
    assert got[1].packet == "FUNCTION alpha lines=10 tier=A\nCALLEES c19 c18 c17" and got[1].dropped == ["body"]
    assert got[0x82000000].packet == "FUNCTION sub_82000000 lines=? tier=?\nCALLEES \n\n" and got[0x82000000].dropped == []
    whole = {r.addr: r for r in text.packets(f, e, b, "addr", 4000).collect()}
    assert whole[1].packet.endswith("y" * 4000)
