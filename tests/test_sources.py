import json

from lodestrata.operators import text
from lodestrata.sources import events, files
from pyspark.sql import functions as F

LISTING = """// preamble
BEGIN_FN(sub_82000000) {
\t// lis r3,1
\t// bl 0x82000100
\thelper_one(cx, base);
\t// bctrl
}
BEGIN_FN(sub_82000200) {
\tif (x) {
\t// bl 0x82000100
BEGIN_FN(sub_82000300) {
\t// bl 0x820004F0
\t__imp__Thing(cx, base);
}
"""


def folder(tmp_path, **named):
    for name, body in named.items():
        (tmp_path / name.replace("__", ".")).write_text(body)
    return "file://" + str(tmp_path)


def test_listing_index_and_edges(spark, tmp_path):
    w = files.whole(spark, folder(tmp_path, a__cpp=LISTING))
    fn = files.listing_functions(w, r"BEGIN_FN\(sub_([0-9A-F]{8})\)")
    assert sorted((r.addr - 0x82000000, r.first, r.n_lines) for r in fn.collect()) == [(0, 1, 6), (0x200, 7, 0), (0x300, 10, 4)]
    got = sorted((r.caller - 0x82000000, r.callee, r.callee_name, r.kind, r.site_line) for r in files.call_edges(fn).collect())
    assert got == [(0, 0, "(indirect)", "indirect", 5), (0, 0x82000100, "helper_one", "direct", 3), (0x200, 0x82000100, "helper_one", "direct", 9), (0x300, 0x820004F0, "__imp__Thing", "import", 11)]


def test_names(spark, tmp_path):
    p = folder(tmp_path, n__csv="82000000,alpha\n0x82000004, beta \nno comma\n# c\n", m__toml='"82000008" = "gamma"\n# "x" = "y"\n')
    got = sorted((r.addr - 0x82000000, r.name) for r in files.names(files.whole(spark, p)).collect())
    assert got == [(0, "alpha"), (4, "beta"), (8, "gamma")]


def test_layout_header(spark, tmp_path):
    h = "// seen in sub_82000000 and sub_82000010\nstruct Ring {\n  uint32_t head;\n  u16 _pad0;\n  u16 tail;\n  float xs[2]; // +0x10\n  Node* next;\n};\nstruct Tiny {\n  u8 a;\n  u64 b;\n};\n"
    fields, cited = files.layout_header(files.whole(spark, folder(tmp_path, s__h=h)))
    got = sorted((r.struct, r.name, r.offset, r.size, r.total) for r in fields.collect() if not r.name.startswith("_pad"))
    assert got == [("Ring", "head", 0, 4, 28), ("Ring", "next", 24, 4, 28), ("Ring", "tail", 6, 2, 28), ("Ring", "xs", 16, 8, 28), ("Tiny", "a", 0, 1, 9), ("Tiny", "b", 1, 8, 9)]
    assert sorted({(r.struct, r.addr - 0x82000000) for r in cited.collect()}) == [("Ring", 0), ("Ring", 16), ("Tiny", 0), ("Tiny", 16)]


def test_trace_lines(spark, tmp_path):
    t = "# seq\tcycles\tthread\tfunction\n1\t10\tVoice Capture\t82000000\n\n2\t11\tmain\tsub_82000004\n3\t12\tmain\t82000000\nno address\n"
    rows = files.trace_lines(files.whole(spark, folder(tmp_path, t__tsv=t)))
    assert [(r.seq, r.addr - 0x82000000, r.thread) for r in rows.orderBy("seq").collect()] == [(1, 0, "Voice Capture"), (2, 4, "main"), (3, 0, "main")]
    got = {r.addr - 0x82000000: (r.n_calls, r.first_seq, r.first_thread) for r in files.trace_counts(rows, ["path"]).collect()}
    assert got == {0: (2, 1, "Voice Capture"), 4: (1, 2, "main")}


def test_queue_json_shapes(spark):
    one = {"82000000": {"status": "open", "calls": {"boot": 3}}}
    rows = [json.dumps(one), json.dumps({"functions": one}), json.dumps([{"addr": "0x82000000", "status": "open", "calls": {"boot": 3}}]), "garbage", None]
    got = files.queue_json(spark.createDataFrame([(r,) for r in rows], "text string")).collect()
    assert [(r.addr, r.record.status, r.record.calls.boot, r.record.note) for r in got] == [(0x82000000, "open", 3, None)] * 3


def test_notes_and_decompiled(spark, tmp_path):
    p = folder(tmp_path, sub_82000000__md="# head\n\nFirst line.\nSecond.\n```\ncode\n```\nlater", sub_82000004__c="/* x */\nint f(int a)\n{\n  halt_baddata();\n}\n", other__md="x")
    w = files.whole(spark, p)
    assert [(r.addr, r.note) for r in files.notes(w).collect()] == [(0x82000000, "First line. Second.")]
    d = files.decompiled(w).collect()
    assert [(r.signature, r.usable, r.n_lines) for r in d] == [("int f(int a)", False, 5)]


def test_images(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"XEX2abc")
    (tmp_path / "b.bin").write_bytes(b"\x7fELFabc")
    (tmp_path / "c.bin").write_bytes(b"??")
    assert sorted(r.kind for r in files.images(spark, "file://" + str(tmp_path)).collect()) == ["elf", "raw", "xex2"]


def test_usage_of_both_dialects(spark):
    rows = [
        (1, '{"type":"system","model":"m","session_id":"s"}'),
        (2, '{"type":"result","is_error":false,"total_cost_usd":0.5,"usage":{"input_tokens":10,"output_tokens":"7","cache_read_input_tokens":[3]}}'),
        (3, '{"type":"turn.completed","usage":{"input_tokens":100,"cached_input_tokens":90,"output_tokens":5,"reasoning_output_tokens":2}}'),
        (4, None),
    ]
    df = spark.createDataFrame([("f", *r) for r in rows], "file string, n int, body string")
    s = events.session_usage(df, ["file"], "n").collect()[0]
    assert (s.model, s.session_id, s.input_tokens, s.output_tokens, s.cache_read_tokens, float(s.cost_usd), s.failed) == ("m", "s", 10, 7, 0, 0.5, False)
    assert [tuple(r) for r in events.turn_usage(df, ["n"]).collect()] == [(3, 10, 90, 7)]


def test_transcripts(spark):
    u = lambda **k: json.dumps({"type": "assistant", "message": {"usage": k}})
    df = spark.createDataFrame([("s", "2030-01-01", u(input_tokens=1)), ("s", "2030-01-05", u(output_tokens=2)), ("s", None, u(input_tokens=5)), ("s", "2030-01-02", '{"type":"user"}'), ("s", "2030-01-02", u())], "s string, at string, body string")
    got = events.transcript_usage(df, ["s"], "at", since="2030-01-02").collect()[0]
    assert (got.n_records, got.input_tokens, got.output_tokens) == (2, 5, 2)


def test_text_views(spark):
    body = "\n".join(f"l{i}" for i in range(40)) + "\n"
    df = spark.createDataFrame([(body,), ("",), (None,), ("x" * 100_000,)], "t string")
    for cap in (2, 3, 12, 39, 40):
        got = [r[0].split("\n") for r in df.select(text.elide(F.col("t"), cap)).collect()]
        assert all(len(g) <= cap for g in got)
        assert cap < 3 or (got[0][0], got[0][-1]) == ("l0", "l39")
    c = spark.createDataFrame([("undefined4 f(uint a)\n{\n  int x;\n\n  x = a + 0x10);\n  return x;\n}",)], "t string")
    r = c.select(text.normalise_c(F.col("t")).alias("n"), text.annotate(F.col("t"), F.create_map(F.lit("0x10"), F.lit("head"))).alias("a")).collect()[0]
    assert r.n == "u32 f(u32 a)\n{\n  x = a + 0x10);\n  return x;\n}"
    assert "x = a + 0x10); // head" in r.a
    j = spark.createDataFrame([('Here:\n```json\n{"a": {"b": 1}}\n```',), ("none",)], "t string")
    assert [x[0] for x in j.select(text.lenient_json(F.col("t"))).collect()] == ['{"a": {"b": 1}}', None]


def test_budget_and_collapse(spark):
    df = spark.createDataFrame([(1, i, "x" * 31) for i in range(5)], "k long, o long, t string")
    assert text.within_budget(df, ["k"], ["o"], "t", 25).count() == 3
    b = spark.createDataFrame([(1, "\t// bl 0x82000000\n\t// bl 0x82000004\n\t// blr\n")], "id long, body string")
    names = spark.createDataFrame([(0x82000000, "alpha"), (0x82000004, "__keep_gpr_1")], "addr long, name string")
    assert [r.text for r in text.collapse_listing(b, "id", "body", names).collect()] == ["bl alpha\nblr"]
