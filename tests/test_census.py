from pyspark.sql import functions as F

from lodestrata.operators import census, folds, lint
from lodestrata.plans.corpus import DIALECT

RULES = DIALECT.merged(blocking={"indirect call": r"\bbctrl\b"}, volatile={"time base": r"\bmftb\b"})
BODIES = {
    1: "// stw r4,16(r3)",
    2: "cx.g[11] = MEM32(cx.g[3] + 48);\n// sth r5,8(r11)",
    3: "top:\n// stb r4,0(r3)\ngoto top;",
    4: "// bctrl\n// mftb r3",
    5: "// bctrl",
    6: "// addi r3,r4,1",
    7: "",
    8: None,
    9: "// stw r5,4(r20)",
    10: "// addi r11,r3,4\n// stfd r4,0(r11)\n// stw r5,8(r1)",
}


def test_verdicts_and_windows(spark):
    df = spark.createDataFrame(list(BODIES.items()), "id long, body string")
    got = {r.id: r for r in census.screen(df, "id", "body", RULES).collect()}
    assert {k: v.verdict for k, v in got.items()} == {1: "pass", 2: "pass", 3: "loop", 4: "volatile", 5: "blocking", 6: "no_stores", 7: "empty", 8: "empty", 9: "unknown", 10: "pass"}
    assert (got[1].windows[0].base, got[1].windows[0].offset, got[1].windows[0].len) == ("3", 16, 4)
    w = got[2].windows[0]
    assert (w.base, w.deref, w.needs_deref, w.offset) == ("3", [48], True, 8)
    assert got[10].windows[0].untraced == "11" and got[10].n_untraced == 1
    assert got[5].reasons == ["indirect call at line 0"]
    tight = {r.id: r.verdict for r in census.screen(df, "id", "body", RULES, most_spans=1).collect()}
    assert tight[10] == "spans"


def test_loops_use_the_last_label(spark):
    df = spark.createDataFrame([(1, "top:\na\ntop:\nb\ngoto top;\ngoto end;\nend:")], "id long, body string")
    assert [tuple(r) for r in census.loop_ranges(census.lines(df, "id", "body"), "id", RULES).collect()] == [(1, 2, 4)]


def test_constants():
    body = "// lis r11,-32254\n// addi r3,r11,18868\n// lis r4,0x8212\n// ori r4,r4,0xa100\n// lwz r5,8(r4)\n// mr r4,r9\n// lwz r6,4(r4)\n// addi r3,r11,18868"
    assert folds.constants(body) == [(((-32254 << 16) & 0xFFFFFFFF) + 18868) & 0xFFFFFFFF, 0x8212A100, 0x8212A108]
    assert folds.constants(None) == [] and folds.constants("x" * 100_000) == []


def test_lint_returns_all_issues(spark):
    df = spark.createDataFrame([("8200zz", 1, "{", [("", 0)], "n" * 301), ("sub_82000000", 0x82000000, "x{}", [("r3", 4)], None)], "addr string, expected long, code string, windows array<struct<base:string,len:bigint>>, note string")
    rows = lint.lint(df, lint.shape_checks()).collect()
    assert [i.name for i in rows[0].issues] == ["addr", "braces", "window_length", "window_base", "note_length"] and not rows[0].ok
    assert rows[1].issues == [] and rows[1].ok


def test_first_match(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "x int")
    got = [r[0] for r in df.select(census.first_match([("one", F.col("x") == 1), ("some", F.col("x") > 0)], "none")).collect()]
    assert got == ["none", "one", "some"]


def test_breakdown(spark):
    df = spark.createDataFrame([(1, "entry"), (1, "derived"), (1, "entry")], "id long, base string")
    assert [tuple(r) for r in census.breakdown(df, "id", "base").collect()] == [(1, "3 (derived:1,entry:2)")]
