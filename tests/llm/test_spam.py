import random

from lodestrata.llm.segments import folded, scan
from pyspark.sql import functions as F

from lodestrata.llm.spam import phrase_shingles, spam_pages, spam_scores

PROSE = "The queue is read once the session ends. We saw that the header stays where it was, and nobody had asked why. If you copy the record, the counter is reset as well."


def pages():
    rnd = random.Random(4)
    kw = lambda: " ".join(rnd.sample(["cheap", "best", "new", "fast", "free"], 1) + rnd.sample(["widget", "gadget"], 1))
    links = "\n".join(f"http://site{i}.example/a/{i}" for i in range(20))
    good = {
        1: PROSE * 3,
        2: PROSE + "\n\nSee also:\n" + "\n".join(links.split("\n")[:4]),
        3: PROSE + "\n\n#one #two #three",
        4: "\n".join(f"* [page {i}](http://site{i}.example/x): {PROSE}" for i in range(9)),
        5: "| op | form | n |\n|--|--|--|\n" + "\n".join(f"| lwz | D | {i} |" for i in range(40)),
        6: "int f(int a)\n{\n" + "\n".join(f"  x{i} = a + {i};" for i in range(40)) + "\n}",
        7: "todo",
        8: "References\n\n" + "\n".join(f'[{i}] "{PROSE}" Notes of the workshop, pp. 3-9. http://site.example/{i}' for i in range(6)),
        9: '{"tags": ["gate", "thread"], "n": 1}\n' * 20,
        10: "**cold row**: " + PROSE + "\n**warm row**: " + PROSE,
    }
    bad = {
        101: "; ".join(kw() for _ in range(60)),
        102: "\n".join(kw() for _ in range(60)),
        103: links,
        104: " ".join(f"#{a}{b}" for a in ("Best", "new", "free") for b in ("Widget", "gadget", "thing", "gizmo")),
        105: "\n".join(f"Fast Widget SKU-{i}99 USD {i}9.99 in stock" for i in range(1, 20)),
        106: "Get widget today because widget with widget means best widget. Our widget is the best widget for widget users. " * 8,
        107: "<html><body><h1>cheap widget</h1><div style='display:none'>" + " ".join(kw() for _ in range(80)) + "</div></body></html>",
        108: PROSE + "\n\n" + ", ".join(kw() for _ in range(90)),
        109: "Tags: " + ", ".join(f"gadget{i}" for i in range(30)),
    }
    return good, bad


def frame(spark, texts):
    return spark.createDataFrame([(k, v, f"h{k % 4}") for k, v in texts.items()], "doc_id long, text string, host string")


def crowd(texts, n=4, first=1001):
    """The same pages on several hosts, under other ids."""
    return {first * k + i: t for k in range(1, n + 1) for i, t in texts.items()}


def test_good_and_bad_pages(spark):
    good, bad = pages()
    got = {r.doc_id % 1001 for r in spam_pages(frame(spark, crowd(good | bad)), "doc_id", "text", "host").collect()}
    assert got == set(bad)


def test_replicated_phrases_decide(spark):
    """A list of keywords is spam where its phrases stand on other hosts, and only there."""
    words = "amber basil cedar delta ember fjord grove haven inlet jetty knoll larch".split()
    page = ", ".join(f"{a} {b}" for a, b in zip(words, words[1:]))
    pick = lambda rows: spam_pages(spark.createDataFrame(rows, "doc_id long, text string, host string"), "doc_id", "text", "host").count()
    assert pick([(1, page, "h")]) == 0
    assert pick([(i, page, "h") for i in range(4)]) == 0
    assert pick([(i, page, f"h{i}") for i in range(4)]) == 4
    half = [(0, page, "a"), (1, ", ".join(f"{b} {a}" for a, b in zip(words, words[1:])), "b")]
    assert pick(half) == 0


def test_phrases_shifted_in_run_on_pages(spark):
    words = [f"{a}{b}" for a in ("red", "blue", "grey", "dark") for b in ("lamp", "door", "stone", "wheel")]
    rows = [(k, " ".join(words[k:] + words[:k]), f"h{k}") for k in range(6)]
    assert spam_pages(spark.createDataFrame(rows, "doc_id long, text string, host string"), "doc_id", "text", "host").count() == 6


def test_nulls_empties_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "h"), (2, "", None), (3, " ", None), (4, "widget, " * 30, None), (4, "widget, " * 30, None)], "doc_id long, items string, links string")
    got = spam_scores(df, "doc_id", "items", "links")
    assert sorted((r.doc_id, r.score > 0.5) for r in got.collect()) == [(3, False), (4, False), (4, False)]
    assert spam_pages(df.limit(0), "doc_id", "items", "links").count() == 0


def test_scan_is_linear():
    import time

    for bad in ("a" * 36_000, "-" * 36_000, "a." * 18_000, "<a" * 18_000, "http://" * 5000, "#a" * 18_000, "1," * 18_000, "'" * 36_000):
        t = time.time()
        scan(bad, frozenset(["the"]), frozenset(["test"]))
        assert time.time() - t < 2


def test_shingles_and_spelling(spark):
    rows = spark.createDataFrame([("a",), ("a b",), ("a b c",)], "p string").select(phrase_shingles(F.col("p"), 2)).collect()
    assert [r[0] for r in rows] == [["a"], ["a b"], ["a b", "b c"]]
    assert folded("B3st c0nv3rt3r fr33 patchеr decompiler3 r31 820d7ce0 2030") == ["best", "converter", "free", "patcher", "decompiler0", "r0", "0d0ce0", "0"]
