import random

from lodestrata.llm.runs import collapse_runs, latest_before

SCHEMA = "capture long, thread string, seq long, item long, cycles long"


def brute(rows, least=2):
    events = {}
    for c, th, s, i, y in rows:
        if None not in (c, th, s):
            k = (c, th, s)
            a, b = events.get(k, (None, None))
            events[k] = (min((x for x in (a, i) if x is not None), default=None), min((x for x in (b, y) if x is not None), default=None))
    out, last = [], None
    for (c, th, s), (i, y) in sorted(events.items()):
        if last and last[0] == (c, th) and i is not None and last[1] == i:
            last[3] = s
            last[4].append(y)
        else:
            last = [(c, th), i, s, s, [y]]
            out.append(last)
    known = lambda ys: [y for y in ys if y is not None]
    return sorted((*k, i, a, b, len(ys), max(known(ys)) - min(known(ys)) if known(ys) else None) for k, i, a, b, ys in out if i is not None and len(ys) >= least)


def test_against_brute_force_over_block_edges(spark):
    rnd = random.Random(5)
    rows = []
    for s in range(1500):
        th = rnd.choice(["a", "a", "b", None])
        item = 7 if 200 < s < 900 and th == "a" else rnd.choice([1, 1, 2, None])
        rows.append((rnd.choice([1, 1, 2]), th, s, item, rnd.choice([None, s * 10])))
    rows += rnd.sample(rows, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for block in (1, 7, 64, 100_000):
        got = collapse_runs(df, ["capture", "thread"], "seq", "item", "cycles", block=block)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str), block


def test_runs_over_many_blocks(spark):
    rows = [(1, "a", s * 3, 5 if s < 2500 else s % 3, 2**60 + s) for s in range(3000)] + [(2, "a", s, 6, s) for s in range(700)]
    got = collapse_runs(spark.createDataFrame(rows, SCHEMA), ["capture", "thread"], "seq", "item", "cycles", block=32)
    assert sorted(map(tuple, got.collect())) == [(1, "a", 5, 0, 7497, 2500, 2499), (2, "a", 6, 0, 699, 700, 699)]


def test_latest_before_by_levels(spark):
    rnd = random.Random(3)
    rows = sorted({(s, rnd.randrange(-5000, 5000)) for s in "ab" for _ in range(60)})
    df = spark.createDataFrame([(s, b, b) for s, b in rows], "s string, block long, v long")
    want = [(s, b, p if q == s else None) for (q, p), (s, b) in zip([(None, None), *rows], rows)]
    for span in (4, 50, 100_000):
        assert sorted(map(tuple, latest_before(df, ["s"], "v", span).collect())) == want


def test_clashing_names(spark):
    df = spark.createDataFrame([("x", s, 1, s, "t") for s in range(4)], "n string, id long, item long, ptr long, last string")
    df = df.withColumnRenamed("n", "block")
    assert [tuple(r) for r in collapse_runs(df, ["block", "last"], "id", "item", "ptr").select("block", "n", "duration").collect()] == [("x", 4, 3)]


def test_empty_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", 1, None, 1), (1, "a", 2, None, 1), (1, None, 3, 4, 1), (1, None, 4, 4, 1)], SCHEMA)
    assert collapse_runs(df, ["capture", "thread"], "seq", "item").count() == 0
    assert collapse_runs(df.limit(0), ["capture", "thread"], "seq", "item", "cycles").count() == 0
