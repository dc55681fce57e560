from lodestrata.operators import verdicts
from lodestrata.streaming import jobs


def drain(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_trace_and_windows(spark, tmp_path):
    src = str(tmp_path / "t")
    spark.createDataFrame([("p", 1, 5, "a"), ("p", 1, 3, "b"), ("p", 2, 4, "c")], "profile string, addr long, seq long, thread string").write.parquet(src)
    s = spark.readStream.schema("profile string, addr long, seq long, thread string").parquet(src)
    got = drain(jobs.live_trace_counts(s, ["profile"], "addr", "seq", "thread"), "complete", "trace_counts_live")
    assert sorted(tuple(r) for r in got.collect()) == [("p", 1, 2, 3, "b"), ("p", 2, 1, 4, "c")]


def test_windowed_usage(spark, tmp_path):
    src = str(tmp_path / "u")
    spark.sql("select timestamp'2030-01-01 00:10:00' as at, 'm' as model, 5L as n union all select timestamp'2030-01-01 00:50:00', 'm', 6L").write.parquet(src)
    s = spark.readStream.schema("at timestamp, model string, n long").parquet(src)
    got = drain(jobs.windowed_usage(s, "at", ["model"], ["n"]), "complete", "usage_live").collect()
    assert [(r.model, r.n_rows, r.sum_n) for r in got] == [("m", 2, 11)]


def test_live_verdicts_agree_with_batch(spark, tmp_path):
    log = "sub_82000000 compared=5 skipped=1\nsub_82000004 diverged\nsub_82000008 overflow\nsub_82000004 clean"
    df = spark.createDataFrame([(1, log)], "id long, text string")
    ev = verdicts.log_events(df, "id", "text")
    src = str(tmp_path / "e")
    ev.write.parquet(src)
    s = spark.readStream.schema(ev.schema).parquet(src)
    got = drain(jobs.live_verdicts(s, "id"), "update", "verdicts_live")
    key = lambda d: sorted((r.id, r.addr, r.result, r.compared) for r in d.collect())
    assert key(got) == key(verdicts.fold_log(ev, "id"))
