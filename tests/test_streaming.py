"""Streams over files, run until all that is there has been read."""

from datetime import datetime, timedelta

from quillon.streaming import events

START = datetime(2024, 1, 1)


def run(spark, tmp_path, rows, schema, build, parts=1):
    """Write ``rows`` as files, stream them one file at a time through ``build``, and return what came out."""
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    for i in range(parts):
        spark.createDataFrame(rows[i::parts] if parts > 1 else rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.read.parquet(out).collect()


def test_debounce(spark, tmp_path):
    rows = [("s", "stop", START + timedelta(seconds=t)) for t in (0, 100, 299, 300, 301, 700)] + [("t", "stop", START)]
    got = run(spark, tmp_path, rows, "session_id string, hook_name string, ts timestamp", lambda s: events.debounced(s, 300))
    assert sorted((r.session_id, (r.ts - START).seconds) for r in got) == [("s", 0), ("s", 300), ("s", 700), ("t", 0)]


def test_topic_gate(spark, tmp_path):
    rows = [("s", START + timedelta(seconds=i), t) for i, t in enumerate([["a", "b"], ["a", "b", "c"], ["x"], ["x"], []])]
    got = run(spark, tmp_path, rows, "session_id string, ts timestamp, terms array<string>", events.topic_gate)
    assert [r.changed for r in sorted(got, key=lambda r: r.ts)] == [True, False, True, False, True]


def test_rate_limit_counts_only_what_it_admits(spark, tmp_path):
    rows = [(1, START + timedelta(seconds=t)) for t in (0, 1, 2, 59, 61, 62)]
    got = run(spark, tmp_path, rows, "user_id long, ts timestamp", lambda s: events.admitted(s, 60, 2))
    assert [r.admitted for r in sorted(got, key=lambda r: r.ts)] == [True, True, False, False, True, True]


def test_session_budget(spark, tmp_path):
    rows = [(1, "h", START + timedelta(minutes=m), m == 0, 10) for m in (0, 10, 100)] + [(1, "h", START + timedelta(days=1), False, 1)]
    got = run(
        spark, tmp_path, rows, "user_id long, hook_name string, ts timestamp, was_referenced boolean, estimated_tokens long", events.budget_stream
    )
    first = min(got, key=lambda r: r.started)
    assert (first.injections, first.referenced, first.tokens) == (2, 1, 20)


def test_watch(spark, tmp_path):
    seen = []
    src = str(tmp_path / "src")
    spark.createDataFrame([(1,), (2,)], "x int").coalesce(1).write.parquet(src)
    q = events.watch(spark.readStream.schema("x int").parquet(src), lambda df, i: seen.append(df.count()), str(tmp_path / "state"), 1)
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 2
