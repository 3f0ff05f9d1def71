"""Streams with timers: what a folder goes through, and entries that expire with their state."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.operators.textindex import TextIndex
from quillon.streaming import timed

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    timed.use_rocksdb(spark)
    yield spark
    spark.conf.set(key, before)


def stream(spark, tmp_path, batches, schema, build, handle=None):
    """Each batch is a file, read one by one."""
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{i:03}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    w = build(files).writeStream.option("checkpointLocation", state).outputMode("append").trigger(availableNow=True)
    q = (w.foreachBatch(handle) if handle else w.format("parquet").option("path", out)).start()
    assert q.awaitTermination(240) and q.exception() is None
    return None if handle else spark.read.parquet(out).collect()


LISTING = "ts timestamp, path string, content_hash string"


def listings():
    """Every 5 seconds: a stays and changes twice, b is removed, c is renamed to d, e changes and is changed back, f is gone before it was told."""
    by_time = {
        0: {"a": "1", "b": "1", "c": "cc", "e": "1"},
        5: {"a": "1", "b": "1", "c": "cc", "e": "1"},
        10: {"a": "2", "b": "1", "c": "cc", "e": "1"},
        11: {"a": "3", "b": "1", "c": "cc", "e": "2"},
        12: {"a": "3", "b": "1", "c": "cc", "e": "1"},
        15: {"a": "3", "d": "cc", "e": "1"},
        20: {"a": "3", "d": "cc", "e": "1"},
        25: {"a": "3", "d": "cc", "e": "1"},
        60: {"a": "3", "d": "cc", "e": "1"},
    }
    return [[(at(t), p, h) for p, h in files.items()] for t, files in by_time.items()]


def told(rows):
    return sorted((r.path, r.kind, r.content_hash, (r.at - START).total_seconds()) for r in rows)


def test_folder(rocks, tmp_path):
    got = stream(rocks, tmp_path, listings(), LISTING, lambda s: timed.file_changes(s, quiet=2, gap=8))
    # from 25 to 60 no listing named anything: all were gone for a while
    gone = [(p, k, h, t) for p, k, h, t in told(got) if t < 30]
    assert gone == sorted(
        [("a", "added", "1", 2.0), ("b", "added", "1", 2.0), ("c", "added", "cc", 2.0), ("e", "added", "1", 2.0)]
        + [("a", "changed", "3", 13.0), ("b", "removed", "1", 20.0), ("c", "removed", "cc", 20.0), ("d", "added", "cc", 17.0)]
    )
    changes = rocks.createDataFrame([r for r in got if (r.at - START).total_seconds() < 30])
    assert [tuple(r) for r in timed.renames(changes, 8).collect()] == [("c", "d", "cc")]


def test_an_index_follows_a_folder(rocks, tmp_path):
    index = TextIndex(rocks, str(tmp_path / "index"), 4)
    names = {p: i for i, p in enumerate("abcde")}
    ids = F.create_map(*[x for p, i in names.items() for x in (F.lit(p), F.lit(i).cast("long"))])

    def notes_of(rows):
        return rows.select(ids[F.col("path")].alias("id"), "path", F.lit("").alias("title"), F.concat(F.lit("word"), "content_hash").alias("text"))

    stream(rocks, tmp_path, listings()[:-1], LISTING, lambda s: timed.file_changes(s, quiet=2, gap=8), timed.index_changes(index, notes_of))
    # the last listing is at 25: a and e were told, d too, b and c are gone
    assert {r.id for r in index.lengths().collect()} == {names[p] for p in "ade"}
    assert [r.id for r in index.bm25(["word3"]).collect()] == [names["a"]] and index.bm25(["word2"]).count() == 0


def held(spark, tmp_path):
    return spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "entry").load().count()


def test_claims_expire(rocks, tmp_path):
    schema = "path string, agent string, type string, ts timestamp, seconds long"
    first = [("p", "x", "read", at(0), None), ("p", "x", "write", at(0), 60), ("q", "y", "read", at(10), 5)]
    later = [[("p", "x", "read", at(1000), 10)], [("r", "z", "read", at(2500), None)], [("r", "z", "read", at(9000), None)], [("s", "z", "read", at(9001), None)]]
    got = stream(rocks, tmp_path, [first, *later], schema, timed.claims)
    assert sorted((r.path, r.type, r.event, (r.at - START).total_seconds()) for r in got) == sorted(
        [("p", "read", "set", 0), ("p", "write", "set", 0), ("q", "read", "set", 10), ("p", "read", "renewed", 1000), ("p", "write", "expired", 60), ("q", "read", "expired", 15)]
        + [("p", "read", "expired", 1800), ("r", "read", "set", 2500), ("r", "read", "expired", 4300), ("r", "read", "set", 9000), ("s", "read", "set", 9001)]
    )
    assert held(rocks, tmp_path) == 2


def test_state_is_gone_after_a_day(rocks, tmp_path):
    schema = "session_id string, key string, ts timestamp, value string"
    day = 24 * 3600
    batches = [[("s", "terms", at(0), "a"), ("t", "terms", at(5), "b")], [("t", "terms", at(day - 60), "c")], [("u", "terms", at(day + 3000), "d")], [("u", "terms", at(day + 3001), "e")]]
    got = stream(rocks, tmp_path, batches, schema, timed.session_state)
    assert [(r.session_id, r.value) for r in got if r.event == "expired"] == [("s", "a")]
    assert held(rocks, tmp_path) == 2  # t, renewed within the day, and u
