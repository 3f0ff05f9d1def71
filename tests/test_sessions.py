"""Handoffs, recovery, dated entries and what is shown at a start, on small literal tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillon.operators import sessions

START = datetime(2024, 5, 1)


def at(hours):
    return START + timedelta(hours=hours)


def test_first_words(spark):
    texts = ["", " one line \n two", "word " * 20, "Short. " + "x" * 12 + " and more words here", "a" * 40, None, "tab\tword " + "y" * 30]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", sessions.first_words(F.col("t"), 25).alias("w")).orderBy("i")
    assert [r.w for r in got.collect()] == ["", "one line", "word word word word word", "Short. " + "x" * 12 + " and", "a" * 25, None, "tab\tword"]
    # a sentence's end counts in the second half only
    one = spark.createDataFrame([("One two three. Four five six seven",)], "t string").select(sessions.first_words(F.col("t"), 20).alias("w")).first()
    assert one.w == "One two three."


def test_handoffs(spark):
    messages = [("s", 0, "user", "Build the index"), ("s", 1, "assistant", "- next: old step"), ("s", 2, "user", "build it"), ("s", 3, "assistant", "ok"), ("s", 4, "user", "Build the index"), ("s", 5, "assistant", None)]
    messages += [("s", 6, "assistant", "Done.\n- [ ] TODO: write tests\n  * still need docs \n3. ready to ship\n- nothing\nTODO: no bullet\n- [ ] TODO: write tests"), ("t", 0, "user", "hi"), ("t", 1, "assistant", "ho")]
    calls = [("s", 1, "x:save_decision", {"title": " Use Parquet "}), ("s", 2, "save_decision", {"title": "use parquet"}), ("s", 3, "mcp__save_note", None), ("s", 3, "mcp:save_note", {"path": "a.md"}), ("s", 4, "Bash", {"title": "no"})]
    files = [("s", 1, "src/a.py"), ("s", 2, "SRC/A.py"), ("s", 3, "tmp/x"), ("s", 3, "b.log"), ("s", 4, None)] + [("s", 5, f"f{i:02}.py") for i in range(25)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = sessions.handoffs(frame(messages, "session_id string, turn int, role string, text string"), frame(calls, "session_id string, turn int, tool string, input map<string,string>"), frame(files, "session_id string, turn int, path string")).collect()
    (r,) = got
    assert (r.session_id, r.n_user, r.n_assistant, r.n_calls) == ("s", 3, 4, 5)
    assert r.topics == ["Build the index", "build it"] and r.decisions == ["Use Parquet"] and r.notes == ["a.md"]
    assert r.files == ["src/a.py", *[f"f{i:02}.py" for i in range(19)]] and r.more_files == 6
    assert r.next_steps == ["- [ ] TODO: write tests", "* still need docs", "3. ready to ship"]
    assert r.tools.startswith("Bash (1), mcp:save_note (1)")
    alone = sessions.handoffs(frame(messages, "session_id string, turn int, role string, text string")).first()
    assert alone.n_calls == 0 and alone.files == [] and alone.tools == ""


def test_recovery(spark):
    source = lambda rows: spark.createDataFrame(rows, "session_id string, owner string, at timestamp, text string")
    sources = {
        "handoff": source([("a", "me", at(1), "old"), ("b", "me", at(2), "new"), ("c", "you", at(3), " ")]),
        "instance": source([("d", "you", at(1), "x" * 5000), ("e", "me", at(9), "late")]), "session_index": source([("f", "they", at(1), "index")]),
    }
    current = spark.createDataFrame([("n", "me"), ("b", "me"), ("y", "you"), ("f", "they"), ("z", None)], "session_id string, owner string")
    got = {r.session_id: (r.recovered_from, r.source, r.completeness, r.context and len(r.context)) for r in sessions.recover(current, sources).collect()}
    assert got == {"n": ("b", "handoff", 1.0, 3), "b": ("a", "handoff", 1.0, 3), "y": ("d", "instance", 0.4, 4000), "f": (None, "none", 0.0, None), "z": (None, "none", 0.0, None)}


def test_recent_entries_and_start(spark):
    log = "# Log\n## 2024-04-01\nold\n## 2024-04-28 Choice\n### Use A\nbecause\n\n### 2024-04-30\nnew\n## 2024-99-99\nno date"
    got = sessions.recent_entries(spark.createDataFrame([("d.md", log), ("e.md", None)], "path string, text string"), "2024-05-01").collect()
    assert [(r.place, str(r.day), r.entry) for r in sorted(got, key=lambda r: r.place)] == [(1, "2024-04-28", "## 2024-04-28 Choice\n### Use A\nbecause"), (2, "2024-04-30", "### 2024-04-30\nnew")]
    live = spark.createDataFrame([("a", at(0)), ("b", at(13)), ("c", at(14)), ("d", None)], "session_id string, updated timestamp")
    assert sorted(r.session_id for r in sessions.active_instances(live, F.lit(at(25)), "c").collect()) == ["b"]
    parts = [("s", "stale", "z" * 2000), ("s", "handoff", "h"), ("s", "pinned", " "), ("s", "other", "o"), ("t", "pinned", "p" * 3000), ("t", "handoff", "h" * 5000), ("t", "decisions", "d" * 4000)]
    got = {r.session_id: r.shown for r in sessions.bootstrap(spark.createDataFrame(parts, "session_id string, kind string, text string")).collect()}
    assert got["s"] == "h\n\n" + "z" * 1000 and got["t"] == ("h" * 4000 + "\n\n" + "p" * 2000 + "\n\n" + "d" * 3000)[:8000]
