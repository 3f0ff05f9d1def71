"""What the fourth round's findings told of."""

import re

import pytest
from pyspark.sql import functions as F

from quillon.operators import guard, provenance, trust
from quillon.sources import writers


def test_notes_lie_under_their_own_names(spark, tmp_path):
    names = ["a/b c.md", "a.md/b.md", "a.md", "../x.md", "/etc/x.md", "x", "x/y", "_PRIVATE/é.md", "a/./b.md", ".md", "n" * 300 + ".md", "", None]
    rows = [(n, f"{i}\x00\n\r\n") for i, n in enumerate(names)] + [("a.md", "0"), ("none.md", None)]
    folder = str(tmp_path / "out")
    writers.write(spark.createDataFrame(rows, "file string, content string"), folder)
    got = [tuple(r) for r in writers.read_back(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted([(n, f"{i}\x00\n\r\n") for i, n in enumerate(names)] + [("none.md", "")], key=repr)
    files = [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and ".names" not in str(p)]
    assert len(files) == len(names) + 1 and {"out/a/b c.md", "out/a.md", "out/none.md"} <= set(files)
    assert all(f.startswith("out/") for f in files) and (tmp_path / "out/a.md").read_text(newline="") == "2\x00\n\r\n"
    # another write to the folder takes the place of a file
    writers.write(spark.createDataFrame([("a.md", "new")], "file string, content string"), folder)
    assert writers.read_back(spark, folder).where(F.col("file") == "a.md").collect() == [("a.md", "new")]
    assert writers.read_back(spark, folder).count() == len(got)


def test_pairs_of_saves_and_shown_notes_are_not_dealt_again(spark):
    rows = [("n.md", 100, ["a.md"]), ("m.md", 100, []), ("o.md", 119, []), ("o.md", 161, None), ("o.md", 119, []), ("./p.md", 60, ["./c.md", "c.md"]), ("q.md", None, ["a.md"])]
    saves = spark.createDataFrame(rows, "note_path string, at int, sources array<string>").withColumn("saved_at", F.timestamp_seconds("at"))
    shown = [(t, p) for t in (0, 1, 39, 41, 59, 60, 100, 101, 118) for p in ("a.md", "./b.md", "b.md", "m.md", "./m.md", "x.png", "./p.md", "../z.md")] + [(160, "b.md")]
    usage = spark.createDataFrame([(t, [p]) for t, p in shown], "at int, injected_paths array<string>").withColumn("ts", F.timestamp_seconds("at"))
    files = spark.createDataFrame([("a.md", "1"), ("b.md", "2")], "path string, content_hash string")
    hashes, want = {"a.md": "1", "b.md": "2"}, {}
    for note, at, _ in rows:
        for t, p in shown:
            plain = p.removeprefix("./")
            if at is not None and t <= at < t + 60 and p.endswith(".md") and p != note and p[:2] != "..":
                want[note, plain] = ("note", hashes.get(plain, ""), max(at, want.get((note, plain), ("", "", 0))[2]))
    want |= {("n.md", "a.md"): ("file", "1", 100), ("./p.md", "c.md"): ("file", "", 60), ("q.md", "a.md"): ("file", "1", None)}
    got = provenance.capture(saves, usage, files).withColumn("at", F.unix_timestamp("captured_at")).collect()
    assert {(r.note_path, r.source_path): (r.source_type, r.source_hash, r.at) for r in got} == want and len(got) == len(want)
    single = provenance.capture(saves.where("note_path = 'm.md'"), usage, files)
    assert "Aggregate [note_path" not in single._jdf.queryExecution().optimizedPlan().toString() and single.count() == 4


@pytest.mark.parametrize("sent", [1_000_000, 3])
def test_terms_are_sought_where_lines_lie(spark, monkeypatch, sent):
    monkeypatch.setattr(guard, "SENT", sent)
    monkeypatch.setattr(guard, "BYTES", 40)
    text = ["Big red fox, big  red\nbig-red Fox", "red\n\nBIG RED", "a--b !! ((big red)) --", "stra\u00dfe x STRA\u00dfE X x(big red)y", "", None, "xbig red", "fox\nbig", "red fox b\nc a"]
    files = [(f"d/{i}", t) for i, t in enumerate(text * 3)] + [("d/0", text[0])]
    words = ["big red", "fox", "FOX", "big  red", "(big red)", "--", "!!", "red", "stra\u00dfe x", "b c", "big\nred", "a--b", "red fox b", "", None]
    terms = [(t, k) for i, t in enumerate(words) for k in (["hard", "soft"] if i % 3 else ["soft"])]
    got = guard.blocked(spark.createDataFrame(files, "path string, text string"), spark.createDataFrame(terms, "term string, tier string"))
    left, right = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))", "(?ai)"
    want = {(p, i + 1, w, k) for p, t in files for i, line in enumerate((t or "").split("\n")) for w, k in terms if w and re.search(right + left + re.escape(w) + left, line)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 60


def test_finds_are_not_shuffled(spark):
    files = spark.createDataFrame([("a/x", "Big red fox\nbig fox"), ("b", "red fox")], "path string, text string")
    terms = spark.createDataFrame([("big red", "hard"), ("fox", "soft")], "term string, tier string")
    reviewed = spark.createDataFrame([("fox", "soft_blocklist", f) for f in ("b/*", "a/?")], "term string, category string, file string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = guard.check(files, terms, reviewed, rules=[("none", "none", "\x01none")])
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.path, r.line, r.rule, r.outcome) for r in got.collect()) == [
            ("a/x", 1, "blocklist:big red", "violation"), ("a/x", 1, "blocklist:fox", "warning"), ("a/x", 2, "blocklist:fox", "warning"), ("b", 1, "blocklist:fox", "violation"),
        ]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_of_two_blocks_are_not_held_at_once(spark):
    rows = [(i, ["a", "b"] + ["c"] * (i % 3)) for i in range(300)]
    got = trust.shared_tags(spark.createDataFrame(rows, "id long, tags array<string>"), block=64)
    assert sorted((r.a, r.b) for r in got.collect()) == [(i, j) for i in range(300) for j in range(i + 1, 300)]
    plan = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode" in x]
    # one of the two stands outside the generated stage that makes the pairs
    generated = ["*(" in x for x in plan[:2]]
    assert generated == [True, False]
