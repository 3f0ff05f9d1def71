"""Queries over small tables with what the third round's findings told of, against their SQL."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import queries as core
from quillon.operators import guard, provenance, textindex, trust, vectorindex


@pytest.fixture
def equal(spark, tmp_path):
    """Whether a query equals its SQL over tables given as SQL."""

    def check(name, **tables):
        con = duckdb.connect()
        for t, sql in tables.items():
            con.execute(f"create table {t} as {sql}")
            con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
        got = core.queries()[name](spark, str(tmp_path))
        rel = con.sql(core.oracle_sql()[name])
        place = [rel.columns.index(c) for c in got.columns]
        want = sorted(repr(tuple(r[i] for i in place)) for r in rel.fetchall())
        assert sorted(repr(tuple(r)) for r in got.collect()) == want
        return want

    return check


def test_claims_that_a_later_row_ended_behind_the_watermark(equal, spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    moments = "(0, 0, 1), (1, 3600, 1), (2, 5340, 2), (3, 7200, 2), (4, 7205, 1)"
    events = f"select i :: bigint as event_id, timestamp '2024-01-01' + to_seconds(s) as ts, u :: bigint as user_id from (values {moments}) t(i, s, u)"
    # the second user's claim ended at 7140, the last moment is 7205: the stream's time is 6605
    assert len(equal("expired_claims", events=events)) == 2


def test_an_order_is_no_customer_of_its_number(equal):
    customer = "select unnest([0, 1, 2, 3, null]) :: bigint as c_custkey"
    orders = "select * from (values (0 :: bigint, 1 :: bigint, '1-URGENT'), (-3, 1, '1-URGENT'), (5, 2, '2-HIGH')) t(o_orderkey, o_custkey, o_orderpriority)"
    assert len(equal("prune_orphans", customer=customer, orders=orders)) == 3


def test_titles_with_quotes_in_files(equal, spark):
    texts = """(1, 'say "hi" to \\ all'), (2, '"'), (3, 'a "b'), (4, '\\"x\\\\" y'), (5, 'plain'), (6, ''), (7, 'a' || chr(10) || 'title: "b"')"""
    documents = f"select i :: bigint as doc_id, t as text, 'en' as lang, 'src1' as source from (values {texts}) v(i, t)"
    labels, events = "select 0 :: bigint as doc_id, 0 as toxic, 0 as quality where false", "select 0 :: bigint as user_id where false"
    embeddings = "select 0 :: bigint as vec_id where false"
    assert len(equal("notes_as_files", documents=documents, labels=labels, events=events, embeddings=embeddings)) == 7


@pytest.mark.parametrize("block", [1024, 7])
def test_tags_are_compared_once_for_each_set(spark, block):
    kinds = [["A", "b", "c"], ["b", "a"], ["c", "B", "z"], ["z"], None, ["a", None, "A", "b"]]
    rows = [(i, kinds[i % 6] if i < 120 else ["all", "q"]) for i in range(150)] + [(3, ["a", "b"])]
    got = trust.shared_tags(spark.createDataFrame(rows, "id long, tags array<string>"), block=block, task=500)
    assert "array_intersect" not in got._jdf.queryExecution().optimizedPlan().toString()
    sets = [(i, {x.lower() for x in t or [] if x}) for i, t in rows]
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, j, len(x & y)) for i, x in sets for j, y in sets if i < j and len(x & y) >= 2)


def test_tasks_of_a_text_index_follow_its_terms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "TASK_TERMS", 100)
    rows = [(i, f"a/{i}.md", None if i % 3 else "b B c", " ".join(f"w{j % (i + 1)}" for j in range(20))) for i in range(30)]
    notes = spark.createDataFrame(rows, "id long, path string, title string, text string")
    got = textindex.counted(notes)[0]
    assert "Aggregate [term" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for i, *fields in rows:
        for name, text in zip(textindex.FIELDS, fields, strict=True):
            for w in re.findall("[0-9a-z]+", (text or "").lower()):
                want[w, i, name] = want.get((w, i, name), 0) + 1
    assert {(r.term, r.id, r.field): r.tf for r in got.collect()} == want
    index = textindex.TextIndex(spark, str(tmp_path / "index"), 4)
    index.apply(notes)
    terms = sum(want.values())
    assert {r.id: r.rank for r in index.bm25(["w3", "b"]).collect()} and index.commits()[0][2] == terms
    # each task writes a file into every directory it has terms of
    written = {p.name.split("-")[1] for p in (tmp_path / "index/postings/seg=0").rglob("part-*")}
    assert len(written) >= terms // 200
    many = index.bm25_many(spark.createDataFrame([(1, ["w3", "b"]), (2, ["w5"])], "query_id int, terms array<string>"))
    assert [(r.id, r["rank"]) for r in many.where("query_id = 1").orderBy("place").collect()] == [tuple(r) for r in index.bm25(["w3", "b"]).collect()]


def test_blocks_tell_a_pair_once_with_its_cosine(spark, monkeypatch):
    monkeypatch.setattr(vectorindex, "TILE", 5)
    monkeypatch.setattr(vectorindex, "PAIRS", 7)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) + (i % 3)).astype(np.float32).tolist()) for i in range(90)] + [(90, [1.0, None, 0.0, 0.0]), (91, [0.0] * 4)]
    vectors = spark.createDataFrame(rows, "note_id long, embedding array<float>").withColumn("dims", F.size("embedding"))
    every = vectorindex.in_blocks(vectors.withColumn("parts", F.lit(3)), ["dims"], 0.5).collect()
    found = vectorindex.candidates(vectors, 0.5, 1, 8, block=20).collect()
    for got in (every, found):
        assert len({(r.a, r.b) for r in got}) == len(got) > 500
    cosines = {(r.a, r.b): r.similarity for r in every}
    assert all(cosines[r.a, r.b] == r.similarity for r in found) and len(found) > 0.9 * len(every)
    want = [(float(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y))), i, j) for i, x in rows[:90] for j, y in rows[:90] if i < j]
    assert sorted((i, j) for c, i, j in want if c >= 0.5) == sorted(k for k, c in cosines.items() if c >= 0.5)


def test_notes_shown_are_sought_once_for_a_slice(spark):
    saves = spark.createDataFrame([("n.md", 100, ["a.md"]), ("m.md", 100, []), ("o.md", 119, [])], "note_path string, at int, sources array<string>").withColumn("saved_at", F.timestamp_seconds("at"))
    usage = spark.createDataFrame([(t, [p]) for t in (39, 41, 59, 60, 100, 101, 118) for p in ("a.md", "./b.md", "m.md", "x.png")], "at int, injected_paths array<string>").withColumn("ts", F.timestamp_seconds("at"))
    files = spark.createDataFrame([("a.md", "1"), ("b.md", "2")], "path string, content_hash string")
    every = {(r.note_path, r.source_path): (r.source_type, r.source_hash) for r in provenance.capture(saves, usage, files).collect()}
    shown = {"a.md": ("note", "1"), "b.md": ("note", "2"), "m.md": ("note", "")}
    assert every == {(n, p): shown[p] for n in ("n.md", "m.md", "o.md") for p in shown if n != p} | {("n.md", "a.md"): ("file", "1")}
    few = provenance.capture(saves, usage, files, all_shown=False).collect()
    assert {r.note_path for r in few} == {k[0] for k in every} and [r.source_path for r in few if r.note_path == "n.md"] == ["a.md"]


def test_lines_are_not_shuffled_to_a_short_list(spark):
    files = spark.createDataFrame([("a", "Big red fox\nbig fox"), ("b", "red")], "path string, text string")
    terms = spark.createDataFrame([("big red", "hard"), ("fox", "soft")], "term string, tier string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = guard.blocked(files, terms)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in got.collect()) == [("a", 1, "big red", "hard"), ("a", 1, "fox", "soft"), ("a", 2, "fox", "soft")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
