"""Which notes a prompt brings up: every kind of search where it has to speak, and where it must not."""

import pytest
from pyspark.sql import functions as F

from quillon.plans import surfacing

SCHEMA = "id long, path string, title string, content_type string, text string, modified double, access_count long, review_by string, trust_state string, suppressed boolean, vec array<double>"
AS_OF = 2e9


def notes(spark, rows):
    made = []
    for i, r in enumerate(rows):
        r = {"path": f"d{i}/n{i}.md", "title": f"T{i}", "type": "decision", "text": "", "at": AS_OF, "vec": [50.0, 0.0]} | r
        made.append((i, r["path"], r["title"], r["type"], r["text"], r["at"], 0, None, "validated", r.get("suppressed", False), r["vec"]))
    return spark.createDataFrame(made, SCHEMA)


def surfaced(spark, rows, prompt, near=None, **more):
    n = notes(spark, rows)
    vectors = n.select(F.col("id").alias("note_id"), F.col("vec").alias("embedding"))
    query = F.array(F.lit(0.0), F.lit(0.0)) if near is None else F.array(*map(F.lit, near))
    return [(r.id, r.mode, round(r.overlap, 3), r.boosted) for r in surfacing.surface(n, vectors, query, prompt, AS_OF, **more).orderBy("place").collect()]


def test_neighbours_and_titles(spark):
    rows = [
        {"vec": [0.0, 1.0], "title": "Near one"}, {"vec": [0.0, 2.0], "title": "Near old", "type": "note", "at": 0.0}, {"title": "Postgres migration plan", "vec": [99.0, 0.0]},
        {"title": "Postgres", "path": "_PRIVATE/p.md"}, {"title": "Postgres", "suppressed": True}, {"vec": [0.0, 15.0], "title": "Far end"}, {"title": "Mostly other words in a long title with postgres at its end", "path": "e/x.md"},
    ]
    got = surfaced(spark, rows, "our postgres migration steps")
    # 0 and 5 are within reach, 1 is near but worth too little, 2 by its title, 6 overlaps too little
    assert [(i, m) for i, m, _, _ in got] == [(2, 1), (0, 0), (5, 0)]


def test_specific_terms_in_contents_when_nothing_is_near(spark):
    rows = [{"text": "about KXQ and its budget review numbers"}, {"text": "budget review numbers alone"}, {"text": "KXQ"}, {"text": "nothing"}]
    got = surfaced(spark, rows, 'KXQ budget review numbers please')
    found = {i: (m, o, b) for i, m, o, b in got}
    assert set(found) == {0, 1, 2} and all(m == 3 for m, _, _ in found.values())
    assert found[0][1] == 0.15 and found[2][1] == 0.0


def test_contents_with_all_broad_terms(spark):
    rows = [{"text": "quarterly revenue forecast for all"}, {"text": "revenue forecast"}, {"text": "quarterly forecast revenue again and quarterly"}]
    got = surfaced(spark, rows, "quarterly revenue forecast?")
    assert [(i, m) for i, m, _, _ in got] == [(2, 6), (0, 6)] or [(i, m) for i, m, _, _ in got] == [(0, 6), (2, 6)]
    assert sum(b for *_, b in got) == 1 and got[0][3] and got[0][2] == 0.25 and got[1][2] == 0.15


def test_misspelled_titles_of_hubs(spark):
    rows = [{"title": "Kubernetes deployment hub", "type": "hub"}, {"title": "Kubernetes notes on many other things of the week", "type": "decision"}]
    got = surfaced(spark, rows, "tell me of kubernets deployments here")
    assert got and got[0][0] == 0


def test_graph_neighbours_and_versions(spark):
    rows = [{"title": "Alpha gateway", "path": "a/alpha.md"}, {"title": "Alpha gateway", "path": "a/alpha-v2.md"}, {"title": "Zed", "type": "note", "at": 0.0}]
    edges = spark.createDataFrame([(2, 0, "r", 1.0)], "src long, dst long, rel string, weight double")
    got = surfaced(spark, rows, "alpha gateway choice", edges=edges)
    assert {i for i, *_ in got} == {1, 2} or {i for i, *_ in got} == {0, 2}
    assert [m for i, m, *_ in got if i == 2] == [7]
    assert surfaced(spark, [], "alpha gateway choice") == []


def test_recent(spark):
    day = 86400.0
    rows = [{"type": "handoff", "at": AS_OF - day, "title": "Session handoff"}, {"type": "note", "at": AS_OF - day}, {"type": "progress", "at": AS_OF - 300 * day}, {"type": "note", "vec": [0.0, 0.0], "at": AS_OF - day}, {"type": "decision", "at": AS_OF - 2 * day}]
    n = notes(spark, rows)
    got = surfacing.recent_surface(n, n.select(F.col("id").alias("note_id"), F.col("vec").alias("embedding")), F.array(F.lit(0.0), F.lit(0.0)), "latest session handoff notes", AS_OF).orderBy("place").collect()
    assert [r.id for r in got][0] == 0 and got[0].overlap > 0 and {r.id for r in got} == {0, 3, 4}


@pytest.mark.parametrize("prompt", ["", "the of"])
def test_nothing_to_ask(spark, prompt):
    n = notes(spark, [{"text": "the of"}])
    assert surfacing.keyword_surface(n, prompt).count() == 0


def test_pinned_come_first(spark):
    n = notes(spark, [{}, {}, {"suppressed": True}])
    found = n.select("path", "title", "content_type", "text", F.lit(0.5).alias("score"), F.lit(0.1).alias("overlap"), (F.col("id") + 1).cast("int").alias("place"))
    pins = spark.createDataFrame([("d1/n1.md", 5), ("d2/n2.md", 1), ("gone.md", 2)], "path string, pinned_at int")
    got = surfacing.with_pinned(found.where("path <> 'd2/n2.md'"), n, pins).orderBy("place").collect()
    assert [(r.path, r.score, r.place) for r in got] == [("d1/n1.md", 1.0, 1), ("d0/n0.md", 0.5, 2)]
