"""Hybrid search on a few notes: fusion, fuzzy titles, ranks by title, boosts, facts; places reckoned by hand."""

from pyspark.sql import functions as F

from quillon.plans import hybrid

ROWS = [
    (1, "a/1.md", "Alpha gateway", "note"), (2, "b/2.md", "Beta store", "note"), (3, "c/3.md", "Gateway alpha design", "note"), (4, "d/4.md", "Alphb gateway", "note"),
    (5, "e/5.md", "Alpho list", "handoff"), (6, "_PRIVATE/6.md", "Alpha gateway", "note"), (7, "f/7.md", "Nothing", "hub"),
]


def made(spark):
    notes = spark.createDataFrame(
        [(i, p, t, k, "x", float(i), 0, False, [], "en", "w", "unknown") for i, p, t, k in ROWS],
        "id long, path string, title string, content_type string, text string, modified double, access_count long, suppressed boolean, tags array<string>, domain string, workstream string, trust_state string",
    )
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 2.0]), (6, [0.0, 0.0])], "note_id long, embedding array<double>")
    return notes, vectors, F.array(F.lit(0.0), F.lit(0.0))


def places(rows):
    return [r.path[2:3] for r in rows.orderBy("place").collect()]


def test_steps(spark):
    n, v, q = made(spark)
    fused = {r.path[2:3]: (r.score, r.source) for r in hybrid.fuse(n, v, q, "alpha gateway", 5).collect()}
    # 1 gains from its title, 3 and 4 fill free places by their titles
    assert fused == {"1": (1.0, "vector"), "2": (0.63, "vector"), "3": (0.85, "keyword"), "4": (0.675, "keyword")}
    assert places(hybrid.hybrid_search(n, v, q, "alpha gateway", 5)) == ["1", "3", "4", "2", "5"]
    boosted = hybrid.hybrid_search(n, v, q, "alpha gateway", 5, boosts={"handoff": 2.0})
    assert places(boosted) == ["1", "3", "5", "4", "2"]


def test_facts_fill_free_places(spark):
    n, v, q = made(spark)
    facts = spark.createDataFrame([(1, "f", "f/7.md", 0.5, [0.0, 1.0]), (2, "f", "b/2.md", 1.0, [0.0, 3.0]), (3, "f", "_PRIVATE/6.md", 1.0, [0.0, 0.0])], "fact_id long, fact_text string, source_path string, confidence double, embedding array<double>")
    got = hybrid.hybrid_search(n, v, q, "alpha gateway", 6, facts=facts)
    score = {r.path[2:3]: r.score for r in got.collect()}
    assert score["2"] == 0.78 and score["7"] == 0.808 and "6" not in score
    assert places(got)[-1] == "7"


def test_nothing_is_found(spark):
    n, v, q = made(spark)
    assert hybrid.hybrid_search(n.limit(0), v, q, "alpha gateway", 5).count() == 0
    assert places(hybrid.hybrid_search(n, v, q, "the", 5)) == ["1", "2"]
    assert places(hybrid.hybrid_search(n, v, q, "alpha gateway", 5, domain="fr")) == []
