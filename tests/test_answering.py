"""Many questions at once, and their evaluation."""

from quillon.operators.textindex import TextIndex
from quillon.plans import answering

CHUNKS = [
    (1, "a/auth.md", "Auth strategy", "tokens and sessions, signed with keys", "validated"), (2, "a/auth.md", "Auth strategy", "more on signed tokens", "validated"),
    (3, "b/old.md", "Old auth", "tokens that nobody signs", "stale"), (4, "c/db.md", "Storage", "rows and keys of the storage", "unknown"),
]


def test_questions(spark, tmp_path):
    chunks = spark.createDataFrame(CHUNKS, "id long, path string, title string, text string, trust_state string")
    index = TextIndex(spark, str(tmp_path / "i"), 4)
    index.apply(chunks)
    questions = spark.createDataFrame([(1, "how are tokens signed?"), (2, "stale notes on tokens"), (3, "the of"), (4, "storage keys"), (5, None)], "query_id int, query string")
    got = answering.answer_many(index, chunks, questions, 2)
    by = {q: [r.path for r in sorted(got.collect(), key=lambda r: r.place) if r.query_id == q] for q in (1, 2, 3, 4, 5)}
    assert by[1][0] == "a/auth.md" and by[2] == ["b/old.md", "a/auth.md"] and by[3] == by[5] == [] and by[4][0] == "c/db.md"
    cases = spark.createDataFrame([(1, "x", "a/auth.md"), (2, "x", "a/auth.md"), (4, "y", "c/db.md"), (3, "y", "c/db.md")], "query_id int, category string, expected string")
    assert sorted((r.category, r.n, r.recall, r.mrr) for r in answering.evaluate(got, cases).collect()) == [("x", 2, 1.0, 0.75), ("y", 2, 0.5, 0.5)]
