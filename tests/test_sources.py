"""Files in and out, imports, backfill of vectors, lookups and logged events."""

from datetime import datetime

from pyspark.sql import functions as F

from quillon.operators import dml, graph, lookups, provenance
from quillon.plans import indexing
from quillon.sources import vault, writers


def test_walk_skips_what_is_no_note(spark, tmp_path):
    for name in ("a.md", "CLAUDE.md", "node_modules/b.md", "x/_PRIVATE/c.md", "x/d.md", "tmp/e.md", "f.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert sorted(r.path for r in vault.walk(spark, str(tmp_path)).collect()) == ["a.md", "tmp/e.md", "x/d.md"]
    assert sorted(r.path for r in vault.walk(spark, str(tmp_path), skip=("tmp",)).collect()) == ["a.md", "x/d.md"]


def test_notes_as_files(spark, tmp_path):
    rows = [("a/b.md", 'Say "hi" \\ there', "note", ["x", "y"], "body\nmore"), (None, "Use Spark!", "decision", None, None), ("a/b.md", "again", None, [], "second")]
    made = writers.markdown(spark.createDataFrame(rows, "path string, title string, content_type string, tags array<string>, text string").withColumn("day", F.to_date(F.lit("2024-05-01"))))
    writers.write(made, str(tmp_path / "out"))
    got = {r.file: r.content for r in writers.read_back(spark, str(tmp_path / "out")).collect()}
    assert set(got) == {"a/b.md", "decisions/2024-05-01-use-spark.md"}
    assert got["decisions/2024-05-01-use-spark.md"] == '---\ntitle: "Use Spark!"\ncontent_type: decision\n---\n\n\n'
    # what is written can be read as a note
    files = spark.createDataFrame([(k, v) for k, v in got.items()], "path string, content string")
    parsed = {r.path: r for r in vault.frontmatter(files).collect()}
    assert parsed["decisions/2024-05-01-use-spark.md"].title == "Use Spark!" and parsed["decisions/2024-05-01-use-spark.md"].explicit_type == "decision"


def test_imports(spark):
    files = spark.createDataFrame(
        [("/p/CLAUDE.md", "one"), ("/p/.cursorrules", "two"), ("/p/sub/AGENTS.md", "three"), ("/p/.hidden/AGENTS.md", "no"), ("/p/node_modules/CLAUDE.md", "no"), ("/p/.github/copilot-instructions.md", "four"), ("/p/readme.md", "no")],
        "path string, content string",
    )
    none = spark.createDataFrame([], "path string, provenance_hash string")
    top = writers.imports(files, none, "/p")
    assert sorted(r.path for r in top.collect()) == ["imports/claude-md.md", "imports/copilot-instructions.md", "imports/cursorrules.md"]
    every = writers.imports(files, none, "/p", everywhere=True)
    assert sorted(r.path for r in every.collect()) == ["imports/claude-md.md", "imports/copilot-instructions.md", "imports/cursorrules.md", "imports/sub-agents-md.md"]
    assert writers.imports(files, top, "/p").count() == 0
    changed = files.withColumn("content", F.when(F.col("content") == "two", "new").otherwise(F.col("content")))
    assert [r.path for r in writers.imports(changed, top, "/p").collect()] == ["imports/cursorrules.md"]
    assert provenance.imported(top).count() == 3


def test_backfill(spark):
    texts = ["short", "a" * 9000, "é" * 5000, None]
    chunks = spark.createDataFrame([(i, f"T{i}", t) for i, t in enumerate(texts)], "id long, title string, text string")
    vectors = spark.createDataFrame([(0, [1.0]), (9, [9.0])], "note_id long, embedding array<double>")
    got = {r.note_id: r.content for r in indexing.to_embed(chunks, vectors).collect()}
    assert set(got) == {1, 2, 3} and len(got[1]) == 7500 and got[3] == "T3\n"
    assert got[2] == ("T2\n" + "é" * 5000).encode()[:7500].decode(errors="ignore")
    embed = lambda df: df.select("note_id", F.array(F.length("content").cast("double")).alias("embedding"))
    new = indexing.backfill(chunks, vectors, embed)
    assert sorted((r.note_id, r.embedding[0]) for r in new.collect()) == [(0, 1.0), (1, 7500.0), (2, float(len(got[2]))), (3, 3.0)]
    modes = [indexing.index_mode(chunks, v).first().mode for v in (vectors.limit(0), vectors, new)]
    assert modes == ["lite", "progressive", "full"]


def test_progressive(spark, tmp_path):
    (tmp_path / "n.md").write_text("---\ntitle: N\n---\n" + "\n".join(f"## H{i}\n" + "x " * 1500 for i in range(3)))
    files = vault.walk(spark, str(tmp_path))
    empty = indexing.records(files.limit(0), 2e9)
    embed = lambda df: df.select("note_id", F.array(F.lit(1.0)).alias("embedding"))
    chunks, vectors = indexing.progressive(empty, spark.createDataFrame([], "note_id long, embedding array<double>"), files, 2e9, embed)
    assert [(r.chunk_id, r.chunk_heading) for r in chunks.orderBy("chunk_id").collect()] == [(0, "H0"), (1, "H1"), (2, "H2")]
    assert vectors.count() == 3 and indexing.index_mode(chunks, vectors).first().mode == "full"


def test_lookups(spark):
    nodes = spark.createDataFrame([(1, "note", "a.md"), (2, "file", "b.go"), (3, "file", "a.md")], "id long, type string, name string")
    assert lookups.resolved_node(nodes, "note", "a.md").first().id == 1 and lookups.resolved_node(nodes, "note", "b.go").first().id == 2
    assert lookups.resolved_node(nodes, "agent", "b.go").count() == 0 and lookups.node_by_name(nodes, "file", "a.md").first().id == 3
    pins = spark.createDataFrame([("a.md",)], "path string")
    assert lookups.is_pinned(pins, "a.md").first().pinned and not lookups.is_pinned(pins.limit(0), "a.md").first().pinned
    sources = spark.createDataFrame([("n", "s"), ("m", "s"), ("n", "r")], "note_path string, source_path string")
    assert lookups.dependents_of(sources, "s").count() == 2 and lookups.notes_with_sources(sources).count() == 2 and [r.source_path for r in lookups.sources_of(sources, "n").collect()] == ["r", "s"]
    chunks = spark.createDataFrame([(1, "a", 1, 5.0), (2, "a", 0, 6.0)], "id long, path string, chunk_id int, modified double")
    assert lookups.root_by_path(chunks, "a").first().id == 2 and [r.id for r in lookups.note_by_path(chunks, "a").collect()] == [2, 1]
    assert tuple(lookups.index_figures(chunks, chunks, chunks.limit(0)).first()) == (1, 2, 6.0, 2, 0)
    assert lookups.exists(chunks) and not lookups.exists(chunks, F.col("id") > 5)


def test_walks_without_private_nodes(spark):
    nodes = spark.createDataFrame([(1, "note", "a"), (2, "note", "_private/x"), (3, "agent", "_PRIVATE/agent")], "id long, type string, name string")
    edges = spark.createDataFrame([(1, 2, "r", 1.0), (1, 3, "r", 1.0), (3, 2, "r", 1.0)], "src long, dst long, rel string, weight double")
    assert [tuple(r.walk) for r in graph.public_walks(graph.traverse(edges, 1), nodes).collect()] == [(1, 3)]
    assert [(r.type, r.n) for r in graph.by_type(nodes).collect()] == [("note", 2), ("agent", 1)]


def test_feedback_facts_and_events(spark):
    rows = spark.createDataFrame([("a/b.md", 0.9, 1), ("a/c/d.md", 0.2, 0), ("x.md", 0.2, 0)], "path string, confidence double, access_count long")
    up = {r.path: (round(r.confidence, 6), r.access_count) for r in dml.feedback_like(rows, "a/*.md", True).collect()}
    assert up == {"a/b.md": (1.0, 6), "a/c/d.md": (0.4, 5), "x.md": (0.2, 0)}
    down = {r.path: round(r.confidence, 6) for r in dml.feedback_like(rows, "x.md", False).collect()}
    assert down == {"a/b.md": 0.9, "a/c/d.md": 0.2, "x.md": 0.05}
    facts = dml.new_facts(spark.createDataFrame([("f one", "s", 3.0, None), (" ", "s", None, 1), ("f two", "s", 0.4, 2)], "fact_text string, source_path string, confidence double, chunk_id int"))
    assert sorted((r.fact_text, r.confidence, r.chunk_id) for r in facts.collect()) == [("f one", 0.6, 0), ("f two", 0.4, 2)]
    e = spark.createDataFrame([("s", "h", datetime(2024, 1, 1), None, -3, 5, None)], "session_id string, hook_name string, ts timestamp, status string, notes_count int, estimated_tokens int, duration_ms long")
    assert tuple(dml.hook_events(e).first())[3:] == ("empty", 0, 5, 0)
