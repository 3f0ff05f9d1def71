"""Knowledge graphs as node and edge tables. Depths are bounded, so traversals are a few joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import ascii_boundaries
from quillon.operators.provenance import inside
from quillon.storage import table


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: two equi joins later instead of one join with OR."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel", "weight").union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel", "weight"))


def neighbours(edges: DataFrame, node: int, direction: str = "both") -> DataFrame:
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("node"), "rel", "weight")
    back = edges.where(F.col("dst") == node).select(F.col("src").alias("node"), "rel", "weight")
    found = {"forward": out, "reverse": back, "both": out.union(back)}[direction]
    return found.where(F.col("node") != node).distinct()


def traverse(edges: DataFrame, start: int, depth: int = 5, rel: str | None = None, least: float = 0.0, limit: int = 1000, reverse: bool = False) -> DataFrame:
    """(node, depth, walk, total) of walks without cycles from ``start``, shortest first, then by walk.

    Longer walks come after all shorter ones, so nothing more is walked once there are ``limit``; a step begins with fewer walks than that.
    """
    step = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "weight") if reverse else edges
    step = step.where(F.col("weight") >= least)
    if rel:
        step = step.where(F.col("rel") == rel)
    step = step.select("src", "dst", "weight")
    front = step.where(F.col("src") == start).where(F.col("dst") != start).select(
        F.col("dst").alias("node"), F.lit(1).alias("depth"), F.array("src", "dst").alias("walk"), F.col("weight").alias("total")
    )
    found = front = table(front, "front")
    for d in range(2, min(depth, 10) + 1):
        if found.limit(limit).count() >= limit:
            break
        front = front.join(step, front["node"] == step["src"]).where(~F.array_contains("walk", F.col("dst"))).select(
            F.col("dst").alias("node"), F.lit(d).alias("depth"), F.array_append("walk", F.col("dst")).alias("walk"), (F.col("total") + F.col("weight")).alias("total")
        )
        # each step's walks are written, so that the next one doesn't compute all before it again
        front = table(front, "front")
        if front.limit(1).count() == 0:
            break
        found = found.union(front)
    return found.orderBy("depth", "walk").limit(limit)


def shortest_path(edges: DataFrame, start: int, goal: int, depth: int = 10) -> DataFrame:
    """One row with the shortest walk and its number of edges; none if there is no walk; ties: the smallest nodes.

    Each step keeps one walk for each node reached, so the frontier never exceeds the nodes.
    """
    spark = edges.sparkSession
    front = spark.range(1).select(F.lit(start).cast("long").alias("node"), F.array(F.lit(start).cast("long")).alias("walk"))
    reached = front
    step = table(edges.select("src", "dst").distinct(), "steps")
    for _ in range(depth):
        if reached.where(F.col("node") == goal).limit(1).count():
            break
        ahead = front.join(step, front["node"] == step["src"]).select(F.col("dst").alias("node"), F.array_append("walk", F.col("dst")).alias("walk"))
        front = table(ahead.groupBy("node").agg(F.min("walk").alias("walk")).join(reached.select("node"), "node", "left_anti"), "front")
        if front.limit(1).count() == 0:
            break
        reached = reached.union(front)
    return reached.where(F.col("node") == goal).select("walk", (F.size("walk") - 1).alias("edges"))


def subgraph(edges: DataFrame, start: int, depth: int = 1) -> DataFrame:
    """Nodes within ``depth`` (three at most) of ``start``, whatever the direction, with their distance."""
    spark = edges.sparkSession
    reached = spark.range(1).select(F.lit(start).cast("long").alias("node"), F.lit(0).alias("depth"))
    way = both_ways(edges).select("a", "b").distinct()
    for d in range(1, min(depth, 3) + 1):
        ahead = reached.join(way, reached["node"] == way["a"]).select(F.col("b").alias("node")).distinct()
        reached = reached.unionByName(ahead.join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
    return reached


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"))
    return n.crossJoin(e).withColumn("average_degree", F.round(2 * F.col("edges") / F.greatest("nodes", F.lit(1)), 6))  # one row each


def by_relationship(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rel")


def by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def public_walks(walks: DataFrame, nodes: DataFrame, most: int = 60) -> DataFrame:
    """The first walks (depth, walk) without a private note or file on them; nodes are (id, type, name)."""
    private = nodes.where(F.col("type").isin("note", "file") & F.upper("name").startswith("_PRIVATE/")).select(F.col("id").alias("node"))
    bad = walks.select("walk", F.explode("walk").alias("node")).join(private, "node", "left_semi").select("walk").distinct()
    return walks.join(bad, "walk", "left_anti").orderBy("depth", "walk").limit(most)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are no notes and have no edge."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.where("type <> 'note'").join(ends, "id", "left_anti")


def expand(candidates: DataFrame, edges: DataFrame, seen: DataFrame, most: int = 2, factor: float = 0.6) -> DataFrame:
    """Unseen neighbours of the best candidates (node, score), at a part of the score; the best few."""
    way = both_ways(edges).select("a", "b").distinct()
    near = candidates.join(way, candidates["node"] == way["a"]).groupBy(F.col("b").alias("node")).agg(F.max("score").alias("parent"))
    return near.join(seen, "node", "left_anti").select("node", F.round(F.col("parent") * factor, 6).alias("score")).orderBy(F.desc("score"), "node").limit(most)


def bootstrap(notes: DataFrame) -> DataFrame:
    """Agent -> note edges, one for each note with an agent."""
    return notes.where("agent is not null and agent <> ''").select(F.col("agent").alias("source"), F.col("path").alias("target"), F.lit("produced").alias("rel"))


def mentions(notes: DataFrame) -> DataFrame:
    """Note -> entity edges for tags and domains, in lower case."""
    tags = notes.select("path", F.explode_outer("tags").alias("t")).where("t is not null").select("path", F.concat(F.lit("tag:"), F.lower("t")).alias("entity"))
    domains = notes.where("domain is not null and domain <> ''").select("path", F.concat(F.lit("domain:"), F.lower("domain")).alias("entity"))
    return tags.union(domains).distinct().withColumn("rel", F.lit("mentions"))


#: How references to files and decisions look in texts, and what can't be a path of the collection.
FILES = (
    r"\b((?:internal|cmd|pkg)/[\w/]+\.go)\b",
    r"\b([\w][\w.-]*/[\w.-]+(?:/[\w.-]+)*\.(?:go|md|yaml|yml|toml|json|sql|sh))\b",
)
FILE_PART = r"\.(go|md|yaml|yml|toml|json|sql|sh)$"
DOMAIN = r"^[a-z0-9.-]+\.(?:com|io|org|ai)(?::\d+)?(?:/|$)"
PLACEHOLDERS = r"(^|/)_private/|(^|/)test_vault/|path/to/|yyyy-mm-dd|(^|/)foo\.go|(^|[^a-z0-9])(vault_path|yyyy|mm|dd)([^a-z0-9]|$)"
OUTSIDE = ("users", "home", "private", "var", "opt", "etc", "root", "volumes", "mnt", "usr", "tmp")
WORKTREES = ("/.windsurf/worktrees/", "/.git/worktrees/")
DECISIONS = (r"(?i)(?:decided|decision|chose|chosen):\s*(.+)", r"(?i)we (?:decided|chose) to\s+(.+?)(?:\.|\z)")
DECISION_VERBS = ("decided", "chose", "chosen", "going with", "plan is to", "shipped", "picked")
DECISION_STARTS = ("use ", "keep ", "adopt ", "split ", "pick ", "picked ", "go with ", "going with ", "plan is to ", "ship ", "shipped ")
NO_DECISION = ("&&", "|", ">", "`", "...", '", "', "(?:", r"\s", r"\w", r"\d", "(?i)", "conversation mode detected", "injected or skipped")
LEAST_DECISION, MOST_DECISION = 10, 200


def reference_path(note: Column, candidate: Column) -> Column:
    """A reference found in a note as a path of the collection, or null.

    Paths that begin with a dot are taken from the note's folder. No URLs or host names, absolute, home or drive paths, none that leave the
    folder, have a file's name as a folder, are placeholders, or begin with a folder of the system.
    """
    raw = F.btrim(F.replace(candidate, F.lit("\\"), F.lit("/")))
    folder = F.regexp_extract(F.replace(F.btrim(note), F.lit("\\"), F.lit("/")), r"^(.*/)[^/]*$", 1)
    path = inside(F.when(raw.startswith("./") | raw.startswith("../"), F.concat(folder, raw)).otherwise(raw))
    low = F.lower(path)
    url = lambda x: x.contains("://") | x.rlike(DOMAIN)
    folders = F.slice(F.split(low, "/"), F.lit(1), F.greatest(F.size(F.split(low, "/")) - 1, F.lit(0)))
    bad = url(F.lower(raw)) | raw.startswith("~/") | F.exists(folders, lambda p: p.rlike(FILE_PART)) | low.rlike(PLACEHOLDERS) | url(low) | F.substring_index(low, "/", 1).isin(*OUTSIDE)
    for w in WORKTREES:
        bad = bad | low.contains(w)
    return F.when(~bad, path)


def file_references(notes: DataFrame) -> DataFrame:
    """(path, target, type, rel): note -> file or note edges from paths in the text that can be paths of the collection."""
    found = F.array_distinct(F.concat(*[F.regexp_extract_all("text", F.lit(ascii_boundaries(p)), F.lit(1)) for p in FILES]))
    rows = notes.select("path", F.explode(found).alias("raw")).select("path", reference_path(F.col("path"), F.col("raw")).alias("target")).where("target is not null")
    kind = F.when(F.lower("target").endswith(".md"), "note").otherwise("file")
    return rows.distinct().select("path", "target", kind.alias("type"), F.lit("references").alias("rel"))


def outside_fences(text: Column) -> Column:
    """A text without its fenced code; a fence that is not closed goes to the end."""
    parts = F.split(text, r"(?m)^[ \t\r\f\x0b]*```.*$\n?")
    return F.array_join(F.filter(parts, lambda x, i: i % 2 == 0), "")


def _decision(whole: Column, said: Column) -> Column:
    """A decision's text, or null if it is too short, a fragment of code, or neither begins as an intent nor is told with a verb."""
    space = F.lit(" \t\r\n")
    text = F.btrim(F.btrim(F.btrim(F.btrim(F.btrim(said, space), F.lit("\"'`")), space), F.lit(".,;:()[]{}")), space)
    low, told = F.lower(text), F.lower(whole)
    starts = low.startswith(DECISION_STARTS[0])
    for x in DECISION_STARTS[1:]:
        starts = starts | low.startswith(x)
    verb = told.contains(DECISION_VERBS[0])
    for x in DECISION_VERBS[1:]:
        verb = verb | told.contains(x)
    bad = (F.octet_length(text) < LEAST_DECISION) | low.startswith("whether ")
    for x in NO_DECISION:
        bad = bad | low.contains(x)
    short = F.when(F.length(text) > MOST_DECISION, F.concat(F.left(text, F.lit(MOST_DECISION)), F.lit("..."))).otherwise(text)
    return F.when(~bad & (starts | verb), short)


def decision_nodes(notes: DataFrame) -> DataFrame:
    """(path, decision): what a note's text says was decided, outside fenced code, each once; a decision affects its note."""
    text = outside_fences(F.col("text"))
    found = F.concat(*[F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("said")) for p in DECISIONS])
    rows = notes.where(F.col("text").rlike("(?i)decided|decision:|chose")).select("path", F.explode(found).alias("d"))
    return rows.select("path", _decision(F.col("d.whole"), F.col("d.said")).alias("decision")).where("decision is not null").distinct()


def rebuild(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, figures) of a graph made anew from all chunks (path, chunk_id, text, agent, tags, domain).

    A note's text is its chunks in order. Nodes are (type, name), edges (source_type, source, target_type, target, rel), each once. Notes that can't
    be read (without a path or without a root chunk) count as failed and leave the others alone; figures is one row.
    """
    roots = chunks.where("chunk_id = 0 and path is not null").select("path", "agent", "tags", "domain").dropDuplicates(["path"])
    texts = chunks.where("path is not null").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", F.coalesce("text", F.lit("")).alias("text")))), lambda c: c["text"]), "\n\n").alias("text"))
    notes = table(roots.join(texts, "path"), "graph-notes")
    edge = lambda df, st, s, tt, t, rel: df.select(st.alias("source_type"), s.alias("source"), tt.alias("target_type"), t.alias("target"), F.lit(rel).alias("rel"))
    path, lit = F.col("path"), F.lit
    refs, made = file_references(notes), decision_nodes(notes)
    edges = edge(refs, lit("note"), path, F.col("type"), F.col("target"), "references")
    edges = edges.unionByName(edge(made, lit("decision"), F.col("decision"), lit("note"), path, "affects"))
    edges = edges.unionByName(edge(notes.where("agent is not null and agent <> ''"), lit("agent"), F.col("agent"), lit("note"), path, "produced"))
    edges = edges.unionByName(edge(mentions(notes), lit("note"), path, lit("entity"), F.col("entity"), "mentions"))
    edges = table(edges.where("source_type <> target_type or source <> target").distinct(), "graph-edges")
    ends = [edges.select(F.col(f"{x}_type").alias("type"), F.col(x).alias("name")) for x in ("source", "target")]
    nodes = table(notes.select(lit("note").alias("type"), F.col("path").alias("name")).union(ends[0]).union(ends[1]).distinct(), "graph-nodes")
    failed = chunks.select("path").distinct().join(roots.select("path"), "path", "left_anti").agg(F.count("*").alias("failed"))
    figures = notes.agg(F.count("*").alias("notes")).crossJoin(failed).crossJoin(nodes.agg(F.count("*").alias("nodes"))).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each
    return nodes, edges, figures
