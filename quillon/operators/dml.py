"""Changes as new snapshots: each function takes tables and returns the table after the change."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new)


def note_ids(chunks: DataFrame) -> DataFrame:
    """Ids that follow from path and chunk, so that an insert can be repeated."""
    return chunks.withColumn("id", F.xxhash64("path", "chunk_id"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_old: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` replace those of their key; columns in ``keep_old`` keep the old value where the new one is null."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in key]
    latest = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_new"))).alias(c) if c in (keep_old or []) else F.max_by(c, "_new").alias(c) for c in rest
    ]
    return both.groupBy(*key).agg(*latest).select(*old.columns)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))


def delete(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def delete_notes(tables: dict[str, DataFrame], paths: DataFrame, with_facts: bool = False) -> dict[str, DataFrame]:
    """The notes of ``paths`` and all that hangs on them: vectors, edges, nodes and sources; then nodes without edges. Facts stay, unless told otherwise."""
    notes, nodes, edges = tables["notes"], tables["nodes"], tables["edges"]
    gone = notes.join(paths, "path", "left_semi").select("id")
    gone_nodes = nodes.join(gone.select(F.col("id").alias("note_id")), "note_id", "left_semi").select(F.col("id").alias("node"))
    left = edges.join(gone_nodes.withColumnRenamed("node", "src"), "src", "left_anti").join(gone_nodes.withColumnRenamed("node", "dst"), "dst", "left_anti")
    ends = left.select(F.col("src").alias("id")).union(left.select(F.col("dst").alias("id"))).distinct()
    kept = nodes.join(gone_nodes.withColumnRenamed("node", "id"), "id", "left_anti")
    facts = tables["facts"].join(paths.select(F.col("path").alias("source_path")), "source_path", "left_anti") if with_facts else tables["facts"]
    return tables | {
        "notes": delete(notes, paths, ["path"]),
        "vectors": tables["vectors"].join(gone.select(F.col("id").alias("note_id")), "note_id", "left_anti"),
        "edges": left,
        "nodes": kept.where("type = 'note'").unionByName(kept.where("type <> 'note'").join(ends, "id", "left_semi")),
        "sources": tables["sources"].join(paths.select(F.col("path").alias("note_path")), "note_path", "left_anti"),
        "facts": facts,
    }


def update(rows: DataFrame, delta: DataFrame, key: list[str], changes: dict[str, Column]) -> DataFrame:
    """Columns in ``changes`` for rows whose key is in ``delta``; changes may use delta's columns as ``d.name``."""
    mark = delta.dropDuplicates(key).withColumn("_hit", F.lit(True)).alias("d")
    joined = rows.alias("r").join(mark, [F.col(f"r.{k}") == F.col(f"d.{k}") for k in key], "left")
    return joined.select(*[F.when(F.col("d._hit"), changes[c]).otherwise(F.col(f"r.{c}")).alias(c) if c in changes else F.col(f"r.{c}").alias(c) for c in rows.columns])


def feedback(rows: DataFrame, paths: DataFrame, up: bool) -> DataFrame:
    sure, used = F.col("r.confidence"), F.col("r.access_count")
    if up:
        return update(rows, paths, ["path"], {"confidence": F.least(F.lit(1.0), sure + 0.2), "access_count": used + 5})
    return update(rows, paths, ["path"], {"confidence": F.greatest(F.lit(0.05), sure - 0.3)})


def feedback_like(rows: DataFrame, pattern: str, up: bool) -> DataFrame:
    """Feedback on all paths that fit a shell pattern, in which * goes across folders; without * or ? it is one path."""
    regex = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"
    return feedback(rows, rows.where(F.col("path").rlike(regex)).select("path"), up)


def new_facts(rows: DataFrame) -> DataFrame:
    """Facts (fact_text, source_path, confidence, chunk_id) with their defaults and an id that follows from note and text."""
    sure = F.when((F.col("confidence") > 0) & (F.col("confidence") <= 1), F.col("confidence")).otherwise(0.6)
    return rows.where("fact_text is not null and trim(fact_text) <> ''").select(
        F.xxhash64("source_path", "fact_text").alias("fact_id"), "fact_text", "source_path", F.coalesce("chunk_id", F.lit(0)).alias("chunk_id"), sure.alias("confidence")
    )


def hook_events(rows: DataFrame) -> DataFrame:
    """Hook events as they are logged: no status means "empty", and counts are never negative."""
    count = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).alias(c)
    return rows.select("session_id", "hook_name", "ts", F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("empty")).alias("status"), count("notes_count"), count("estimated_tokens"), count("duration_ms"))


def keep_newest(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The newest n rows: a distributed top-k."""
    return rows.orderBy(*order).limit(n)


def expire(rows: DataFrame, column: str, as_of: Column, seconds: int) -> DataFrame:
    return rows.where(F.unix_timestamp(column) >= F.unix_timestamp(as_of) - seconds)


def claim_path(path: Column) -> Column:
    """A path with forward slashes, without leading dots; null for one that leaves the folder or is absolute."""
    p = F.regexp_replace(F.regexp_replace(F.btrim(path), r"\\", "/"), r"^(\./)+", "")
    return F.when((p == "") | p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)") | p.rlike("^[A-Za-z]:"), None).otherwise(F.regexp_replace(p, "/+", "/"))


def active_claims(claims: DataFrame, as_of: float) -> DataFrame:
    """Claims that haven't expired, by path, writes first, then by agent."""
    return claims.where(F.col("expires_at") > as_of).orderBy("path", F.desc("type"), "agent")


def release_claims(claims: DataFrame, path: str, agent: str | None = None) -> DataFrame:
    gone = F.col("path") == path
    if agent:
        gone = gone & (F.lower("agent") == agent.lower())
    return claims.where(~gone)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): new, changed, unchanged or deleted, by the hash of the content."""
    a, b = old.select("path", F.col("content_hash").alias("was")), new.select("path", F.col("content_hash").alias("now"))
    kind = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", kind.alias("change"))


def delete_all(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """Each table's snapshot without rows, to be written over it; columns stay."""
    return tuple(t.where(F.lit(False)) for t in tables)


def orphan_vectors(vectors: DataFrame, notes: DataFrame) -> DataFrame:
    """Vectors whose note is gone."""
    return vectors.join(notes.select(F.col("id").alias("note_id")), "note_id", "left_anti")
