"""Point lookups and probes: filters that Parquet's statistics can answer with few row groups, and one-row answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def note_by_id(notes: DataFrame, note_id: int) -> DataFrame:
    return notes.where(F.col("id") == note_id)


def note_by_path(chunks: DataFrame, path: str) -> DataFrame:
    """All chunks of a note, in order."""
    return chunks.where(F.col("path") == path).orderBy("chunk_id")


def root_by_path(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.where((F.col("path") == path) & (F.col("chunk_id") == 0))


def node_by_name(nodes: DataFrame, type_: str, name: str) -> DataFrame:
    return nodes.where((F.col("type") == type_) & (F.col("name") == name))


def resolved_node(nodes: DataFrame, type_: str, name: str) -> DataFrame:
    """The node of that type and name, else, for a note or a file, the one of the other of these types."""
    other = {"note": "file", "file": "note"}.get(type_)
    found = nodes.where((F.col("name") == name) & F.col("type").isin(type_, *([other] if other else [])))
    return found.orderBy(F.desc(F.col("type") == type_)).limit(1)


def is_pinned(pins: DataFrame, path: str) -> DataFrame:
    """One row: pinned."""
    return pins.agg(F.coalesce(F.bool_or(F.col("path") == path), F.lit(False)).alias("pinned"))


def sources_of(sources: DataFrame, path: str) -> DataFrame:
    return sources.where(F.col("note_path") == path).orderBy("source_path")


def dependents_of(sources: DataFrame, source: str) -> DataFrame:
    """Notes that are based on a source."""
    return sources.where(F.col("source_path") == source).select("note_path").distinct()


def notes_with_sources(sources: DataFrame) -> DataFrame:
    return sources.select(F.col("note_path").alias("path")).distinct()


def facts_of(facts: DataFrame, path: str) -> DataFrame:
    return facts.where(F.col("source_path") == path)


def exists(rows: DataFrame, where: Column | None = None) -> bool:
    return (rows.where(where) if where is not None else rows).limit(1).count() > 0


def index_figures(chunks: DataFrame, vectors: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: notes, chunks, vectors, facts and the newest change."""
    n = chunks.agg(F.count_distinct("path").alias("notes"), F.count("*").alias("chunks"), F.max("modified").alias("newest"))
    return n.crossJoin(vectors.agg(F.count("*").alias("vectors"))).crossJoin(facts.agg(F.count("*").alias("facts")))  # one row each
