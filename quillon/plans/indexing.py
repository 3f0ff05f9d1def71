"""Building and refreshing the note tables from a Markdown folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import scores as S
from quillon.functions import text as T
from quillon.operators import chunking, dml
from quillon.sources import vault
from quillon.storage import table


def records(files: DataFrame, as_of: float) -> DataFrame:
    """Chunk rows of parsed files; new notes start with no access and what their header says about trust."""
    parsed = vault.frontmatter(files).select(
        "path", "title", "tags", "domain", "workstream", "agent", "modified", "content_hash", "review_by",
        T.content_type(F.col("path"), F.col("explicit_type"), F.col("tags")).alias("content_type"),
        F.coalesce("trust_state", F.lit("unknown")).alias("trust_state"), F.col("body").alias("text"),
    )
    sure = S.confidence(F.col("content_type"), F.col("modified"), F.lit(0), F.col("review_by").isNotNull(), F.col("trust_state"), as_of)
    cut = chunking.by_headings(parsed.withColumn("confidence", sure), numbered=True)
    # chunks of a note, numbered in their order
    keep = [c for c in cut.columns if c not in ("place", "part", "chunk_heading", "chunk")]
    listed = cut.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("place", "part", "chunk_heading", "chunk"))).alias("c"))
    rows = listed.select(*keep, F.posexplode_outer("c").alias("chunk_id", "p")).select(*keep, "chunk_id", "p.chunk_heading", F.col("p.chunk").alias("text"))
    return dml.note_ids(rows).withColumn("access_count", F.lit(0).cast("long")).withColumn("suppressed", F.lit(False))


def refresh(old: DataFrame, files: DataFrame, as_of: float) -> DataFrame:
    """The next snapshot: unchanged notes stay, changed ones are cut anew and keep their counts and marks, gone ones go."""
    was = old.where("chunk_id = 0").select("path", "content_hash")
    change = dml.changes(was, files.select("path", "content_hash"))
    same = old.join(change.where("change = 'unchanged'").select("path"), "path", "left_semi")
    new = records(files.join(change.where("change in ('new', 'changed')").select("path"), "path", "left_semi"), as_of)
    marks = old.where("chunk_id = 0").select("path", F.col("access_count").alias("was_count"), F.col("suppressed").alias("was_suppressed"))
    carried = new.join(marks, "path", "left").withColumn("access_count", F.coalesce("was_count", "access_count")).withColumn("suppressed", F.coalesce("was_suppressed", "suppressed"))
    return same.unionByName(carried.drop("was_count", "was_suppressed"))


#: Fixed value: bytes of what is embedded of a chunk.
EMBEDDED = 7500


def to_embed(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(note_id, content) of chunks without a vector: title and text, cut to what a model is given (by bytes, at a whole character)."""
    content = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    cut = F.when(F.octet_length(content) <= EMBEDDED, content).otherwise(_head(content))
    return chunks.join(vectors.select(F.col("note_id").alias("id")), "id", "left_anti").select(F.col("id").alias("note_id"), cut.alias("content"))


def _head(content: Column) -> Column:
    """The longest beginning that fits, found by halving the number of characters."""

    def halve(at: Column, step: Column) -> Column:
        return F.when(F.octet_length(F.left(content, at + step)) <= EMBEDDED, at + step).otherwise(at)

    steps = F.array(*[F.lit(1 << k) for k in reversed(range(EMBEDDED.bit_length()))])
    return F.left(content, F.aggregate(steps, F.lit(0), halve))


def backfill(chunks: DataFrame, vectors: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The next snapshot of vectors (note_id, embedding): those of gone chunks go, missing ones come from ``embed``, which takes (note_id, content)."""
    kept = vectors.join(chunks.select(F.col("id").alias("note_id")), "note_id", "left_semi")
    new = embed(to_embed(chunks, kept))
    return kept.select("note_id", "embedding").unionByName(new.select("note_id", "embedding"))


def index_mode(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: lite without vectors, progressive while some are missing, full with all; with how many there are."""
    has = chunks.select("id").join(vectors.select(F.col("note_id").alias("id"), F.lit(1).alias("has")).distinct(), "id", "left")
    figures = has.agg(F.count("*").alias("chunks"), F.count("has").alias("embedded"))
    return figures.select("chunks", "embedded", F.when(F.col("embedded") == 0, "lite").when(F.col("embedded") < F.col("chunks"), "progressive").otherwise("full").alias("mode"))


def progressive(old: DataFrame, vectors: DataFrame, files: DataFrame, as_of: float, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(chunks, vectors) after a change of the folder: texts first, so that words can be searched at once, then the vectors that are missing.

    The chunks are written before anything is embedded, so a run that ends between the two goes on with the rest.
    """
    chunks = table(refresh(old, files, as_of), "chunks")
    return chunks, backfill(chunks, vectors, embed)
