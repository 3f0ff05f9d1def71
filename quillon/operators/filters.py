"""Predicates and point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(path: str = "path", suppressed: str = "suppressed") -> Column:
    """Neither private nor suppressed. The private folder is matched as a prefix, whatever its case."""
    return ~F.upper(path).startswith("_PRIVATE/") & ~F.coalesce(F.col(suppressed), F.lit(False))


def has_tags(tags: str, wanted: list[str]) -> Column:
    """Any of the wanted tags, whatever the case; null tags have none."""
    return F.coalesce(F.arrays_overlap(F.transform(tags, lambda t: F.lower(t)), F.array(*[F.lit(w.lower()) for w in wanted])), F.lit(False))


def metadata(tags: list[str] | None = None, **equal: str | None) -> Column:
    """Equality on any columns given, whatever the case, and any-of on tags."""
    out = F.lit(True)
    for column, value in equal.items():
        if value:
            out = out & (F.lower(F.col(column)) == value.lower())
    return out & has_tags("tags", tags) if tags else out


def metadata_search(roots: DataFrame, top_k: int = 20, tags: list[str] | None = None, **equal: str | None) -> DataFrame:
    """Newest visible notes that match; tags are tested on those found (after the limit)."""
    found = roots.where(visible() & metadata(**equal)).orderBy(F.desc("modified"), "path").limit(max(1, min(top_k, 200)))
    return (found.where(has_tags("tags", tags)) if tags else found).withColumn("score", F.lit(0.0))


def noise(path: str, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.col(path).contains(p)
    return out


def recent(roots: DataFrame, limit: int = 10) -> DataFrame:
    return roots.where(visible()).orderBy(F.desc("modified"), "path").limit(limit)


def latest_handoff(roots: DataFrame) -> DataFrame:
    return recent(roots.where("content_type = 'handoff'"), 1)


def suppressed_paths(roots: DataFrame) -> DataFrame:
    return roots.where("suppressed").select("path").distinct()


def valid_embeddings(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors of the right size that aren't all zero."""
    return vectors.where((F.size("embedding") == size) & F.exists("embedding", lambda x: x != 0))


def check_vectors(vectors: DataFrame, dims: int, stored: dict[str, str], provider: str, model: str) -> DataFrame:
    """``vectors`` if they can be searched with this model, else an error; nothing stored is compatible with all."""
    if int(stored.get("embed_dims", 0) or 0) not in (0, dims):
        raise ValueError(f"vectors have {stored['embed_dims']} dimensions, the model has {dims}")
    if "embed_provider" in stored and "embed_model" in stored and (stored["embed_provider"], stored["embed_model"]) != (provider, model):
        raise ValueError("vectors were made by another model")
    return vectors
