"""Score columns. Time is always given as ``as_of`` (epoch seconds), never taken from a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days to half of the recency by content type (absent: never decays), and type baselines.
HALF_LIFE = {"research": 90.0, "project": 90.0, "note": 60.0, "handoff": 30.0, "progress": 30.0, "kaizen": 30.0}
PERMANENT = ("decision", "hub")
DEFAULT_HALF_LIFE = 60.0
BASELINE = {"decision": 0.9, "hub": 0.85, "research": 0.7, "project": 0.65, "handoff": 0.6, "kaizen": 0.5, "progress": 0.5, "note": 0.5}
TRUST = {"validated": 1.0, "unknown": 1.0, "stale": 0.75, "contradicted": 0.4}


def lookup(column: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def round3(x: Column) -> Column:
    """Thousandths, halves up, for x >= 0."""
    return F.floor(x * 1000 + 0.5) / 1000


def round1(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def recency(modified: Column, content_type: Column, as_of: float) -> Column:
    """0.5 ** (age / half life); 1 for permanent types and for what lies in the future."""
    age = (F.lit(float(as_of)) - modified) / 86400.0
    decayed = F.pow(F.lit(0.5), age / lookup(content_type, HALF_LIFE, DEFAULT_HALF_LIFE))
    return F.when(content_type.isin(*PERMANENT) | (age <= 0), 1.0).otherwise(decayed)


def confidence(content_type: Column, modified: Column, access_count: Column, has_review: Column, trust_state: Column, as_of: float) -> Column:
    base = 0.5 * lookup(content_type, BASELINE, 0.5) + 0.35 * recency(modified, content_type, as_of)
    boost = F.least(F.lit(0.15), F.log2(access_count + 1.0) / 10) + F.when(has_review, 0.05).otherwise(0.0)
    return round3(clamp((base + boost) * lookup(trust_state, TRUST, 1.0)))


def composite(semantic: Column, modified: Column, confidence_: Column, content_type: Column, weights: tuple[float, float, float], as_of: float) -> Column:
    a, b, c = weights
    return round3(clamp(a * semantic + b * recency(modified, content_type, as_of) + c * confidence_))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """0 for arrays of different sizes and zero vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    whole = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (whole == 0), 0.0).otherwise(dot / whole)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
