"""Hybrid search: neighbours and title matches in one plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import scores as S
from quillon.functions import text as T
from quillon.operators import ranking, search
from quillon.storage import table

STRONG, FUZZY = 0.7, 0.4


def fuse(notes: DataFrame, vectors: DataFrame, query: Column, text: str, top_k: int = 10, tags=None, late: search.Late = None, **equal) -> DataFrame:
    """(path, score, source) before ranking.

    Strong title matches raise a neighbour's score; if the neighbours fill the list, its tail makes room for title
    matches; the rest is filled by them in the order of their scores.
    """
    terms = T.search_terms(text)
    # a few rows that several branches use: written, so that the scan behind them runs once
    near = table(search.vector_search(notes, vectors, query, top_k, tags=tags, late=late, **equal).select("id", "path", "score", "exact"), "near")
    if not terms:
        return near.select("path", "score", F.lit("vector").alias("source"))
    found = search.title_match(notes, terms, 1, 2 * top_k).withColumn("kw", ranking.keyword_title_score(F.col("title"), F.col("text"), terms, text))
    if tags or equal:
        found = found.where(search.metadata(tags, **equal))
    kw = table(found.select("path", "kw", "modified"), "titles")
    size = near.agg(F.count("*").alias("n_near")).crossJoin(kw.agg(F.count("*").alias("n_kw")))
    cut = max(2, math.ceil(top_k * 0.3))
    order = Window.orderBy("exact", "id")
    fused = near.join(kw.select("path", "kw"), "path", "left").select(
        "id", "path", "exact",
        F.when(F.col("kw") >= STRONG, S.round3(F.least(F.lit(1.0), F.col("score") + 0.5 * F.col("kw")))).otherwise(F.col("score")).alias("score"),
    )
    fused = fused.withColumn("n", F.row_number().over(order)).crossJoin(F.broadcast(size))
    kept = fused.where((F.col("n_kw") == 0) | (F.col("n_near") < top_k) | (F.col("n") <= F.greatest(F.col("n_near") - cut, F.lit(0))))
    kept = kept.select("path", "score", F.lit("vector").alias("source"))
    free = kept.agg((F.lit(top_k) - F.count("*")).alias("free"))
    new = kw.join(kept, "path", "left_anti").withColumn("n", F.row_number().over(Window.orderBy(F.desc("kw"), F.desc("modified"), "path")))
    filled = new.crossJoin(F.broadcast(free)).where(F.col("n") <= F.col("free")).select("path", F.col("kw").alias("score"), F.lit("keyword").alias("source"))
    return kept.unionByName(filled)


def hybrid_search(notes: DataFrame, vectors: DataFrame, query: Column, text: str, top_k: int = 10, facts: DataFrame | None = None, boosts: dict[str, float] | None = None, noise=None, tags=None, late: search.Late = None, **equal) -> DataFrame:
    """Fusion, fuzzy titles for free places, ranking by title overlap, type boosts, facts."""
    terms = T.search_terms(text)
    merged = table(fuse(notes, vectors, query, text, top_k, tags, late, **equal), "fused")
    if terms:
        near = search.fuzzy_title(notes.where(search.metadata(tags, **equal)), terms, 2 * top_k).select("path", "modified").join(merged, "path", "left_anti")
        free = merged.agg((F.lit(top_k) - F.count("*")).alias("free"), F.count_if(F.col("source") == "keyword").alias("n_kw"))
        n = F.row_number().over(Window.orderBy(F.desc("modified"), "path"))
        fuzzy = near.withColumn("n", n).crossJoin(F.broadcast(free)).where("n <= free and n_kw > 0")  # one row
        merged = merged.unionByName(fuzzy.select("path", F.lit(FUZZY).alias("score"), F.lit("fuzzy").alias("source")))
        merged = table(merged, "merged")
    full = notes.join(merged, "path").select("id", "path", "title", "content_type", "score", "source")
    full = table(full, "full")
    ranked = ranking.rank(full, T.title_words(text), noise) if T.title_words(text) else full.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "path")))
    ranked = table(ranked, "ranked")
    if boosts:
        # boosts sort by score again, and so set the title tiers aside
        ranked = ranking.type_boosts(ranked, boosts).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "place")))
    if facts is not None:
        gained = search.fact_boost(ranked, notes, search.search_facts(facts, query, 20), top_k)
        ranked = gained.join(ranked.select("path", "place"), "path", "left").withColumn("place", F.row_number().over(Window.orderBy(F.isnull("place"), "place", F.desc("score"), "path")))
    return ranked
