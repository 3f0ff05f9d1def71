"""Vector, keyword, fuzzy and text-index search over notes.

Every search scans the notes once, and keeps the best rows with a distributed top-k (``orderBy().limit()``), so what
later steps rank is as small as the limit. Ties are broken by path or id.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import scores as S
from quillon.functions import text as T
from quillon.operators.filters import metadata, visible
from quillon.operators.textindex import TextIndex
from quillon.storage import table

CEILING = 20.0  # the distance at which semantic similarity ends


def vector_column(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def nearest(notes: DataFrame, vectors: DataFrame, query: Column, k: int) -> DataFrame:
    """The k nearest visible notes, before any scoring. Only ids and distances are sorted."""
    ids = notes.where(visible()).select(F.col("id").alias("note_id"))
    top = vectors.join(ids, "note_id", "left_semi").select("note_id", S.l2(F.col("embedding"), query).alias("distance"))
    top = top.withColumn("distance", F.round("distance", 9)).orderBy("distance", "note_id").limit(k)
    return notes.join(top, notes["id"] == top["note_id"]).drop("note_id")


def nearest_of_each(queries: DataFrame, vectors: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(q_id, other, place): for each query (note_id, embedding) the k nearest other vectors, the nearest first.

    Blocks of queries meet blocks of vectors; a task keeps k for each of its queries, and the best of those are sought by query. Only vectors
    of a query's own length have a distance from it.
    """
    q = queries.where("embedding is not null").select("note_id", "embedding", F.size("embedding").alias("dims"))
    v = vectors.where("embedding is not null").select("note_id", "embedding", F.size("embedding").alias("dims"))
    n, m = max(1, math.ceil(q.count() / block)), max(1, math.ceil(v.count() / block))
    deal = lambda df, own, parts, other, others: df.withColumn(own, F.pmod(F.xxhash64("note_id"), F.lit(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q_id": [], "other": [], "distance": []})
        a, b = np.stack(left["embedding"].to_numpy()).astype(np.float64), np.stack(right["embedding"].to_numpy()).astype(np.float64)
        ids, others = left["note_id"].to_numpy(), right["note_id"].to_numpy()
        out = []
        for i, x in zip(ids, a, strict=True):
            d = np.round(np.sqrt(((b - x) ** 2).sum(axis=1)), 9)
            d[others == i] = np.inf
            first = np.lexsort((others, d))[:k]
            first = first[np.isfinite(d[first])]
            out.append(pd.DataFrame({"q_id": i, "other": others[first], "distance": d[first]}))
        return pd.concat(out, ignore_index=True)

    met = deal(q, "i", n, "j", m).groupBy("dims", "i", "j").cogroup(deal(v, "j", m, "i", n).groupBy("dims", "i", "j")).applyInPandas(best, "q_id long, other long, distance double")
    place = F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "other"))
    return met.withColumn("place", place).where(F.col("place") <= k).select("q_id", "other", "place")


Late = Callable[[DataFrame], DataFrame] | None


def vector_search(notes: DataFrame, vectors: DataFrame, query: Column, top_k: int = 10, ceiling: float = CEILING, tags=None, late: Late = None, **equal) -> DataFrame:
    """Five times as many neighbours, then metadata, the best chunk of each path, blended scores, top k by distance.

    ``late`` adds columns that only the neighbours need, such as counts of accesses.
    """
    top_k = max(1, min(top_k, 100))
    found = nearest(notes, vectors, query, 5 * top_k)
    found = late(found) if late else found
    every = Window.partitionBy(F.lit(0))  # 500 rows at most
    found = found.withColumns({"low": F.min("distance").over(every), "high": F.max("distance").over(every)})
    kept = found.where(metadata(tags, **equal))
    first = Window.partitionBy("path").orderBy("distance", "id")
    best = kept.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").orderBy("distance", "id").limit(top_k)
    absolute = F.greatest(F.lit(0.0), 1 - F.col("distance") / ceiling)
    relative = F.when(F.col("high") <= F.col("low"), 1.0).otherwise(1 - (F.col("distance") - F.col("low")) / (F.col("high") - F.col("low")))
    blended = 0.7 * absolute + 0.3 * relative
    boosted = F.when(F.col("access_count") > 0, F.least(F.lit(1.0), blended + 0.02 * F.log1p(F.col("access_count").cast("double")))).otherwise(blended)
    return best.select(
        "id", "path", "title", "content_type", "domain", "workstream", "trust_state", "modified", "text", S.round3(boosted).alias("score"), S.round1(F.col("distance")).alias("distance"),
        F.col("distance").alias("exact"),
    )


def find_similar(notes: DataFrame, vectors: DataFrame, note_id: int, top_k: int = 5, ceiling: float = CEILING) -> DataFrame:
    """Notes near a note's own vector, without that note; more are fetched so that enough are left."""
    own = vectors.where(F.col("note_id") == note_id).select("embedding").first()
    if own is None:
        return vector_search(notes, vectors.limit(0), vector_column([0.0]), top_k)
    found = vector_search(notes, vectors, vector_column(own[0]), top_k + 10, ceiling)
    return found.where(F.col("id") != note_id).orderBy(F.desc("score"), "id").limit(top_k)


def _matches(terms: list[str], *columns: str) -> Column:
    """How many terms occur in any of the columns."""
    out = F.lit(0)
    for t in terms:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(F.col(c)).contains(t), F.lit(False))
        out = out + F.when(hit, 1).otherwise(0)
    return out


def keyword_search(chunks: DataFrame, terms: list[str], limit: int = 10) -> DataFrame:
    """Root rows of notes any chunk of which has a term; most terms in the root row first, then the newest."""
    seen = chunks.where(visible())
    # one pass: a path's rows come down to whether any has a term, and its root row
    hit = _matches(terms, "title", "text")
    root = F.struct("id", "title", "modified", "text")
    paths = seen.groupBy("path").agg(F.max(hit > 0).alias("hit"), F.max(F.when(F.col("chunk_id") == 0, root)).alias("root")).where("hit and root is not null")
    roots = paths.select("path", "root.*").withColumn("matches", hit)
    return roots.orderBy(F.desc("matches"), F.desc("modified"), "path").limit(limit)


def content_term_search(chunks: DataFrame, terms: list[str], least: int = 1, limit: int = 10) -> DataFrame:
    """Notes by how many terms any of their chunks has, then by how often for their length, then the newest."""
    seen = chunks.where(visible())
    found = [F.lower(F.col("text")).contains(t) for t in terms]
    anywhere = [f | F.lower(F.col("title")).contains(t) for f, t in zip(found, terms, strict=True)]
    sums = seen.groupBy("path").agg(
        sum((F.max(F.when(a, 1).otherwise(0)) for a in anywhere), F.lit(0)).alias("coverage"),
        sum((F.sum(F.when(f, 1).otherwise(0)) for f in found), F.lit(0)).alias("frequency"),
        F.count("*").alias("n_chunks"),
    )
    roots = seen.where("chunk_id = 0").select("id", "path", "title", "modified")
    density = F.col("frequency") * F.col("frequency") / F.col("n_chunks")
    return roots.join(sums.where(F.col("coverage") >= least), "path").withColumn("density", F.round(density, 6)).orderBy(F.desc("coverage"), F.desc("density"), F.desc("modified"), "path").limit(limit)


def title_match(roots: DataFrame, terms: list[str], least: int = 1, limit: int = 20, title_only: bool = True) -> DataFrame:
    found = _matches(terms, "title") if title_only else _matches(terms, "title", "path")
    return roots.where(visible()).withColumn("matches", found).where(F.col("matches") >= least).orderBy(F.desc("matches"), F.desc("modified"), "path").limit(limit)


def _one_edit_from(term: str):
    return lambda w: F.levenshtein(w, F.lit(term)) == 1


def _equal_to(term: str):
    return lambda w: w == term


def fuzzy_title(roots: DataFrame, terms: list[str], limit: int = 10) -> DataFrame:
    """Of the newest notes those with a title word at an edit distance of exactly one from a term of five letters or more."""
    long = [t for t in terms if len(t.encode()) >= 5]
    newest = roots.where(visible()).orderBy(F.desc("modified"), "path").limit(max(200, 10 * limit))
    words = F.split(F.lower("title"), "[^0-9a-z]+")
    near = F.lit(False)
    for t in long:
        near = near | F.exists(words, _one_edit_from(t))
    return newest.where(near).orderBy(F.desc("modified"), "path").limit(limit)


def bm25(notes: DataFrame, terms: list[str], limit: int = 30, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, rank) by BM25 where there is no index: all texts are cut, and only the query's terms are counted; collection figures are one row."""
    all_terms = T.tokens(F.concat_ws(" ", "path", "title", "text"))
    base = notes.select("id", all_terms.alias("terms"))
    # texts are cut once; both the figures and the ranking read what is left of them
    per = table(base.select("id", F.size("terms").alias("length"), *[F.size(F.filter("terms", _equal_to(t))).alias(f"tf{i}") for i, t in enumerate(terms)]), "counts")
    figures = per.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(terms))])
    total = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        tf = F.col(f"tf{i}")
        total = total + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    ranked = per.crossJoin(F.broadcast(figures)).select("id", F.round(total, 6).alias("rank"))  # one row
    return ranked.where("rank > 0").orderBy(F.desc("rank"), "id").limit(limit)


def text_search(notes: DataFrame, terms: list[str], top_k: int = 10, tags=None, index: TextIndex | None = None, late: Late = None, **equal) -> DataFrame:
    """Best by BM25 (three times as many), then metadata; all have the score 0.5 and an access boost.

    With an ``index`` of the visible notes only the terms' postings are read, and then the notes that they name.
    """
    seen = notes.where(visible())
    top = index.bm25(terms, 3 * top_k) if index else bm25(seen, terms, 3 * top_k)
    found = seen.join(F.broadcast(top), "id")  # 3 * top_k rows
    found = late(found) if late else found
    boost = F.when(F.col("access_count") > 0, F.least(F.lit(1.0), 0.5 + 0.02 * F.log1p(F.col("access_count").cast("double")))).otherwise(0.5)
    return found.where(metadata(tags, **equal)).withColumn("score", S.round3(boost)).orderBy(F.desc("rank"), "id").limit(top_k)


def search_facts(facts: DataFrame, query: Column, top_k: int = 10) -> DataFrame:
    near = facts.withColumn("distance", F.round(S.l2(F.col("embedding"), query), 9))
    return near.orderBy("distance", "fact_id").limit(max(1, min(top_k, 100))).drop("embedding")


def fact_boost(results: DataFrame, notes: DataFrame, found: DataFrame, top_k: int, ceiling: float = CEILING) -> DataFrame:
    """(path, score, from_fact): results whose notes have a near fact gain; free places go to notes of other facts."""
    best = found.groupBy(F.col("source_path").alias("path")).agg(F.min_by("confidence", F.struct("distance", "fact_id")).alias("sure"), F.min("distance").alias("fact_distance"))
    gained = results.join(best, "path", "left").select(
        "path", S.round3(F.least(F.lit(1.0), F.col("score") + F.coalesce(0.05 + 0.10 * F.col("sure"), F.lit(0.0)))).alias("score"), F.lit(False).alias("from_fact")
    )
    added = best.join(results, "path", "left_anti").join(notes.where(visible()).select("path"), "path", "left_semi")
    added = added.select("path", S.round3(0.85 * F.greatest(F.lit(0.0), 1 - F.col("fact_distance") / ceiling)).alias("score"), F.lit(True).alias("from_fact"))
    # results first: additions only fill what is free
    order = Window.orderBy("from_fact", F.desc("score"), "path")
    return gained.unionByName(added.orderBy(F.desc("score"), "path").limit(top_k)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= top_k).drop("n")


def federated(searches: dict[str, DataFrame], top_k: int = 10) -> DataFrame:
    """Best results of several collections, each (vault, path) once."""
    parts = [df.withColumn("vault", F.lit(name)) for name, df in sorted(searches.items())]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    once = Window.partitionBy("vault", "path").orderBy(F.desc("score"), "path")
    return every.withColumn("n", F.row_number().over(once)).where("n = 1").drop("n").orderBy(F.desc("score"), "vault", "path").limit(top_k)


def with_fallback(searches: list[DataFrame], top_k: int = 10, metadata_hits: DataFrame | None = None) -> DataFrame:
    """(path, score, source, place): the first of ``searches`` (path, score) that finds anything, by score.

    ``metadata_hits``, for a query about metadata, come before them, and a path found by both counts there. ``source`` is the
    search's number, -1 for metadata. Each search is a top-k already, so all that is ordered here is a few rows.
    """
    found = [df.select("path", "score").withColumn("source", F.lit(i)) for i, df in enumerate(searches)]
    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df)
    first = every.agg(F.min("source").alias("first"))
    kept = every.join(F.broadcast(first), F.col("source") == F.col("first")).drop("first")  # one row
    if metadata_hits is not None:
        kept = kept.unionByName(metadata_hits.select("path", "score").withColumn("source", F.lit(-1)))
    kept = kept.groupBy("path").agg(F.min(F.struct("source", (-F.col("score")).alias("back"))).alias("best"))
    order = Window.orderBy("source", F.desc("score"), "path")
    rows = kept.select("path", (-F.col("best.back")).alias("score"), "best.source").orderBy("source", F.desc("score"), "path").limit(top_k)
    return rows.withColumn("place", F.row_number().over(order))


def ask_context(results: DataFrame, notes: DataFrame, letters: int = 1000) -> DataFrame:
    """(place, path, context): what an answer is to be based on, numbered, each note's beginning."""
    body = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.col("title"), F.lit(" ("), F.col("path"), F.lit(")\n"), F.left("text", F.lit(letters)))
    return results.select("path", "place").join(notes.select("path", "title", "text"), "path").select("place", "path", body.alias("context"))
