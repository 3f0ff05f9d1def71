"""Which notes a prompt brings up: gates on prompts, several kinds of search, one list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import prompts as P
from quillon.functions import scores as S
from quillon.functions import text as T
from quillon.operators import graph, ranking, search
from quillon.operators.textindex import TextIndex
from quillon.storage import table

FAR, SEMANTIC, COMPOSITE = 16.3, 0.25, 0.70
MOST, OVERLAP, TEXT, CONTENT, RESCUED = 3, 0.10, 0.85, 0.15, 0.25
RECENT_TYPES = ("handoff", "hub", "progress", "decision")
WEIGHTS, RECENT_WEIGHTS, RECENT_LEAST = (0.3, 0.3, 0.4), (0.1, 0.7, 0.2), 0.45
#: The shortest prompt (in bytes) that is answered, and the similarity of terms up to which a topic is new.
SHORTEST, NEW_TOPIC = 20, 0.35


def decide(prompts: DataFrame, text: str = "text", session: str | None = None, order: str | None = None) -> DataFrame:
    """The first gate that stops a prompt, or "search": short, slash command, small talk, no signal, a task, the topic of the prompt before.

    Prompts about what is recent pass the gates of signal, mode and topic. The last gate needs the columns of the session and of the order in it; it
    compares with the terms of the prompt before in the session.
    """
    p = F.col(text)
    mode, recent = P.mode(p), P.asks_for_recent(p)
    same = F.lit(False)
    if session and order:
        terms = T.term_array(p)
        prompts = prompts.withColumn("_terms", terms).withColumn("_before", F.lag("_terms").over(Window.partitionBy(session).orderBy(order)))
        same = F.coalesce(S.jaccard(F.col("_terms"), F.col("_before")) > NEW_TOPIC, F.lit(False))
    decision = (
        F.when(F.coalesce(F.octet_length(p), F.lit(0)) < SHORTEST, "skip_short").when(F.btrim(p).startswith("/"), "skip_slash").when(P.small_talk(p), "skip_conversational")
        .when(~recent & P.low_signal(p), "skip_lowsignal").when(~recent & (mode == "executing"), "skip_executing").when(~recent & (mode == "socializing"), "skip_socializing")
        .when(~recent & same, "skip_sametopic").otherwise("search")
    )
    return prompts.withColumns({"decision": decision, "mode": mode}).drop("_terms", "_before")


def _counts(found: DataFrame) -> tuple[int, bool, bool]:
    """How many candidates there are, whether one's overlap is high, and whether one's is positive."""
    r = found.agg(F.count("*").alias("n"), F.max("overlap").alias("top")).first()  # a few rows
    return r.n, (r.top or 0.0) >= ranking.HIGH, (r.top or 0.0) > 0


def surface(notes: DataFrame, vectors: DataFrame, query: Column, prompt: str, as_of: float, edges: DataFrame | None = None, chunks: DataFrame | None = None, far: float = FAR, late: search.Late = None) -> DataFrame:
    """(id, path, title, content_type, trust_state, text, score, overlap, boosted, mode, place): notes for a prompt, the best first.

    Seven kinds of search, each a top-k of its own; what an earlier one found counts there:
    0 neighbours of the prompt's vector within ``far``; 1 titles and paths that overlap; 2 hubs whose title overlaps by half; 3 specific terms, if places are free
    or nothing is near, with notes whose contents have the broad terms; 4 broad terms in titles, if nothing is near; 5 titles one edit away, if
    places are free; 6 contents with all broad terms, if there is no specific one. Then neighbours in the graph (7), versions of one note, three tiers.
    All have to reach the composite score. Where no title fits, the first match of contents gets an overlap by itself (``boosted``).
    ``chunks`` are the notes' chunks; without them each note's text is one. ``late`` adds what only the found notes need (access_count, trust_state).
    """
    spark = notes.sparkSession
    notes = notes.where(search.visible())
    chunks = (chunks if chunks is not None else notes.withColumn("chunk_id", F.lit(0))).where(search.visible())
    words = [w.lower() for w in T.title_words(prompt)]
    told = spark.range(1).select(P.key_terms(F.lit(prompt)).alias("k")).first().k  # the prompt itself
    specific, broad = [t.lower() for t in told.specific], [t.lower() for t in told.broad]
    conf = S.confidence(F.col("content_type"), F.col("modified"), F.col("access_count"), F.col("review_by").isNotNull(), F.col("trust_state"), as_of)
    sorted_, alone, full = ranking.title_overlap(words)("title", "path"), ranking.plain_overlap(words, False)("title", "path"), ranking.plain_overlap(words, True)("title", "path")
    keep = ["id", "path", "title", "content_type", "trust_state", "text", "modified"]
    none = F.lit(0.0)

    def rated(rows: DataFrame, semantic: Column, overlap: Column, mode: int) -> DataFrame:
        score = S.composite(semantic, F.col("modified"), conf, F.col("content_type"), WEIGHTS, as_of)
        return rows.withColumn("score", score).where(F.col("score") >= COMPOSITE).select(*keep, "score", overlap.alias("overlap"), F.lit(False).alias("boosted"), F.lit(mode).alias("mode"))

    def of(found: DataFrame, *more: str) -> DataFrame:
        """The whole notes of a search's few rows."""
        rows = notes.join(F.broadcast(found.select("path", *more)), "path")
        return late(rows) if late else rows

    near = search.nearest(notes, vectors, query, 6 * MOST)
    near = table(late(near) if late else near, "near")  # a few rows
    least = near.agg(F.min("distance").alias("d")).first().d
    far_off = least is None or least > far
    first = F.row_number().over(Window.partitionBy("path").orderBy("distance", "id"))
    every = Window.partitionBy(F.lit(0))
    close = near.withColumn("n", first).where("n = 1").withColumns({"low": F.min("distance").over(every), "high": F.max("distance").over(every)})
    semantic = F.when(F.col("high") <= F.col("low"), 1 - (F.col("distance") - F.col("low"))).otherwise(1 - (F.col("distance") - F.col("low")) / (F.col("high") - F.col("low")))
    close = close.where(F.lit(not far_off) & (F.col("distance") <= far)).withColumn("semantic", semantic).where(F.col("semantic") >= SEMANTIC)
    found = table(rated(close, F.col("semantic"), sorted_, 0), "found")

    def add(rows: DataFrame) -> None:
        nonlocal found
        found = table(found.unionByName(rows.join(F.broadcast(found.select("path")), "path", "left_anti")), "found")

    def lifted(rows: DataFrame, overlap: Column, strong: bool, positive: bool, rescue: bool) -> DataFrame:
        """Of content matches in their order, the first without a high overlap gets one, if no candidate has any; others get a low one."""
        rows = rows.withColumn("overlap", overlap).join(F.broadcast(found.select("path")), "path", "left_anti")
        place = F.row_number().over(Window.partitionBy(F.col("overlap") < ranking.HIGH).orderBy(F.desc("coverage"), F.desc("density"), F.desc("modified"), "path"))
        up = F.lit(rescue and not strong and not positive) & (F.col("overlap") < ranking.HIGH) & (place == 1)
        raised = rows.withColumn("up", up)
        low = F.lit(rescue and not positive) & (F.col("overlap") < CONTENT)
        return raised.withColumns({"overlap": F.when(F.col("up"), RESCUED).when(low, CONTENT).otherwise(F.col("overlap")), "boosted": F.col("up")}).select(*keep, "score", "overlap", "boosted", "mode")

    def contents(least_terms: int, mode: int) -> DataFrame:
        got = search.content_term_search(chunks, broad, least_terms, 10 * MOST)
        score = S.composite(F.lit(TEXT), F.col("modified"), conf, F.col("content_type"), WEIGHTS, as_of)
        return of(got, "coverage", "density").withColumn("score", score).where(F.col("score") >= COMPOSITE).withColumn("mode", F.lit(mode))

    if words:
        titles = of(search.title_match(notes, words, 1, 10 * MOST, title_only=False)).where(F.greatest(full, alone) >= OVERLAP)
        add(rated(titles, F.lit(TEXT), sorted_, 1))
        hubs = of(search.title_match(notes, words, 1, 10).where("content_type = 'hub'")).withColumn("own", alone).where(F.col("own") >= 0.5)
        add(rated(hubs, F.lit(TEXT), F.col("own"), 2))
    n, strong, positive = _counts(found)
    if specific and (n < MOST or far_off and not strong):
        verified = table(contents(max(2, len(broad) - 1), 3), "verified") if far_off and len(broad) >= 3 else None
        got = of(search.keyword_search(chunks, [*specific, *broad], 3 * MOST))
        if verified is None:
            add(rated(got, F.lit(TEXT), none, 3))
        else:
            sure = got.join(F.broadcast(verified.select("path", F.lit(True).alias("sure"))), "path", "left")
            lift = F.when(F.col("sure"), F.when((sorted_ < CONTENT) & F.lit(not positive), CONTENT).otherwise(sorted_)).otherwise(0.0)
            add(rated(sure, F.lit(TEXT), lift, 3))
            add(lifted(verified, sorted_, strong, positive, True))
    n, strong, positive = _counts(found)
    if n < MOST and far_off and len(broad) >= 2 and not specific:
        add(rated(of(search.title_match(notes, broad, 2, 3 * MOST, title_only=False)), F.lit(TEXT), none, 4))
        n, strong, positive = _counts(found)
    if n < MOST:
        fuzzy = of(search.fuzzy_title(notes, T.search_terms(prompt), 3 * MOST)).withColumn("own", alone)
        add(rated(fuzzy.where(F.col("own") >= F.when(F.col("content_type") == "hub", 0.20).otherwise(0.40)), F.lit(TEXT), F.col("own"), 5))
        n, strong, positive = _counts(found)
    if not specific and len(broad) >= 3 and (n < MOST or far_off or not strong):
        add(lifted(contents(len(broad), 6), sorted_, strong, positive, n < MOST))
    if edges is not None:
        top = found.orderBy(F.desc("score"), "path").limit(2).select(F.col("id").alias("node"), "score")
        more = graph.expand(top, edges, found.select(F.col("id").alias("node")))
        extra = notes.join(F.broadcast(more.select(F.col("node").alias("id"), F.col("score"))), "id")
        extra = late(extra) if late else extra
        add(extra.select(*keep, "score", none.alias("overlap"), F.lit(False).alias("boosted"), F.lit(7).alias("mode")))
    kept = ranking.drop_versions(found)
    o, high = F.col("overlap"), F.col("overlap") >= ranking.HIGH
    order = [F.desc(high), F.desc(F.when(high, o).otherwise(0.0)), F.desc(o > 0), F.desc(F.col("content_type").isin(*ranking.PRIORITY)), F.desc("score"), F.asc("path")]
    return kept.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("modified")  # a few dozen rows


def recent_surface(notes: DataFrame, vectors: DataFrame, query: Column, prompt: str, as_of: float, far: float = FAR + 2) -> DataFrame:
    """(id, path, title, content_type, text, score, overlap, place) for prompts about what is recent, weighed by recency.

    Neighbours within ``far``, then the newest notes that are handoffs, hubs, progress or decisions, then titles with two of the prompt's words; a
    note counts where it is found first, and one whose title or path fits goes before the others.
    """
    notes = notes.where(search.visible())
    words = [w.lower() for w in T.title_words(prompt)]
    conf = S.confidence(F.col("content_type"), F.col("modified"), F.col("access_count"), F.col("review_by").isNotNull(), F.col("trust_state"), as_of)
    keep = ["id", "path", "title", "content_type", "text", "modified"]

    def rated(rows: DataFrame, semantic: Column, mode: int) -> DataFrame:
        score = S.composite(semantic, F.col("modified"), conf, F.col("content_type"), RECENT_WEIGHTS, as_of)
        return rows.withColumn("score", score).where(F.col("score") >= RECENT_LEAST).select(*keep, "score", F.lit(mode).alias("mode"))

    first = F.row_number().over(Window.partitionBy("path").orderBy("distance", "id"))
    every = Window.partitionBy(F.lit(0))  # a few rows
    near = search.nearest(notes, vectors, query, 6 * MOST).withColumn("n", first).where("n = 1").withColumns({"low": F.min("distance").over(every), "high": F.max("distance").over(every)})
    span = F.when(F.col("high") <= F.col("low"), 1.0).otherwise(F.col("high") - F.col("low"))
    parts = rated(near.where(F.col("distance") <= far).withColumn("semantic", F.greatest(1 - (F.col("distance") - F.col("low")) / span, F.lit(0.0))), F.col("semantic"), 0)
    newest = notes.orderBy(F.desc("modified"), "path").limit(3 * MOST).where(F.col("content_type").isin(*RECENT_TYPES))
    parts = parts.unionByName(rated(newest, F.lit(0.0), 1))
    fits = F.lit(0.0)
    if words:
        titles = search.title_match(notes, words, 2, 10 * MOST, title_only=False).select("path")
        fitting = notes.join(F.broadcast(titles), "path").withColumn("fit", ranking.plain_overlap(words, True)("title", "path")).where(F.col("fit") >= OVERLAP / 2)
        fitting = table(fitting, "fitting")  # a few rows
        parts = parts.unionByName(rated(fitting, F.lit(TEXT), 2))
    once = parts.groupBy("path").agg(F.min(F.struct("mode", (-F.col("score")).alias("back"), "id", "title", "content_type", "text")).alias("x")).select("path", "x.id", "x.title", "x.content_type", "x.text", (-F.col("x.back")).alias("score"))
    if words:
        once, fits = once.join(F.broadcast(fitting.select("path", "fit")), "path", "left"), F.coalesce("fit", F.lit(0.0))
    ranked = once.withColumn("overlap", fits)
    high = F.col("overlap") >= OVERLAP / 2
    place = F.row_number().over(Window.orderBy(F.desc(high), F.desc(F.when(high, F.col("overlap")).otherwise(0.0)), F.desc("score"), "path"))
    return ranked.withColumn("place", place).select("id", "path", "title", "content_type", "text", "score", "overlap", "place")


def keyword_surface(notes: DataFrame, prompt: str, index: TextIndex | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """(path, title, content_type, text, score) where there are no vectors: by the text index, or without one by words in any chunk; all score a half."""
    notes, terms = notes.where(search.visible()), T.search_terms(prompt)
    if not terms:
        return notes.limit(0).select("path", "title", "content_type", "text", F.lit(0.5).alias("score"))
    if index is not None:
        found = notes.join(F.broadcast(index.bm25(terms, 3 * MOST)), "id").orderBy(F.desc("rank"), "id").limit(MOST)
    else:
        rows = chunks if chunks is not None else notes.withColumn("chunk_id", F.lit(0))
        found = notes.join(F.broadcast(search.keyword_search(rows, terms, MOST).select("path")), "path")
    return found.select("path", "title", "content_type", "text", F.lit(0.5).alias("score"))


def with_pinned(results: DataFrame, notes: DataFrame, pins: DataFrame) -> DataFrame:
    """Results (path, title, content_type, text, score, overlap, place) with the pinned notes (path, pinned_at) in front, in the order of their pins.

    A pinned note has score and overlap 1 and counts once, as pinned.
    """
    first = notes.where(search.visible()).join(pins, "path").select("path", "title", "content_type", "text", F.lit(1.0).alias("score"), F.lit(1.0).alias("overlap"), F.lit(0).alias("rank"), F.col("pinned_at").cast("double").alias("at"))
    rest = results.join(pins.select("path"), "path", "left_anti").select("path", "title", "content_type", "text", "score", "overlap", F.lit(1).alias("rank"), F.col("place").cast("double").alias("at"))
    return first.unionByName(rest).withColumn("place", F.row_number().over(Window.orderBy("rank", "at", "path"))).drop("rank", "at")  # pins and results are few
