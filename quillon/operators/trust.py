"""Provenance and similarity groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import vectorindex
from quillon.operators.mining import contradiction
from quillon.storage import table

#: Vectors of a block at most where all are compared; a task holds two blocks.
WIDE = 65_536


def divergence(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Sources of type file whose content has another hash now, or is gone."""
    now = files.select(F.col("path").alias("source_path"), F.col("content_hash").alias("now"))
    joined = sources.where("source_type = 'file'").join(now, "source_path", "left")
    return joined.where(F.lower(F.coalesce("now", F.lit(""))) != F.lower("source_hash")).select("note_path", "source_path", F.col("now").isNull().alias("missing"), "captured_at")


def propagate(notes: DataFrame, sources: DataFrame, files: DataFrame, as_of: float, grace: int = 300) -> DataFrame:
    """(path, trust_state): stale where a source changed some time ago; validated where there are sources and none did."""
    bad = divergence(sources, files).where(F.col("captured_at") < as_of - grace).select(F.col("note_path").alias("path")).distinct().withColumn("stale", F.lit(True))
    known = sources.select(F.col("note_path").alias("path")).distinct().withColumn("sourced", F.lit(True))
    j = notes.select("path", "trust_state").join(known, "path", "left").join(bad, "path", "left")
    return j.select("path", F.when(F.col("stale"), "stale").when(F.col("sourced"), "validated").otherwise(F.col("trust_state")).alias("trust_state"))


def similar_pairs(vectors: DataFrame, threshold: float, block: int = 2048, recall: float | None = None, index: tuple[int, int] | None = None) -> DataFrame:
    """(a, b, similarity) of pairs a < b of (note_id, embedding) with a cosine of at least ``threshold``, exact for every pair returned.

    Without ``recall`` all pairs are found: vectors are dealt into blocks of about ``block``, each task multiplies two of them, and
    the work grows with the square of the vectors, in even tasks. With it (say 0.95), candidates come from an index of signed random
    projections (``vectorindex``) in which a pair at the threshold is found with that probability at least, and closer ones with a higher
    one; where such an index would not save half of the work (few vectors, or a low threshold) all pairs are compared all the same. ``index`` gives the number of
    directions and tables of the index itself.

    Vectors of unlike length are not similar. Null vectors, and vectors of length zero, are like nothing.
    """
    rows = vectors.where("embedding is not null and note_id is not null").select("note_id", "embedding", F.size("embedding").alias("dims"))
    n = rows.count()
    tables = index or (vectorindex.layout(n, threshold, recall) if recall else None)
    if tables:
        near = vectorindex.candidates(rows, threshold, *tables, block=max(block, min(WIDE, n // 16)))
    else:
        # a vector is sent once for each block: blocks grow with the vectors up to WIDE
        near = vectorindex.in_blocks(rows.withColumn("parts", F.lit(max(1, math.ceil(n / max(block, min(WIDE, n // 16)))))), ["dims"], threshold)
    return near.select("a", "b", F.round("similarity", 6).alias("similarity")).where(F.col("similarity") >= threshold)


def leader_groups(items: DataFrame, pairs: DataFrame, order: str = "modified") -> DataFrame:
    """(leader, member): items, newest first, join the first leader they are similar to, or lead themselves.

    Whether an item leads depends on those before it, so items are settled in rounds: in each, items without an unsettled
    predecessor lead, and what follows one of them is settled as a follower at once. Rounds are as many as the longest
    chain of leaders that wait for each other. A follower's leader is sought when all leaders are known.
    """
    when = items.select("id", F.col(order).alias("at"))
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    later = both.join(when.withColumnRenamed("id", "a"), "a").join(when.select(F.col("id").alias("b"), F.col("at").alias("before")), "b")
    later = later.where("(before is not null and at is null) or before > at or (before <=> at and b < a)")
    later = table(later.select("a", "b", "before"), "later")
    waiting, followers = later.select("a", "b"), items.select("id").limit(0)
    while waiting.limit(1).count():
        lead = waiting.select("b").distinct().join(waiting.select(F.col("a").alias("b")), "b", "left_anti")
        new = table(waiting.join(lead, "b", "left_semi").select(F.col("a").alias("id")).distinct(), "followers")
        followers = followers.unionByName(new)
        waiting = waiting.join(new.select(F.col("id").alias("a")), "a", "left_anti").join(new.select(F.col("id").alias("b")), "b", "left_anti")
        waiting = table(waiting, "waiting")
    followers = table(followers, "followers")
    leaders = table(items.select("id").join(followers, "id", "left_anti"), "leaders")
    first = later.join(leaders.withColumnRenamed("id", "b"), "b", "left_semi").join(followers.withColumnRenamed("id", "a"), "a", "left_semi")
    first = first.groupBy("a").agg(F.max_by("b", F.struct("before", (-F.col("b")).alias("back"))).alias("leader"))
    return leaders.select(F.col("id").alias("leader"), F.col("id").alias("member")).union(first.select("leader", F.col("a").alias("member")))


def set_pairs(sets: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, shared) of pairs a < b of (id, tags), distinct sets of plain tags, with at least ``least`` in common.

    A prefix filter: a set's tags are ordered from the rarest to the commonest, and of two sets with so many in common one of the first
    n - least + 1 of each must be the same; so the commonest tags, above all one that every set has, are no key of the join.
    """
    each = sets.where(F.size("tags") >= least).select("id", F.explode("tags").alias("tag"))
    often = each.groupBy("tag").agg(F.count("*").alias("n"))
    ordered = each.join(often, "tag").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "tag"))).alias("t")).select("id", F.transform("t", lambda x: x["tag"]).alias("tags"))
    ordered = table(ordered, "tag-sets")
    keys = ordered.select("id", "tags", F.explode(F.slice("tags", F.lit(1), F.size("tags") - least + 1)).alias("key"))
    a, b = (keys.select(F.col("id").alias(x), F.col("tags").alias(f"t{x}"), "key") for x in "ab")
    # a pair meets at each key that both begin with, and counts at the first of them
    met = a.join(b, "key").where("a < b").withColumn("common", F.array_intersect("ta", "tb"))
    return met.where((F.size("common") >= least) & (F.get("common", F.lit(0)) == F.col("key"))).select("a", "b", F.size("common").alias("shared"))


def shared_tags(sets: DataFrame, least: int = 2, block: int = 1024, task: int = 4_000_000) -> DataFrame:
    """(a, b, shared) of pairs a < b of (id, tags) with at least ``least`` tags in common, whatever their case.

    Sets are compared once for each distinct set (``set_pairs``). Ids of one set lie in blocks of about ``block``, and what is dealt to the tasks are pairs of
    blocks, about ``task`` pairs of ids to each; so a set of many copies is no single task. Null and empty sets have nothing in common with any.
    """
    plain = F.array_sort(F.array_distinct(F.transform(F.filter("tags", lambda t: t.isNotNull()), lambda t: F.lower(t))))
    own = sets.where("tags is not null and id is not null").select("id", plain.alias("tags")).where(F.size("tags") >= least)
    classes = own.groupBy("tags").agg(F.count("*").alias("n")).select("tags", "n", F.monotonically_increasing_id().alias("set"))
    classes = table(classes, "sets")
    parts = F.ceil(F.col("n") / block).cast("int").alias("parts")
    dealt = own.join(classes.select("tags", "set", parts), "tags").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    blocks = table(dealt.groupBy("set", "part").agg(F.collect_list("id").alias("ids")), "blocks")
    pairs = set_pairs(classes.select(F.col("set").alias("id"), "tags"), least).select(F.col("a").alias("s"), F.col("b").alias("t"), "shared")
    pairs = table(pairs.union(classes.select("set", "set", F.size("tags"))), "set-pairs")
    left, right = (blocks.select(F.col("set").alias(x), F.col("part").alias(f"p{x}"), F.col("ids").alias(f"i{x}")) for x in "st")
    met = table(pairs.join(left, "s").join(right, "t").where("s <> t or ps <= pt"), "block-pairs")
    rows = met.agg(F.sum(F.size("is").cast("double") * F.size("it"))).first()[0] or 0
    met = met.repartition(min(max(1, math.ceil(rows / task)), 20_000), "s", "ps", "t", "pt")
    # what a generated stage makes of a row is held until it goes on to the next one: the lambda ends the stage, so that is one id with a block, not a block with a block
    each = met.withColumn("x", F.explode(F.transform("is", lambda x: x))).withColumn("y", F.explode("it")).where("if(s = t and ps = pt, x < y, x <> y)")
    return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")


def tag_groups(notes: DataFrame, least: int = 2, order: str = "modified") -> DataFrame:
    """(leader, member) of groups of at least two notes (id, tags) that share ``least`` tags with their leader; the newest note leads.

    Notes with the same set of tags have the same leader, so leaders are sought among the distinct sets, each as its newest note.
    """
    sets = F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull()), lambda t: F.lower(t))))
    rows = notes.select("id", F.col(order).alias("at"), sets.alias("tags")).where(F.size("tags") >= least)
    newest = F.min(F.struct(F.col("at").isNull().alias("late"), (-F.col("at")).alias("back"), "id")).alias("first")
    classes = table(rows.groupBy("tags").agg(newest, F.count("*").alias("n")).select("tags", F.col("first.id").alias("id"), (-F.col("first.back")).alias("modified"), "n"), "classes")
    led = leader_groups(classes, set_pairs(classes, least))
    size = led.join(classes.select(F.col("id").alias("member"), "n"), "member").groupBy("leader").agg(F.sum("n").alias("size")).where("size >= 2")
    kept = led.join(size.select("leader"), "leader", "left_semi").join(classes.select(F.col("id").alias("member"), "tags"), "member").select("leader", "tags")
    return rows.join(kept, "tags").select("leader", F.col("id").alias("member"))


def equal_tag_sets(notes: DataFrame, least: int = 2) -> DataFrame:
    """Sets of tags that several notes share whole, with how many."""
    return notes.where(F.size("tags") >= least).groupBy(F.array_join(F.array_sort("tags"), ",").alias("tags")).agg(F.count("*").alias("n")).where("n >= 2")


def folder_groups(notes: DataFrame) -> DataFrame:
    return notes.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("n")).where("n >= 2")


def mark_contradicted(notes: DataFrame, near: DataFrame, text: Column, saved: Column, ceiling: float = 20.0) -> DataFrame:
    """(path, kind, confidence) of the notes that a saved text contradicts.

    ``near`` are the notes nearest to it (path, distance); the saved note itself is left out.
    """
    like = F.greatest(F.lit(0.0), 1 - F.col("distance") / ceiling)
    judged = near.where(F.col("path") != saved).select("path", contradiction(text, like).alias("c")).where("c is not null")
    return judged.join(notes.select("path"), "path", "left_semi").select("path", "c.kind", "c.confidence")
