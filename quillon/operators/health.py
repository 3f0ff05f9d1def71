"""Counts, trust and health of a collection, usage budgets, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import scores as S
from quillon.operators.filters import visible

KNOWLEDGE = ("decision", "research", "hub", "project")
DAY = 86400.0


def counts(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count_distinct("path").alias("n_notes"), F.count("*").alias("n_chunks"))


def trust_summary(roots: DataFrame) -> DataFrame:
    state = F.coalesce("trust_state", F.lit("unknown"))
    known = F.when(state.isin("validated", "stale", "contradicted"), state).otherwise("unknown")
    return roots.groupBy(known.alias("trust_state")).agg(F.count("*").alias("n"))


def breakdown(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def health(roots: DataFrame, vectors: DataFrame, as_of: float) -> DataFrame:
    """One row of figures over all notes, in one pass and a semi join."""
    embedded = vectors.select(F.col("note_id").alias("id")).distinct().withColumn("has", F.lit(True))
    r = roots.join(embedded, "id", "left")
    age = F.lit(float(as_of)) - F.col("modified")
    return r.agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce("has", F.lit(False))).alias("embedded"),
        F.count_if((F.col("access_count") == 0) & (age > 30 * DAY)).alias("stale"),
        F.count_if(age <= 7 * DAY).alias("recent"),
        F.count_if(F.col("content_type").isin(*KNOWLEDGE)).alias("knowledge"),
        F.count_if(F.col("access_count") > 0).alias("accessed"),
        F.count_if(F.col("suppressed")).alias("suppressed"),
        F.count_if(F.col("trust_state") == "validated").alias("validated"),
        F.count_if(F.col("trust_state") != "unknown").alias("tracked"),
        F.min("modified").alias("oldest"),
        F.max("modified").alias("newest"),
    )


def health_score(figures: DataFrame) -> DataFrame:
    """Five parts of 20: vectors, knowledge (ten times its share, 20 at most), freshness, use, trust."""
    share = lambda a: F.col(a) / F.greatest(F.col("total"), F.lit(1))
    parts = [
        20 * share("embedded"),
        F.least(F.lit(20.0), 10 * 20 * share("knowledge")),
        20 * (1 - share("stale")),
        20 * share("accessed"),
        F.when(F.col("tracked") == 0, 20.0).otherwise(20 * F.col("validated") / F.greatest("tracked", F.lit(1))),
    ]
    score = F.floor(sum(parts, F.lit(0.0)) + 0.5)
    return figures.select("total", score.cast("int").alias("score"), F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor").alias("label"))


#: Shares of use that are low and high for all, and very low for one hook of more than so many uses; tokens of a use that are many.
LOW, HIGH, VERY_LOW, SOME_USES, MANY_TOKENS = 0.3, 0.8, 0.2, 3, 500


def tool_score(figures: DataFrame) -> DataFrame:
    """Four parts of 25, cut to a whole number: vectors, knowledge (ten times its share, 25 at most), notes of the last week, use."""
    share = lambda a: F.col(a) / F.greatest(F.col("total"), F.lit(1))
    parts = 25 * share("embedded") + F.least(F.lit(25.0), 250 * share("knowledge")) + F.least(F.lit(25.0), 25 * share("recent")) + 25 * share("accessed")
    score = F.least(F.greatest(F.floor(parts), F.lit(0)), F.lit(100))
    return figures.select("total", score.cast("int").alias("score"))


def most_used(roots: DataFrame, n: int = 5) -> DataFrame:
    return roots.where(~F.coalesce("suppressed", F.lit(False))).orderBy(F.desc("access_count"), "path").limit(n)


def average_confidence(roots: DataFrame, confidence: Column) -> DataFrame:
    """One row: the mean of confidences above zero of notes that aren't suppressed."""
    return roots.where(~F.coalesce("suppressed", F.lit(False))).agg(F.round(F.avg(F.when(confidence > 0, confidence)), 6).alias("average"))


def budget_report(usage: DataFrame) -> DataFrame:
    """Injections of each hook and, with the hook ``null``, of all: how many were used, tokens, and what to do about it.

    ``advice`` is a list: "raise" the bar or "calibrated" for all, "adjust" and "shorten" for a hook.
    """
    sums = [F.count("*").alias("injections"), F.count_if("was_referenced").alias("referenced"), F.sum("estimated_tokens").alias("tokens")]
    each = usage.groupBy("hook_name").agg(*sums)
    every = each.agg(*[F.sum(c).alias(c) for c in ("injections", "referenced", "tokens")]).where("injections > 0").select(F.lit(None).cast("string").alias("hook_name"), "injections", "referenced", "tokens")
    g = each.withColumn("own", F.lit(True)).unionByName(every.withColumn("own", F.lit(False)))
    g = g.withColumns({"rate": F.col("referenced") / F.col("injections"), "average": F.floor(F.col("tokens") / F.col("injections"))}).withColumn("utilisation", S.round3(F.col("rate")))
    own = F.col("own")
    advice = F.array(
        F.when(~own & (F.col("rate") < LOW), "raise"), F.when(~own & (F.col("rate") > HIGH), "calibrated"),
        F.when(own & (F.col("utilisation") < VERY_LOW) & (F.col("injections") > SOME_USES), "adjust"), F.when(own & (F.col("average") > MANY_TOKENS), "shorten"),
    )
    return g.select("hook_name", "injections", "referenced", "tokens", "utilisation", "average", F.filter(advice, lambda x: x.isNotNull()).alias("advice"))


def last_sessions(usage: DataFrame, n: int) -> DataFrame:
    """All uses of the n sessions that ended last."""
    last = usage.groupBy("session_id").agg(F.max("ts").alias("ended")).orderBy(F.desc("ended"), "session_id").limit(n)
    return usage.join(last.select("session_id"), "session_id", "left_semi")


def overdue(roots: DataFrame, as_of: str) -> DataFrame:
    """Visible notes whose review date has come, with the days since (0 on the day itself)."""
    days = F.date_diff(F.lit(as_of).cast("date"), "review_by")
    return roots.where(visible()).withColumn("days_overdue", days).where("days_overdue >= 0")


def brief(roots: DataFrame, confidence: Column | None = None) -> DataFrame:
    """Sections of a briefing: newest, handoffs, decisions, most used, stale and, with a ``confidence``, the surest; ten or twenty rows each."""
    seen = roots.where(visible())

    def top(name: str, where: Column, n: int, *order) -> DataFrame:
        return seen.where(where).orderBy(*order, "path").limit(n).select(F.lit(name).alias("section"), "path")

    parts = [
        top("recent", F.lit(True), 20, F.desc("modified")),
        top("sessions", F.col("content_type").isin("handoff", "progress"), 10, F.desc("modified")),
        top("decisions", F.col("content_type") == "decision", 10, F.desc("modified")),
        top("accessed", F.col("access_count") > 0, 10, F.desc("access_count")),
        top("stale", F.col("trust_state") == "stale", 10, F.desc("modified")),
    ]
    if confidence is not None:
        parts.append(top("sure", confidence > 0.7, 10, confidence.desc(), F.desc("access_count")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def newest(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def evaluate(ranks: DataFrame, k: int = 5) -> DataFrame:
    """(category, n, recall, mrr) from the rank of each case's expected note (null: not found)."""
    hit = F.col("rank") <= k
    return ranks.groupBy("category").agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("recall"), F.round(F.avg(F.when(hit, 1 / F.col("rank")).otherwise(0.0)), 6).alias("mrr")
    )


def rate_limited(events: DataFrame, seconds: int = 60, most: int = 30) -> DataFrame:
    """Each event with how many its user had in the minute up to it, and whether that is too many."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(w)).withColumn("rejected", F.col("in_window") > most)


def index_age(roots: DataFrame, as_of: float) -> DataFrame:
    """One row: seconds since the newest note was changed; null for no notes."""
    return roots.agg((F.lit(float(as_of)) - F.max("modified")).alias("age_seconds"))


def status_rollup(roots: DataFrame, status: str = "status", content_type: str = "kaizen") -> DataFrame:
    """(status, n) of the notes of a type; a missing or empty status is open."""
    said = F.lower(F.btrim(status))
    return roots.where(F.col("content_type") == content_type).groupBy(F.when(F.coalesce(said, F.lit("")) == "", "open").otherwise(said).alias("status")).agg(F.count("*").alias("n"))


def recent_sessions(usage: DataFrame, limit: int = 10, user: str | None = None) -> DataFrame:
    """(session_id, started, ended, n) of the sessions that ended last; ``user`` compares without case."""
    rows = usage if user is None else usage.where(F.lower(F.col("user_id").cast("string")) == user.lower())
    ends = rows.groupBy("session_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))
    return ends.orderBy(F.desc("ended"), "session_id").limit(limit)


def hook_activity(usage: DataFrame, limit: int = 20, hook: str | None = None) -> DataFrame:
    """The newest uses, of one hook if named."""
    rows = usage if hook is None else usage.where(F.col("hook_name") == hook)
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def sample_facts(facts: DataFrame, limit: int = 5) -> DataFrame:
    """The newest facts: those of the largest ids."""
    return facts.drop("embedding").orderBy(F.desc("fact_id")).limit(limit)
