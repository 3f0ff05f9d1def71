"""Ranking of results, which are as few as a search's limit allows (a hundred or so).

Title overlap matches words greedily and one by one, which no built-in expression does; it runs as a pandas UDF over
the few results. Everything else is columns.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillon.functions import scores as S
from quillon.functions.snippets import truncate

PRIORITY = ("handoff", "decision", "research", "hub")
HIGH, SOME, PATH_ONLY = 0.199, 0.10, 0.25
_WORDS = re.compile(r"[0-9A-Za-z_]+")


def one_edit(a: str, b: str) -> bool:
    """Exactly one edit apart, one of them having seven letters at least."""
    if max(len(a), len(b)) < 7 or abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


def same_stem(a: str, b: str) -> bool:
    short = min(len(a), len(b))
    need = max(short - 1, 5)
    return short >= 5 and abs(len(a) - len(b)) <= 3 and a[:need] == b[:need]


def overlap(terms: list[str], title: str, path: str) -> float:
    """Share of the query's terms that match, times the share of the title's and path's words that are matched.

    A term takes at most one word, in this order: equal, with an s more, with an s less, one edit apart or of one stem
    (the first of these by alphabet).
    """
    source = [title or "", *re.sub(r"\.md$", "", path or "").split("/")]
    free = {part.lower() for s in source for w in _WORDS.findall(s) for part in w.split("_") if len(part) >= 2}
    total = len(free)
    asked = [p.lower() for t in terms for p in (t.split("-") if "-" in t else [t]) if "-" not in t or len(p) >= 2]
    if not total or not asked:
        return 0.0
    hits = 0
    for t in asked:
        options = [t, t + "s", t[:-1] if len(t) > 2 and t.endswith("s") else ""]
        found = next((o for o in options if o and o in free), None)
        if found is None:
            found = next((w for w in sorted(free) if one_edit(t, w) or same_stem(t, w)), None)
        if found is not None:
            free.discard(found)
            hits += 1
    share = hits / len(asked)
    return 0.0 if not hits or total <= 2 and share < 0.30 else share * hits / total


def plain_overlap(terms: list[str], with_path: bool):
    """The overlap with the title's words, or with those of title and path."""

    @F.pandas_udf(DoubleType())
    def run(title: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([overlap(terms, t, p if with_path else "") for t, p in zip(title, path, strict=True)], dtype="float64")

    return run


def title_overlap(terms: list[str]):
    @F.pandas_udf(DoubleType())
    def run(title: pd.Series, path: pd.Series) -> pd.Series:
        alone = [overlap(terms, t, "") for t in title]
        # a match in the path alone counts half, if it is good
        return pd.Series([a if a > 0 else (b / 2 if (b := overlap(terms, t, p)) >= PATH_ONLY else 0.0) for a, t, p in zip(alone, title, path, strict=True)])

    return run


def three_tiers(results: DataFrame, overlap_: str = "overlap") -> list[Column]:
    o = F.col(overlap_)
    high, some = o >= HIGH, o >= SOME
    rest = some & ~high
    return [
        F.desc(high), F.desc(F.when(high, o).otherwise(0.0)), F.desc(rest), F.desc(F.when(rest, F.col("content_type").isin(*PRIORITY)).otherwise(False)),
        F.desc("score"), F.asc("path"),
    ]


def drop_versions(results: DataFrame) -> DataFrame:
    """Of results of one folder whose file names begin with one another, the one of the larger overlap, then score, stays."""
    folder, name = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.md$", "")
    r = results.select("path", "overlap", "score", folder.alias("folder"), name.alias("name"))
    a, b = r.alias("a"), r.alias("b")
    near = F.col("a.name").startswith(F.col("b.name")) | F.col("b.name").startswith(F.col("a.name"))
    key = lambda x: F.struct(F.col(f"{x}.overlap"), F.col(f"{x}.score"), F.col(f"{x}.path"))
    worse = a.join(b, (F.col("a.folder") == F.col("b.folder")) & (F.col("a.path") != F.col("b.path")) & near & (key("a") < key("b")))
    return results.join(worse.select(F.col("a.path").alias("path")).distinct(), "path", "left_anti")


def rank(results: DataFrame, terms: list[str], noise: list[str] | None = None) -> DataFrame:
    """Overlap, noise filter (unless nothing would be left), versions, three tiers; the place is the column place."""
    scored = results.withColumn("overlap", title_overlap(terms)("title", "path"))
    if noise:
        bad = F.lit(False)
        for n in noise:
            bad = bad | F.col("path").contains(n)
        clean = scored.withColumn("bad", bad)
        left = clean.agg(F.count_if(~F.col("bad")).alias("left"))
        scored = clean.crossJoin(F.broadcast(left)).where("not bad or left = 0").drop("bad", "left")  # one row
    kept = drop_versions(scored)
    return kept.withColumn("place", F.row_number().over(Window.orderBy(*three_tiers(kept))))


#: Fixed value: what a stale note's confidence is multiplied with.
STALE = 0.75


def type_boosts(results: DataFrame, boosts: dict[str, float], stale_wanted: bool = False) -> DataFrame:
    """Scores times the factors of their types, one at most; where stale notes are asked for, theirs without what being stale took."""
    boosted = S.round3(F.least(F.lit(1.0), F.col("score") * S.lookup(F.lower("content_type"), boosts, 1.0)))
    if stale_wanted:
        boosted = F.when(F.lower("trust_state") == "stale", S.round3(F.least(F.lit(1.0), boosted / STALE))).otherwise(boosted)
    return results.withColumn("score", boosted)


def keyword_title_score(title: Column, text: Column, terms: list[str], query: str) -> Column:
    """0.95 for a title that is a term, 0.5 to 0.85 by matches otherwise; more if the whole query occurs."""
    low = F.lower(title)
    m = sum((F.when(low.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    base = F.when(low.isin(*terms), 0.95).when(m == 0, 0.5).otherwise(S.round3(0.5 + 0.35 * m / len(terms)))
    q = query.lower()
    return F.when(F.lower(text).contains(q), F.least(F.lit(1.0), base * 1.5)).when(low.contains(q), F.least(F.lit(1.0), base * 1.2)).otherwise(base)


#: Fixed values of packing: results at most (and for unclear queries), share of the leader's overlap below which results go, and tokens for all and for one note.
MOST, MOST_UNCLEAR, GAP, BUDGET, PER_NOTE = 3, 2, 0.65, 800, 400


def pack_context(results: DataFrame, key: list[str], budget: int = BUDGET, per_note: int = PER_NOTE, most: int = MOST, recent: bool = False) -> DataFrame:
    """(key, place, path, entry, tokens) of what is shown of ranked results (key, place, path, title, content_type, score, overlap, trust_state, text, boosted).

    An unclear query (the first result's overlap is not high) shows two at most. Behind a leader of some overlap the first result without any ends the list;
    behind one of high overlap the first with less than ``GAP`` of it. Then a greedy fold: a note that doesn't fit into what is left of the budget is passed
    over, and smaller ones behind it may still fit. ``boosted`` says that an overlap came from a content match, and so is none here. Of each query
    only ``most`` rows are gathered.
    """
    few = results.where(F.col("place") <= most)
    w = Window.partitionBy(*key)
    own = F.when(F.coalesce("boosted", F.lit(False)), 0.0).otherwise(F.col("overlap"))
    lead = F.first(own).over(w.orderBy("place"))
    few = few.withColumns({"lead": lead, "lead_boosted": F.first(F.coalesce("boosted", F.lit(False))).over(w.orderBy("place"))})
    few = few.where(F.lit(recent) | (F.col("lead") >= HIGH) | (F.col("place") <= MOST_UNCLEAR))
    some, high = (F.col("lead") > 0) & (F.col("lead") < HIGH), (F.col("lead") >= HIGH) & ~F.col("lead_boosted")
    ends = (some & (F.col("overlap") <= 0)) | (high & (F.col("overlap") < F.greatest(F.col("lead") * GAP, F.lit(SOME))))
    few = few.withColumn("cut", F.min(F.when(ends & (F.col("place") > 1), F.col("place"))).over(w)).where("cut is null or place < cut")
    trust = F.when(F.col("trust_state").isin("stale", "contradicted"), F.concat(F.lit(", trust: "), "trust_state")).otherwise("")
    head = F.concat(F.lit("**"), "title", F.lit("** ("), "content_type", F.lit(", score: "), F.format_string("%.3f", F.col("score").cast("double")), trust, F.lit(")\n"), "path")
    body = truncate(F.coalesce("text", F.lit("")), per_note * 4)
    entry = F.when(body == "", head).otherwise(F.concat(head, F.lit("\n"), body))
    listed = few.withColumn("entry", entry).withColumn("tokens", F.floor(F.octet_length("entry") / 4).cast("int")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "path", "entry", "tokens"))).alias("x"))

    def fold(state: Column, x: Column) -> Column:
        fits = state["used"] + x["tokens"] <= budget
        return F.struct((state["used"] + F.when(fits, x["tokens"]).otherwise(0)).alias("used"), F.when(fits, F.array_append(state["kept"], x)).otherwise(state["kept"]).alias("kept"))

    start = F.struct(F.lit(0).alias("used"), F.slice("x", F.lit(1), F.lit(0)).alias("kept"))
    return listed.select(*key, F.inline(F.aggregate("x", start, fold, lambda s: s["kept"])))
