"""What a session leaves for the next one: handoffs from its messages, recovery from the best source there is, what is shown at a start.

Messages are (session_id, turn, role, text). Each part of a handoff is found by its own small aggregation over sessions, with bounded
lists, so a long session is no single task's burden. Null and empty texts say nothing. Order is by turn, then by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths and numbers of a handoff, and how next steps are told.
TOPIC, TITLE, STEP, KEY = 150, 180, 150, 50
TOPICS, STEPS, FILES, TOOLS, LAST = 8, 5, 20, 10, 3
MARKERS = (
    "next step", "next:", "todo:", "todo ", "remaining:", "still need", "left to do", "not yet", "pending:", "should be", "ready to", "needs to", "want to",
    "follow up", "follow-up",
)
LEAST_MESSAGES = 3
#: Files that say nothing about a session.
ARTIFACTS = (".tmp", ".temp", ".swp", ".swo", ".ds_store", ".log", ".orig", ".bak", "~")
NO_FILES, NO_FOLDERS = ("/dev/null", "dev/null", "nul"), ("tmp/", "temp/", "/tmp/", ".git/")
#: How much each source of a recovery tells, the budgets in characters of what is shown at a start, days and hours that count as recent.
SOURCES = {"handoff": 1.0, "instance": 0.4, "session_index": 0.3}
BUDGETS = {"handoff": 4000, "pinned": 2000, "decisions": 3000, "stale": 1000}
ALL, DAYS, HOURS = 8000, 7, 12


def first_words(text: Column, most: int) -> Column:
    """The first line, cut behind a sentence's end in its second half, else at a word's end, if it is longer than ``most``."""
    space = F.lit(" \t\r\n")
    line = F.btrim(F.substring_index(F.btrim(text, space), "\n", 1), space)
    head = F.left(line, F.lit(most))
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    word = F.regexp_extract(head, r"(?s)^(.+)[ \t]", 1)
    return F.when(F.length(line) <= most, line).when(F.length(sentence) > most // 2, F.btrim(sentence, space)).when(word != "", F.btrim(word, space)).otherwise(F.btrim(head, space))


def meaningful(path: Column) -> Column:
    """Whether a changed file says something about a session."""
    low = F.lower(path)
    bad = (F.coalesce(path, F.lit("")) == "") | low.isin(*NO_FILES)
    for x in NO_FOLDERS:
        bad = bad | low.startswith(x)
    for x in ARTIFACTS:
        bad = bad | low.endswith(x)
    return ~bad


def _first_of_each(rows: DataFrame, key: Column, value: str, order: list[str], most: int | None = None) -> DataFrame:
    """(session_id, values): values in order, of equal keys the first, ``most`` at most."""
    once = rows.withColumn("_key", key).groupBy("session_id", "_key").agg(F.min(F.struct(*order, value)).alias("x"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(*[f"x.{o}" for o in order], "_key"))
    once = once.withColumn("n", place)
    kept = once.where(F.col("n") <= most) if most else once
    return kept.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", f"x.{value}"))), lambda s: s[value]).alias("values"))


def topics(messages: DataFrame) -> DataFrame:
    said = messages.where("role = 'user'").withColumn("topic", first_words(F.col("text"), TOPIC)).where("topic <> ''")
    return _first_of_each(said, F.left("topic", F.lit(KEY)), "topic", ["turn"], TOPICS)


def next_steps(messages: DataFrame) -> DataFrame:
    """Bullets and numbered lines of the last three answers that speak of what is to come."""
    last = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))
    answers = messages.where("role = 'assistant'").withColumn("n", last).where(F.col("n") <= LAST)
    lines = answers.select("session_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "step")).withColumn("step", F.btrim("step", F.lit(" \t\r")))
    ahead = F.lit(False)
    for m in MARKERS:
        ahead = ahead | F.lower("step").contains(m)
    steps = lines.where(F.col("step").rlike(r"^([-*] |[1-9]\..)") & ahead).withColumn("step", first_words(F.col("step"), STEP))
    return _first_of_each(steps, F.left("step", F.lit(KEY)), "step", ["turn", "line"], STEPS)


def saved(calls: DataFrame, tool: str, field: str) -> DataFrame:
    """What calls (session_id, turn, tool, input) of a tool, by the last part of its name, were given; whatever its case once."""
    own = calls.where(F.lower(F.btrim("tool")).rlike(rf"(^|[:_]){tool}$")).withColumn("value", first_words(F.col("input").getItem(field), TITLE)).where("value <> ''")
    return _first_of_each(own, F.lower("value"), "value", ["turn"])


def handoffs(messages: DataFrame, calls: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """A row for each session of three messages at least: (session_id, n_user, n_assistant, n_calls, topics, decisions, notes, files, more_files, tools, next_steps).

    ``calls`` (session_id, turn, tool, input) are the tools that were used, ``files`` (session_id, turn, path) those that were changed.
    """
    spark = messages.sparkSession
    calls = calls if calls is not None else spark.createDataFrame([], "session_id string, turn long, tool string, input map<string,string>").withColumn("session_id", F.col("session_id").cast(dict(messages.dtypes)["session_id"]))
    changed = (files if files is not None else calls.select("session_id", "turn", F.col("tool").alias("path")).where(F.lit(False))).where(meaningful(F.col("path")))
    out = messages.groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.count("*").alias("n")).where(F.col("n") >= LEAST_MESSAGES).drop("n")
    used = calls.groupBy("session_id", "tool").agg(F.count("*").alias("c"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("c"), "tool"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= TOOLS, F.struct("n", "tool", "c")))), lambda t: F.concat(t["tool"], F.lit(" ("), t["c"].cast("string"), F.lit(")")))
    tools = used.withColumn("n", place).groupBy("session_id").agg(F.sum("c").alias("n_calls"), F.array_join(listed, ", ").alias("tools"))
    all_files = _first_of_each(changed, F.lower("path"), "path", ["turn"], FILES)
    counted = changed.groupBy("session_id").agg(F.greatest(F.count_distinct(F.lower("path")) - FILES, F.lit(0)).alias("more_files"))
    parts = {"topics": topics(messages), "decisions": saved(calls, "save_decision", "title"), "notes": saved(calls, "save_note", "path"), "files": all_files, "next_steps": next_steps(messages)}
    none = F.array().cast("array<string>")
    for name, df in parts.items():
        out = out.join(df.withColumnRenamed("values", name), "session_id", "left").withColumn(name, F.coalesce(name, none))
    out = out.join(tools, "session_id", "left").join(counted, "session_id", "left")
    return out.select("session_id", "n_user", "n_assistant", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), "topics", "decisions", "notes", "files", F.coalesce("more_files", F.lit(0)).alias("more_files"), F.coalesce("tools", F.lit("")).alias("tools"), "next_steps")


def recover(current: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """(session_id, recovered_from, source, completeness, context) for each current session (session_id, owner): the owner's best source of an earlier session.

    ``sources`` are tables (session_id, owner, at, text) by name: a handoff comes before an instance, that before the index; of one kind the newest, and never the
    session itself. Sources without text don't count; without any the source is "none". Of each owner and kind only the two newest are looked at.
    """
    every = None
    for rank, (name, sure) in enumerate(SOURCES.items()):
        if name in sources:
            part = sources[name].where("text is not null and trim(text) <> ''").select(F.col("session_id").alias("recovered_from"), "owner", "at", "text", F.lit(rank).alias("rank"), F.lit(name).alias("source"), F.lit(sure).alias("completeness"))
            every = part if every is None else every.unionByName(part)
    newest = F.row_number().over(Window.partitionBy("owner", "source").orderBy(F.desc("at"), F.desc("recovered_from")))
    once = every.groupBy("owner", "source", "rank", "completeness", "recovered_from").agg(F.max(F.struct("at", "text")).alias("x")).select("*", "x.at", "x.text").drop("x")
    two = once.withColumn("n", newest).where("n <= 2")
    met = current.select("session_id", "owner").join(two, "owner", "left").withColumn("other", ~F.col("recovered_from").eqNullSafe(F.col("session_id")) & F.col("source").isNotNull())
    best = met.groupBy("session_id").agg(F.min(F.when(F.col("other"), F.struct("rank", "n", "recovered_from", "source", "completeness", F.left("text", F.lit(BUDGETS["handoff"])).alias("context")))).alias("b"))
    return best.select("session_id", "b.recovered_from", F.coalesce("b.source", F.lit("none")).alias("source"), F.coalesce("b.completeness", F.lit(0.0)).alias("completeness"), "b.context")


def recent_entries(logs: DataFrame, as_of: str, days: int = DAYS) -> DataFrame:
    """(path, place, day, entry) of the dated entries of decision logs (path, text) that are less than ``days`` old.

    An entry goes from a heading of the second or third level with a date to the next such one; headings without a date belong to it.
    """
    entries = F.filter(F.split("text", r"(?m)^(?=[ \t]*###? +\d{4}-\d{2}-\d{2})"), lambda e: F.btrim(e).rlike(r"^###? +\d{4}-\d{2}-\d{2}"))
    rows = logs.select("path", F.posexplode(entries).alias("place", "entry"))
    day = F.try_to_date(F.regexp_extract("entry", r"###? +(\d{4}-\d{2}-\d{2})", 1))
    return rows.select("path", "place", day.alias("day"), F.rtrim("entry", F.lit(" \t\r\n")).alias("entry")).where(F.date_diff(F.lit(as_of).cast("date"), "day") < days)


def active_instances(instances: DataFrame, as_of: Column, session_id: str | None = None, hours: int = HOURS) -> DataFrame:
    """Instances (session_id, updated, ...) of other sessions that were updated in the last hours."""
    other = instances if session_id is None else instances.where(~F.col("session_id").eqNullSafe(session_id))
    return other.where(F.unix_timestamp("updated") >= F.unix_timestamp(as_of) - hours * 3600)


def bootstrap(sections: DataFrame) -> DataFrame:
    """(session_id, shown): what is shown at a session's start, of sections (session_id, kind, text).

    Kinds come in the order of their budgets, each cut to its own, those without text left out, all together cut to the whole budget.
    """
    order = F.element_at(F.create_map(*[x for i, k in enumerate(BUDGETS) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    size = F.element_at(F.create_map(*[x for k, n in BUDGETS.items() for x in (F.lit(k), F.lit(n))]), F.col("kind"))
    known = sections.where(F.col("kind").isin(*BUDGETS) & (F.trim("text") != "")).select("session_id", order.alias("place"), F.left("text", size).alias("text"))
    once = known.groupBy("session_id", "place").agg(F.min("text").alias("text")).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("x"))  # one of each kind
    return once.select("session_id", F.left(F.array_join(F.transform("x", lambda t: t["text"]), "\n\n"), F.lit(ALL)).alias("shown"))
