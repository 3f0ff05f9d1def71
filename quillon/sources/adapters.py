"""Notes, vectors, facts, usage and graph views over the generic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.filters import visible
from quillon.operators.textindex import TextIndex
from quillon.storage import shared_path

TYPES = ("decision", "hub", "research", "project", "note", "handoff", "progress", "kaizen")
EPOCH = 1704067200  # 2024-01-01
AS_OF = 1719792000  # 2024-07-01


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each note, with its whole text, without what other tables say about it (see ``with_state``)."""
    i = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        i.alias("id"),
        F.concat(F.when(i % 97 == 0, "_PRIVATE/").otherwise(""), F.concat_ws("/", "source", "lang"), F.lit("/doc_"), i, F.lit(".md")).alias("path"),
        F.substring_index(F.translate(F.substring_index("text", " ", 8), "\n", " "), " ", 8).alias("title"),
        F.array("lang", "source").alias("tags"),
        F.col("lang").alias("domain"),
        F.col("source").alias("workstream"),
        F.concat(F.lit("agent"), i % 7).alias("agent"),
        F.element_at(F.array(*map(F.lit, TYPES)), (i % 8 + 1).cast("int")).alias("content_type"),
        (F.lit(float(EPOCH)) + 3600 * i).alias("modified"),
        F.when(i % 3 == 0, F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int"))).alias("review_by"),
        (i % 50 == 0).alias("suppressed"),
        "text",
    )


def with_state(rows: DataFrame, spark: SparkSession, sf_dir: str, few: bool = False) -> DataFrame:
    """``rows`` (of plain notes) with access_count and trust_state. ``few``: they are a top-k, so their ids are sent to where events and labels lie."""
    events, labels = read(spark, sf_dir, "events").select(F.col("user_id").alias("id")), read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    if few:
        ids = F.broadcast(rows.select("id"))  # a search's limit bounds them
        events, labels = events.join(ids, "id", "left_semi"), labels.join(ids, "id", "left_semi")
    uses = events.groupBy("id").agg(F.count("*").alias("access_count"))
    marks = labels.groupBy("id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    trust = F.when(F.col("toxic") == 1, "contradicted").when(F.col("quality") == 1, "validated").when(F.col("quality") == 0, "stale").otherwise("unknown")
    joined = rows.join(uses, "id", "left").join(marks, "id", "left")
    return joined.withColumns({"access_count": F.coalesce("access_count", F.lit(0)), "trust_state": trust}).drop("toxic", "quality")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with their state."""
    return with_state(plain_notes(spark, sf_dir), spark, sf_dir)


_INDEXES: dict[tuple[str, str], TextIndex] = {}


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of the visible notes; a session builds it once, in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        index = TextIndex(spark, shared_path(spark, "text-index"))
        index.apply(plain_notes(spark, sf_dir).where(visible()))
        _INDEXES[key] = index
    return _INDEXES[key]


def chunks(notes_: DataFrame) -> DataFrame:
    """Lines of each note as its chunks; chunk 0 is the root. Other columns are those of the note."""
    rest = [c for c in notes_.columns if c != "text"]
    return notes_.select(*rest, F.posexplode_outer(F.split("text", "\n")).alias("chunk_id", "text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("note_id"), "embedding")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as facts of the note of the same number, with the vector of that number."""
    vec = vectors(spark, sf_dir)
    docs = notes(spark, sf_dir).select("id", F.col("path").alias("source_path"))
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("fact_id"), F.col("text").alias("fact_text"))
    return items.join(docs, items["fact_id"] == docs["id"]).join(vec, items["fact_id"] == vec["note_id"]).select(
        "fact_id", "fact_text", "source_path", (0.5 + (F.col("fact_id") % 5) / 10).alias("confidence"), "embedding"
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as uses of notes by hooks; a session is a user's run of events without a gap of 30 minutes."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    new = F.when(gap.isNull() | (gap > 30 * 60 * 1_000_000), 1).otherwise(0)
    return e.withColumn("n", F.sum(new).over(w)).select(
        "event_id", F.concat_ws("-", "user_id", "n").alias("session_id"), "user_id", "ts",
        F.col("event_type").alias("hook_name"), F.floor("value").cast("long").alias("estimated_tokens"),
        (F.col("event_type") == "purchase").alias("was_referenced"), (F.col("event_id") % 1000).alias("note_id"),
    )


def graph_nodes(notes_: DataFrame) -> DataFrame:
    """Note, agent and tag nodes with ids that follow from type and name."""
    note = notes_.select(F.lit("note").alias("type"), F.col("path").alias("name"), F.col("id").alias("note_id"))
    agent = notes_.select(F.lit("agent").alias("type"), F.col("agent").alias("name")).distinct().withColumn("note_id", F.lit(None).cast("long"))
    tag = notes_.select(F.explode("tags").alias("tag")).select(F.lit("entity").alias("type"), F.concat(F.lit("tag:"), F.lower("tag")).alias("name")).distinct()
    return note.unionByName(agent).unionByName(tag.withColumn("note_id", F.lit(None).cast("long")))


def note_edges(notes_: DataFrame, n: int) -> DataFrame:
    """Note i refers to note (7 i + 3) mod n, with weight ((i mod 10) + 1) / 10."""
    return notes_.select(F.col("id").alias("src"), ((7 * F.col("id") + 3) % n).alias("dst"), F.lit("references").alias("rel"), ((F.col("id") % 10 + 1) / 10).alias("weight"))
