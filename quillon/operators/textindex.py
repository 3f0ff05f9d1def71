"""A stored inverted index of notes, kept up by differences.

A folder holds segments, each written once: ``postings`` (term, id, field, tf, length) in directories by a hash of the term, ``lengths``
(id, length) of the notes a segment brings, ``gone`` (id, length) of those it takes away, and ``commits`` with the segment's figures. A search
lists the buckets of its own terms, so Spark reads only those directories, and within them only row groups whose terms fit; a posting
carries its note's length, so nothing else is read for a ranking. Number of notes and mean length are sums over the commits.

A note is changed by one segment that has it in ``gone`` and in ``lengths``: postings of older segments don't count any more. A
segment counts once its commit is written, which is the last step; what a failed attempt left is written over by the next one.
``compact`` writes all live postings as one segment of a new index.

Null paths, titles and texts have no terms; notes without any count as notes of length 0. Of rows that repeat an id in one batch one is
taken. A term that most notes have is spread over tasks by ranges of (term, id). An empty index finds nothing.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.storage import table

FIELDS = ("path", "title", "text")
POSTINGS = "term string, id long, field string, tf long, length long"
#: What a task sorts or holds at most, in terms.
TASK_TERMS = 2_000_000
COMMIT = "seg int, notes long, terms long, buckets int, gone long"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def counted(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of notes; a text's terms are counted in its own row, so no task holds a table of terms."""
    once = notes.select("id", *FIELDS).dropDuplicates(["id"])
    cut = once.select(F.col("id").cast("long").alias("id"), *[F.sort_array(T.tokens(F.coalesce(f, F.lit("")))).alias(f) for f in FIELDS])
    cut = cut.withColumn("length", sum((F.size(f) for f in FIELDS), F.lit(0)).cast("long"))
    # equal terms lie side by side: where each run of them begins, and the end
    begins = {f"{f}_at": F.expr(f"filter(sequence(1, size({f}) + 1), i -> i = 1 or i > size({f}) or {f}[i - 1] <> {f}[i - 2])") for f in FIELDS}
    runs = [F.expr(f"transform(slice({f}_at, 1, size({f}_at) - 1), (i, k) -> struct({f}[i - 1] as term, '{f}' as field, cast({f}_at[k + 1] - i as bigint) as tf))") for f in FIELDS]
    postings = cut.withColumns(begins).select("id", "length", F.inline(F.flatten(F.array(*runs))))
    return postings.select("term", "id", "field", "tf", "length"), cut.select("id", "length")


def tasks(terms: float) -> int:
    """So many tasks that none has much more than ``TASK_TERMS`` of them."""
    return max(1, ceil(terms / TASK_TERMS))


class TextIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._commits: list[tuple[int, int, int, int, int]] | None = None

    # segments

    def commits(self) -> list[tuple[int, int, int, int, int]]:
        """(seg, notes, terms, buckets, gone) of each segment; as few rows as there were changes since the index was compacted.

        They are read once: an object sees the index as it was then, and its own changes.
        """
        if self._commits is None:
            try:
                self._commits = sorted(tuple(r) for r in self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits").collect())
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                self._commits = []
        return self._commits

    def _read(self, name: str, schema: str, segments: list[int]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], f"{schema}, seg int")
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{name}/seg={s}").withColumn("seg", F.lit(s)) for s in segments]
        return reduce(DataFrame.unionByName, parts)

    def _live(self, rows: DataFrame, commits: list) -> DataFrame:
        """Rows (id, seg) whose id no later segment took away."""
        taking = [c[0] for c in commits if c[4]]
        if not taking:
            return rows
        gone = self._read("gone", "id long, length long", taking).groupBy("id").agg(F.max("seg").alias("until"))
        return rows.join(gone, (rows["id"] == gone["id"]) & (rows["seg"] < gone["until"]), "left_anti")

    def lengths(self) -> DataFrame:
        """(id, length) of the notes that are in the index."""
        commits = self.commits()
        return self._live(self._read("lengths", "id long, length long", [c[0] for c in commits]), commits).select("id", "length")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """Live postings, of ``terms`` only if given: these alone are read then."""
        commits = self.commits()
        if not commits:
            return self.spark.createDataFrame([], POSTINGS)
        parts = []
        for seg, _, _, buckets, _ in commits:
            rows = self.spark.read.schema(f"{POSTINGS}, bucket int").option("basePath", f"{self.path}/postings/seg={seg}").parquet(f"{self.path}/postings/seg={seg}")
            if terms:  # hashes of literals are known when the query is planned, and so are the directories
                rows = rows.where(F.col("bucket").isin(*[bucket_of(F.lit(t), buckets) for t in terms]) & F.col("term").isin(terms))
            elif terms is not None:
                rows = rows.limit(0)
            parts.append(rows.drop("bucket").withColumn("seg", F.lit(seg)))
        return self._live(reduce(DataFrame.unionByName, parts), commits).drop("seg")

    def apply(self, add: DataFrame | None = None, remove: DataFrame | None = None) -> None:
        """One segment: the notes of ``add`` (id, path, title, text) come in place of what their ids had, the ids of ``remove`` go."""
        commits = self.commits()
        seg = commits[-1][0] + 1 if commits else 0
        at = lambda name: f"{self.path}/{name}/seg={seg}"
        old = self.lengths()
        ids = [df.select(F.col("id").cast("long").alias("id")) for df in (add, remove) if df is not None]
        touched = reduce(DataFrame.unionByName, ids).distinct()
        (old.join(touched, "id", "left_semi") if commits else old).write.mode("overwrite").parquet(at("gone"))
        postings, lengths = counted(add if add is not None else self.spark.createDataFrame([], "id long, path string, title string, text string"))
        lengths.write.mode("overwrite").parquet(at("lengths"))
        figures = lambda name: self.spark.read.schema("id long, length long").parquet(at(name)).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        came, went = figures("lengths"), figures("gone")
        dealt = postings.withColumn("bucket", bucket_of(F.col("term"), self.buckets)).repartitionByRange(tasks(came[1]), "bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
        commit = self.spark.range(1).select(*[F.lit(v).cast(t).alias(n) for n, t, v in (("seg", "int", seg), ("notes", "long", came[0] - went[0]), ("terms", "long", came[1] - went[1]), ("buckets", "int", self.buckets), ("gone", "long", went[0]))])
        commit.write.mode("append").parquet(f"{self.path}/commits")
        self._commits = None

    def refresh(self, old: DataFrame, new: DataFrame) -> None:
        """Follow a table from one snapshot to the next: only notes whose path, title or text differ are read anew."""
        mark = lambda df: df.select(F.col("id").cast("long").alias("id"), F.xxhash64(*FIELDS).alias("mark"))
        was, now = mark(old), mark(new)
        changed = now.join(was, ["id", "mark"], "left_anti").select("id")
        self.apply(new.join(changed, "id", "left_semi"), was.join(now, "id", "left_anti").select("id"))

    def compact(self, path: str, buckets: int | None = None) -> TextIndex:
        """The same index in one segment at another place."""
        other = TextIndex(self.spark, path, buckets or self.buckets)
        at = lambda name: f"{other.path}/{name}/seg=0"
        commits = self.commits()
        self.lengths().write.mode("overwrite").parquet(at("lengths"))
        rows = self.postings().withColumn("bucket", bucket_of(F.col("term"), other.buckets)).repartitionByRange(tasks(sum(c[2] for c in commits)), "bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
        figures = [F.lit(0), F.lit(sum(c[1] for c in commits)), F.lit(sum(c[2] for c in commits)), F.lit(other.buckets), F.lit(0)]
        self.spark.range(1).select(*[v.cast(t).alias(n) for v, n, t in zip(figures, ("seg", "notes", "terms", "buckets", "gone"), ("int", "long", "long", "int", "long"), strict=True)]).write.mode("overwrite").parquet(f"{other.path}/commits")
        return other

    # search

    def bm25(self, terms: list[str], limit: int = 30, k1: float = 1.2, b: float = 0.75, fields: tuple[str, ...] = FIELDS) -> DataFrame:
        """(id, rank) of the best notes by BM25 over the fields together, from the postings of ``terms`` alone."""
        terms = list(dict.fromkeys(terms))
        if not terms:
            return self.spark.createDataFrame([], "id long, rank double")
        commits = self.commits()
        n, total = sum(c[1] for c in commits), sum(c[2] for c in commits)
        hits = self.postings(terms)
        if fields != FIELDS:
            hits = hits.where(F.col("field").isin(*fields))
        per = hits.groupBy("id", "length").agg(*[F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(terms)])
        df = hits.groupBy("id").agg(*[F.max(F.when(F.col("term") == t, 1).otherwise(0)).alias(f"in{i}") for i, t in enumerate(terms)])
        df = df.agg(*[F.coalesce(F.sum(f"in{i}"), F.lit(0)).alias(f"df{i}") for i in range(len(terms))])
        mean, rank = max(total, 1) / max(n, 1), F.lit(0.0)
        for i in range(len(terms)):
            idf = F.greatest(F.log((F.lit(n) - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
            tf = F.col(f"tf{i}")
            rank = rank + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / mean))
        return per.crossJoin(F.broadcast(df)).select("id", F.round(rank, 6).alias("rank")).where("rank > 0").orderBy(F.desc("rank"), "id").limit(limit)  # one row

    def bm25_many(self, queries: DataFrame, limit: int = 30, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(query_id, id, rank, place): the best notes of each of many queries (query_id, terms) in one job, each as ``bm25`` would rank them.

        Postings meet the queries' distinct terms, and only directories of theirs are read; a term's number of notes is counted once for all queries. Common terms
        are joined by Spark's skew join. Queries without terms, and null ones, find nothing.
        """
        commits = self.commits()
        n, total = sum(c[1] for c in commits), sum(c[2] for c in commits)
        mean = max(total, 1) / max(n, 1)
        asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).where("term is not null")
        wanted = asked.select("term").distinct()
        own = self._live(reduce(DataFrame.unionByName, [self._met(c, wanted) for c in commits]), commits) if commits else self.postings().withColumn("seg", F.lit(0))
        tf = own.repartition(tasks(total), "term", "id").groupBy("term", "id", "length").agg(F.sum("tf").alias("tf"))
        tf = table(tf, "asked-postings")
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
        met = df.join(asked, "term").agg(F.sum("df")).first()[0] or 0
        parts = tf.join(df, "term").select("term", "id", part.alias("part")).join(asked, "term").select("query_id", "id", "part")
        scored = parts.repartition(tasks(met), "query_id", "id").groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("rank")).where("rank > 0")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank"), "id"))
        return scored.withColumn("place", place).where(F.col("place") <= limit)

    def _met(self, commit: tuple[int, int, int, int, int], wanted: DataFrame) -> DataFrame:
        """A segment's postings of terms in a table; the join on the bucket lets Spark prune directories when it runs."""
        seg, _, _, buckets, _ = commit
        folder = f"{self.path}/postings/seg={seg}"
        rows = self.spark.read.schema(f"{POSTINGS}, bucket int").option("basePath", folder).parquet(folder)
        return rows.join(wanted.withColumn("bucket", bucket_of(F.col("term"), buckets)), ["bucket", "term"], "left_semi").drop("bucket").withColumn("seg", F.lit(seg))
