"""Shards of bounded size by extendible hashing (operator 8).

The directory is indexed by the first bits of a 64-bit hash. All buckets begin at depth 0; only a bucket whose documents
exceed the byte limit is split on one more bit, until every bucket fits. The tree is found on a histogram: bytes are
summed by the first ``bits`` bits, with a partial aggregate, and each prefix's bytes at all shallower depths follow from
the histogram. Where a bucket at the deepest prefix is still too large, the next ``STEP`` bits of that bucket alone are
looked at, so the work follows the oversized buckets.

The hash covers the id and the text, so rows that share an id can be split. Rows that are equal in both can't be told
apart by any hash: where such a group alone exceeds the limit at 64 bits, its rows are dealt into numbered overflow
shards of the same bucket. A row that alone exceeds the limit has a shard to itself.

Null texts count no bytes; null ids are hashed as nulls. An empty table has an empty directory. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.llm.shared import table

LIMIT, STEP = 16 << 20, 12
#: Shards that a task writes, on average, where there are more than partitions.
SHARDS_OF_A_TASK = 2


def _prefix(bits: int) -> str:
    return f"shiftrightunsigned(hash, {64 - bits})" if bits else "0L"


def directory(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(depth, prefix, bytes, rows, overflow) of each bucket, from (hash, bytes) of each row.

    overflow is true only for a bucket of 64 bits that is still too large.
    """
    spark = sizes.sparkSession
    found, done = None, 0
    open_rows = sizes
    while True:
        bits = min(64, done + STEP)
        histogram = table(open_rows.groupBy(F.expr(_prefix(bits)).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")), "histogram")
        # depth by depth: what a bucket at each depth would hold; the first that fits is a bucket of the directory
        depths = F.sequence(F.lit(done + 1 if done else 0), F.lit(bits))
        nodes = (
            histogram.withColumn("depth", F.explode(depths))
            .groupBy("depth", F.expr(f"shiftrightunsigned(prefix, {bits} - depth)").alias("node"))
            .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        )
        fits = (F.col("bytes") <= limit) | (F.col("rows") == 1)
        nodes = nodes.withColumn("fits", fits)
        parent = nodes.where("not fits").select((F.col("depth") + 1).alias("depth"), F.col("node").alias("up"))
        # a bucket that fits under one that doesn't (or the root of all)
        leaves = nodes.where("fits").withColumn("up", F.expr("shiftright(node, 1)")).join(parent, ["depth", "up"], "left_semi")
        root = nodes.where(f"fits and depth = {done + 1 if done else 0}")
        if done:
            # below an open bucket of the round before, the first depth's parents are open by definition
            leaves = leaves.unionByName(root.withColumn("up", F.expr("shiftright(node, 1)")))
        else:
            leaves = leaves.unionByName(root.withColumn("up", F.lit(0).cast("long")))
        leaves = leaves.select("depth", F.col("node").alias("prefix"), "bytes", "rows", F.lit(False).alias("overflow"))
        rest = table(nodes.where(f"not fits and depth = {bits}").select(F.col("node").alias("prefix"), "bytes", "rows"), "open")
        if bits == 64:
            leaves = leaves.unionByName(rest.select(F.lit(64).alias("depth"), "prefix", "bytes", "rows", F.lit(True).alias("overflow")))
        leaves = table(leaves, "leaves")
        found = leaves if found is None else found.unionByName(leaves)
        if bits == 64 or rest.limit(1).count() == 0:
            return found
        open_rows = table(open_rows.join(rest.select("prefix"), F.expr(_prefix(bits)) == F.col("prefix"), "left_semi"), "open_rows")
        done = bits


def _dealt(docs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(row, hash, bytes, depth, prefix, overflow, part, shard, shard_bytes) of each row, and the directory.

    ``row`` is a struct of all columns of ``docs``, so no name of theirs can clash with one of ours.
    """
    rows = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        F.xxhash64(F.col("doc_id").cast("long"), "text").alias("hash"),
    )
    # only sizes and hashes are grouped
    tree = table(directory(table(rows.select("hash", "bytes"), "sizes"), limit), "directory")
    # a row meets the buckets that share its first bits, as many as tell nearly all buckets apart, and its own bits choose one; so no text is copied for the lookup,
    # and it is shuffled for it only where the directory is too large to be sent to all tasks
    figures = tree.agg(F.max("depth").alias("depth"), F.count("*").alias("n")).first()
    bits = min(figures.depth or 0, max(figures.n, 1).bit_length() + 2)
    wider = F.expr(f"sequence(shiftleft(prefix, {bits} - depth), shiftleft(prefix + 1, {bits} - depth) - 1)")
    entries = tree.select(
        "depth", "prefix", F.col("bytes").alias("shard_bytes"), "overflow", F.explode(F.when(F.col("depth") >= bits, F.array(F.expr(f"shiftrightunsigned(prefix, depth - {bits})"))).otherwise(wider)).alias("first"),
    )
    own = (F.col("depth") == 0) | (F.expr("shiftrightunsigned(hash, 64 - depth)") == F.col("prefix"))
    placed = rows.withColumn("first", F.expr(_prefix(bits))).join(entries, "first").where(own).drop("first")
    # buckets of 64 bits that are too large: rows equal in id and text, all of one size; as many to a part as fit
    over = table(placed.where("overflow").withColumn("number", F.monotonically_increasing_id()), "overflow")
    over = over.withColumn("file", F.shiftright("number", 33))
    files = over.groupBy("prefix", "file").agg(F.count("*").alias("n"))
    files = files.select("prefix", "file", (F.sum("n").over(Window.partitionBy("prefix").orderBy("file")) - F.col("n")).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("prefix", "file").orderBy("number")) - 1
    fit = F.greatest(F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1))), F.lit(1))
    over = over.withColumn("place", place).join(files, ["prefix", "file"]).withColumn("part", F.floor((F.col("place") + F.col("ahead")) / fit))
    size = F.least(fit, F.round(F.col("shard_bytes") / F.greatest("bytes", F.lit(1))) - F.col("part") * fit) * F.col("bytes")
    over = over.withColumn("shard_bytes", size.cast("long"))
    plain = placed.where("not overflow").withColumn("part", F.lit(0).cast("long"))
    names = ["row", "hash", "bytes", "depth", "prefix", "overflow", "part", "shard_bytes"]
    out = plain.select(*names).unionByName(over.select(*names))
    name = F.concat(
        F.lit("shard-"),
        F.when(F.col("depth") == 0, "").otherwise(F.expr("substring(lpad(bin(prefix), 64, '0'), 65 - depth, depth)")),
        F.when(F.col("overflow"), F.concat(F.lit("-"), F.col("part"))).otherwise(""),
    )
    return out.withColumn("shard", name), tree


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, bytes, depth, prefix, overflow_part, shard, shard_bytes) of each row; shard names the bucket's bits."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt, _ = _dealt(narrow, limit)
    return dealt.select(F.col("row.doc_id").alias("doc_id"), "bytes", "depth", "prefix", F.col("part").alias("overflow_part"), "shard", "shard_bytes")


def global_depth(tree: DataFrame) -> int:
    """How many bits index the directory."""
    return int(tree.agg(F.max("depth")).first()[0] or 0)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Write each row of ``docs``, with all its columns, under a folder of its shard in ``path``; returns the directory.

    A shard is one file, or a few if a task holds it in parts. The folders' column is called ``shard``; if ``docs`` has a column of that name, underscores are
    added to it. Rows of equal id and text that exceed a shard together are dealt into parts by the rule of ``assign``.
    """
    dealt, tree = _dealt(docs, limit)
    folder = "shard"
    while folder in {c.lower() for c in docs.columns}:
        folder += "_"
    # a shard is bounded, so one task can hold it, and a few on average
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), tree.count() // SHARDS_OF_A_TASK)
    dealt.select("row.*", F.col("shard").alias(folder)).repartition(parts, F.col(folder)).write.partitionBy(folder).parquet(path)
    return tree


def read_shards(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows written by ``write_shards``; ``schema`` has the columns of the documents and the folders' column."""
    return spark.read.schema(schema).parquet(path)
