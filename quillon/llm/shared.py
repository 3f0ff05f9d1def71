"""What several training-data operators use: tables in the shared folder, joins on hot keys, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.storage import shared_dir, shared_path, small_batches, table

__all__ = ["connected_components", "hot_keys", "join_hot", "shared_dir", "shared_path", "small_batches", "spread_join", "table"]


def hot_keys(many: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more rows than an even shuffle partition; so there are at most as many as partitions.

    The bound makes it safe to broadcast them, and one row for each.
    """
    parts = max(int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    counts = table(many.groupBy(*keys).agg(F.count("*").alias("n")), "key-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return table(counts.where(F.col("n") * parts > total).select(*keys), "hot-keys")


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """``many`` with the single row of ``one`` for its key: rows of ``hot`` keys stay where they are, others are shuffled."""
    cold = many.join(F.broadcast(hot), keys, "left_anti").join(one, keys)
    few = one.join(F.broadcast(hot), keys, "left_semi")  # at most a row for each hot key
    return cold.unionByName(many.join(F.broadcast(few), keys).select(*cold.columns))


def spread_join(many: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """``join_hot`` with the keys that are hot in ``many``; ``many`` is best a written table, as it is read twice."""
    return join_hot(many, one, keys, hot_keys(many, keys))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b); component is the smallest node reachable.

    Each round takes the smallest label among neighbours and then jumps to the label's own label, so the number of
    rounds follows the logarithm of the diameter. Labels live in shared tables; no group is gathered anywhere: nodes
    with many neighbours and labels of many nodes are joined where their rows lie.
    """
    both = table(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "edges",
    )
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    hubs = hot_keys(both, ["b"])
    for _ in range(max_rounds):
        near = (
            join_hot(both, labels.select(F.col("node").alias("b"), "component"), ["b"], hubs)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        step = table(labels.join(near, "node").select("node", F.least("component", "near").alias("next"), F.col("component").alias("old")), "step")
        # every label is a node, so it has a label itself
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = table(spread_join(step, jump, ["next"]).select("node", F.least("next", "far").alias("component"), "old"), "labels")
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError("connected components did not settle")
