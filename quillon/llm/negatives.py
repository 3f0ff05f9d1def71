"""Hard negatives: for an anchor and each of its positives the best rows of other labels within a band of scores.

Anchors are a stated set of queries (ids divisible by a number), scored against all rows in blocks. In a block each anchor's
scores are computed as whole numbers and lexsorted by score and id; a binary search finds where a positive's upper limit
lies, and the entries from there on that are above its lower limit are read. Blocks hold a bounded number of rows and
anchors, whatever a label's share of all rows; what leaves a block are a few entries for each anchor or pair, which a
window over that key merges. Two passes: positives have to be known over all rows before negatives can be sought.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Of rows that repeat an id the one with the
smallest (label, vector) counts. Shorter vectors are scored as if they ended in zeros. Ties go to the smaller id. Anchors without
positives, and positives without negatives in the band, have no row; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import table
from quillon.llm.vectors import finite, matrix, products, scaled

#: Rows and anchors of a block, at most on average; anchors scored at once.
ROWS, ANCHORS, AT_ONCE = 8192, 8192, 64


def by_score(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places in the order of falling score, then rising id."""
    return np.lexsort((ids, -scores))


def _scores(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(anchor's place, its scores with all rows), some anchors at a time."""
    a, b = matrix(anchors["v"]), matrix(rows["v"])
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    for i in range(0, len(a), AT_ONCE):
        for k, s in enumerate(products(a[i : i + AT_ONCE], b)):
            yield i + k, s


def best_positives(anchors: pa.Table, rows: pa.Table, most: int) -> pa.Table:
    """(anchor_id, other, score): each anchor's best ``most`` other rows of its label among ``rows``."""
    own, label = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    out: list[tuple[np.ndarray, ...]] = []
    for i, s in _scores(anchors, rows):
        same = np.flatnonzero((labels == label[i]) & (ids != own[i]))
        first = same[by_score(s[same], ids[same])[:most]]
        out.append((np.full(len(first), own[i]), ids[first], s[first]))
    return _table(out, ("anchor_id", "other", "score"))


def best_negatives(anchors: pa.Table, rows: pa.Table, most: int, low: int, high: int) -> pa.Table:
    """(anchor_id, positive_id, positive_score, other, score): the first ``most`` rows of other labels with ``low`` to ``high`` percent of a positive's score."""
    own, label = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    positives = anchors["positives"].combine_chunks()
    begin = positives.offsets.to_numpy()
    flat = positives.flatten()
    p_id, p_score = flat.field("other").to_numpy(), flat.field("score").to_numpy()
    out: list[tuple[np.ndarray, ...]] = []
    for i, s in _scores(anchors, rows):
        different = np.flatnonzero(labels != label[i])
        order = different[by_score(s[different], ids[different])]
        falling = -s[order]
        for p in range(begin[i], begin[i + 1]):
            least, largest = -((-low * int(p_score[p])) // 100), high * int(p_score[p]) // 100
            at = int(np.searchsorted(falling, -largest, "left"))
            took = order[at : at + most]
            took = took[s[took] >= least]
            n = len(took)
            out.append((np.full(n, own[i]), np.full(n, p_id[p]), np.full(n, p_score[p]), ids[took], s[took]))
    return _table(out, ("anchor_id", "positive_id", "positive_score", "other", "score"))


def _positives(most: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        return best_positives(anchors, rows, most)

    return run


def _negatives(most: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        return best_negatives(anchors, rows, most, low, high)

    return run


def _table(parts: list[tuple[np.ndarray, ...]], names: tuple[str, ...]) -> pa.Table:
    columns = [np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]).astype(np.int64) for k in range(len(names))]
    return pa.table(dict(zip(names, columns, strict=True)))


def _in_blocks(anchors: DataFrame, rows: DataFrame, n: int, n_anchors: int, run, schema: str) -> DataFrame:
    """``run`` on every block of anchors with every block of rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m, a = max(1, ceil(n / ROWS), min(parts, ceil(n / 512))), max(1, ceil(n_anchors / ANCHORS))
    own = lambda k: F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = anchors.withColumn("i", own(a)).withColumn("j", every(m))
    right = rows.withColumn("j", own(m)).withColumn("i", every(a))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, schema)


def mine(vectors: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, noisy: int = 7, labels: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all as the module says.

    ``vectors`` has vec_id, label and embedding; labels of ids divisible by ``noisy`` are moved on by one, modulo ``labels``.
    """
    moved = F.when(F.col("vec_id") % noisy == 0, (F.col("label").cast("long") + 1) % labels).otherwise(F.col("label").cast("long"))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding"))
    rows = good.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), scaled("embedding").alias("v"))
    rows = table(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v"), "vectors")
    anchors = rows.where(F.col("vec_id") % every == 0)
    n, n_anchors = rows.count(), anchors.count()

    found = _in_blocks(anchors, rows, n, n_anchors, _positives(n_positives), "anchor_id long, other long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other"))
    positives = found.withColumn("n", place).where(F.col("n") <= n_positives)
    listed = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("other", "score")).alias("positives"))  # n_positives at most
    asked = table(anchors.join(listed, "vec_id"), "anchors")

    found = _in_blocks(
        asked, rows, n, n_anchors, _negatives(n_negatives, low, high), "anchor_id long, positive_id long, positive_score long, other long, score long"
    )
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n_negatives).select(
        "anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
