"""Lloyd's rounds that follow changes: assignments and the clusters' sums are kept, and only what can change is computed.

In a round a vector whose own centroid stood still is compared with the centroids that moved; only vectors whose centroid
moved meet all. Vectors that change clusters are signed transfers, -v for the old one and +v for the new one, summed in
the tasks that hold them; sums and counts are the old ones plus the transfers. Centroids are exact: floor(sum / count) in whole numbers.
Each round's assignments and sums are written to the shared folder, so a lost executor costs tasks of one round. The driver holds the
centroids only (``k`` rows).

Vectors that are null, have another number of components, or a null or non-finite one, are left out. Rows that repeat an id are
vectors of their own; a null id can't be a first centroid but is assigned. With fewer than ``k`` vectors there are as many centroids;
equal ones keep their numbers, and the smaller number wins. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import table
from quillon.llm.vectors import finite, matrix, products, scaled

STATE = "vec_id long, v array<int>, cluster int, distance long, was int"


def distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, exact."""
    square = lambda x: (x * x).sum(axis=1)
    return square(v)[:, None] - 2 * products(v, centres) + square(centres)[None, :]


def reassign(v: np.ndarray, cluster: np.ndarray, distance: np.ndarray, centres: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and its distance; ties: the smaller number. ``cluster`` is -1 for vectors without one."""
    cluster, distance = cluster.copy(), distance.copy()
    anew = np.flatnonzero((cluster < 0) | moved[cluster])
    if len(anew):
        d = distances(v[anew], centres)
        best = d.argmin(axis=1)
        nearest = d[np.arange(len(anew)), best]
    kept, some = np.setdiff1d(np.arange(len(v)), anew, assume_unique=True), np.flatnonzero(moved)
    if len(kept) and len(some):
        d = distances(v[kept], centres[some])
        other = d.argmin(axis=1)
        far, number = d[np.arange(len(kept)), other], some[other]
        wins = (far < distance[kept]) | ((far == distance[kept]) & (number < cluster[kept]))
        cluster[kept[wins]], distance[kept[wins]] = number[wins], far[wins]
    if len(anew):
        cluster[anew], distance[anew] = best, nearest
    return cluster, distance


def _round(state: DataFrame, centres: np.ndarray, moved: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            was, far = b.column("cluster"), b.column("distance")
            before = was.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            c, d = reassign(matrix(b.column("v")), before, far.fill_null(-1).to_numpy(zero_copy_only=False), centres, moved)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(c, pa.int32()), pa.array(d, pa.int64()), was], ["vec_id", "v", "cluster", "distance", "was"])

    return state.mapInArrow(run, STATE)


def _transfers(state: DataFrame, width: int) -> DataFrame:
    """(cluster, n, s0, s1, ...): what vectors that changed clusters bring and take, summed by cluster."""
    went = state.where("was is null or was <> cluster").select(
        "v", F.inline(F.array(F.struct(F.col("cluster").alias("to"), F.lit(1).cast("long").alias("sign")), F.struct(F.col("was").alias("to"), F.lit(-1).cast("long").alias("sign"))))
    )
    sums = [F.sum(F.col("sign") * F.get("v", F.lit(k)).cast("long")).alias(f"s{k}") for k in range(width)]
    return went.where("to is not null").groupBy(F.col("to").alias("cluster")).agg(F.sum("sign").alias("n"), *sums)


def lloyd(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors (vec_id, embedding) that are kept.

    First centroids are the ``k`` vectors with the smallest SHA-256 of "seed:vec_id", in that order.
    """
    kept = vectors.where((F.size("embedding") == size) & finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), scaled("embedding").alias("v"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id is not null").orderBy(order, "v").limit(k).collect()  # k rows
    centres = np.array([r.v for r in first], np.int64).reshape(len(first), size)
    if not len(centres):
        empty = kept.where(F.lit(False))
        return empty.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    state = kept.select("vec_id", "v", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("was", "int"))])
    moved, sums = np.ones(len(centres), bool), None
    for r in range(rounds + 1):
        state = table(_round(state, centres, moved), "assignments")
        if r == rounds or not moved.any():
            break
        change = _transfers(state, size)
        if sums is not None:
            change = sums.unionByName(change).groupBy("cluster").agg(*[F.sum(c).alias(c) for c in change.columns[1:]])
        sums = table(change, "sums")
        new = centres.copy()
        for row in sums.collect():  # k rows at most
            if row.n > 0:
                new[row.cluster] = [row[f"s{i}"] // row.n for i in range(size)]
        moved, centres = (new != centres).any(axis=1), new
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    inertia = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = inertia.crossJoin(inertia.agg(F.sum("cluster_inertia").alias("inertia")))  # k rows with one row
    return state.join(F.broadcast(inertia), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.get(F.array(*map(F.lit, names)), F.col("cluster")).alias("centroid_sha256")
    )
