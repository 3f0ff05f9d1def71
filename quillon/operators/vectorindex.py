"""Candidate pairs of vectors by signed random projections, in blocks.

A table of the index has some random directions, and a vector's key is the signs of its products with them; the chance that two vectors
agree in one sign is 1 - angle / pi. Vectors with the same key in any table are compared. A key with many vectors is cut into blocks of
bounded size, and blocks are compared two by two, so no task holds a whole key.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables and directions of an index at most, and what putting a vector into a table costs, in comparisons.
MOST_TABLES, MOST_DIRECTIONS, PUT = 200, 1200, 64
SEED = 11
#: Vectors of a tile, and pairs of which cosines are reckoned at once.
TILE, PAIRS = 2048, 200_000


def layout(n: int, threshold: float, recall: float) -> tuple[int, int] | None:
    """(directions, tables) of the cheapest index of ``n`` vectors that finds a pair at the threshold with probability ``recall``.

    None if it would cost more than half of comparing all pairs.
    """
    agree = 1 - acos(max(-1.0, min(1.0, threshold))) / pi
    best = None
    for bits in range(1, 33):
        hit = agree**bits
        tables = 1 if hit >= 1 else ceil(log(1 - recall) / log(1 - hit))
        if tables > MOST_TABLES or tables * bits > MOST_DIRECTIONS:
            break
        cost = tables * n * (PUT + n / 2 ** (bits + 1))
        if best is None or cost < best[0]:
            best = (cost, bits, tables)
    return best[1:] if best and best[0] < n * n / 4 else None


def directions(dims: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng((SEED, dims)).normal(size=(dims, tables * bits))


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Null components count as zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), copy=False).reshape(len(column), dims)


def keys(rows: DataFrame, bits: int, tables: int, signs: bool = False) -> DataFrame:
    """Each of ``rows`` (note_id, embedding, dims) with its key in every table (table, key); with ``signs`` its keys in all of them, as bytes."""
    kind = dict(rows.dtypes)["note_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        power = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            size = batch.column("dims").to_numpy()
            for dims in np.unique(size).tolist():
                part = batch.filter(pa.array(size == dims))
                if dims not in made:
                    made[dims] = directions(dims, bits, tables)
                above = (_vectors(part.column("embedding"), dims) @ made[dims] > 0).reshape(part.num_rows, tables, bits)
                key = above @ power
                every = pa.array([k.tobytes() for k in key.astype("<i8")], pa.binary())
                for t in range(tables):
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [part.column("note_id"), part.column("embedding"), part.column("dims"), pa.array(np.full(n, t, np.int32)), pa.array(key[:, t].astype(np.int64)), *([every] if signs else [])],
                        ["note_id", "embedding", "dims", "table", "key", *(["signs"] if signs else [])],
                    )

    return rows.select("note_id", "embedding", "dims").mapInArrow(run, f"note_id {kind}, embedding {dict(rows.dtypes)['embedding']}, dims int, table int, key long" + (", signs binary" if signs else ""))


def _exact(left: np.ndarray, right: np.ndarray, norms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Cosines of rows of two tables, summed in the order of their components, as ``scores.cosine`` does."""
    dot = np.zeros(len(left))
    for d in range(left.shape[1]):
        dot += left[:, d] * right[:, d]
    whole = norms[0] * norms[1]
    return np.where(whole == 0, 0.0, dot / np.where(whole == 0, 1.0, whole))


def _norms(vectors: np.ndarray) -> np.ndarray:
    total = np.zeros(len(vectors))
    for d in range(vectors.shape[1]):
        total += vectors[:, d] * vectors[:, d]
    return np.sqrt(total)


def in_blocks(rows: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """(a, b, similarity) of vectors of one group with a cosine near ``threshold`` or above; ``parts`` says into how many blocks the group is cut.

    A task multiplies tiles of ``TILE`` vectors, so what it holds besides its two blocks is bounded. Rows with ``signs``, their keys in all tables, meet in the first table in
    which their keys are equal, and in no other. A null component has no similarity.
    """
    kind, signed = dict(rows.dtypes)["note_id"], "signs" in rows.columns

    def multiply(frame: pa.Table) -> pa.Table:
        dims, i, j = (frame.column(c)[0].as_py() for c in ("dims", "i", "j"))
        ids, own = frame.column("note_id").to_numpy(), frame.column("own").to_numpy()
        column = frame.column("embedding").combine_chunks()
        raw = column.flatten()
        known = ~np.isnan(np.zeros(len(ids)))
        if raw.null_count:
            known = ~raw.is_null().to_numpy(zero_copy_only=False).reshape(len(ids), dims).any(axis=1)
        exact = raw.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dims)
        unit = np.nan_to_num(exact)
        unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
        norms = _norms(exact)
        if signed:
            keys_ = np.frombuffer(b"".join(frame.column("signs").to_pylist()), dtype="<i8").reshape(len(ids), -1)
            before = keys_[:, : frame.column("table")[0].as_py()]
        left, right = np.flatnonzero((own == i) & known), np.flatnonzero((own == j) & known)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for x in range(0, len(left), TILE):
            for y in range(0, len(right), TILE):
                one, two = left[x : x + TILE], right[y : y + TILE]
                p, q = np.nonzero(unit[one] @ unit[two].T >= threshold - 1e-5)
                p, q = one[p], two[q]
                keep = (ids[p] < ids[q]) if i == j else (ids[p] != ids[q])
                p, q = p[keep], q[keep]
                for k in range(0, len(p), PAIRS):
                    m, n = p[k : k + PAIRS], q[k : k + PAIRS]
                    if signed:
                        new = ~(before[m] == before[n]).any(axis=1)
                        m, n = m[new], n[new]
                    with np.errstate(all="ignore"):
                        out.append((np.minimum(ids[m], ids[n]), np.maximum(ids[m], ids[n]), _exact(exact[m], exact[n], (norms[m], norms[n]))))
        a, b, c = (np.concatenate([o[k] for o in out]) if out else np.array([]) for k in range(3))
        return pa.table({"a": pa.array(a, frame.schema.field("note_id").type) if out else pa.array([], frame.schema.field("note_id").type), "b": pa.array(b, frame.schema.field("note_id").type) if out else pa.array([], frame.schema.field("note_id").type), "similarity": pa.array(c, pa.float64())})

    dealt = rows.withColumn("own", F.pmod(F.xxhash64("note_id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "parts")
    return dealt.groupBy(*group, "i", "j").applyInArrow(multiply, f"a {kind}, b {kind}, similarity double")


def candidates(rows: DataFrame, threshold: float, bits: int, tables: int, block: int = 2048) -> DataFrame:
    """(a, b, similarity) of vectors that share a key in some table and are near the threshold or above it, each pair once."""
    keyed = keys(rows, bits, tables, signs=True)
    group = ["dims", "table", "key"]
    # keys of more vectors than a block are cut; a join that Spark sends to all tasks while they are few, and splits where it is skewed
    large = keyed.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > block).select(*group, F.ceil(F.col("n") / block).cast("long").alias("parts"))
    dealt = keyed.join(large, group, "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    return in_blocks(dealt, group, threshold)
