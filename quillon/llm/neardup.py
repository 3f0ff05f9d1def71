"""Near-duplicate documents by HyperMinHash (operator 3).

A document's set holds its distinct k-word shingles. ``BUCKETS`` registers keep, for each bucket of the hash space, the
smallest hash as a count of leading zeros (6 bits) and the ``MANTISSA`` bits after the leading one: two bytes each.
Empty registers of short documents are filled from other registers (the same ones for the same set), so that registers
of two documents agree about as often as their sets' similarity says. Steps:

1. exact copies (equal sets) become one class, with a partial aggregate, so large groups of copies cost nothing later;
2. runs of ``ROWS`` compressed registers are the bands. Of the classes that share a band each is compared with the smallest
   one, by their registers, less the agreement that chance gives; those unlike it are compared with all of the band, in blocks
   of about ``BLOCK`` that meet pairwise. Only a spanning forest leaves a block, never all pairs; pairs of classes that
   are both like the smallest are in one component already;
3. components of that graph are the candidate groups. Each class is first compared, on full sets, with the ``PROBES`` smallest
   classes that step 2 joined it to: ``100 * |A & B| >= percent * |A | B|``, work in proportion to the classes;
4. where that leaves a group in several parts, every class outside its largest part is compared with every class of the
   group, in blocks of full sets that meet pairwise; only a forest of the links found is kept. Links within a part
   are not sought: its classes are one component already;
5. components of the confirmed links are the result.

Null and empty texts have an empty set, are linked with nothing and are kept. Repeated rows with one id are copies and
fall in one class. A null id cannot be named in a result; such rows are left out. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import words as W
from quillon.llm.shared import connected_components, small_batches, spread_join, table

BANDS, ROWS, MANTISSA, BLOCK = 24, 6, 10, 256
BUCKETS, PROBES = BANDS * ROWS, 2
#: An estimate from 144 registers has a deviation of 0.03 at a similarity of 0.85; candidates may lie this far below.
MARGIN = 0.11
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of the smallest hashes."""
    top = (least >> np.uint64(11)).astype(np.float64)  # 53 bits, exact
    _, exponent = np.frexp(top)
    zeros = np.minimum(53 - exponent, 53).astype(np.uint64)
    mantissa = (least << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def sketch(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Registers (rows x BUCKETS) of the sets hashes[at[i]:at[i + 1]]; rows without hashes have zeros."""
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    bucket = ((hashes >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    least = np.full((n, BUCKETS), _EMPTY)
    np.minimum.at(least.ravel(), row * BUCKETS + bucket.astype(np.int64), W.mix(hashes ^ W.M2))
    missing = (least == _EMPTY) & (np.diff(at) > 0)[:, None]
    source, r, c = least.copy(), *np.nonzero(missing)
    for t in range(1, 65):
        if not len(r):
            break
        other = (W.mix(c.astype(np.uint64) * np.uint64(1000003) + np.uint64(t)) % np.uint64(BUCKETS)).astype(np.int64)
        found = source[r, other]
        good = found != _EMPTY
        least[r[good], c[good]] = found[good]
        r, c = r[~good], c[~good]
    if len(r):
        least[r, c] = source[r].min(axis=1)
    out = registers(least)
    out[np.diff(at) == 0] = 0
    return out


def chance(sizes: np.ndarray) -> np.ndarray:
    """For sets of these sizes, the distribution of a register's leading zeros (rows x 54)."""
    load = np.maximum(sizes, 1)[:, None] / BUCKETS
    below = 1 - np.exp(-np.maximum(load, 1 / BUCKETS) * 2.0 ** -np.arange(55))
    return (below[:, :-1] - below[:, 1:]) / below[:, :1]


def estimate(reg_a: np.ndarray, reg_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal registers, less what equal registers of unlike elements add."""
    share = (reg_a == reg_b).mean(axis=1)
    p = (chance(size_a) * chance(size_b)).sum(axis=1) * 2.0**-MANTISSA
    return (share - p) / (1 - p)


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for batch in W.slices(whole, "text"):
                    h, _, _, first = W.words(*W.flat(batch.column("text")), lower=True)
                    sh, at = W.shingles(h, first, k)
                    n = np.zeros(batch.num_rows, np.int64)
                    one, two = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                    salted = W.mix(sh ^ W.GOLD)
                    for i in range(batch.num_rows):
                        part = sh[at[i] : at[i + 1]]
                        if len(part):
                            order = np.argsort(part) if len(part) > 1 else np.zeros(1, np.int64)
                            fresh = np.concatenate([[True], np.diff(part[order]) != 0])
                            n[i] = fresh.sum()
                            one[i] = part[order][fresh].sum().view(np.int64)
                            two[i] = salted[at[i] : at[i + 1]][order][fresh].sum().view(np.int64)
                    reg = sketch(sh, at)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id"), pa.array(n), pa.array(one), pa.array(two), pa.array([x.tobytes() if m else None for x, m in zip(reg, n, strict=True)], pa.binary())],
                        ["doc_id", "n_shingles", "one", "two", "registers"],
                    )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for batch in W.slices(whole, "text"):
                    h, _, _, first = W.words(*W.flat(batch.column("text")), lower=True)
                    sh, at = W.shingles(h, first, k)
                    sets = pa.array([np.unique(sh[at[i] : at[i + 1]]).tobytes() for i in range(batch.num_rows)], pa.binary())
                    rest = [c for c in batch.schema.names if c != "text"]
                    yield pa.RecordBatch.from_arrays([*map(batch.column, rest), sets], [*rest, "shingles"])

    return run


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[list[pd.DataFrame]]:
    """Groups of frames sorted by ``keys``; a group that crosses frames is put together first."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        new = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(new)
        yield [frame.iloc[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        rest = frame.iloc[starts[-1] :]
    if rest is not None and len(rest):
        yield [rest]


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each id to the smallest id of its component in the graph of the links (a[i], b[i])."""
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(ids[i]), int(ids[label[i]])) for i in np.flatnonzero(label != np.arange(len(ids)))]


def _star(percent: int):
    """Whether each class is like the smallest of its band."""
    least = percent / 100 - MARGIN

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            reg = np.frombuffer(b"".join(frame["registers"]), np.uint16).reshape(-1, BUCKETS)
            top = np.frombuffer(b"".join(frame["center_registers"]), np.uint16).reshape(-1, BUCKETS)
            size, top_size = frame["n_shingles"].to_numpy(), frame["center_shingles"].to_numpy()
            fit = 100 * np.minimum(size, top_size) >= percent * np.maximum(size, top_size)
            yield frame[["rep", "center"]].assign(linked=fit & (estimate(reg, top, size, top_size) >= least))
        W.release()

    return run


def _estimated(percent: int):
    least = percent / 100 - MARGIN

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in _groups(frames, ["band", "key", "i", "j"]):
            out: list[tuple[int, int]] = []
            for g in groups:
                g = g.drop_duplicates("rep").sort_values("rep")  # a class may come as one of either side
                ids, sizes = g["rep"].to_numpy(), g["n_shingles"].to_numpy()
                reg = np.frombuffer(b"".join(g["registers"]), np.uint16).reshape(len(g), BUCKETS)
                # only pairs with a class that is unlike the smallest
                a, b = np.nonzero(np.triu(np.ones((len(g), len(g)), bool), 1) & ~(g["linked"].to_numpy()[:, None] & g["linked"].to_numpy()[None, :]))
                fit = 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
                a, b = a[fit], b[fit]
                if len(a):
                    like = estimate(reg[a], reg[b], sizes[a], sizes[b]) >= least
                    out += _forest(ids, a[like], b[like])
            yield pd.DataFrame(sorted(set(out)), columns=["a", "b"], dtype="int64")
        W.release()

    return run


def _tried(percent: int):
    """Members of (b, j) groups against the set of b itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in _groups(frames, ["b", "j"]):
            out: list[tuple[int, int]] = []
            for g in groups:
                root = [np.frombuffer(x, np.uint64) for x in g["shingles"][g["rep"] == g["b"]]]
                for rep, b, x in zip(g["rep"], g["b"], g["shingles"], strict=True):
                    if rep == b:
                        continue
                    own = np.frombuffer(x, np.uint64)
                    for r in root:
                        both = len(np.intersect1d(own, r, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(r) - both):
                            out.append((int(rep), int(b)))
                            break
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        W.release()

    return run


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of sets, by products of incidence matrices over slices of what is shared."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = counts[column] > 1
    rows, column = rows[keep], (np.cumsum(counts > 1) - 1)[column[keep]]
    out = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        a, b = np.searchsorted(column, [low, low + 8192])
        x = np.zeros((len(sets), 8192), np.float32)
        x[rows[a:b], column[a:b] - low] = 1
        out += x @ x.T
    return out


def _confirmed(percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in _groups(frames, ["cluster", "i", "j"]):
            out: list[tuple[int, int]] = []
            for g in groups:
                g = g.drop_duplicates("rep").sort_values("rep")  # a class may come as one of either side
                ids = g["rep"].to_numpy()
                sets = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
                sizes = np.array([len(s) for s in sets])
                if len(sets) < 2:
                    continue
                if len(sets) == 2:
                    both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
                    if 100 * both >= percent * (sizes.sum() - both):
                        out.append((int(ids[1]), int(ids[0])))
                    continue
                both = common(sets)
                a, b = np.nonzero(np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1))
                out += _forest(ids, a, b)
            yield pd.DataFrame(sorted(set(out)), columns=["a", "b"], dtype="int64")
        W.release()

    return run


def _grid(odd: Column) -> Column:
    """Places (i, j) of a class on a grid of ``few`` by ``many`` blocks, so that every odd one meets every class."""
    left, right = F.pmod(F.xxhash64("rep"), F.col("few")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("many")).cast("int")
    as_odd = F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda j: F.struct(left.alias("i"), j.alias("j")))
    as_other = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda i: F.struct(i.alias("i"), right.alias("j")))
    return F.when(odd, F.array_union(as_odd, as_other)).otherwise(as_other)


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text); see the module's text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    with small_batches(docs.sparkSession, 1000):
        sketches = table(docs.mapInArrow(_sketches(k), "doc_id long, n_shingles long, one long, two long, registers binary"), "sketches")
    classes = (
        sketches.where("n_shingles > 0")
        .groupBy("n_shingles", "one", "two")
        .agg(F.min("doc_id").alias("rep"), F.min("registers").alias("registers"))
    )
    classes = table(classes, "classes")
    width = 2 * ROWS
    bands = classes.select("rep", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "registers").select(
        "rep", "band", F.substring("registers", 1, 0).alias("none"), F.expr(f"substring(registers, band * {width} + 1, {width})").alias("key")
    ).drop("none")
    # equal band and key meet; the registers follow only for those that meet anyone
    shared = ["band", "key"]
    counts = table(bands.groupBy(*shared).agg(F.min("rep").alias("center"), F.count("*").alias("members")).where("members > 1"), "bands")
    met = table(spread_join(bands.select("rep", *shared), counts, shared), "met")
    own = classes.select("rep", "n_shingles", "registers")
    tops = counts.select("center").distinct().join(own.withColumnRenamed("rep", "center"), "center")
    tops = tops.withColumnsRenamed({"n_shingles": "center_shingles", "registers": "center_registers"})
    pairs = spread_join(table(met.where("rep <> center").select("rep", "center").distinct(), "pairs"), tops, ["center"]).join(own, "rep")
    like = table(pairs.mapInPandas(_star(percent), "rep long, center long, linked boolean"), "stars")
    stars = table(met.join(like, ["rep", "center"], "left").select("rep", *shared, F.coalesce("linked", F.col("rep") == F.col("center")).alias("linked")), "members")
    loose = like.where("linked").select(F.col("rep").alias("a"), F.col("center").alias("b"))
    odd = stars.groupBy(*shared).agg(F.count_if(~F.col("linked")).alias("odd"), F.count("*").alias("all")).where("odd > 0 and all > 2")
    odd = table(odd.select(*shared, F.ceil(F.col("odd") / BLOCK).cast("int").alias("few"), F.ceil(F.col("all") / BLOCK).cast("int").alias("many")), "odd")
    if odd.limit(1).count():
        parts = [*shared, "i", "j"]
        rows = spread_join(stars, odd, shared)
        places = _grid(~F.col("linked"))
        rows = rows.select("rep", "linked", *shared, F.explode(places).alias("at")).select("rep", "linked", *shared, "at.i", "at.j").join(own, "rep")
        found = rows.repartition(*parts).sortWithinPartitions(*parts).mapInPandas(_estimated(percent), "a long, b long")
        loose = loose.unionByName(found)
    loose = table(loose.distinct(), "loose")
    groups = connected_components(loose).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    half = BLOCK // 2

    def confirmed(places: DataFrame, keys: list[str], judge) -> DataFrame:
        """Links that ``judge`` finds in groups of ``keys``; ``places`` has the groups of each class."""
        # one text of each class (repeated ids may bring several rows); a set is made once and goes to all its groups
        texts = docs.join(places, docs["doc_id"] == places["rep"]).select("rep", "places", "text")
        kind = places.schema["places"].dataType.simpleString()
        with small_batches(docs.sparkSession, 500):
            sets = texts.mapInArrow(_sets(k), f"rep long, places {kind}, shingles binary").select("rep", F.explode("places").alias("p"), "shingles")
            dealt = sets.select("rep", "shingles", "p.*").repartition(*keys).sortWithinPartitions(*keys)
            return table(dealt.mapInPandas(judge, "a long, b long").distinct(), "links")

    # each class with few that it was joined to
    tries = loose.groupBy("a").agg(F.slice(F.array_sort(F.collect_set("b")), 1, PROBES).alias("b"))
    tries = table(tries.select("a", F.explode("b").alias("b")), "tries")
    blocks = tries.groupBy("b").agg(F.ceil(F.count("*") / half).cast("int").alias("blocks"))
    own = spread_join(tries, blocks, ["b"]).select(F.col("a").alias("rep"), "b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("j"))
    roots = blocks.select(F.col("b").alias("rep"), "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    places = own.unionByName(roots).groupBy("rep").agg(F.collect_list(F.struct("b", "j")).alias("places"))
    tight = confirmed(table(places, "places"), ["b", "j"], _tried(percent))
    # groups that are still in parts
    parts = connected_components(tight).select(F.col("node").alias("rep"), F.col("component").alias("part"))
    members = table(groups.join(parts, "rep", "left").select("rep", "cluster", F.coalesce("part", "rep").alias("part")), "members")
    sizes = members.groupBy("cluster", "part").agg(F.count("*").alias("n"))
    apart = sizes.groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"), F.count("*").alias("parts"))
    # the only pair of a group of two has been tried
    apart = table(apart.where("parts > 1 and all > 2").select("cluster", "main", F.ceil((F.col("all") - F.col("most")) / half).cast("int").alias("few"), F.ceil(F.col("all") / half).cast("int").alias("many")), "apart")
    if apart.limit(1).count():
        rest = spread_join(members, apart, ["cluster"])
        places = F.transform(_grid(F.col("part") != F.col("main")), lambda x: F.struct(F.col("cluster").alias("cluster"), x["i"].alias("i"), x["j"].alias("j")))
        places = rest.select("rep", places.alias("places"))
        tight = tight.unionByName(confirmed(table(places, "places"), ["cluster", "i", "j"], _confirmed(percent)))
    linked = connected_components(tight)
    of_class = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n_shingles", "one", "two", F.coalesce("component", "rep").alias("component_id")
    )
    keys = ["n_shingles", "one", "two"]
    full = sketches.select("doc_id", *keys)
    joined = spread_join(full.where("n_shingles > 0"), of_class, keys)
    alone = full.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return (
        joined.select("doc_id", "n_shingles", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
