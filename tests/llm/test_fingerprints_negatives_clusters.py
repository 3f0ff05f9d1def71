"""Fingerprints, hard negatives and clusters against plain versions, on the smallest tables and odd rows."""

import hashlib
import re
from collections import defaultdict
from math import floor, isfinite

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import clusters, fingerprints, negatives, queries

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
VECTOR = "vec_id long, embedding array<float>, label int, cluster string, score string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# fingerprints


def plain_paragraphs(text):
    parts = re.split(r"[\n\r]+|(?<=[.!?] )(?=[AEIOUaeiou])", text)
    return {p for p in (x.strip(" \t\r\n\x0b\x0c") for x in parts) if p}


def plain_likeness(a, b):
    a, b = plain_paragraphs(a), plain_paragraphs(b)
    return 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))


def plain_fingerprints(docs):
    docs = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is not None, d[0] or 0, len(d[1])))
    out = {}
    for k, (i, t) in enumerate(docs):
        follows = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + follows[:half]
        out[i, t] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_likeness(t, edited), plain_likeness(t, follows))
    return out


def same_as_plain(spark, docs):
    schema = "doc_id long, text string, keys string, range int, n string, copy int"
    frame = spark.createDataFrame([(i, t, "k", 1, "x", 1) for i, t in docs], schema)
    got = fingerprints.fingerprints(frame).collect()
    want = sorted((repr(i), n, h, round(e, 9), round(f, 9)) for (i, _), (n, h, e, f) in plain_fingerprints(docs).items())
    assert sorted((repr(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    return got


def test_fingerprints_of_the_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = same_as_plain(spark, docs)
    assert len({r.fingerprint for r in got}) > 0.8 * len(got)
    texts = dict(docs)
    by_text = defaultdict(set)
    for r in got:
        by_text[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_fingerprints_of_odd_rows(spark):
    long = "\n".join(f"line {i} of a long text" for i in range(3000))
    docs = [(None, "lost"), (1, None), (2, ""), (3, " \n \t\n"), (5, "one"), (8, "é 😀 ü. A b.\nA b."), (9, long), (10, long + "\nand more"), (11, long[:60000]), (-4, "x\ny\nx\ny"), (2**40, "last. end")]
    same_as_plain(spark, docs)
    got = fingerprints.fingerprints(spark.createDataFrame([(7, "alone\nhere")], "doc_id long, text string")).first()
    assert got.near_next == 1.0 and got.n_chars == 10
    assert fingerprints.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = fingerprints.fingerprints(spark.createDataFrame([(7, "a\nb"), (7, "a\nb"), (8, "c")], "doc_id long, text string")).collect()
    assert len(twice) == 3 and len({r.fingerprint for r in twice if r.doc_id == 7}) == 1


def test_peeling_recovers_the_digests(spark):
    a, b = list(range(1000, 1040)), list(range(1003, 1043))
    row = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    got = row.select(fingerprints.peel(fingerprints.subtract(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))).alias("p")).first().p
    assert sorted(got.more) == [1000, 1001, 1002] and sorted(got.less) == [1040, 1041, 1042]
    none = spark.createDataFrame([(a, [])], "a array<long>, b array<long>")
    cells = none.select(fingerprints.peel(fingerprints.subtract(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))).alias("p"), fingerprints.larger(F.col("a"), F.col("b"), 5).alias("n")).first()
    assert cells.p is None and cells.n in (40, None)


def test_fingerprints_run_without_python(spark):
    plan = fingerprints.fingerprints(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# hard negatives


def odd_vectors():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(140):
        v = np.round(rng.normal(size=6) / 4, 2).astype(np.float32)
        rows.append([i, [float(x) for x in v], int(rng.integers(0, 3)), "c", "s"])
    for i in range(100, 140):  # ties
        rows[i][1] = rows[i % 5][1]
    rows += [[200, None, 1, None, None], [201, [1.0, None], 1, None, None], [202, [NAN], 1, None, None], [203, [INF, 1.0], 0, None, None], [204, [1.0, 2.0], None, None, None]]
    rows += [[None, [1.0, 1.0], 1, None, None], [250, [], 1, None, None], [300, [0.5, 0.5], 1, None, None], list(rows[3]), [-50, [1.0] * 6, 0, None, None]]
    return [tuple(r) for r in rows]


def whole(v):
    return [floor(256 * x) for x in v]


def good(v):
    return v is not None and all(x is not None and isfinite(x) for x in v)


def plain_negatives(rows):
    kept = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and good(v):
            label = (label + 1) % 10 if i % 7 == 0 else label
            kept[i] = min(kept.get(i, (label, whole(v))), (label, whole(v)))
    out = []
    for a, (la, va) in kept.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=False)), i, label) for i, (label, v) in kept.items() if i != a)
        for p, pid, _ in [s for s in scored if s[2] == la][:5]:
            band = [(n, i) for n, i, label in scored if label != la and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(a, pid, k + 1, i, -p, -n) for k, (n, i) in enumerate(band)]
    return sorted(out)


@pytest.mark.parametrize("rows", [None, 16])
def test_hard_negatives(spark, rows, monkeypatch):
    if rows:  # many blocks
        monkeypatch.setattr(negatives, "ROWS", rows)
        monkeypatch.setattr(negatives, "ANCHORS", 2)
    made = odd_vectors()
    assert rows_of(negatives.mine(spark.createDataFrame(made, VECTOR))) == plain_negatives(made)
    assert len(plain_negatives(made)) > 10
    assert negatives.mine(spark.createDataFrame([], VECTOR)).count() == 0


def test_products_are_exact():
    from quillon.llm.vectors import products

    a = np.array([[2**24, -(2**24), 3]] * 2, np.int64)
    assert products(a, a).tolist() == [[2**49 + 9] * 2] * 2
    big = np.full((1, 64), 2**24, np.int64)
    assert products(big, big)[0, 0] == 64 * 2**48


# clusters


def plain_clusters(rows, k, rounds, size):
    kept = [(i, np.array(whole(v), dtype=object)) for i, v, *_ in rows if good(v) and len(v) == size]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v.tolist()) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in seeds]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for n, g in groups.items():
            centres[n] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    end = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in end)
    own = defaultdict(int)
    for _, n, d in end:
        own[n] += d
    key = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), n, d, own[n], total, key[n]) for i, n, d in end)


@pytest.mark.parametrize(("k", "rounds"), [(7, 5), (40, 3), (200, 2), (1, 1)])
def test_clusters(spark, k, rounds):
    made = odd_vectors()
    got = clusters.lloyd(spark.createDataFrame(made, VECTOR), k=k, rounds=rounds, size=6)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == plain_clusters(made, k, rounds, 6)


def test_clusters_of_nothing(spark):
    got = clusters.lloyd(spark.createDataFrame(odd_vectors(), VECTOR), size=64)
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_a_moved_owner_meets_all_centroids():
    v = np.array([[0], [10]])
    centres = np.array([[30], [9], [1]])
    cluster, distance = clusters.reassign(v, np.array([0, 1]), np.array([0, 1]), centres, np.array([True, False, False]))
    assert cluster.tolist() == [2, 1] and distance.tolist() == [1, 1]


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_centroids"])
def test_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = queries.queries()[name](spark, SF)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(rel.columns)
    place = [rel.columns.index(c) for c in got.columns]
    assert rows_of(got) == sorted(tuple(r[i] for i in place) for r in rel.fetchall())
