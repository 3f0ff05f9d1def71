"""Similar vectors by an index and in blocks, shared tags, and groups with leaders."""

import numpy as np
import pytest

from quillon.operators import search, trust, vectorindex


def brute(rows, threshold):
    out = {}
    for i, x in rows:
        for j, y in rows:
            if i < j and x is not None and y is not None and len(x) == len(y):
                x_, y_ = (np.nan_to_num(np.array(v, dtype=np.float64)) for v in (x, y))
                norm = np.linalg.norm(x_) * np.linalg.norm(y_)
                c = float(x_ @ y_ / norm) if norm else 0.0
                if round(c, 6) >= threshold:
                    out[i, j] = round(c, 6)
    return out


def made(n=300, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.35 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(40)]  # copies
    return rows + [(900, [1.0, 2.0]), (901, [2.0, 4.0]), (902, None), (903, [0.0] * 16), (904, [])]


@pytest.mark.parametrize("block", [2048, 37])
def test_all_pairs_in_blocks(spark, block):
    rows = made(60)
    got = trust.similar_pairs(spark.createDataFrame(rows, "note_id long, embedding array<float>"), 0.7, block=block)
    assert {(r.a, r.b): round(r.similarity, 6) for r in got.collect()} == brute(rows, 0.7)


@pytest.mark.parametrize("block", [2048, 16])
def test_index_finds_what_it_promises(spark, block):
    rows = made()
    want = brute(rows, 0.8)
    bits, tables = 6, 14
    got = trust.similar_pairs(spark.createDataFrame(rows, "note_id long, embedding array<float>"), 0.8, block=block, index=(bits, tables))
    got = {(r.a, r.b): r.similarity for r in got.collect()}
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in got)
    assert len(got) >= 0.9 * len(want) and len(want) > 500
    # copies always meet
    assert all((a, b) in got for a in range(300, 340) for b in range(a + 1, 340))


def test_layout():
    assert vectorindex.layout(500, 0.4, 0.95) is None and vectorindex.layout(10**6, 0.05, 0.95) is None
    bits, tables = vectorindex.layout(10**7, 0.9, 0.95)
    agree = 1 - np.arccos(0.9) / np.pi
    assert 1 - (1 - agree**bits) ** tables >= 0.95 and bits * tables <= vectorindex.MOST_DIRECTIONS
    assert vectorindex.layout(10**6, 1.0, 0.95)[1] == 1


def test_index_reads_no_more_than_candidates(spark):
    rows = spark.createDataFrame(made(), "note_id long, embedding array<float>").where("embedding is not null")
    rows = rows.withColumn("dims", vectorindex.F.size("embedding"))
    keyed = vectorindex.keys(rows, 8, 5)
    assert keyed.count() == 5 * rows.count()
    most = keyed.where("dims = 16").groupBy("table", "key").count().agg({"count": "max"}).first()[0]
    assert most < 200


def test_nearest_of_unlike_lengths(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0]), (4, None), (5, [1.0, 0.0, 0.0])], "note_id long, embedding array<float>")
    got = [tuple(r) for r in search.nearest_of_each(rows, rows, 3).orderBy("q_id", "place").collect()]
    assert got == [(1, 2, 1), (2, 1, 1)]


TAGS = [
    (1, 5.0, ["A", "b", "c"]), (2, 9.0, ["a", "B"]), (3, 9.0, ["b", "c", "all"]), (4, None, ["all", "x"]), (5, 1.0, ["x", "ALL", "all"]), (6, 2.0, None), (7, 2.0, []),
    (8, 2.0, ["a"]), (9, 7.0, ["c", "a", "z"]), (10, 3.0, ["b", "a"]), (11, 4.0, [None, "q", "q"]),
]


def brute_groups(rows):
    sets = {i: {t.lower() for t in tags or [] if t} for i, _, tags in rows}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    left, out = [r[0] for r in order], []
    while left:
        group = [x for x in left if x == left[0] or len(sets[x] & sets[left[0]]) >= 2]
        out += [(left[0], x) for x in group] if len(group) >= 2 else []
        left = [x for x in left if x not in group]
    return sorted(out)


def test_shared_tags(spark):
    frame = spark.createDataFrame(TAGS, "id long, modified double, tags array<string>")
    sets = {i: {t.lower() for t in tags or [] if t} for i, _, tags in TAGS}
    want = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 2)
    assert sorted(tuple(r) for r in trust.shared_tags(frame).collect()) == want
    assert sorted(tuple(r) for r in trust.tag_groups(frame).collect()) == brute_groups(TAGS)
    assert trust.tag_groups(frame.limit(0)).count() == 0


def test_a_tag_of_all_notes_is_no_key(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(i), ["all", f"t{rng.integers(0, 150)}", f"u{rng.integers(0, 150)}"]) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, modified double, tags array<string>")
    pairs = trust.shared_tags(frame)
    sets = [(i, set(t)) for i, _, t in rows]
    assert pairs.count() == sum(len(x & y) >= 2 for i, x in sets for j, y in sets if i < j)
    assert sorted(tuple(r) for r in trust.tag_groups(frame).collect()) == brute_groups(rows)
