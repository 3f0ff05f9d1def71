"""The stored text index: equal to a search over all texts after every change, and reading only what it has to."""

import re
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.operators import search
from quillon.operators.textindex import POSTINGS, TextIndex, bucket_of

NOTES = "id long, path string, title string, text string, extra string"
FIRST = [
    (1, "a/one.md", "One Guide", "alpha beta beta", "x"),
    (2, "a/two.md", None, "alpha gamma", None),
    (3, None, "Three", "", "x"),
    (4, "b/four.md", "Alpha", None, "x"),
    (5, "b/five.md", "Five", "the the the beta " * 50, "x"),
]
TERMS = ["alpha", "beta", "the", "none"]


def rows(df):
    return [tuple(r) for r in df.collect()]


def filled(df):
    return df.fillna("", ["path", "title", "text"])


@pytest.fixture
def made(spark, tmp_path):
    return lambda name="i", buckets=8: TextIndex(spark, str(tmp_path / name), buckets)


def test_follows_every_change(spark, made):
    index = made()
    now = spark.createDataFrame(FIRST, NOTES)
    index.apply(now)
    assert rows(index.bm25(TERMS, 10)) == rows(search.bm25(filled(now), TERMS, 10))
    later = [FIRST[0], (2, "a/two.md", "Two", "beta beta beta", "y"), *FIRST[3:], (6, "c.md", "the", "alpha", None)]
    new = spark.createDataFrame(later, NOTES)
    index.refresh(now, new)
    assert rows(index.bm25(TERMS, 10)) == rows(search.bm25(filled(new), TERMS, 10))
    assert sorted(rows(index.lengths())) == sorted((r[0], r[1]) for r in made("again").__class__(spark, index.path).lengths().collect())
    index.apply(remove=new.where("id in (1, 6, 77)"))
    left = new.where("id not in (1, 6)")
    assert rows(index.bm25(TERMS, 10)) == rows(search.bm25(filled(left), TERMS, 10))
    index.apply(add=new.where("id = 1"))  # back again
    left = new.where("id <> 6")
    assert rows(index.bm25(TERMS, 10)) == rows(search.bm25(filled(left), TERMS, 10))
    whole = made("whole")
    whole.apply(left)
    small = index.compact(whole.path + "-2", 4)
    for other in (whole, small):
        assert sorted(rows(other.postings())) == sorted(rows(index.postings())) and rows(other.bm25(TERMS, 10)) == rows(index.bm25(TERMS, 10))
    assert len(small.commits()) == 1 and len(index.commits()) == 4


def test_reads_only_its_terms(spark, made):
    index = made(buckets=16)
    index.apply(spark.createDataFrame(FIRST, NOTES))
    own = spark.range(1).select(bucket_of(F.lit("alpha"), 16)).first()[0]
    plan = index.postings(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert f"(bucket#{re.search(r'bucket#(\d+)', plan)[1]} = {own})" in re.search(r"PartitionFilters: \[[^\]]*\]", plan)[0]
    assert "EqualTo(term,alpha)" in plan
    # the directories of the others can be gone
    for folder in Path(index.path, "postings/seg=0").glob("bucket=*"):
        if folder.name != f"bucket={own}":
            shutil.rmtree(folder)
    assert {r.term for r in index.postings(["alpha"]).collect()} == {"alpha"}


def test_odd_rows(spark, made):
    index = made()
    assert rows(index.bm25(TERMS)) == [] and rows(index.postings()) == [] and rows(index.lengths()) == []
    index.apply(spark.createDataFrame([], NOTES))
    assert rows(index.bm25(TERMS)) == []
    index.apply(spark.createDataFrame([FIRST[0], FIRST[0]], NOTES))
    assert index.lengths().count() == 1 and rows(index.bm25([])) == [] and rows(index.bm25(["beta", "beta"]))[0][0] == 1
    assert rows(index.bm25(["beta"], fields=("title",))) == []
    assert sorted(index.postings().columns) == sorted(c.split()[0] for c in POSTINGS.split(", "))


def test_a_failed_attempt_does_not_count(spark, made):
    index = made()
    index.apply(spark.createDataFrame(FIRST[:2], NOTES))
    # an attempt that wrote a segment's postings and then ended
    spark.createDataFrame([("alpha", 9, "text", 1, 1, 0)], f"{POSTINGS}, bucket int").write.partitionBy("bucket").parquet(f"{index.path}/postings/seg=1")
    assert {r.id for r in index.postings(["alpha"]).collect()} == {1, 2}
    index.apply(spark.createDataFrame(FIRST[3:], NOTES))
    assert {r.id for r in index.postings(["alpha"]).collect()} == {1, 2, 4}


def test_many_queries_at_once(spark, made):
    index = made()
    now = spark.createDataFrame(FIRST, NOTES)
    index.apply(now)
    index.apply(add=spark.createDataFrame([(2, "a/two.md", "Two", "beta beta beta", "y")], NOTES), remove=now.where("id = 1"))
    queries = {1: TERMS, 2: ["beta", "beta"], 3: ["none"], 4: [], 5: ["guide", None]}
    got = index.bm25_many(spark.createDataFrame(list(queries.items()), "query_id int, terms array<string>"), 3).orderBy("query_id", "place").collect()
    for q, terms in queries.items():
        want = rows(index.bm25([t for t in terms if t], 3))
        assert [(r.id, round(r.rank, 5)) for r in got if r.query_id == q] == [(i, round(x, 5)) for i, x in want]
    assert made("empty").bm25_many(spark.createDataFrame([(1, ["a"])], "query_id int, terms array<string>")).count() == 0
