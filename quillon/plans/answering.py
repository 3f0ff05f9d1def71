"""Many questions at once: the best notes for each, and how good they are against expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import prompts as P
from quillon.functions import text as T
from quillon.operators import health
from quillon.operators.textindex import TextIndex

#: What a title's word adds to a chunk's rank, as a share of it, and how many chunks are looked at for each question.
TITLE_WORD, FETCHED = 0.25, 60


def answer_many(index: TextIndex, chunks: DataFrame, questions: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, path, score, place): the best notes of each question (query_id, query), in one job over the index of ``chunks`` (id, path, title, trust_state).

    A note counts by its best chunk; words of the question in its title raise it, and notes in a state of trust that the question asks for come first.
    Questions without terms find nothing. Ties go to the smaller path.
    """
    asked = questions.select("query_id", "query", T.tokens(F.array_join(T.term_array(F.col("query")), " ")).alias("terms"), P.metadata_hints(F.col("query"))["trust_state"].alias("wanted"))
    found = index.bm25_many(asked.select("query_id", "terms"), FETCHED).select("query_id", "id", "rank")
    rows = found.join(chunks.select("id", "path", "title", "trust_state"), "id").join(asked.select("query_id", "query", "wanted"), "query_id")
    fit = F.size(F.array_intersect(T.tokens(F.coalesce("title", F.lit(""))), T.tokens(F.col("query"))))
    state = F.coalesce(F.col("wanted") == F.col("trust_state"), F.lit(False))
    best = rows.groupBy("query_id", "path").agg(F.max(F.struct(state.alias("state"), (F.col("rank") * (1 + TITLE_WORD * fit)).alias("score"))).alias("m"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("m.state"), F.desc("m.score"), "path"))
    return best.withColumn("place", place).where(F.col("place") <= limit).select("query_id", "path", F.round("m.score", 6).alias("score"), "place")


def evaluate(answers: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    """(category, n, recall, mrr) of answers against cases (query_id, category, expected): whether and where the expected note is among the first ``k``."""
    met = cases.join(answers, "query_id", "left").where("path is null or path = expected").groupBy("query_id").agg(F.min("place").alias("rank"))
    return health.evaluate(cases.join(met, "query_id", "left").select("category", "rank"), k)
