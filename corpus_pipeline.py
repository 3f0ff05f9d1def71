"""A training corpus from raw documents in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns of ``docs``; the last one returns packed pieces. ``run`` writes what each stage returns as Parquet in the shared
folder and reads it again as the next one's ``docs``, so a lost executor costs one stage's tasks at most.

In every stage: null and empty texts are judged as empty ones by the models (and fail the base rules, as they have fewer than
20 words); near duplicates and decontamination keep them, packing gives them a piece of one token. Rows with a null id are
kept by all stages and packed. Rows that repeat an id are judged by their own texts by the models; near duplicates and decontamination keep
or drop all rows of an id together. Ties go to the smallest id. An empty table gives empty results; columns beyond those
of ``documents`` go along, whatever they are called, and packing ignores them. Texts are read whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontam, neardup, packing, quality, rules
from quillon.llm.shared import table

TOKENIZER = "byte_bpe_50k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network scores below its threshold go."""
    train = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.sift(docs, labels, train=train)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the n-gram model go. The model is fitted on labelled rows of all documents."""
    train = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.sift(docs, labels, train=train)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 on five-word shingles the document of the smallest id stays."""
    got = neardup.near_duplicates(docs, k=5, percent=80)
    kept = docs.join(table(got.where("not kept").select("doc_id").distinct(), "copies"), "doc_id", "left_anti")
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with the sources mixed evenly."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packed),
]

#: Models, sketches and tokens are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
