"""A corpus pipeline: toxicity, quality, near duplicates, benchmark decontamination, packing.

Each stage is one of the operators in ``tablescope.llm`` applied to all documents that the
stage before it kept. Its result is written as Parquet and read again by the next one, so
a lost executor costs no more than the stage at work.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import decontaminate, near, pack, quality, toxicity
from tablescope.llm.names import spare
from tablescope.session import materialize

#: Documents this likely to be toxic go; documents less likely than this to be good go.
TOXIC, GOOD = 0.7, 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, with all columns of ``docs``, whatever their names.

    Learned from the labelled rows of ``docs``; without labels nothing goes. Null and empty
    texts, and texts shorter than any n-gram, are scored as texts without known n-grams;
    repeated rows and equal texts go or stay together.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = spare(docs, "toxic_score")
    return toxicity.score(docs, model, name=score).filter(F.col(score) < TOXIC).drop(score)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, with all columns of ``docs``. Nulls, ties and repeated rows are as in ``drop_toxic``."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = spare(docs, "quality_score")
    return quality.score(docs, model, name=score).filter(F.col(score) >= GOOD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, all documents without words, with all columns (see ``near.keep_one`` for nulls and ties)."""
    return near.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, with all columns.

    Whether a document goes is settled by its text alone, so texts are looked up by their
    hash: equal texts go or stay together, null and empty ones stay, and doc_id plays no part.
    """
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(docs.select(key.alias("doc_id"), "text"), benchmark)
    (name,) = spare(docs, "text_key")
    found = found.select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, key).join(found, name, "left_anti").drop(name)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; a null text is empty, equal and null ids are documents of their own."""
    return pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_documents),
]

#: Training and graph stages can't be said in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the pieces of the documents that are left and their places in sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
