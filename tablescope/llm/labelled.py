"""Bounded samples of labelled documents, and models fitted on them in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text modulo ``modulus``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, learnable: Column, per_class: int) -> DataFrame:
    """(doc_id, text, label): up to ``per_class`` labelled documents of each class, chosen by a hash of doc_id.

    ``learnable`` says which rows of ``labels`` may be learned from. A document with
    several labels takes what most of them say; one with several texts takes the smallest.
    """
    votes = labels.select("doc_id", F.col(label).alias("label"), learnable.alias("learnable"))
    votes = votes.filter("doc_id IS NOT NULL AND label IS NOT NULL AND learnable")
    votes = votes.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    chosen = [votes.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for value in (0, 1)]
    # At most 2 * per_class rows of two numbers: a proven bound.
    joined = documents.select("doc_id", "text").join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id")
    return joined.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit_in_one_task(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """The model that ``fit`` makes from the whole (bounded) sample; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        model = fit(pa.Table.from_batches(found).sort_by("doc_id")) if sum(map(len, found)) else None
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model)]}, pa.schema([("model", pa.binary())]))

    rows = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return next((m for r in rows if (m := pickle.loads(r["model"])) is not None), None)
