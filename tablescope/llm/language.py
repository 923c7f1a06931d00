"""Language identification by sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three characters (lower-cased, white space as one space) are hashed
into ``SLOTS`` slots. Document frequencies are counted over all documents that may be
learned from. The regression is trained on a bounded sample with follow-the-regularised-
leader (per-coordinate steps, an L1 and an L2 penalty, so most weights are zero), and a
temperature fitted on a part of the sample that was kept back makes the scores
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.labelled import fit_in_one_task
from tablescope.llm.utf8 import mix

SLOTS = 1 << 14
ORDERS = (1, 2, 3)
#: Documents learned from, about, of each language.
PER_LANGUAGE = 1500
#: Step size, its damping, and the penalties of the regression.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
UNKNOWN = "und"


def counts(text: str) -> np.ndarray:
    """How often each slot's n-grams occur in a text."""
    codes = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    total, rolled = np.zeros(SLOTS, np.int64), np.zeros(len(codes), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        size = len(codes) - order + 1
        if size <= 0:
            break
        rolled = rolled[:size] * np.uint64(0x9E3779B97F4A7C15) + codes[order - 1 :] + np.uint64(1)
        if order in ORDERS:
            total += np.bincount((mix(rolled) >> np.uint64(50)).astype(np.int64), minlength=SLOTS)
    return total


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): log counts times inverse document frequencies, of length 1."""
    found = counts(text)
    slots = np.flatnonzero(found)
    values = np.log1p(found[slots]) * idf[slots]
    return slots, values / max(np.sqrt((values**2).sum()), 1e-12)


def document_frequencies(documents: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents (text) each slot occurs, and the number of documents. Tasks send a row per slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[:-1] += counts(text or "") > 0
                total[-1] += 1
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(total[slots])], ["slot", "n"])

    rows = documents.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(SLOTS + 1)
    for row in rows:  # SLOTS rows and one at most
        frequency[row["slot"]] = row["n"]
    return frequency[:-1], int(frequency[-1])


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(sample: pa.Table, idf: np.ndarray, epochs: int = 3) -> dict:
    """Train on a sample (text, lang) that fits one task's memory; a fifth of it sets the temperature."""
    names = sorted(set(sample["lang"].to_pylist()))
    label = np.array([names.index(v) for v in sample["lang"].to_pylist()])
    rows = [features(t or "", idf) for t in sample["text"].to_pylist()]
    rng = np.random.default_rng(3)
    order = rng.permutation(len(rows))
    kept_back, learned = order[: len(order) // 5], order[len(order) // 5 :]
    z, n = np.zeros((SLOTS, len(names))), np.zeros((SLOTS, len(names)))
    for _ in range(epochs):
        for i in rng.permutation(learned):
            slots, values = rows[i]
            weights = _weights(z[slots], n[slots])
            error = _softmax(values @ weights)
            error[label[i]] -= 1
            slope = values[:, None] * error
            after = n[slots] + slope**2
            z[slots] += slope - (np.sqrt(after) - np.sqrt(n[slots])) / ALPHA * weights
            n[slots] = after
    weights = _weights(z, n)
    margins = np.array([rows[i][1] @ weights[rows[i][0]] for i in kept_back]).reshape(len(kept_back), len(names))
    trials = np.exp(np.linspace(np.log(0.02), np.log(5), 60))
    losses = [-np.log(_softmax(margins / t)[np.arange(len(margins)), label[kept_back]] + 1e-12).sum() for t in trials]
    temperature = float(trials[int(np.argmin(losses))]) if len(margins) else 1.0
    return {"names": names, "weights": weights.astype(np.float32), "idf": idf, "temperature": temperature}


def train(documents: DataFrame, learnable: Column, per_language: int = PER_LANGUAGE) -> dict | None:
    """Learn from ``documents`` (doc_id, text, lang) where ``learnable`` holds and lang is not null; None if there are none.

    Frequencies cover all those documents; the regression takes about ``per_language`` of
    each language, chosen by a hash of the row.
    """
    allowed = documents.filter(learnable & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in allowed.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not sizes:
        return None
    frequency, total = document_frequencies(allowed)
    idf = np.log((total + 1) / (frequency + 1)) + 1
    limit = F.lit(None).cast("long")
    for name, size in sizes.items():
        limit = F.when(F.col("lang") == name, F.lit(min(1 << 20, (per_language << 20) // size))).otherwise(limit)
    drawn = allowed.filter(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 20)) < limit)
    sample = drawn.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    return fit_in_one_task(sample, lambda table: fit(table, idf))


def predict(documents: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """``documents`` with lang_pred and score (its probability), from the whole text.

    Null texts and texts without a letter get lang_pred 'und' and score 0, and so do all
    without a model. Equal probabilities go to the name that sorts first. Other columns
    are kept; columns named like the new ones are replaced.
    """
    kept = documents.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for value in batch.column(batch.schema.get_field_index(text)):
                body = value.as_py() or ""
                if model is None or not any(map(str.isalpha, body)):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                slots, values = features(body, model["idf"])
                odds = _softmax(values @ model["weights"][slots] / model["temperature"])
                names.append(model["names"][int(odds.argmax())])
                scores.append(float(odds.max()))
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)
