"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of a text's UTF-8 bytes (A-Z lower-cased, runs between words
kept as they are) that occur in it at all. Each n-gram's value is its log-count ratio
between toxic and other texts; a logistic regression on these values gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.labelled import fit_in_one_task, labelled_sample
from tablescope.llm.utf8 import blocks, column_bytes, lower_table, mix

#: Lengths of the n-grams in bytes.
ORDERS = (4, 6, 8)
#: Labelled documents learned from, of each class.
PER_CLASS = 1500
#: N-grams kept as features: those of the largest weight by ratio and frequency.
FEATURES = 1 << 13
SLOT_BITS = 20
COUNT_BITS = 22


#: hashes: sorted n-gram hashes; weights: one for each; bias.
Model = dict


def model_of(hashes: np.ndarray, weights: np.ndarray, bias: float) -> Model:
    return {"hashes": hashes, "weights": weights, "bias": bias}


def ngrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashes of the n-grams that start at each byte, and whether they lie within one row."""
    data = lower_table()[data].astype(np.uint64) + np.uint64(1)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes to the row's end
    rolled, have = np.zeros(len(data), np.uint64), 0
    for order in ORDERS:
        while have < order:  # h(n) = h(n - 1) * p + next byte
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15)
            rolled[: max(0, len(data) - have)] += data[have:]
            have += 1
        yield mix(rolled), left >= order


def _distinct(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """The distinct n-grams of each text that has any."""
    data, offsets = column_bytes(texts)
    for row in range(len(offsets) - 1):
        own = data[offsets[row] : offsets[row + 1]]
        if len(own):
            yield row, np.unique(np.concatenate([h[inside] for h, inside in ngrams(own, np.array([0, len(own)]))]))


def _worth(toxic: np.ndarray, other: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log-count ratio of features seen in so many texts, and the ratio times the feature's spread."""
    ratio = np.log((toxic + 0.5) / (label.sum() + 1)) - np.log((other + 0.5) / ((~label).sum() + 1))
    rate = (toxic + other) / len(label)
    return ratio, np.where(toxic + other >= 3, np.abs(ratio) * np.sqrt((rate * (1 - rate)).clip(0)), 0)


def _candidates(texts: pa.Array, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the n-grams that may become features.

    N-grams are first counted in a table of fixed size by the first bits of their hash, so
    the sample's n-grams are never held at once; only those in its best slots are kept.
    """
    shift, counts = np.uint64(64 - COUNT_BITS), np.zeros((2, 1 << COUNT_BITS), np.int32)
    for row, hashes in _distinct(texts):
        np.add.at(counts[int(label[row])], (hashes >> shift).astype(np.int64), 1)
    worth = np.empty(1 << COUNT_BITS, np.float32)
    for low in range(0, len(worth), 1 << 18):  # in pieces, so no table of 64-bit numbers is held
        piece = slice(low, low + (1 << 18))
        worth[piece] = _worth(counts[1, piece], counts[0, piece], label)[1]
    best = np.argpartition(worth, len(worth) - 4 * FEATURES)[-4 * FEATURES :]
    good = np.zeros(1 << COUNT_BITS, bool)
    good[best] = True
    rows, kept = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for row, hashes in _distinct(texts):
        kept.append(hashes[good[(hashes >> shift).astype(np.int64)]])
        rows.append(np.full(len(kept[-1]), row))
    return np.concatenate(rows), np.concatenate(kept)


def fit(sample: pa.Table, steps: int = 200, penalty: float = 1e-5) -> Model:
    """Fit on a sample (text, label) that fits one task's memory. One class alone gives a constant score."""
    label = sample["label"].to_numpy().astype(bool)
    share = (label.sum() + 0.5) / (len(label) + 1)
    prior = float(np.log(share / (1 - share)))
    if label.all() or not label.any():
        return model_of(np.zeros(0, np.uint64), np.zeros(0), prior)
    rows, hashes = _candidates(sample["text"].combine_chunks(), label)
    known, column = np.unique(hashes, return_inverse=True)
    toxic = np.bincount(column, weights=label[rows], minlength=len(known))
    ratio, worth = _worth(toxic, np.bincount(column, minlength=len(known)) - toxic, label)
    kept = np.sort(np.argsort(-worth, kind="stable")[:FEATURES])
    kept = kept[worth[kept] > 0]
    place = np.full(len(known), -1)
    place[kept] = np.arange(len(kept))
    inside = place[column] >= 0
    rows, column, value = rows[inside], place[column[inside]], ratio[column[inside]]
    # Accelerated gradient descent on the penalised log loss, in which the classes weigh the same.
    balance = np.where(label, 0.5 / label.sum(), 0.5 / (~label).sum())
    forward = lambda w: np.bincount(rows, weights=value * w[column], minlength=len(label))
    back = lambda e: np.bincount(column, weights=value * e[rows], minlength=len(kept))
    lead = np.ones(len(kept))  # to the largest eigenvalue, for the step size
    for _ in range(15):
        lead = back(balance * forward(lead / np.linalg.norm(lead)))
    rate = 1 / (0.25 * (1.5 * np.linalg.norm(lead) + 1) + penalty)
    weights, bias = np.zeros(len(kept)), 0.0
    ahead, ahead_bias = weights, bias
    for step in range(steps):
        margin = forward(ahead) + ahead_bias
        error = (1 / (1 + np.exp(-margin.clip(-50, 50))) - label) * balance
        new, new_bias = ahead - rate * (back(error) + penalty * ahead), ahead_bias - rate * error.sum()
        pull = step / (step + 3)
        ahead, ahead_bias = new + pull * (new - weights), new_bias + pull * (new_bias - bias)
        weights, bias = new, new_bias
    weights = weights * ratio[kept]
    some = np.abs(weights) > 1e-6 * max(np.abs(weights).max(initial=0), 1e-12)
    return model_of(known[kept][some], weights[some], float(bias))


def margins(model: Model, data: np.ndarray, offsets: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The model's margin of every row; ``slots`` marks the places of its hashes by their first bits."""
    known, out = model["hashes"], np.full(len(offsets) - 1, model["bias"])
    if not len(known):
        return out
    rows, columns = [], []
    for hashes, inside in ngrams(data, offsets):
        at = np.flatnonzero(slots[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] & inside)
        place = np.searchsorted(known, hashes[at]).clip(max=len(known) - 1)
        hit = known[place] == hashes[at]
        rows.append(np.searchsorted(offsets, at[hit], "right") - 1)
        columns.append(place[hit])
    pairs = np.unique(np.concatenate(rows) * len(known) + np.concatenate(columns))
    return out + np.bincount(pairs // len(known), weights=model["weights"][pairs % len(known)], minlength=len(out))


def train(documents: DataFrame, labels: DataFrame, learnable: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Fit on up to ``per_class`` labelled documents of each class; without labels the score is 0.5 for all."""
    allowed = F.lit(True) if learnable is None else learnable
    model = fit_in_one_task(labelled_sample(documents, labels, "toxic", allowed, per_class), fit)
    return model or model_of(np.zeros(0, np.uint64), np.zeros(0), 0.0)


def score(documents: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``documents`` with the probability ``name`` (0 to 1) that the text is toxic, over the whole text.

    Null and empty texts get the score of a text without any known n-gram. All other
    columns are kept; one of the same name is replaced. Equal texts get equal scores.
    """
    kept = documents.drop(name)
    schema = T.StructType([*kept.schema, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << SLOT_BITS, bool)
        slots[(model["hashes"] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = True
        for batch in batches:
            data, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
            found = [margins(model, own, starts, slots) for _, own, starts in blocks(data, offsets)]
            margin = np.concatenate(found) if found else np.zeros(0)
            probability = 1 / (1 + np.exp(-margin.clip(-500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probability)], [*batch.schema.names, name])

    return kept.mapInArrow(run, schema)
