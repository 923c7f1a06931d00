"""Quality: a byte-level convolutional network, written and trained in numpy.

Bytes are embedded, learned filters run over them with a stride of two, and each filter's
largest response is kept in every chunk of 512 bytes. Chunks overlap by half and cover
the whole document. A hidden layer reads each chunk; the largest and the mean of its
units over all chunks give the probability of good quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.labelled import fit_in_one_task, labelled_sample
from tablescope.llm.utf8 import blocks, column_bytes

#: Bytes of half a chunk, filter width, stride, size of the embedding, filters and hidden units.
HALF, WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 256, 6, 2, 6, 24, 16
PAD = 256
#: Labelled documents learned from, of each class.
PER_CLASS = 800
#: Half chunks that the filters run over at once.
ROWS = 128

Model = dict


def halves(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes, one per half chunk with the start of the next half, and the document of each. An empty text has one."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // HALF))
    owner = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (offsets[:-1][owner] + place * HALF)[:, None] + np.arange(HALF + WIDTH - STRIDE)
    inside = at < offsets[1:][owner][:, None]
    padded = np.append(data, np.uint8(0))
    return np.where(inside, padded[np.where(inside, at, len(data))].astype(np.int16), PAD), owner


def responses(model: Model, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest response in each half, and at which step it was."""
    steps = HALF // STRIDE
    best, at = np.empty((len(rows), FILTERS), np.float32), np.empty((len(rows), FILTERS), np.int64)
    for low in range(0, len(rows), ROWS):
        seen = np.ascontiguousarray(model["embed"][rows[low : low + ROWS]]).reshape(len(rows[low : low + ROWS]), -1)
        a, b = seen.strides
        windows = np.lib.stride_tricks.as_strided(seen, (len(seen), steps, WIDTH * EMBED), (a, STRIDE * EMBED * b, b))
        out = windows.reshape(-1, WIDTH * EMBED) @ model["filters"]
        out = out.reshape(len(seen), steps, FILTERS)
        at[low : low + ROWS] = out.argmax(1)
        best[low : low + ROWS] = np.take_along_axis(out, at[low : low + ROWS][:, None], 1)[:, 0]
    return best, at


def _pool(model: Model, best: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """From half chunks to documents; what the way back needs comes along."""
    joined = np.append(owner[1:] == owner[:-1], False)
    after = np.where(joined[:, None], np.roll(best, -1, 0), best)
    single = np.append(True, owner[1:] != owner[:-1]) & ~joined  # a document of one half is one chunk
    chunk = np.flatnonzero(joined | single)
    later = (after > best)[chunk]
    pooled = np.maximum(np.maximum(best, after)[chunk] + model["bias"], 0)
    hidden = np.maximum(pooled @ model["w1"] + model["b1"], 0)
    document = owner[chunk]
    first = np.flatnonzero(np.append(True, document[1:] != document[:-1]))
    count = np.diff(np.append(first, len(document)))
    top, mean = np.maximum.reduceat(hidden, first), np.add.reduceat(hidden, first) / count[:, None]
    logit = np.concatenate([top, mean], 1) @ model["w2"] + model["b2"]
    return logit, chunk, later, pooled, hidden, top, mean, first, count


def logits(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows, owner = halves(data, offsets)
    return _pool(model, responses(model, rows)[0], owner)[0]


def start(seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "embed": draw(PAD + 1, EMBED, scale=0.5), "filters": draw(WIDTH * EMBED, FILTERS, scale=0.25), "bias": np.zeros(FILTERS, np.float32),
        "w1": draw(FILTERS, HIDDEN, scale=0.25), "b1": np.zeros(HIDDEN, np.float32), "w2": draw(2 * HIDDEN, scale=0.25), "b2": np.float32(0),
    }


def slopes(model: Model, rows: np.ndarray, owner: np.ndarray, label: np.ndarray) -> tuple[float, Model]:
    """Log loss of some documents and its gradient."""
    best, at = responses(model, rows)
    logit, chunk, later, pooled, hidden, top, mean, first, count = _pool(model, best, owner)
    probability = 1 / (1 + np.exp(-logit.clip(-30, 30)))
    loss = -np.log(np.where(label, probability, 1 - probability) + 1e-9).mean()
    error = ((probability - label) / len(label)).astype(np.float32)
    document = np.repeat(np.arange(len(first)), count)
    up = error[:, None] * model["w2"]
    is_top = hidden == top[document]
    is_top = is_top / np.add.reduceat(is_top.astype(np.float32), first)[document]
    d_hidden = (is_top * up[document, :HIDDEN] + up[document, HIDDEN:] / count[document][:, None]) * (hidden > 0)
    d_pooled = (d_hidden @ model["w1"].T) * (pooled > 0)
    # Back to the one window of each chunk and filter that gave the largest response.
    source = chunk[:, None] + later
    step = at[source, np.arange(FILTERS)]
    codes = rows[source[..., None], step[..., None] * STRIDE + np.arange(WIDTH)]
    seen = model["embed"][codes].reshape(*codes.shape[:2], -1)
    d_seen = (d_pooled[..., None] * model["filters"].T).reshape(*codes.shape, EMBED)
    d_embed = np.stack([np.bincount(codes.ravel(), weights=d_seen[..., k].ravel(), minlength=PAD + 1) for k in range(EMBED)], 1)
    return loss, {
        "embed": d_embed, "filters": np.einsum("cf,cfk->kf", d_pooled, seen), "bias": d_pooled.sum(0),
        "w1": pooled.T @ d_hidden, "b1": d_hidden.sum(0), "w2": np.concatenate([top, mean], 1).T @ error, "b2": error.sum(),
    }


def _piece(text: np.ndarray, good: float, rng: np.random.Generator) -> np.ndarray:
    """The whole text, or (while training, a third of the time) a piece of it, so that short texts are known too."""
    size = int(rng.integers(20, 250) if good else rng.integers(150, 600))
    if len(text) <= size or rng.random() > 0.35:
        return text
    begin = int(rng.integers(0, len(text) - size))
    return text[begin : begin + size]


def fit(sample: pa.Table, epochs: int = 16, batch: int = 24, rate: float = 0.01) -> Model:
    """Train on a sample (text, label) that fits one task's memory."""
    label = sample["label"].to_numpy().astype(np.float32)
    data, offsets = column_bytes(sample["text"].combine_chunks())
    model, rng = start(), np.random.default_rng(11)
    if label.min() == label.max():
        share = (label.sum() + 0.5) / (len(label) + 1)
        return model | {"w2": model["w2"] * 0, "b2": np.float32(np.log(share / (1 - share)))}
    mean, square = ({k: np.zeros_like(v, np.float64) for k, v in model.items()} for _ in range(2))
    each = -(-len(label) // batch)
    for step in range(1, epochs * each + 1):
        if (step - 1) % each == 0:
            order = rng.permutation(len(label))
        chosen = order[((step - 1) % each) * batch :][:batch]
        parts = [_piece(data[offsets[i] : offsets[i + 1]], label[i], rng) for i in chosen]
        rows, owner = halves(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
        slope = slopes(model, rows, owner, label[chosen])[1]
        now = rate * (1 - 0.95 * step / (epochs * each))
        for k, g in slope.items():
            mean[k], square[k] = 0.9 * mean[k] + 0.1 * g, 0.99 * square[k] + 0.01 * g**2
            move = now * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
            model[k] = (model[k] - move - now * 1e-4 * model[k]).astype(np.float32)
    return model


def train(documents: DataFrame, labels: DataFrame, learnable: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Fit on up to ``per_class`` labelled documents of each class; without labels the score is 0.5 for all."""
    allowed = F.lit(True) if learnable is None else learnable
    model = fit_in_one_task(labelled_sample(documents, labels, "quality", allowed, per_class), fit)
    return model or start() | {"w2": np.zeros(2 * HIDDEN, np.float32)}


def score(documents: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``documents`` with the probability ``name`` (0 to 1) that the text is good, over the whole text.

    Null and empty texts are one chunk of padding. All other columns are kept; one of the
    same name is replaced. Equal texts get equal scores.
    """
    kept = documents.drop(name)
    schema = T.StructType([*kept.schema, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
            found = [logits(model, own, starts) for _, own, starts in blocks(data, offsets)]
            logit = np.concatenate(found).astype(np.float64) if found else np.zeros(0)
            probability = 1 / (1 + np.exp(-logit.clip(-500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probability)], [*batch.schema.names, name])

    return kept.mapInArrow(run, schema)
