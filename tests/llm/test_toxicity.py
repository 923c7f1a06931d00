import random

import numpy as np
import pyarrow as pa

from tablescope.llm import toxicity
from tablescope.llm.utf8 import column_bytes
from tests_llm_tools import table

DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, toxic int, text string"


def corpus(n=300):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["zonkwort", "Übelwicht"])
        docs.append((i, " ".join(text), "x"))
        labels.append((i, int(bad), "clash"))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    docs += [(None, None, None), (900, None, "s"), (901, "", "s"), (902, "zonkwort " * 20000, "s"), (902, "zonkwort " * 20000, "s")]
    documents, marks = table(spark, DOCS, docs), table(spark, LABELS, [*labels, (None, 1, None), (5, None, None)])
    model = toxicity.train(documents, marks.filter("doc_id < 200"))
    rows = toxicity.score(documents, model).collect()
    assert len(rows) == len(docs)
    got = {r.doc_id: r.score for r in rows}
    held = [i for i in range(200, 300)]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95
    assert got[902] > 0.5 and got[900] == got[901] == got[None] and all(0 <= r.score <= 1 for r in rows)


def test_no_or_one_class(spark):
    docs, labels = corpus(20)
    documents = table(spark, DOCS, docs)
    none = toxicity.train(documents, table(spark, LABELS, []))
    one = toxicity.train(documents, table(spark, LABELS, [(i, 1, "") for i in range(9)]))
    assert {r.score for r in toxicity.score(documents, none).collect()} == {0.5}
    assert min(r.score for r in toxicity.score(documents, one).collect()) > 0.8
    assert toxicity.score(documents.limit(0), none).count() == 0


def test_ngrams_stay_within_rows():
    data, offsets = column_bytes(pa.array(["abcdef", None, "", "abcdefg"]))
    for order, (hashes, inside) in zip(toxicity.ORDERS, toxicity.ngrams(data, offsets)):
        assert inside.sum() == max(0, 7 - order) + max(0, 8 - order)
        if order <= 6:
            assert hashes[0] == hashes[6]


def test_short_texts(spark):
    """Texts of 0 to 9 bytes, as the only row, as the only labelled one and among others."""
    for n in range(10):
        text = "abcdefghij"[:n]
        data, offsets = column_bytes(pa.array([text]))
        assert [int(inside.sum()) for _, inside in toxicity.ngrams(data, offsets)] == [max(0, n - order + 1) for order in toxicity.ORDERS]
        sample = pa.table({"text": [text, "other words", text, text, "more of it"], "label": [1, 0, 1, 1, 0]})
        model = toxicity.fit(sample)
        slots = np.ones(1 << toxicity.SLOT_BITS, bool)
        alone = toxicity.margins(model, data, offsets, slots)
        both = toxicity.margins(model, *column_bytes(pa.array(["x", text, "some words"])), slots)
        assert abs(alone[0] - both[1]) < 1e-12
    docs = [(n, "abcdefghij"[:n], "s") for n in range(10)]
    labels = [(n, n % 2, "c") for n in range(10)]
    model = toxicity.train(table(spark, DOCS, docs), table(spark, LABELS, labels))
    assert toxicity.score(table(spark, DOCS, docs).repartition(10), model).count() == 10


def plain_hash(gram):
    """The hash of an n-gram, number by number."""
    mask = (1 << 64) - 1
    h = 0
    for byte in gram:
        h = (h * 0x9E3779B97F4A7C15 + byte + 1) & mask
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = ((h ^ (h >> 33)) * factor) & mask
    return h ^ (h >> 33)


def test_scores_equal_sets_of_ngrams(spark):
    docs, labels = corpus(120)
    documents = table(spark, DOCS, docs)
    model = toxicity.train(documents, table(spark, LABELS, labels))
    weight = dict(zip(model["hashes"].tolist(), model["weights"].tolist()))
    got = {r.doc_id: r.score for r in toxicity.score(documents, model).collect()}
    for key, text, _ in docs:
        data = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode()
        grams = {data[i : i + n] for n in toxicity.ORDERS for i in range(len(data) - n + 1)}
        margin = model["bias"] + sum(weight.get(plain_hash(g), 0.0) for g in grams)
        assert abs(got[key] - 1 / (1 + np.exp(-margin))) < 1e-9
