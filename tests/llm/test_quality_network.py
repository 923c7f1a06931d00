import random

import numpy as np
import pyarrow as pa

from tablescope.llm import quality
from tablescope.llm.utf8 import column_bytes
from tests_llm_tools import table

DOCS = "doc_id long, text string, score string"


def corpus(n):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 150))]
        if i % 2:
            words = [w + "###" for w in words] if i % 4 == 1 else [w for w in words[:8] for _ in range(12)]
        rows.append((i, " ".join(words), "x"))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(400)
    odd = [(None, None, None), (900, "", None), (901, "word " * 60000, None), (902, rows[0][1], None), (902, rows[0][1], None)]
    documents = table(spark, DOCS, rows + odd)
    labels = table(spark, "doc_id long, quality int, text string", [(i, 1 - i % 2, "c") for i in range(280)] + [(None, 1, None), (3, None, None)])
    scored = quality.score(documents, quality.train(documents, labels)).collect()
    assert len(scored) == len(rows) + len(odd)
    got = {r.doc_id: r.score for r in scored}
    assert np.mean([(got[i] >= 0.5) == (i % 2 == 0) for i in range(280, 400)]) > 0.95
    assert got[None] == got[900] and abs(got[902] - got[0]) < 1e-5 and all(0 <= r.score <= 1 for r in scored)
    none = quality.train(documents, labels.limit(0))
    assert {r.score for r in quality.score(documents, none).collect()} == {0.5}
    assert quality.score(documents.limit(0), none).count() == 0


def test_gradient_and_coverage():
    rng = np.random.default_rng(1)
    model = quality.start()
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in (0, 3, 256, 257, 700, 5000)]
    data, offsets = column_bytes(pa.array(texts))
    rows, owner = quality.halves(data, offsets)
    assert list(np.bincount(owner)) == [1, 1, 1, 2, 3, 20]
    label = np.array([1, 0, 1, 0, 1, 0], np.float32)
    loss, slope = quality.slopes(model, rows, owner, label)
    for name, at in (("w1", (2, 3)), ("w2", (4,)), ("filters", (5, 6)), ("embed", (97, 2))):
        moved = {k: v.copy() if hasattr(v, "copy") else v for k, v in model.items()}
        moved[name][at] += 1e-2
        up = quality.slopes(moved, rows, owner, label)[0]
        moved[name][at] -= 2e-2
        down = quality.slopes(moved, rows, owner, label)[0]
        assert abs((up - down) / 2e-2 - slope[name][at]) < 2e-3 + 0.1 * abs(slope[name][at])
    one = [quality.logits(model, *column_bytes(pa.array([t])))[0] for t in texts]
    assert np.allclose(one, quality.logits(model, data, offsets), atol=1e-4)
