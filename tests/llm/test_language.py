import random

import numpy as np
from pyspark.sql import functions as F

from tablescope.llm import language
from tests_llm_tools import table

DOCS = "doc_id long, text string, lang string, score string"


def corpus(n=240):
    rng = random.Random(6)
    kinds = {"aa": ["ba", "bo", "ra", "ty"], "bb": ["shk", "ünd", "ro", "ty"], "cc": ["ба", "ро", "ny", "ty"]}
    rows = []
    for i in range(n):
        lang = sorted(kinds)[i % 3]
        words = ["".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(words), lang, "x"))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    odd = [(None, None, "aa", None), (900, "", None, None), (901, "12 + 3!", "bb", None), (902, "ба " * 50000, None, None), (None, "shkro ündro", None, None)]
    df = table(spark, DOCS, corpus() + odd)
    model = language.train(df, F.col("doc_id") < 160)
    rows = language.predict(df, model).collect()
    got = [r for r in rows if r.doc_id is not None and 160 <= r.doc_id < 240]
    assert len(rows) == 245 and np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    by = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in rows}
    assert by[None, None] == by[900, ""] == by[901, "12 + 3!"] == ("und", 0.0)
    assert by[902, "ба " * 50000][0] == "cc" and by[None, "shkro ündro"][0] == "bb"
    assert all(0 <= r.score <= 1 for r in rows)
    assert (model["weights"] == 0).mean() > 0.5  # sparse


def test_nothing_to_learn(spark):
    df = table(spark, DOCS, corpus(6))
    assert language.train(df, F.lit(False)) is None
    assert {r.lang_pred for r in language.predict(df, None).collect()} == {"und"}
    assert language.predict(df.limit(0), None).count() == 0


def test_frequencies_cover_all(spark):
    rows = corpus(30)
    frequency, total = language.document_frequencies(table(spark, DOCS, rows).select("text").repartition(3))
    assert total == 30 and np.array_equal(frequency, sum((language.counts(r[1]) > 0).astype(int) for r in rows))
