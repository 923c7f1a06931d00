import random
import re

import duckdb

from tablescope.llm import licenses
from tests_llm_tools import table

SCHEMA = "doc_id long, text string, row long, template string, label int"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    w = words(text)
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


NOTICE = licenses.NOTICES["mit"]


def fixture():
    rng = random.Random(3)
    bits = ["the", "mit", "license", "apache", "gnu", "general", "public", "cc", "by", "MIT License", "CC-BY", "é", "K", "kind", "x", "\n", "sa", "of"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    notice = NOTICE.split()
    near = notice[:20] + ["really"] + notice[20:30] + notice[32:]
    texts += [None, "", " ", "MIT", "MIT License", "mit\x00license", "Apache License", "GNU GENERAL PUBLIC LICENSE " * 3, "CC BY-NC 4.0.", "İ cc by Kelvin",
              NOTICE, "words before " + " ".join(near) + " and after", " ".join(notice[:25]), " ".join(notice[::-1]), NOTICE + " " + NOTICE,
              NOTICE + " other words " * 40 + NOTICE, "word " * 60000 + "mit license"]
    return [(i, t, 5, "x", 1) for i, t in enumerate(texts)] + [(None, None, 1, "x", 1), (None, "cc by", 1, "x", 1), (3, texts[3], 1, "y", 2), (7, "cc by", 1, None, None)]


def test_base_places_equal_brute_force(spark):
    rows = fixture()
    got = licenses.scan(table(spark, SCHEMA, rows)).collect()
    want = [(r[0], *base(r[1])) for r in rows]
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.scan(table(spark, SCHEMA, [])).count() == 0


def test_notices(spark):
    rows = fixture()
    got = {r.doc_id: r for r in licenses.scan(table(spark, SCHEMA, rows)).collect()}
    of = {t: i for i, t, *_ in rows[:-4]}
    assert (got[of[NOTICE]].labels, got[of[NOTICE]].score, got[of[NOTICE]].n_base) == ("mit", 1.0, 0)
    notice = NOTICE.split()
    # One word more and two fewer: hits on three neighbouring diagonals are one span.
    near = next(got[i] for t, i in of.items() if t and t.startswith("words before"))
    assert near.labels == "mit" and 0.75 <= near.score < 1
    part = got[of[" ".join(notice[:25])]]
    assert part.labels == "" and part.score == 25 / len(notice)
    assert got[of[" ".join(notice[::-1])]].score == 0
    assert got[of["CC BY-NC 4.0."]].labels == "cc-by,cc-by-nc"
    assert all(got[i].labels == "mit" for t, i in of.items() if t and t.startswith(NOTICE))


def test_equal_to_sql(spark):
    rows = fixture()
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [(r[0], r[1]) for r in rows if not r[1] or "\x00" not in r[1]])
    want = db.execute(licenses.oracle()).fetchall()
    got = [tuple(r) for r in licenses.scan(table(spark, SCHEMA, [r for r in rows if not r[1] or "\x00" not in r[1]])).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_python_on_the_main_path(spark):
    plan = licenses.scan(table(spark, SCHEMA, fixture()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
