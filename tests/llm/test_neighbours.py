import numpy as np

from tablescope.llm import neighbours
from tests_llm_tools import table

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def brute(rows, k, every):
    want = {}
    for i, v in rows:
        if i % every == 0:
            near = sorted((float(np.sqrt(((np.float32(v).astype(float) - np.float32(u).astype(float)) ** 2).sum())), j) for j, u in rows if j != i)
            want[i] = near[:k]
    return want


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 400)
    monkeypatch.setattr(neighbours, "BLOCK", 5)
    rng = np.random.default_rng(1)
    hot = rng.normal(size=16)  # a third of all vectors lie close together
    rows = [(i, (hot + rng.normal(size=16) * 0.01 if i % 3 == 0 else rng.normal(size=16)).tolist()) for i in range(1200)]
    got = {}
    for r in neighbours.nearest(table(spark, SCHEMA, [(i, v, "c", 1) for i, v in rows]), k=10, every=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, 10, 50)
    hits = 0
    for i, near in want.items():
        assert [r for r, *_ in sorted(got[i])] == list(range(1, 11))
        hits += len({j for _, j, _ in got[i]} & {j for _, j in near})
        exact = dict((j, d) for d, j in brute(rows, 1200, 1200 if i else 1).get(i, []))
        assert all(abs(s - exact.get(j, s)) < 1e-9 for _, j, s in got[i])
    assert got.keys() == want.keys() and hits / (10 * len(want)) >= 0.9


def test_footrule():
    rng = np.random.default_rng(2)
    lists = np.array([rng.permutation(12)[:5] for _ in range(30)])
    places = np.full((30, 12), 5)
    np.put_along_axis(places, lists, np.arange(5)[None].repeat(30, 0), 1)
    for i in range(30):
        assert np.array_equal(neighbours.footrules(lists[i], neighbours.inverted(lists, 12), 30), np.abs(places - places[i]).sum(1))


def test_odd_rows(spark):
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (100, [1.0, 1.0])]
    bad = [(None, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, []), (200, [1.0, 2.0, 3.0])]
    df = table(spark, SCHEMA, [(i, v, None, None) for i, v in good + bad])
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in neighbours.nearest(df).collect())
    root = round(2**0.5, 6)
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 1.0), (0, 4, 3, root), (0, 5, 3, root),
                   (100, 1, 0, 1.0), (100, 2, 1, 1.0), (100, 3, 2, 1.0), (100, 4, 3, 1.0), (100, 5, 3, 1.0)]
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(table(spark, SCHEMA, [(100, [1.0, 2.0], None, None)])).count() == 0
