import math
import random

import numpy as np
import pytest

from conftest import by, rows, strings
from tablescope.operators import correlate, describe, profile, quick
from tablescope.operators.quantiles import approximate_quantiles, exact_quantiles
from tablescope.operators.cells import numeric_cells

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def _shapes():
    rng = np.random.default_rng(7)
    return {
        "normal": rng.normal(100, 5, 5000),
        "heavy": rng.pareto(0.4, 5000) * 1e6,
        "tiny_range": 1.7e9 + rng.random(5000) * 1e-3,
        "hot": np.where(rng.random(5000) < 0.4, 3.0, rng.normal(0, 1, 5000)),
        "far_point": np.append(rng.random(4999), 1e300),
        "both_ends": np.append(rng.normal(0, 1, 4998), [1e200, -1e200]),
        "two": rng.choice([1.0, 2.0], 5000),
        "constant": np.full(5000, 4.25),
    }


@pytest.mark.parametrize("interval_rows", [1_000_000, 3])
def test_quantiles_are_exact_for_any_shape(spark, interval_rows):
    shapes = _shapes()
    df = spark.createDataFrame(
        [tuple(map(float, r)) for r in zip(*shapes.values())], ", ".join(f"{n} double" for n in shapes)
    ).repartition(5)
    found = {(r["column"], r["p"]): r["q"] for r in exact_quantiles(df, profile.moments(df), PROBS, interval_rows).collect()}
    for name, values in shapes.items():
        ordered = np.sort(values)
        for p in PROBS:
            at = p * (len(values) - 1)
            low, high, part = math.floor(at), math.ceil(at), at - math.floor(at)
            want = ordered[low] if low == high else ordered[low] * (1 - part) + ordered[high] * part
            assert found[name, p] == pytest.approx(want, rel=1e-12, abs=1e-300), (name, p)


def test_quantiles_of_few_values(spark):
    df = strings(spark, a=["2", "3", "5", "x"], b=[None, "7", None, ""])
    table = by(describe.descriptive_table(df))
    assert table["a"]["q5"] == pytest.approx(2.1) and table["a"]["q25"] == 2.5 and table["a"]["q50"] == 3
    assert table["b"]["count"] == 1 and table["b"]["q95"] == 7 and table["b"]["stddev"] == 0
    near = {(r["column"], r["p"]): r["q"] for r in approximate_quantiles(numeric_cells(df), [0.5]).collect()}
    assert near["a", 0.5] == 3


def test_no_numbers_at_all(spark):
    df = strings(spark, a=["x", "y"])
    assert describe.descriptive_table(df).count() == 0
    assert describe.outliers(df).count() == 0
    assert correlate.all_correlations(df).count() == 0
    assert describe.histogram(df, describe.histogram_bins(describe.descriptive_table(df))).count() == 0


def test_outliers(spark):
    values = [0.0] * 50 + [1.0] * 50 + [100.0, -100.0, 100.0]
    df = spark.createDataFrame([(v, 1.0) for v in values], "v double, flat double")
    found = rows(describe.outliers(df))
    assert [(c, p, v) for c, p, v, _ in found] == [("v", 1, -100.0), ("v", 2, 100.0), ("v", 3, 100.0)]
    mean, sd = np.mean(values), np.std(values, ddof=1)
    assert found[0][3] == pytest.approx((mean + 100) / sd)
    assert len(rows(describe.outliers(df, limit=1))) == 1


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    shapes = {"n": rng.normal(0, 1, 2000), "steps": rng.integers(0, 30, 2000) / 10, "flat": np.full(2000, 2.0)}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*shapes.values())], "n double, steps double, flat double")
    bins = describe.histogram_bins(describe.descriptive_table(df))
    number = {r["column"]: r["bins"] for r in bins.collect()}
    found = sorted(rows(describe.histogram(df, bins)))
    for name, values in shapes.items():
        sizes, edges = np.histogram(values, bins=number[name])
        mine = [r for r in found if r[0] == name]
        assert [r[4] for r in mine] == sizes.tolist(), name
        assert [r[2] for r in mine] + [mine[-1][3]] == pytest.approx(edges.tolist())


def test_box_stats(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 40.0, -30.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    box = by(describe.box_stats(df, describe.descriptive_table(df)))["v"]
    q25, q75 = np.quantile(values, [0.25, 0.75])
    assert (box["q25"], box["q75"], box["whisker_low"], box["whisker_high"], box["fliers"]) == (q25, q75, 1.0, 5.0, 2)


def test_correlations_use_complete_pairs(spark):
    random.seed(5)
    data = []
    for i in range(300):
        a = random.gauss(1e9, 1)
        data.append((a, 2 * a + random.random(), None if i % 3 else random.random(), 5.0, 1.0 if i % 3 else 2.0))
    df = spark.createDataFrame(data, "a double, b double, c double, flat double, half double")
    found = {(r["left"], r["right"]): r for r in correlate.all_correlations(df).collect()}
    array = np.array([[np.nan if v is None else v for v in row] for row in data])
    for (left, right), r in found.items():
        x, y = (array[:, "abc".index(n) if n in "abc" else 4] for n in (left, right))
        both = ~np.isnan(x) & ~np.isnan(y)
        assert r["sample_size"] == both.sum()
        assert r["correlation"] == pytest.approx(np.corrcoef(x[both], y[both])[0, 1], abs=1e-6)
    # ``flat`` never varies, ``half`` does not vary where ``c`` is known.
    assert set(found) == {("a", "b"), ("a", "c"), ("a", "half"), ("b", "c"), ("b", "half")}


def test_correlations_over_many_blocks(spark):
    rng = np.random.default_rng(2)
    array = rng.normal(size=(200, 19))
    df = spark.createDataFrame([tuple(map(float, r)) for r in array], ", ".join(f"x{i:02d} double" for i in range(19)))
    found = correlate.all_correlations(df).collect()
    assert len(found) == 19 * 18 // 2
    want = np.corrcoef(array.T)
    for r in found:
        assert r["correlation"] == pytest.approx(want[int(r["left"][1:]), int(r["right"][1:])])
    top = correlate.top_correlations(correlate.all_correlations(df), 3).collect()
    assert [abs(r["correlation"]) for r in top] == sorted((abs(r["correlation"]) for r in found), reverse=True)[:3]
    matrix = correlate.correlation_matrix(correlate.all_correlations(df), describe.numeric_ranking(profile.moments(df), 10))
    assert matrix.count() == 100


def test_many_columns_take_one_scan(spark, tmp_path):
    width = 300
    spark.range(60).selectExpr(*[f"sin(id * {i + 1}) + id * {i % 3} AS x{i:03d}" for i in range(width)]).write.parquet(f"{tmp_path}/wide")
    df = spark.read.parquet(f"{tmp_path}/wide")
    names = df.columns
    stats = spark.createDataFrame([(n, 60, 60, 1.0, 2.0, -1.0, 1.0) for n in names], "column string, rows long, count long, mean double, stddev double, min double, max double")
    pairs = correlate.all_correlations(df, names, stats)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    found = {(r["left"], r["right"]): r["correlation"] for r in pairs.collect()}
    assert len(found) == width * (width - 1) // 2
    want = df.selectExpr("corr(x000, x002) AS a", "corr(x010, x200) AS b").first()
    assert abs(found["x000", "x002"] - want["a"]) < 1e-9 and abs(found["x010", "x200"] - want["b"]) < 1e-9


def test_quick_profile(spark):
    n = 250
    df = strings(
        spark,
        key=[f"{i:04d}" for i in range(n)],
        amount=[f"{i * 1000:,}" if i % 6 else "x" for i in range(n)],
        late=["word" if i < 200 else "1" for i in range(n)],
        blank=[""] * n,
    )
    types = {r["column"]: r["type"] for r in quick.column_types(df, ["key"]).collect()}
    assert types == {"key": "number", "amount": "number", "late": "string", "blank": "string"}
    frame = quick.lenient_frame(df, ["amount", "blank"])
    stats = by(quick.stats_table(frame))
    assert stats["blank"]["count"] == 0 and stats["blank"]["mean"] is None
    assert stats["amount"]["max"] == 248_000 or stats["amount"]["max"] == 249_000
    assert stats["amount"]["count"] == sum(1 for i in range(n) if i % 6)
