import math
import random

from conftest import by, rows, strings
from pyspark.sql import functions as F
from tablescope.operators import cells as C
from tablescope.operators import profile as P


def test_counts_types_and_moments(spark):
    df = strings(
        spark,
        tie=["1", "true", "x", None],
        mixed=["a", "b", "c", "2.5"],
        number=["2", "3", "5", "inf"],
        empty=["", "null", "nan", None],
    )
    facts = by(P.column_facts(df))
    assert [facts[c]["inferred_type"] for c in ("tie", "mixed", "number", "empty")] == ["numeric", "text", "numeric", "unknown"]
    assert facts["tie"]["null_ratio"] == 0.25 and facts["tie"]["non_null_count"] == 3
    assert facts["number"]["numeric_count"] == 4 and facts["number"]["count"] == 3 and facts["number"]["non_finite_count"] == 1
    assert math.isclose(facts["number"]["mean"], 10 / 3) and facts["number"]["max"] == 5
    assert facts["mixed"]["mean"] == 2.5
    assert facts["empty"]["mean"] is None and facts["empty"]["null_ratio"] == 1
    assert by(P.moments(df)).keys() == {"tie", "mixed", "number"}
    assert P.completeness(P.kind_counts(df)).first()[0] == (0.75 + 1 + 1 + 0) / 4


def test_single_row_has_no_spread(spark):
    assert by(P.moments(strings(spark, a=["4"])))["a"]["stddev"] == 0.0


def test_table_without_rows(spark):
    df = strings(spark, a=["1"]).limit(0)
    assert P.column_facts(df).count() == 0
    assert P.completeness(P.kind_counts(df)).first()[0] == 0
    assert rows(P.duplicate_rows(df)) == [(0, 0, 0.0)]


def test_wide_tables_use_several_scans(spark):
    names = [f"c {i}`{{}}" for i in range(60)]
    df = spark.range(10).select(*[(F.col("id") + i).alias(n) for i, n in enumerate(names)])
    facts = by(P.column_facts(df))
    assert len(facts) == 60 and facts[names[59]]["min"] == 59
    assert C.cells(df).count() == 600
    assert len(by(P.distinct_values(df))) == 60


def test_distinct_values_against_brute_force(spark):
    random.seed(1)
    unique = [f"v{i:06d}" for i in range(30_000)]
    random.shuffle(unique)
    hot = ["hot" if i % 3 else str(i % 40) + "x" for i in range(30_000)]
    few = [f"k{i % 25}" for i in range(30_000)]
    df = spark.createDataFrame(
        list(zip(unique, hot, few, range(30_000))), "unique string, hot string, few string, number int"
    ).repartition(7)
    found = by(P.distinct_values(df))
    for name, values in (("unique", unique), ("hot", hot), ("few", few)):
        assert found[name]["distinct_sample"] == sorted(set(values))[:25], name
        assert found[name]["distinct_count"] == 25
        assert found[name]["distinct_overflow"] == (len(set(values)) > 25)
    assert found["number"]["distinct_sample"] == [str(i) for i in range(25)]
    exact = {r["column"]: r["distinct"] for r in P.distinct_counts(df).collect()}
    assert exact == {"unique": 30_000, "hot": len(set(hot)), "few": 25, "number": 30_000}
    rough = {r["column"]: r["distinct"] for r in P.distinct_counts(df, approximate=True).collect()}
    assert abs(rough["unique"] - 30_000) < 4_500


def test_duplicates(spark):
    df = strings(spark, a=["1", "1.0", "x", None, "", "x"], b=["a", "a", None, "x", "x", ""])
    # 1 and 1.0 are the same number, None and blank are both missing; ("x", null) is not (null, "x").
    assert rows(P.duplicate_rows(df)) == [(6, 3, 0.5)]
    hot = spark.range(9_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS v")
    assert rows(P.duplicate_rows(hot))[0][:2] == (9_000, 2_999)


def test_first_values_and_rows(spark):
    df = spark.createDataFrame([(i, None if i < 3 else f"t{i}", " x " if i else "") for i in range(20)], "k int, a string, b string")
    found = rows(P.sample_values(df, ["k"], ["a", "b"]))
    assert sorted(found) == [("a", i + 1, f"t{i + 3}") for i in range(5)] + [("b", i + 1, "x") for i in range(5)]
    assert rows(P.preview(df, ["k"]))[:2] == [("0", "", ""), ("1", "", "x")]
    assert [r["user"] for r in P.numeric_row_sample(df.withColumn("user", F.expr("CASE WHEN k > 4 THEN k END")), ["k"], ["user"], 2).collect()] == [5, 6]
    assert P.training_sample(df, ["k"], 4).count() == 4


def test_profile_is_alphabetical_and_complete(spark):
    df = strings(spark, b=["1", "2"], a=[None, None])
    profile = P.column_profile(df, ["b"]).collect()
    assert [r["column"] for r in profile] == ["a", "b"]
    assert profile[0]["distinct_sample"] == [] and profile[0]["sample_values"] == []
    assert profile[1]["sample_values"] == ["1.0", "2.0"]
    assert rows(P.schema_table(P.column_profile(df))) == [("a", "unknown"), ("b", "numeric")]
