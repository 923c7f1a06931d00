import pytest

from conftest import by, rows, strings
from tablescope.operators import profile, quality


def issues_of(df):
    return quality.check_table(df).issues()


@pytest.mark.parametrize(("missing", "severity"), [(20, None), (21, "WARNING"), (39, "WARNING"), (40, "ERROR")])
def test_null_ratio(spark, missing, severity):
    df = spark.range(100).selectExpr("id", f"CASE WHEN id >= {missing} THEN 1.5 + id END AS v")
    found = [r for r in issues_of(df).collect() if r["rule"] == "null_ratio_threshold"]
    assert [r["severity"] for r in found] == ([severity] if severity else [])
    if found:
        assert found[0]["message"] == f"{int(missing / 100 * 100)}% nulls detected"


@pytest.mark.parametrize(
    ("distinct", "severity"), [(14, "OK"), (15, "WARNING"), (24, "WARNING"), (25, "ERROR"), (60, "ERROR")]
)
def test_cardinality(spark, distinct, severity):
    df = spark.range(120).selectExpr(f"concat('t', id % {distinct}) AS v")
    row = quality.categorical_cardinality(profile.kind_counts(df), profile.distinct_values(df)).first()
    assert row["severity"] == severity and row["distinct_sample"] == min(distinct, 25)
    assert row["sample_limit_hit"] == (distinct >= 25)


@pytest.mark.parametrize(("repeats", "severity"), [(0, None), (1, "WARNING"), (5, "ERROR")])
def test_duplicates(spark, repeats, severity):
    df = spark.range(100).selectExpr(f"CASE WHEN id < {repeats} THEN 99 ELSE id END AS v")
    found = quality.duplicate_issue(profile.duplicate_rows(df)).collect()
    assert [r["severity"] for r in found] == ([severity] if severity else [])
    if severity:
        assert found[0]["message"] == f"Detected {repeats} duplicate rows ({repeats:.2f}% of dataset)"


def test_mixed_and_tie(spark):
    df = strings(spark, mixed=["a", "b", "1"], tie=["1", "true", "x"])
    found = [(r["rule"], r["column"]) for r in issues_of(df).collect()]
    assert found == [("mixed_type", "mixed")]


def test_numeric_range(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id < 15 THEN 1000D ELSE id % 10 END AS v", "1D AS flat")
    found = by(quality.check_table(df).ranges)
    assert found["v"]["violation_count"] == 15 and found["v"]["severity"] == "WARNING"
    assert found["flat"]["violation_count"] == 0 and found["flat"]["lower_bound"] == 1


def test_order_score_and_rule_count(spark):
    df = spark.range(100).selectExpr(
        "CASE WHEN id > 60 THEN id END AS b", "concat('t', id % 30) AS a", "CASE WHEN id % 4 > 0 THEN 'x' ELSE '5' END AS c"
    )
    table = issues_of(df)
    assert [(r["column"], r["rule"], r["severity"]) for r in table.collect()] == [
        ("a", "categorical_cardinality", "ERROR"),
        ("b", "null_ratio_threshold", "ERROR"),
        ("c", "mixed_type", "WARNING"),
        (None, "duplicate_rows", "ERROR"),
    ]
    summary = quality.severity_summary(table).first()
    assert (summary["error_count"], summary["warning_count"], summary["max_severity"], summary["score"]) == (3, 1, "ERROR", 0)
    assert summary["penalty"] == pytest.approx(1.7) and summary["issue_count"] == 4
    assert quality.rules_evaluated(profile.column_facts(df)).first()[0] == 3 * 3 + 1


def test_clean_table(spark):
    df = spark.range(50).selectExpr("id")
    summary = quality.severity_summary(issues_of(df)).first()
    assert summary["score"] == 1 and summary["max_severity"] is None and summary["issue_count"] == 0
    assert rows(quality.non_empty(df)) == [("non_empty", "pass")]
    assert rows(quality.non_empty(df.limit(0))) == [("non_empty", "fail")]
