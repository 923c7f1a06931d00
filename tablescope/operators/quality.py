"""Data-quality rules over column facts: issues, severities and a score."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.values import number_literal
from tablescope.operators.cells import aggregate_numbers
from tablescope.operators.profile import column_facts, distinct_values, duplicate_rows
from tablescope.session import per_column, pinned

# Thresholds and weights of the rules.
NULL_RATIO_WARNING = 0.2
NULL_RATIO_ERROR = 0.4
RANGE_SIGMAS = 3
RANGE_WARNING_RATIO = 0.01
RANGE_ERROR_RATIO = 0.05
CARDINALITY_WARNING = 15
CARDINALITY_ERROR = 50
DUPLICATE_ERROR_RATIO = 0.05
SEVERITY_WEIGHTS = {"ERROR": 0.5, "WARNING": 0.2, "INFO": 0.05}

_ISSUE = "struct({seq} AS seq, '{rule}' AS rule, {severity} AS severity, {value} AS value, {message} AS message)"


def numeric_range(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Bounds and violations for every column whose values are mostly numeric.

    A value violates when it lies more than three standard deviations from the mean.
    """
    varied = "stddev > 0 AND stddev < double('inf')"
    bounds = pinned(
        facts.where("inferred_type = 'numeric' AND count > 0").selectExpr(
            "column",
            f"CASE WHEN {varied} THEN mean - {RANGE_SIGMAS} * stddev ELSE min END AS lower_bound",
            f"CASE WHEN {varied} THEN mean + {RANGE_SIGMAS} * stddev ELSE max END AS upper_bound",
            "min AS min_observed",
            "max AS max_observed",
            "count AS sample_count",
        )
    )
    outside = {
        name: {
            "violation_count": f"count_if({{x}} < {number_literal(b['lower_bound'])} OR {{x}} > {number_literal(b['upper_bound'])})"
        }
        for name, b in per_column(bounds).items()
    }
    if outside:
        counted = bounds.join(F.broadcast(aggregate_numbers(df, outside)), "column")
    else:
        counted = bounds.withColumn("violation_count", F.lit(0).cast("bigint"))
    return counted.selectExpr("*", "violation_count / sample_count AS violation_ratio").selectExpr(
        "*",
        f"CASE WHEN violation_ratio >= {RANGE_ERROR_RATIO}D THEN 'ERROR' "
        f"WHEN violation_ratio >= {RANGE_WARNING_RATIO}D THEN 'WARNING' ELSE 'OK' END AS severity",
    )


def categorical_cardinality(facts: DataFrame, distinct: DataFrame) -> DataFrame:
    """Distinct values (counted up to the tracking limit) of text and boolean columns."""
    observed = facts.where("inferred_type IN ('text', 'boolean')").join(F.broadcast(distinct), "column")
    return observed.selectExpr(
        "column",
        "distinct_count AS distinct_sample",
        "non_null_count",
        "distinct_count / non_null_count AS ratio",
        "distinct_count = 25 AS sample_limit_hit",
    ).selectExpr(
        "*",
        f"CASE WHEN distinct_sample >= {CARDINALITY_ERROR} "
        f"OR (sample_limit_hit AND distinct_sample >= {CARDINALITY_WARNING}) THEN 'ERROR' "
        f"WHEN distinct_sample >= {CARDINALITY_WARNING} THEN 'WARNING' ELSE 'OK' END AS severity",
    )


def duplicate_severity(duplicates: DataFrame) -> DataFrame:
    return duplicates.selectExpr(
        "*",
        f"CASE WHEN duplicates = 0 THEN 'OK' WHEN ratio >= {DUPLICATE_ERROR_RATIO}D THEN 'ERROR' "
        "ELSE 'WARNING' END AS severity",
    )


def column_checks(facts: DataFrame, ranges: DataFrame, cardinality: DataFrame) -> DataFrame:
    """One row per column with everything the rules look at. All inputs have one row per column."""
    r = ranges.selectExpr(
        "column", "sample_count", "violation_count", "violation_ratio", "severity AS range_severity"
    )
    c = cardinality.selectExpr(
        "column", "distinct_sample", "sample_limit_hit", "severity AS cardinality_severity"
    )
    return facts.join(F.broadcast(r), "column", "left").join(F.broadcast(c), "column", "left")


def null_ratio_issue_sql() -> str:
    return "CASE WHEN null_ratio > {w}D THEN {issue} END".format(
        w=NULL_RATIO_WARNING,
        issue=_ISSUE.format(
            seq=1,
            rule="null_ratio_threshold",
            severity=f"CASE WHEN null_ratio < {NULL_RATIO_ERROR}D THEN 'WARNING' ELSE 'ERROR' END",
            value="null_ratio",
            message="concat(int(null_ratio * 100), '% nulls detected')",
        ),
    )


def mixed_type_issue_sql() -> str:
    return "CASE WHEN inferred_type = 'text' AND numeric_count > 0 THEN {issue} END".format(
        issue=_ISSUE.format(
            seq=2,
            rule="mixed_type",
            severity="'WARNING'",
            value="double(numeric_count)",
            message="'Mixed types detected; values parsed as both text and numeric.'",
        ),
    )


def numeric_range_issue_sql() -> str:
    return "CASE WHEN range_severity IN ('WARNING', 'ERROR') THEN {issue} END".format(
        issue=_ISSUE.format(
            seq=3,
            rule="numeric_range",
            severity="range_severity",
            value="violation_ratio",
            message="concat(violation_count, ' of ', sample_count, ' sampled values fall outside expected range')",
        ),
    )


def cardinality_issue_sql() -> str:
    return "CASE WHEN cardinality_severity IN ('WARNING', 'ERROR') THEN {issue} END".format(
        issue=_ISSUE.format(
            seq=4,
            rule="categorical_cardinality",
            severity="cardinality_severity",
            value="double(distinct_sample)",
            message="concat('Observed ', distinct_sample, ' distinct values across ', non_null_count, ' non-null rows', "
            "CASE WHEN sample_limit_hit THEN '; sample limit reached, true cardinality may be higher' ELSE '' END)",
        ),
    )


def column_issues(checks: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Issues of the given per-column rules, all from one projection."""
    found = f"filter(array({', '.join(rules)}), i -> i IS NOT NULL)"
    return checks.selectExpr("column", f"inline({found})").select(
        "rule", "severity", "column", "value", "message", "seq"
    )


def duplicate_issue(duplicates: DataFrame) -> DataFrame:
    return duplicate_severity(duplicates).where("duplicates > 0").selectExpr(
        "'duplicate_rows' AS rule",
        "severity",
        "cast(NULL AS STRING) AS column",
        "ratio AS value",
        "concat('Detected ', duplicates, ' duplicate rows (', format_string('%.2f', 100 * ratio), '% of dataset)') AS message",
        "5 AS seq",
    )


def issues_table(checks: DataFrame, duplicates: DataFrame) -> DataFrame:
    """All issues: columns alphabetical, rules in fixed order, duplicate rows last."""
    rules = [null_ratio_issue_sql(), mixed_type_issue_sql(), numeric_range_issue_sql(), cardinality_issue_sql()]
    found = column_issues(checks, rules).unionByName(duplicate_issue(duplicates))
    return found.orderBy(F.col("column").asc_nulls_last(), "seq")


def rules_evaluated(facts: DataFrame) -> DataFrame:
    """How many rule checks ran: two per column, one more by type, one for duplicate rows."""
    per_column = (
        "2 + CASE WHEN inferred_type = 'numeric' AND count > 0 THEN 1 "
        "WHEN inferred_type IN ('text', 'boolean') THEN 1 ELSE 0 END"
    )
    return facts.selectExpr(
        f"coalesce(sum({per_column}), 0L) + CASE WHEN max(rows) > 0 THEN 1 ELSE 0 END AS rules_evaluated"
    )


def severity_summary(issues: DataFrame) -> DataFrame:
    """One row: issues per severity, the worst severity, the penalty and the score."""
    weights = " ".join(f"WHEN '{s}' THEN {w}D" for s, w in SEVERITY_WEIGHTS.items())
    counted = issues.selectExpr(
        *[f"count_if(severity = '{s}') AS {s.lower()}_count" for s in SEVERITY_WEIGHTS],
        f"coalesce(sum(CASE severity {weights} ELSE 0D END), 0D) AS penalty",
        "count(1) AS issue_count",
    )
    worst = " ".join(f"WHEN {s.lower()}_count > 0 THEN '{s}'" for s in SEVERITY_WEIGHTS)
    return counted.selectExpr(
        "*", f"CASE {worst} END AS max_severity", "greatest(0D, 1 - least(1D, penalty)) AS score"
    )


def non_empty(df: DataFrame) -> DataFrame:
    """Pass when the table has at least one row and one column."""
    columns = len(df.columns)
    return df.limit(1).selectExpr(
        "'non_empty' AS name", f"CASE WHEN count(1) > 0 AND {columns} > 0 THEN 'pass' ELSE 'fail' END AS status"
    )


class Checked(NamedTuple):
    """What the rules of a table are decided by; all but the rows behind them is one row per column."""

    facts: DataFrame
    checks: DataFrame
    duplicates: DataFrame
    ranges: DataFrame
    cardinality: DataFrame

    def issues(self) -> DataFrame:
        return issues_table(self.checks, self.duplicates)


def check_table(df: DataFrame) -> Checked:
    """Run all checks of a table. The facts come first, from one pass, and guide the rest."""
    facts = pinned(column_facts(df))
    # Issues, scores and sentences all start from these: a row per column each, and one for duplicates.
    ranges = pinned(numeric_range(df, facts))
    distinct = pinned(distinct_values(df).select("column", "distinct_count", "distinct_overflow"))
    cardinality = categorical_cardinality(facts, distinct)
    return Checked(facts, column_checks(facts, ranges, cardinality), pinned(duplicate_rows(df)), ranges, cardinality)
