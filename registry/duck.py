"""Building blocks of the check SQL in DuckDB's dialect."""

from __future__ import annotations

from registry.inputs import COLUMNS, duck_source

NUMBER = "([+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity))"
SPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def strip(x: str) -> str:
    return f"trim({x}, '{SPACE}')"


def kind(x: str, family: str) -> str:
    if family != "string":
        return f"CASE WHEN {x} IS NULL THEN 'null' ELSE '{'text' if family == 'time' else 'numeric'}' END"
    s = strip(x)
    return (
        f"CASE WHEN {x} IS NULL OR {s} IN ('', 'null', 'NULL') OR lower({s}) IN ('nan', '+nan', '-nan') THEN 'null' "
        f"WHEN lower({s}) IN ('true', 'false') THEN 'boolean' "
        f"WHEN regexp_full_match({s}, '{NUMBER}') THEN 'numeric' ELSE 'text' END"
    )


def number(x: str, family: str) -> str:
    if family == "time":
        return "CAST(NULL AS DOUBLE)"
    if family == "string":
        s = strip(x)
        return f"CASE WHEN regexp_full_match({s}, '{NUMBER}') AND isfinite(TRY_CAST({s} AS DOUBLE)) THEN TRY_CAST({s} AS DOUBLE) END"
    return f"CAST({x} AS DOUBLE)"


def text(x: str, family: str) -> str:
    if family != "string":
        return f"CAST({x} AS VARCHAR)"
    k = kind(x, family)
    return (
        f"CASE {k} WHEN 'text' THEN {strip(x)} WHEN 'boolean' THEN lower({strip(x)}) "
        f"WHEN 'numeric' THEN CAST({number(x, family)} AS VARCHAR) END"
    )


def cells(name: str, columns: list[str] | None = None, want: tuple[str, ...] = ("kind", "num")) -> str:
    """A query giving one row per cell."""
    make = {"kind": kind, "num": number, "text": text}
    parts = []
    for column, family in COLUMNS[name].items():
        if columns is None or column in columns:
            fields = ", ".join(f"{make[w](column, family)} AS {w}" for w in want)
            parts.append(f"SELECT '{column}' AS \"column\", {fields} FROM base")
    return f"WITH base AS (SELECT * FROM {duck_source(name)}) " + " UNION ALL ".join(parts)


def facts(name: str) -> str:
    """CTEs ``cells`` and ``facts`` (one row per column)."""
    return (
        f"cells AS ({cells(name)}), counted AS (SELECT \"column\", count(*) AS \"rows\", "
        "count(*) FILTER (kind = 'null') AS null_count, count(*) FILTER (kind = 'numeric') AS numeric_count, "
        "count(*) FILTER (kind = 'boolean') AS boolean_count, count(*) FILTER (kind = 'text') AS text_count, "
        "count(num) AS n, avg(num) AS mean, CASE WHEN count(num) > 0 THEN coalesce(stddev_samp(num), 0) END AS stddev, "
        "min(num) AS lo, max(num) AS hi FROM cells GROUP BY 1), "
        "facts AS (SELECT *, \"rows\" - null_count AS non_null_count, null_count / \"rows\" AS null_ratio, "
        "CASE WHEN numeric_count + boolean_count + text_count = 0 THEN 'unknown' "
        "WHEN numeric_count >= boolean_count AND numeric_count >= text_count THEN 'numeric' "
        "WHEN boolean_count >= text_count THEN 'boolean' ELSE 'text' END AS inferred_type FROM counted)"
    )


def quantiles(source: str = "cells") -> str:
    """CTE ``quant`` with exact quantiles per column."""
    return (
        'quant AS (SELECT "column", '
        + ", ".join(
            f"quantile_cont(num, {p}) AS {q}"
            for p, q in ((0.05, "q5"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.95, "q95"))
        )
        + f' FROM {source} WHERE num IS NOT NULL GROUP BY 1)'
    )


def distinct(name: str, columns: list[str] | None = None) -> str:
    """CTE ``dist``: distinct values up to 25 and whether there are more."""
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {text(c, f)}) AS d FROM base"
        for c, f in COLUMNS[name].items()
        if columns is None or c in columns
    )
    return (
        f"base AS (SELECT * FROM {duck_source(name)}), dist AS (SELECT \"column\", least(d, 25) AS distinct_count, "
        f"d > 25 AS distinct_overflow FROM ({parts}))"
    )


def duplicates(name: str, columns: list[str] | None = None) -> str:
    """CTE ``dup``: rows, duplicates and ratio."""
    listed = ", ".join(columns or COLUMNS[name])
    return (
        f"dup AS (SELECT (SELECT count(*) FROM {duck_source(name)}) AS \"rows\", "
        f"(SELECT count(*) FROM {duck_source(name)}) - (SELECT count(*) FROM (SELECT DISTINCT {listed} FROM {duck_source(name)})) AS duplicates)"
    )


def ranges() -> str:
    """CTE ``ranges`` from ``cells`` and ``facts``."""
    return (
        "bounds AS (SELECT *, CASE WHEN stddev > 0 THEN mean - 3 * stddev ELSE lo END AS lower_bound, "
        "CASE WHEN stddev > 0 THEN mean + 3 * stddev ELSE hi END AS upper_bound "
        "FROM facts WHERE inferred_type = 'numeric' AND n > 0), "
        "ranged AS (SELECT b.\"column\", b.lower_bound, b.upper_bound, b.lo AS min_observed, b.hi AS max_observed, "
        "count(*) AS sample_count, count(*) FILTER (c.num < b.lower_bound OR c.num > b.upper_bound) AS violation_count "
        "FROM cells c JOIN bounds b ON c.\"column\" = b.\"column\" WHERE c.num IS NOT NULL GROUP BY ALL), "
        "ranges AS (SELECT *, violation_count / sample_count AS violation_ratio, "
        "CASE WHEN violation_count / sample_count >= 0.05 THEN 'ERROR' "
        "WHEN violation_count / sample_count >= 0.01 THEN 'WARNING' ELSE 'OK' END AS severity FROM ranged)"
    )


def cardinality() -> str:
    """CTE ``card`` from ``facts`` and ``dist``."""
    return (
        "card AS (SELECT f.\"column\", d.distinct_count AS distinct_sample, f.non_null_count, "
        "d.distinct_count / f.non_null_count AS ratio, d.distinct_count = 25 AS sample_limit_hit, "
        "CASE WHEN d.distinct_count = 25 THEN 'ERROR' WHEN d.distinct_count >= 15 THEN 'WARNING' ELSE 'OK' END AS severity "
        "FROM facts f JOIN dist d ON f.\"column\" = d.\"column\" WHERE f.inferred_type IN ('text', 'boolean'))"
    )


def issues(name: str) -> str:
    """All CTEs up to ``issues`` for one table."""
    return (
        f"WITH {facts(name)}, {distinct(name)}, {ranges()}, {cardinality()}, {duplicates(name)}, issues AS ("
        "SELECT 'null_ratio_threshold' AS rule, CASE WHEN null_ratio < 0.4 THEN 'WARNING' ELSE 'ERROR' END AS severity, "
        "\"column\", null_ratio AS value, concat(CAST(floor(null_ratio * 100) AS INT), '% nulls detected') AS message, 1 AS seq "
        "FROM facts WHERE null_ratio > 0.2 "
        "UNION ALL SELECT 'mixed_type', 'WARNING', \"column\", numeric_count, "
        "'Mixed types detected; values parsed as both text and numeric.', 2 FROM facts "
        "WHERE inferred_type = 'text' AND numeric_count > 0 "
        "UNION ALL SELECT 'numeric_range', severity, \"column\", violation_ratio, "
        "concat(violation_count, ' of ', sample_count, ' sampled values fall outside expected range'), 3 FROM ranges "
        "WHERE severity <> 'OK' "
        "UNION ALL SELECT 'categorical_cardinality', severity, \"column\", distinct_sample, "
        "concat('Observed ', distinct_sample, ' distinct values across ', non_null_count, ' non-null rows', "
        "CASE WHEN sample_limit_hit THEN '; sample limit reached, true cardinality may be higher' ELSE '' END), 4 FROM card "
        "WHERE severity <> 'OK' "
        "UNION ALL SELECT 'duplicate_rows', CASE WHEN duplicates / \"rows\" >= 0.05 THEN 'ERROR' ELSE 'WARNING' END, NULL, "
        "duplicates / \"rows\", concat('Detected ', duplicates, ' duplicate rows (', printf('%.2f', 100 * duplicates / \"rows\"), "
        "'% of dataset)'), 5 FROM dup WHERE duplicates > 0)"
    )


SEVERITIES = (
    "sev AS (SELECT count(*) FILTER (severity = 'ERROR') AS error_count, "
    "count(*) FILTER (severity = 'WARNING') AS warning_count, count(*) FILTER (severity = 'INFO') AS info_count, "
    "coalesce(sum(CASE severity WHEN 'ERROR' THEN 0.5 WHEN 'WARNING' THEN 0.2 ELSE 0.05 END), 0)::DOUBLE AS penalty, "
    "count(*) AS issue_count FROM issues), "
    "summary AS (SELECT *, CASE WHEN error_count > 0 THEN 'ERROR' WHEN warning_count > 0 THEN 'WARNING' "
    "WHEN info_count > 0 THEN 'INFO' END AS max_severity, greatest(0, 1 - least(1, penalty)) AS score FROM sev)"
)


def pairs(name: str, columns: list[str] | None = None) -> str:
    """CTE ``pairs``: Pearson r of every pair of columns that can hold numbers, names ascending."""
    names = sorted(c for c, f in COLUMNS[name].items() if f in ("int", "double") and (columns is None or c in columns))
    parts = [
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", corr(CAST({b} AS DOUBLE), CAST({a} AS DOUBLE)) AS r, "
        f"regr_count({b}, {a}) AS n FROM base"
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    ]
    return (
        f"base AS (SELECT * FROM {duck_source(name)}), pairs AS (SELECT * FROM ({' UNION ALL '.join(parts)}) "
        "WHERE n >= 2 AND r IS NOT NULL AND NOT isnan(r))"
    )
