"""The queries: name, Spark side, and where SQL can say the same, its text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import duck
from registry.inputs import COLUMNS, duck_source, table
from tablescope.functions import values as V
from tablescope.functions.values import quoted
from tablescope.operators import automl, correlate, describe, profile, quality, quick, report
from tablescope.operators.cells import cells, field_types
from tablescope.operators.quantiles import exact_quantiles, quantile_columns
from tablescope.session import key_of, materialize, scratch_path
from tablescope.sources import delimited, files, sinks
from tablescope.streaming.profile import start_profile

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, nudged off ties, so that summation order does not show."""
    return df.selectExpr(
        *[
            f"round({quoted(f.name)} + 1e-9D, 6) AS {quoted(f.name)}" if f.dataType.typeName() == "double" else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def r(*names: str) -> str:
    """SQL select items rounding each ``expression AS name``."""
    items = []
    for item in names:
        expression, _, alias = item.rpartition(" AS ")
        expression = expression or alias
        items.append(f"round({expression} + 1e-9, 6) AS {alias}")
    return ", ".join(items)


# --- values ------------------------------------------------------------------------------


def _value_kinds(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = cells(table(spark, sf_dir, name), want=("kind", "num"))
        return rounded(
            rows.groupBy("column", "kind").agg(F.expr("count(1) AS n"), F.expr("avg(num) AS mean"))
        )

    return query


for _name in ("events", "documents", "mixed", "orders"):
    add(
        f"value_kinds_{_name}",
        _value_kinds(_name),
        f"WITH cells AS ({duck.cells(_name)}) SELECT \"column\", kind, count(*) AS n, {r('avg(num) AS mean')} FROM cells GROUP BY 1, 2",
    )


def _canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "mixed")
    types = field_types(df)
    return df.select(
        "o_orderkey",
        *[V.canonical_text(c, types[c]).alias(c) for c in ("remark", "flag")],
        V.is_missing("flag").alias("flag_missing"),
        V.numeric_value("remark").alias("remark_number"),
        V.to_float_lenient("concat('1,', o_orderkey, '.25')").alias("lenient"),
    )


add(
    "canonical_values",
    _canonical_values,
    f"SELECT o_orderkey, {duck.text('remark', 'string')} AS remark, {duck.text('flag', 'string')} AS flag, "
    f"{duck.kind('flag', 'string')} = 'null' AS flag_missing, {duck.number('remark', 'string')} AS remark_number, "
    f"CAST(replace(concat('1,', o_orderkey, '.25'), ',', '') AS DOUBLE) AS lenient FROM {duck_source('mixed')}",
)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = "element_at(array('csv','TSV','tab','ndjson','json','xlsx','pq','sqlite3','zip','tgz','gz','bin'), int(pmod(page_id, 12)) + 1)"
    return table(spark, sf_dir, "pages").select(
        "page_id",
        V.slug("url").alias("slug"),
        V.safe_filename("concat(url, '..x')", "page").alias("file"),
        V.detect_format(f"concat('in/', page_id, '.', {ext})", "'application/json'").alias("format"),
        V.csv_cell("CASE WHEN page_id % 3 = 0 THEN double('NaN') ELSE page_id / 2 END", field_double()).alias("cell"),
        V.format_preview("url").alias("shown"),
        V.binary_to_text("cast(url AS BINARY)").alias("coded"),
    )


def field_double():
    from pyspark.sql.types import DoubleType

    return DoubleType()


add(
    "name_and_cell_formats",
    _names,
    "SELECT page_id, CASE WHEN trim(regexp_replace(url, '[^\\p{L}\\p{N}_-]', '_', 'g'), '_') = '' THEN 'column' "
    "ELSE trim(regexp_replace(url, '[^\\p{L}\\p{N}_-]', '_', 'g'), '_') END AS slug, "
    "CASE WHEN replace(split_part(concat(url, '..x'), '/', -1), '..', '_') = '' THEN 'page' "
    "ELSE replace(split_part(concat(url, '..x'), '/', -1), '..', '_') END AS file, "
    "['csv','tsv','tsv','jsonl','json','excel','parquet','sqlite','zip','tar','gzip','json'][page_id % 12 + 1] AS format, "
    "CASE WHEN page_id % 3 = 0 THEN '' ELSE CAST(page_id / 2 AS VARCHAR) END AS cell, "
    "CASE WHEN length(url) > 80 THEN concat(substr(url, 1, 77), '...') ELSE url END AS shown, "
    "base64(encode(url)) AS coded FROM pages",
)


# --- profiles ----------------------------------------------------------------------------


_KEYS = {"lineitem": list(COLUMNS["lineitem"]), "events": ["event_id"], "documents": ["doc_id"], "labelled": ["doc_id"], "mixed": ["o_orderkey"]}


def _column_profile(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = profile.column_profile(table(spark, sf_dir, name), _KEYS[name])
        texts = ("distinct_sample", "sample_values")
        return rounded(found.withColumns({c: F.md5(F.array_join(c, "|")) for c in texts}))

    return query


def _distinct_sample_sql(name: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        value = duck.text(c, "string") if COLUMNS[name][c] == "string" else c
        parts.append(
            f"SELECT '{c}' AS \"column\", least(count(*), 25) AS distinct_count, count(*) > 25 AS distinct_overflow, "
            "md5(string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) FILTER (place <= 25)) AS sample "
            f"FROM (SELECT v, row_number() OVER (ORDER BY v) AS place FROM (SELECT DISTINCT {value} AS v FROM base) WHERE v IS NOT NULL)"
        )
    return f"WITH base AS (SELECT * FROM {duck_source(name)}) " + " UNION ALL ".join(parts)


def _first_values_sql(name: str) -> str:
    key = ", ".join(_KEYS[name])
    return f"WITH base AS (SELECT * FROM {duck_source(name)}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", md5(string_agg(t, '|' ORDER BY place)) AS firsts FROM "
        f"(SELECT {duck.text(c, f)} AS t, row_number() OVER (ORDER BY {key}) AS place FROM base WHERE {duck.kind(c, f)} <> 'null') WHERE place <= 5"
        for c, f in COLUMNS[name].items()
    )


for _name in _KEYS:
    add(
        f"column_profile_{_name}",
        _column_profile(_name),
        f"WITH {duck.facts(_name)}, dist AS ({_distinct_sample_sql(_name, list(COLUMNS[_name]))}), firsts AS ({_first_values_sql(_name)}) "
        f"SELECT f.\"column\", f.inferred_type, f.null_count, {r('f.null_ratio AS null_ratio')}, f.non_null_count, d.distinct_count, "
        "d.distinct_overflow, d.sample AS distinct_sample, s.firsts AS sample_values "
        "FROM facts f JOIN dist d ON f.\"column\" = d.\"column\" JOIN firsts s ON f.\"column\" = s.\"column\"",
    )

add(
    "null_profile_labelled",
    lambda spark, d: rounded(profile.kind_counts(table(spark, d, "labelled")).select("column", "rows", "null_count", "null_ratio")),
    f"WITH {duck.facts('labelled')} SELECT \"column\", \"rows\", null_count, {r('null_ratio')} FROM facts",
)
add(
    "completeness_labelled",
    lambda spark, d: rounded(profile.completeness(profile.kind_counts(table(spark, d, "labelled")))),
    f"WITH {duck.facts('labelled')} SELECT {r('avg(1 - null_ratio) AS completeness')} FROM facts",
)
add(
    "schema_table_events",
    lambda spark, d: profile.schema_table(profile.kind_counts(table(spark, d, "events"))),
    f"WITH {duck.facts('events')} SELECT \"column\" AS name, inferred_type AS type FROM facts",
)
for _name in ("lineitem", "events", "mixed"):
    add(
        f"moments_{_name}",
        (lambda n: lambda spark, d: rounded(profile.moments(table(spark, d, n)).drop("rows")))(_name),
        f"WITH {duck.facts(_name)} SELECT \"column\", n AS count, {r('mean', 'stddev', 'lo AS min', 'hi AS max')} FROM facts WHERE n > 0",
    )


def _distinct_sample(name: str, columns: list[str]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = profile.distinct_values(table(spark, sf_dir, name), columns)
        return found.selectExpr("column", "distinct_count", "distinct_overflow", "md5(array_join(distinct_sample, '|')) AS sample")

    return query


for _name in ("part", "customer", "orders", "documents", "mixed"):
    _columns = list(COLUMNS[_name])
    add(f"distinct_sample_{_name}", _distinct_sample(_name, _columns), _distinct_sample_sql(_name, _columns))

add(
    "distinct_counts_lineitem",
    lambda spark, d: profile.distinct_counts(table(spark, d, "lineitem")),
    "WITH base AS (SELECT * FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM base" for c in COLUMNS["lineitem"]),
)


def _sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.sample_values(table(spark, sf_dir, "labelled"), ["doc_id"])
    return found.selectExpr("column", "place", "md5(text) AS text")


add(
    "sample_values_labelled",
    _sample_values,
    f"WITH base AS (SELECT * FROM {duck_source('labelled')}) "
    + " UNION ALL ".join(
        f"(SELECT '{c}' AS \"column\", CAST(row_number() OVER (ORDER BY doc_id) AS INT) AS place, md5({duck.text(c, f)}) AS text "
        f"FROM base WHERE {duck.kind(c, f)} <> 'null' ORDER BY doc_id LIMIT 5)"
        for c, f in COLUMNS["labelled"].items()
    ),
)
add(
    "preview_documents",
    lambda spark, d: profile.preview(table(spark, d, "documents"), ["doc_id"]),
    "SELECT "
    + ", ".join(
        f"CASE WHEN length({duck.text(c, f)}) > 80 THEN concat(substr({duck.text(c, f)}, 1, 77), '...') "
        f"ELSE coalesce({duck.text(c, f)}, '') END AS {c}"
        for c, f in COLUMNS["documents"].items()
    )
    + " FROM documents ORDER BY documents.doc_id LIMIT 5",
)
add(
    "numeric_row_sample_events",
    lambda spark, d: profile.numeric_row_sample(table(spark, d, "events"), ["event_id"], ["user_id", "value"]).select("user_id", "value"),
    "SELECT CAST(user_id AS DOUBLE) AS user_id, value FROM events ORDER BY event_id LIMIT 500",
)
add(
    "training_sample_orders",
    lambda spark, d: profile.training_sample(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_orderkey"]),
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderpriority "
    "FROM orders ORDER BY orders.o_orderkey LIMIT 2000",
)

for _key, _name, _columns in (
    ("documents", "documents", ["text", "lang", "source", "n_chars"]),
    ("lineitem", "lineitem", list(COLUMNS["lineitem"])),
    ("lineitem_flags", "lineitem", ["l_returnflag", "l_linestatus", "l_linenumber"]),
):
    add(
        f"duplicate_rows_{_key}",
        (lambda n, c: lambda spark, d: rounded(profile.duplicate_rows(table(spark, d, n).select(*c))))(_name, _columns),
        f"WITH {duck.duplicates(_name, _columns)} SELECT \"rows\", duplicates, {r('duplicates / \"rows\" AS ratio')} FROM dup",
    )


# --- quality rules -----------------------------------------------------------------------


_ISSUE_FIELDS = f"rule, severity, \"column\", {r('value')}, message, seq"


def _facts_only_rule(name: str, rule: Callable[[], str]) -> Query:
    return lambda spark, d: rounded(quality.column_issues(profile.column_facts(table(spark, d, name)), [rule()]))


add(
    "dq_null_ratio",
    _facts_only_rule("labelled", quality.null_ratio_issue_sql),
    duck.issues("labelled") + f" SELECT {_ISSUE_FIELDS} FROM issues WHERE seq = 1",
)
add(
    "dq_mixed_type",
    _facts_only_rule("mixed", quality.mixed_type_issue_sql),
    duck.issues("mixed") + f" SELECT {_ISSUE_FIELDS} FROM issues WHERE seq = 2",
)


def _ranges(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        return rounded(quality.numeric_range(df, profile.column_facts(df)))

    return query


for _name in ("events", "lineitem", "documents"):
    add(
        f"dq_numeric_range_{_name}",
        _ranges(_name),
        f"WITH {duck.facts(_name)}, {duck.ranges()} SELECT \"column\", "
        + r("lower_bound", "upper_bound", "min_observed", "max_observed", "violation_ratio")
        + ", sample_count, violation_count, severity FROM ranges",
    )


def _cardinality(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        return rounded(quality.categorical_cardinality(profile.kind_counts(df), profile.distinct_values(df)))

    return query


for _name in ("part", "documents"):
    add(
        f"dq_cardinality_{_name}",
        _cardinality(_name),
        f"WITH {duck.facts(_name)}, {duck.distinct(_name)}, {duck.cardinality()} SELECT \"column\", distinct_sample, "
        f"non_null_count, {r('ratio')}, sample_limit_hit, severity FROM card",
    )
add(
    "dq_duplicates_documents",
    lambda spark, d: rounded(
        quality.duplicate_issue(profile.duplicate_rows(table(spark, d, "documents").select("text", "lang", "source", "n_chars")))
    ),
    f"WITH {duck.duplicates('documents', ['text', 'lang', 'source', 'n_chars'])} SELECT 'duplicate_rows' AS rule, "
    "CASE WHEN duplicates / \"rows\" >= 0.05 THEN 'ERROR' ELSE 'WARNING' END AS severity, CAST(NULL AS VARCHAR) AS \"column\", "
    f"{r('duplicates / \"rows\" AS value')}, concat('Detected ', duplicates, ' duplicate rows (', "
    "printf('%.2f', 100 * duplicates / \"rows\"), '% of dataset)') AS message, 5 AS seq FROM dup WHERE duplicates > 0",
)


def _issues(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(quality.check_table(table(spark, sf_dir, name)).issues())

    return query


def _severities(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(quality.severity_summary(quality.check_table(table(spark, sf_dir, name)).issues()))

    return query


for _name in ("labelled", "events", "mixed"):
    add(f"dq_issues_{_name}", _issues(_name), duck.issues(_name) + f" SELECT {_ISSUE_FIELDS} FROM issues")
for _name in ("events", "orders"):
    add(
        f"dq_severity_and_score_{_name}",
        _severities(_name),
        duck.issues(_name) + f", {duck.SEVERITIES} SELECT error_count, warning_count, info_count, {r('penalty', 'score')}, "
        "issue_count, max_severity FROM summary",
    )
for _name in ("events", "labelled"):
    add(
        f"dq_rules_evaluated_{_name}",
        (lambda n: lambda spark, d: quality.rules_evaluated(profile.column_facts(table(spark, d, n))))(_name),
        f"WITH {duck.facts(_name)} SELECT CAST(sum(2 + CASE WHEN inferred_type = 'numeric' AND n > 0 THEN 1 "
        "WHEN inferred_type IN ('text', 'boolean') THEN 1 ELSE 0 END) + 1 AS BIGINT) AS rules_evaluated FROM facts",
    )
add(
    "non_empty_orders",
    lambda spark, d: quality.non_empty(table(spark, d, "orders")),
    "SELECT 'non_empty' AS name, CASE WHEN count(*) > 0 THEN 'pass' ELSE 'fail' END AS status FROM orders",
)


# --- descriptive statistics --------------------------------------------------------------

_Q = ("q5", "q25", "q50", "q75", "q95")
for _name in ("lineitem", "events", "part", "labelled"):
    add(
        f"descriptive_stats_{_name}",
        (lambda n: lambda spark, d: rounded(describe.descriptive_table(table(spark, d, n))))(_name),
        f"WITH {duck.facts(_name)}, {duck.quantiles()} SELECT f.\"column\", f.n AS count, "
        + r("f.mean AS mean", "f.stddev AS stddev", "f.lo AS min", "f.hi AS max", *[f"q.{q} AS {q}" for q in _Q])
        + " FROM facts f JOIN quant q ON f.\"column\" = q.\"column\"",
    )


def _split_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same quantiles with every interval of more than ten rows split again."""
    df = table(spark, sf_dir, "orders")
    found = exact_quantiles(df, profile.moments(df), list(describe.QUANTILES), interval_rows=10)
    return rounded(quantile_columns(found, describe.QUANTILES))


add(
    "quantiles_split_orders",
    _split_quantiles,
    f"WITH cells AS ({duck.cells('orders')}), {duck.quantiles()} SELECT \"column\", {r(*_Q)} FROM quant",
)


def _outliers_sql(name: str) -> str:
    return (
        f"WITH {duck.facts(name)}, scored AS (SELECT c.\"column\", c.num AS value, abs(c.num - f.mean) / f.stddev AS zscore "
        "FROM cells c JOIN facts f ON c.\"column\" = f.\"column\" WHERE f.n >= 5 AND f.stddev > 0 AND c.num IS NOT NULL), "
        "ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY zscore DESC, value) AS INT) AS place "
        "FROM scored WHERE zscore >= 3), outliers AS (SELECT * FROM ranked WHERE place <= 10)"
    )


for _name in ("events", "documents", "lineitem"):
    add(
        f"outliers_{_name}",
        (lambda n: lambda spark, d: rounded(describe.outliers(table(spark, d, n))))(_name),
        _outliers_sql(_name) + f" SELECT \"column\", place, {r('value', 'zscore')} FROM outliers",
    )
for _name in ("lineitem", "labelled"):
    add(
        f"correlations_{_name}",
        (lambda n: lambda spark, d: rounded(correlate.top_correlations(correlate.all_correlations(table(spark, d, n)))))(_name),
        f"WITH {duck.pairs(_name)} SELECT \"left\", \"right\", {r('r AS correlation')}, n AS sample_size FROM pairs "
        "ORDER BY abs(r) DESC, \"left\", \"right\" LIMIT 20",
    )


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    ranking = describe.numeric_ranking(profile.moments(df), 10)
    return rounded(correlate.correlation_matrix(correlate.all_correlations(df), ranking))


add(
    "correlation_matrix_lineitem",
    _matrix,
    f"WITH {duck.pairs('lineitem')}, both_ways AS (SELECT \"left\", \"right\", r FROM pairs UNION ALL "
    "SELECT \"right\", \"left\", r FROM pairs UNION ALL SELECT DISTINCT \"left\", \"left\", 1.0 FROM "
    "(SELECT \"left\" FROM pairs UNION SELECT \"right\" FROM pairs)) "
    f"SELECT \"left\", \"right\", {r('r AS correlation')} FROM both_ways",
)
add(
    "numeric_ranking_labelled",
    lambda spark, d: describe.numeric_ranking(profile.moments(table(spark, d, "labelled")), 8),
    f"WITH {duck.facts('labelled')} SELECT \"column\", n AS count, CAST(row_number() OVER (ORDER BY n DESC, \"column\") AS INT) AS place "
    "FROM facts WHERE n > 0 ORDER BY place LIMIT 8",
)

_BINS = (
    "bins AS (SELECT f.\"column\", f.n, f.lo, f.hi, CAST(CASE WHEN f.n < 2 THEN 1 WHEN q75 - q25 <> 0 AND hi - lo <> 0 THEN "
    "least(greatest(1, round_even((hi - lo) / (2 * (q75 - q25) * pow(n, -1.0 / 3)), 0)), greatest(1, round_even(sqrt(n), 0) * 10)) "
    "ELSE greatest(1, round_even(sqrt(n), 0)) END AS INT) AS bins FROM facts f JOIN quant q ON f.\"column\" = q.\"column\")"
)


def _histogram(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        return rounded(describe.histogram(df, describe.histogram_bins(describe.descriptive_table(df))))

    return query


for _name in ("events", "part"):
    add(
        f"histogram_bins_{_name}",
        (lambda n: lambda spark, d: rounded(describe.histogram_bins(describe.descriptive_table(table(spark, d, n)))))(_name),
        f"WITH {duck.facts(_name)}, {duck.quantiles()}, {_BINS} SELECT \"column\", n AS count, "
        f"{r('lo AS min', 'hi AS max')}, bins FROM bins",
    )
for _name in ("events", "part", "lineitem"):
    _edge = "(lo + ({i}) * ((hi - lo) / bins))"
    add(
        f"histogram_{_name}",
        _histogram(_name),
        f"WITH {duck.facts(_name)}, {duck.quantiles()}, {_BINS}, raws AS (SELECT b.*, c.num, "
        "least(CAST(floor((c.num - lo) / (hi - lo) * bins) AS INT), bins - 1) AS raw FROM cells c JOIN bins b "
        "ON c.\"column\" = b.\"column\" WHERE c.num IS NOT NULL), binned AS (SELECT \"column\", raw "
        f"- CASE WHEN num < {_edge.format(i='raw')} THEN 1 ELSE 0 END "
        f"+ CASE WHEN raw < bins - 1 AND num >= {_edge.format(i='raw + 1')} THEN 1 ELSE 0 END AS bin, count(*) AS size "
        "FROM raws GROUP BY 1, 2), every_bin AS (SELECT *, CAST(unnest(range(0, bins)) AS INT) AS bin FROM bins) "
        f"SELECT e.\"column\", e.bin, {r(_edge.format(i='e.bin') + ' AS low', 'CASE WHEN e.bin = bins - 1 THEN hi ELSE ' + _edge.format(i='e.bin + 1') + ' END AS high')}, "
        "coalesce(size, 0) AS size FROM every_bin e LEFT JOIN binned c ON e.\"column\" = c.\"column\" AND e.bin = c.bin",
    )


def _boxes(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        return rounded(describe.box_stats(df, describe.descriptive_table(df)))

    return query


for _name in ("events", "lineitem"):
    add(
        f"box_stats_{_name}",
        _boxes(_name),
        f"WITH {duck.facts(_name)}, {duck.quantiles()}, fences AS (SELECT q.*, q25 - 1.5 * (q75 - q25) AS low_fence, "
        "q75 + 1.5 * (q75 - q25) AS high_fence FROM quant q) SELECT f.\"column\", count(*) AS count, "
        + r(
            "least(min(num) FILTER (num >= low_fence), any_value(q25)) AS whisker_low",
            "any_value(q25) AS q25", "any_value(q50) AS q50", "any_value(q75) AS q75",
            "greatest(max(num) FILTER (num <= high_fence), any_value(q75)) AS whisker_high",
        )
        + ", count(*) FILTER (num < low_fence OR num > high_fence) AS fliers FROM cells c JOIN fences f "
        "ON c.\"column\" = f.\"column\" WHERE num IS NOT NULL GROUP BY 1",
    )


def _scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labelled")
    names = ["doc_id", "n_chars", "quality", "toxic"]
    pairs = correlate.top_correlations(correlate.all_correlations(df, names), describe.MAX_SCATTERS)
    return describe.scatter_points(df, pairs, names, ["doc_id"], profile.NUMERIC_SAMPLE_ROWS).drop("key")


add(
    "scatter_points_labelled",
    _scatter,
    f"WITH {duck.pairs('labelled', ['doc_id', 'n_chars', 'quality', 'toxic'])}, best AS (SELECT * FROM pairs "
    "ORDER BY abs(r) DESC, \"left\", \"right\" LIMIT 3), sample AS (SELECT * FROM base ORDER BY md5(CAST(doc_id AS VARCHAR)) LIMIT 500), "
    "long AS (SELECT row_number() OVER () AS id, * FROM sample), cells AS ("
    + " UNION ALL ".join(f"SELECT id, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS num FROM long" for c in ("doc_id", "n_chars", "quality", "toxic"))
    + ") SELECT b.\"left\", b.\"right\", x.num AS x, y.num AS y FROM best b JOIN cells x ON x.\"column\" = b.\"left\" "
    "JOIN cells y ON y.\"column\" = b.\"right\" AND y.id = x.id WHERE x.num IS NOT NULL AND y.num IS NOT NULL",
)


# --- quick profile -----------------------------------------------------------------------

_QUICK = {"event_id": "CAST(event_id AS DOUBLE)", "user_id": "CAST(user_id AS DOUBLE)", "value": "value", "amount": "CAST(user_id * 1000 AS DOUBLE)"}
_QUICK_CELLS = "cells AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {sql} AS num FROM events" for c, sql in _QUICK.items()
) + ")"


# The types as SQL finds them in the first 200 rows.
_QUICK_NAMES = ("event_id", "user_id", "event_type", "value", "amount", "ts")
_QUICK_TYPES = (
    f"first AS (SELECT * FROM {duck_source('raw_events')} ORDER BY event_id LIMIT 200), texts AS ("
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", nullif({duck.strip(f'CAST({c} AS VARCHAR)')}, '') AS cell FROM first"
        for i, c in enumerate(_QUICK_NAMES, start=1)
    )
    + "), types AS (SELECT CAST(position AS INT) AS position, \"column\", CASE WHEN count(*) FILTER ("
    f"regexp_full_match(replace(cell, ',', ''), '{duck.NUMBER}')) >= 0.8 * count(cell) AND count(cell) > 0 THEN 'number' ELSE 'string' END AS type "
    "FROM texts GROUP BY 1, 2)"
)


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "raw_events")
    return quick.lenient_frame(df, quick.number_names(quick.column_types(df, ["event_id"])))


add(
    "quick_types",
    lambda spark, d: quick.column_types(table(spark, d, "raw_events"), ["event_id"]),
    f"WITH {_QUICK_TYPES} SELECT * FROM types",
)
add(
    "quick_stats",
    lambda spark, d: rounded(quick.stats_table(_numbers(spark, d))),
    f"WITH {_QUICK_CELLS} SELECT \"column\", count(*) AS count, "
    + r(
        "avg(num) AS mean", "stddev_samp(num) AS std", "min(num) AS min",
        *[f"quantile_cont(num, {p}) AS {q}" for p, q in quick.QUANTILES.items()], "max(num) AS max",
    )
    + " FROM cells GROUP BY 1",
)
add(
    "quick_correlations",
    lambda spark, d: rounded(quick.correlations(_numbers(spark, d))),
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, round(corr({_QUICK[b]}, {_QUICK[a]}) + 1e-9, 6) AS pearson_r, count(*) AS n FROM events"
        for i, a in enumerate(_QUICK)
        for b in list(_QUICK)[i + 1 :]
    )
    + ")",
)
add(
    "quick_outliers",
    lambda spark, d: rounded(quick.outliers(_numbers(spark, d))),
    f"WITH {_QUICK_CELLS}, stats AS (SELECT \"column\", avg(num) AS mean, stddev_samp(num) AS sd FROM cells GROUP BY 1), "
    "scored AS (SELECT c.\"column\", num AS value, (num - mean) / sd AS z FROM cells c JOIN stats s ON c.\"column\" = s.\"column\") "
    f"SELECT \"column\", {r('value', 'z')} FROM scored WHERE abs(z) >= 3 ORDER BY abs(z) DESC, \"column\", value LIMIT 50",
)
add(
    "quick_shape",
    lambda spark, d: quick.shape(table(spark, d, "raw_events"), table(spark, d, "raw_events").columns),
    "SELECT count(*) AS \"rows\", CAST(6 AS BIGINT) AS columns FROM events",
)
add(
    "quick_head",
    lambda spark, d: quick.head_rows(table(spark, d, "raw_events"), ["event_id"]),
    f"SELECT * FROM {duck_source('raw_events')} ORDER BY event_id LIMIT 3",
)


def _quick_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.plans.quick import quick_profile

    made = quick_profile(table(spark, sf_dir, "raw_events"), ["event_id"]).document()
    form = "summary struct<rows: bigint, columns: bigint>, schema array<struct<position: int, column: string, type: string>>"
    return made.selectExpr(f"from_json(document, '{form}') AS made").selectExpr("made.summary.*", "inline(made.schema)")


add(
    "quick_document",
    _quick_document,
    f"WITH {_QUICK_TYPES} SELECT (SELECT count(*) FROM events) AS \"rows\", CAST(6 AS BIGINT) AS columns, position, \"column\", type FROM types",
)


# --- report and results ------------------------------------------------------------------


def _metrics(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = quality.check_table(df)
    return checked.facts, report.dataset_metrics(checked.facts, quality.severity_summary(checked.issues()))


add(
    "dataset_metrics_events",
    lambda spark, d: rounded(_metrics(table(spark, d, "events"))[1]),
    duck.issues("events") + f", {duck.SEVERITIES} SELECT (SELECT max(\"rows\") FROM facts) AS \"rows\", "
    "(SELECT count(*) FROM facts) AS columns, (SELECT round(avg(1 - null_ratio) + 1e-9, 6) FROM facts) AS completeness, "
    "(SELECT CAST(sum(3) + 1 AS BIGINT) FROM facts) AS rules_evaluated, error_count, warning_count, info_count, "
    f"{r('penalty')}, issue_count, max_severity, {r('score')} FROM summary",
)


def _narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    facts, metrics = _metrics(df)
    return report.narrative(metrics, correlate.all_correlations(df, stats=facts), describe.outliers(df, facts))


add(
    "report_summary_events",
    _narrative,
    duck.issues("events") + f", {duck.SEVERITIES}, {duck.pairs('events').replace('base AS', 'raw AS', 1).replace('FROM base', 'FROM raw')}, "
    "far AS (SELECT c.\"column\", c.num AS value, abs(c.num - f.mean) / f.stddev AS z FROM cells c JOIN facts f "
    "ON c.\"column\" = f.\"column\" WHERE f.n >= 5 AND f.stddev > 0 AND abs(c.num - f.mean) / f.stddev >= 3), "
    "shown AS (SELECT * FROM far WHERE \"column\" = (SELECT min(\"column\") FROM far) ORDER BY z DESC, value LIMIT 2) "
    "SELECT concat('The dataset contains ', format('{:,}', (SELECT max(\"rows\") FROM facts)), ' rows across ', "
    "(SELECT count(*) FROM facts), ' columns. Data quality score ', printf('%.2f', score), '. ', "
    "(SELECT concat('Strongest correlation observed between ', \"left\", ' and ', \"right\", ' (r=', printf('%.2f', r), '). ') "
    "FROM pairs ORDER BY abs(r) DESC, \"left\", \"right\" LIMIT 1), "
    "(SELECT concat('Potential outliers detected in ', any_value(\"column\"), ': ', "
    "string_agg(printf('%.2f', value), ', ' ORDER BY z DESC, value), '. ') FROM shown), "
    f"'{report.CLOSING_SENTENCE}') AS summary FROM summary",
)


def _top_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_issues(quality.check_table(table(spark, sf_dir, "labelled")).issues())


add(
    "report_top_issues_labelled",
    _top_issues,
    duck.issues("labelled") + " SELECT rule, \"column\", message, severity FROM issues ORDER BY \"column\" NULLS LAST, seq LIMIT 20",
)
add(
    "report_strongest_pairs_lineitem",
    lambda spark, d: rounded(report.strongest_pairs(correlate.all_correlations(table(spark, d, "lineitem")))),
    f"WITH {duck.pairs('lineitem')} SELECT \"left\", \"right\", {r('r AS correlation')} FROM pairs "
    "ORDER BY abs(r) DESC, \"left\", \"right\" LIMIT 10",
)
add(
    "report_top_outliers_documents",
    lambda spark, d: rounded(report.top_outliers(describe.outliers(table(spark, d, "documents")))),
    _outliers_sql("documents")
    + f" SELECT \"column\", place, {r('value', 'zscore')} FROM outliers WHERE place <= 5 AND \"column\" IN "
    "(SELECT DISTINCT \"column\" FROM outliers ORDER BY 1 LIMIT 5)",
)


_WRITTEN = (
    [(f"{p}_json", "application/json", f"phases/{p}.json") for p in (
        "ingest", "profile", "dq_validate", "dq_severities", "dq_ranges", "dq_cardinality", "dq_duplicates", "descriptive_stats",
        "nl_report", "finalize")]
    + [("results_results", "application/json", "results/results.json"), ("results_manifest", "application/json", "results/manifest.json")]
    + [("results_outliers.json", "application/json", "results/outliers.json"), ("results_report.txt", "text/plain", "results/report.txt")]
    + [(f"results_{n}.csv", "text/csv", f"results/{n}.csv") for n in ("descriptive_stats", "correlations", "preview")]
    + [(f"results_graphs_{n}.csv", "text/csv", f"results/graphs/{n}.csv") for n in ("histograms", "box_plots", "correlation_matrix", "scatter")]
)


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest of a written profile lists, and what was written."""
    from tablescope.plans.dataset import write_profile

    path = scratch_path(spark, "profile")
    entries = write_profile(table(spark, sf_dir, "events"), path, order_by=["event_id"])
    listed = entries.select("name", "content_type", F.expr(f"substring(key, {len(path) + 2})").alias("key"))
    files_found = files.file_catalog(spark, path).select(F.regexp_extract("path", r"((?:phases|results)/.*)/[^/]*$", 1).alias("key")).distinct()
    return listed.join(files_found.withColumn("written", F.lit(True)), "key", "full")


add(
    "manifest_events",
    _manifest,
    "SELECT *, true AS written FROM (VALUES " + ", ".join(f"('{n}', '{t}', '{k}')" for n, t, k in _WRITTEN) + ') t(name, content_type, "key")',
)


def _results_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema, summary and number of links of the results document."""
    from tablescope.plans.dataset import profile_dataset

    profiled = profile_dataset(table(spark, sf_dir, "orders"))
    made = profiled.document(profiled.manifest("artifacts/orders"))
    form = "summary struct<rows: bigint, columns: bigint, completeness: double>, schema array<struct<name: string, type: string>>, links map<string, string>"
    parsed = made.selectExpr(f"from_json(document, '{form}') AS made")
    return parsed.selectExpr("made.summary.*", "cardinality(made.links) AS links", "inline(made.schema)")


add(
    "results_document_orders",
    _results_document,
    f"WITH {duck.facts('orders')} SELECT (SELECT count(*) FROM orders) AS \"rows\", CAST(6 AS BIGINT) AS columns, CAST(1 AS DOUBLE) AS completeness, "
    f"CAST({len(_WRITTEN) - 2} AS INT) AS links, \"column\" AS name, inferred_type AS type FROM facts",
)


# --- sources and sinks -------------------------------------------------------------------


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes and line breaks through a CSV file and back."""
    path = scratch_path(spark, "documents.csv")
    sinks.write_csv(table(spark, sf_dir, "documents"), path)
    back = delimited.read_csv(spark, path)
    return back.selectExpr("bigint(doc_id) AS doc_id", "md5(text) AS text", "lang", "source", "bigint(n_chars) AS n_chars")


add("csv_roundtrip_documents", _csv_roundtrip, "SELECT doc_id, md5(text) AS text, lang, source, n_chars FROM documents")


def _tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "customer.tsv")
    table(spark, sf_dir, "customer").write.options(header=True, sep="\t").csv(path)
    back = delimited.read_tsv(spark, path)
    return back.selectExpr(
        "bigint(c_custkey) AS c_custkey", "c_name", "int(c_nationkey) AS c_nationkey", "double(c_acctbal) AS c_acctbal", "c_mktsegment"
    )


add("tsv_roundtrip_customer", _tsv_roundtrip, "SELECT * FROM customer")


def _quick_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orders.txt")
    table(spark, sf_dir, "orders").write.options(header=True, sep="|").csv(path)
    back = delimited.read_quick(spark, path)
    return back.selectExpr(
        "bigint(o_orderkey) AS o_orderkey", "bigint(o_custkey) AS o_custkey", "o_orderstatus", "double(o_totalprice) AS o_totalprice",
        "substring(o_orderdate, 1, 10) AS o_orderdate", "o_orderpriority",
    )


add(
    "sniffed_roundtrip_orders",
    _quick_roundtrip,
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders",
)


def _mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lines of objects, with lines between them that hold no object."""
    path = scratch_path(spark, "customers.jsonl")
    people = table(spark, sf_dir, "customer")
    other = "CASE c_custkey % 4 WHEN 0 THEN '[{\"c_custkey\": 0}]' WHEN 1 THEN 'null' WHEN 2 THEN '' ELSE '{broken' END"
    people.selectExpr("to_json(struct(*)) AS value").unionAll(people.selectExpr(other)).write.text(path)
    back = files.read_jsonl(spark, path)
    return back.selectExpr("c_custkey", "c_name", "int(c_nationkey) AS c_nationkey", "c_acctbal", "c_mktsegment")


add("jsonl_objects_customer", _mixed_lines, "SELECT * FROM customer")


def _bucketed(rows: DataFrame, key: str, each: int) -> DataFrame:
    """``rows`` with a bucket, so many that each holds about ``each`` rows."""
    return rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(rows.count() // each + 1)))


def _mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON documents, lists of about a hundred, with other items among the objects."""
    path = scratch_path(spark, "customers.json")
    people = table(spark, sf_dir, "customer")
    items = _bucketed(people, "c_custkey", 100).groupBy("part").agg(F.collect_list(F.to_json(F.struct(*people.columns))).alias("items"))
    items.selectExpr("part", "concat('[5, ', concat_ws(',\\n ', items), ', \"x\", [1]]') AS value").repartition("part").write.partitionBy(
        "part"
    ).text(path)
    back = files.read_json(spark, f"{path}/part=*")
    return back.selectExpr("c_custkey", "c_name", "int(c_nationkey) AS c_nationkey", "c_acctbal", "c_mktsegment")


add("json_objects_customer", _mixed_documents, "SELECT * FROM customer")


def _one_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as one list in one file, which is cut by as many tasks as it has splits."""
    path = scratch_path(spark, "customer.json")
    people = table(spark, sf_dir, "customer").selectExpr("1 AS part", "concat(to_json(struct(*)), ',') AS value")
    ends = spark.range(2).selectExpr("id * 2 AS part", "CASE id WHEN 0 THEN '[' ELSE 'null]' END AS value")
    people.unionAll(ends).repartition(1).sortWithinPartitions("part").select("value").write.text(path)
    back = files.read_json(spark, path)
    return back.selectExpr("c_custkey", "c_name", "int(c_nationkey) AS c_nationkey", "c_acctbal", "c_mktsegment")


add("json_list_customer", _one_list, "SELECT * FROM customer")


def _clashing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as objects with a late key, one with numbers and texts, and two that differ in case."""
    path = scratch_path(spark, "turns.jsonl")
    turns = table(spark, sf_dir, "conversations")
    late = "CASE WHEN turn >= 3 THEN concat(',\"late\":', turn * 10) ELSE '' END"
    mixed = "CASE WHEN turn % 2 = 0 THEN string(turn) ELSE concat('\"t', turn, '\"') END"
    plain = "left(to_json(struct(*)), length(to_json(struct(*))) - 1)"
    turns.selectExpr(f"concat({plain}, {late}, ',\"mixed\":', {mixed}, ',\"Role\":\"', upper(role), '\"}}') AS value").write.text(path)
    back = files.read_jsonl(spark, path)
    return back.selectExpr("conv_id", "turn", "role_2", "Role AS upper_role", "md5(text) AS text", "late", "mixed")


add(
    "jsonl_clashing_conversations",
    _clashing_keys,
    "SELECT conv_id, turn, role AS role_2, upper(role) AS upper_role, md5(text) AS text, CASE WHEN turn >= 3 THEN turn * 10 END AS late, "
    "CASE WHEN turn % 2 = 0 THEN CAST(turn AS VARCHAR) ELSE concat('t', turn) END AS mixed FROM conversations",
)


def _with_headers(spark: SparkSession, rows: DataFrame, header: str, path: str) -> str:
    """``rows`` (part, value) as files that begin with a header, one for a bucket; a pattern of their folders."""
    heads = rows.select("part").distinct().selectExpr("part", f"{V.literal(header)} AS value", "0 AS place")
    lines = heads.unionAll(rows.selectExpr("part", "value", "1 AS place")).repartition("part").sortWithinPartitions("part", "place")
    lines.select("part", "value").write.partitionBy("part").text(path)
    return f"{path}/part=*"


def _clashing_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose header repeats names, one of them in another case, and whose rows are ragged or blank."""
    path = scratch_path(spark, "ragged.csv")
    people = _bucketed(table(spark, sf_dir, "customer"), "c_custkey", 2000).selectExpr(
        "part", "CASE c_custkey % 3 WHEN 0 THEN concat_ws(',', c_custkey, c_name, c_acctbal) WHEN 1 THEN concat_ws(',', c_custkey, c_name, c_acctbal, c_nationkey) "
        "ELSE concat_ws(',', c_custkey, c_name, c_acctbal, c_nationkey, c_mktsegment) END AS value"
    )
    blank = table(spark, sf_dir, "nation").selectExpr("0L AS part", "' , , ' AS value")
    found = _with_headers(spark, people.unionAll(blank), "key,Name,balance,name", path)
    back = delimited.read_csv(spark, found)
    return back.selectExpr("bigint(key) AS key", "Name AS name", "double(balance) AS balance", "name_2 AS nation", "column_5 AS segment")


add(
    "ragged_csv_customer",
    _clashing_headers,
    "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS nation, "
    "CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment ELSE '' END AS segment FROM customer",
)


def _stray_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records with stray quotes, and with quotes and line breaks inside of quotes, all in one line."""
    path = scratch_path(spark, "stray.csv")
    texts = _bucketed(table(spark, sf_dir, "documents"), "doc_id", 2000).selectExpr(
        "part", "concat(doc_id, ',5\" pipe ', doc_id % 7, ',\"', replace(text, '\"', '\"\"'), '\"end,', lang, '\"', source, ',\"a, \"\"b\"\"\n\"') AS value"
    )
    back = delimited.read_csv(spark, _with_headers(spark, texts, 'doc_id,thing,"the ""text""",lang', path))
    return back.selectExpr("bigint(doc_id) AS doc_id", "thing", 'md5(`the "text"`) AS text', "lang", "column_5 AS last")


add(
    "stray_quotes_csv_documents",
    _stray_quotes,
    "SELECT doc_id, concat('5\" pipe ', doc_id % 7) AS thing, md5(concat(text, 'end')) AS text, concat(lang, '\"', source) AS lang, "
    "concat('a, \"b\"', chr(10)) AS last FROM documents",
)


# --- file order --------------------------------------------------------------------------

#: An order of orders that is not that of their keys, and a column that is numeric at first.
_SHUFFLED = "(o_orderkey * 7919) % 100003"
_REMARK = f"CASE WHEN {_SHUFFLED} < 5000 THEN CAST({_SHUFFLED} AS {{string}}) ELSE 'late' END AS remark"


def _shuffled_orders(spark: SparkSession, sf_dir: str) -> str:
    """Orders as CSV files in another order than that of their keys."""
    path = scratch_path(spark, "shuffled.csv")
    orders = table(spark, sf_dir, "orders").selectExpr("*", _REMARK.format(string="STRING"), f"{_SHUFFLED} AS place")
    ordered = orders.repartitionByRange("place", "o_orderkey").sortWithinPartitions("place", "o_orderkey")
    ordered.drop("place").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).write.options(header=True).csv(path)
    return path


_ORDER_TEXTS = {
    "o_orderkey": "CAST(o_orderkey AS VARCHAR)", "o_custkey": "CAST(o_custkey AS VARCHAR)", "o_orderstatus": "o_orderstatus",
    "o_totalprice": "CAST(o_totalprice AS VARCHAR)", "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d')", "o_orderpriority": "o_orderpriority",
    "remark": "remark",
}
_ORDER_SHOWN = {n: duck.text(n, "string") for n in _ORDER_TEXTS}
_SHUFFLED_SQL = (
    f"WITH shuffled AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _ORDER_TEXTS.items())}, row_number() OVER (ORDER BY place, key) AS place "
    f"FROM (SELECT *, o_orderkey AS key, {_SHUFFLED} AS place, {_REMARK.format(string='VARCHAR')} FROM orders))"
)


def _file_order_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a table without a key, as they stand in its files."""
    orders = files.read_dataset(spark, _shuffled_orders(spark, sf_dir), "csv", position=True)
    return profile.preview(orders, key_of(orders, None))


add("file_order_preview_orders", _file_order_preview, f"{_SHUFFLED_SQL} SELECT {', '.join(f'{x} AS {n}' for n, x in _ORDER_SHOWN.items())} FROM shuffled WHERE place <= 5")


def _file_order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.column_profile(files.read_dataset(spark, _shuffled_orders(spark, sf_dir), "csv", position=True))
    return found.selectExpr("column", "posexplode(sample_values) AS (place, text)").selectExpr("column", "place + 1 AS place", "text")


add(
    "file_order_samples_orders",
    _file_order_samples,
    f"{_SHUFFLED_SQL} "
    + " UNION ALL ".join(f"SELECT '{n}' AS \"column\", CAST(place AS INT) AS place, {x} AS text FROM shuffled WHERE place <= 5" for n, x in _ORDER_SHOWN.items()),
)


def _file_order_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.plans.quick import quick_profile

    return quick_profile(delimited.read_quick(spark, _shuffled_orders(spark, sf_dir), position=True)).types


add(
    "file_order_types_orders",
    _file_order_types,
    f"{_SHUFFLED_SQL} "
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{n}' AS \"column\", CASE WHEN count(TRY_CAST({n} AS DOUBLE)) >= 0.8 * count(*) THEN 'number' ELSE 'string' END AS type "
        "FROM shuffled WHERE place <= 200"
        for i, n in enumerate(_ORDER_TEXTS, start=1)
    ),
)


def _jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "conversations.jsonl")
    sinks.write_json(table(spark, sf_dir, "conversations"), path)
    return files.read_jsonl(spark, path).selectExpr("conv_id", "turn", "role", "md5(text) AS text")


add("jsonl_roundtrip_conversations", _jsonl_roundtrip, "SELECT conv_id, turn, role, md5(text) AS text FROM conversations")


def _parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "part.parquet")
    sinks.write_parquet(table(spark, sf_dir, "part"), path)
    sinks.write_parquet(table(spark, sf_dir, "part"), path)  # an existing result is kept, not doubled
    return files.read_parquet(spark, path)


add("parquet_roundtrip_part", _parquet_roundtrip, "SELECT * FROM part")


def _text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "names.txt")
    sinks.write_text(table(spark, sf_dir, "customer").select("c_name"), path)
    return spark.read.text(path).selectExpr("value AS c_name")


add("text_roundtrip_customer", _text_roundtrip, "SELECT c_name FROM customer")


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = {
        "customer": table(spark, sf_dir, "customer").selectExpr("c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment"),
        "supplier": table(spark, sf_dir, "supplier").selectExpr("s_name AS name", "s_acctbal AS balance"),
    }
    return files.union_tagged(people)


add(
    "union_tagged_people",
    _union,
    "SELECT 'customer' AS __sheet__, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer "
    "UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier",
)


# --- modelling ---------------------------------------------------------------------------


_SCORED = (
    f"WITH {duck.facts('labelled')}, d AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM {duck_source('labelled')}"
        for c in COLUMNS["labelled"]
    )
    + "), scored AS (SELECT f.\"column\", f.\"rows\", f.non_null_count, d.\"distinct\", f.inferred_type, "
    "d.\"distinct\" / f.non_null_count AS ratio FROM facts f JOIN d ON d.\"column\" = f.\"column\" WHERE d.\"distinct\" >= 2) "
)


def _target_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labelled")
    return rounded(automl.target_scores(profile.kind_counts(df), profile.distinct_counts(df)))


add(
    "target_scores",
    _target_scores,
    _SCORED + f"SELECT \"column\", \"rows\", non_null_count, \"distinct\", inferred_type, {r('ratio')}, "
    + r(
        "CASE WHEN inferred_type = 'text' THEN 0.1 ELSE 0 END + CASE WHEN ratio > 0.98 AND \"rows\" > 50 THEN 0.2 ELSE 0 END "
        "+ CASE WHEN ratio < 0.02 THEN 0.2 ELSE 0 END + abs(0.5 - least(ratio, 1.0)) AS score"
    )
    + " FROM scored",
)


def _problem_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labelled")
    joined = profile.kind_counts(df).join(profile.distinct_counts(df), "column")
    return joined.selectExpr("column", f"{automl.promoted_sql()} AS promoted", f"{automl.problem_type_sql()} AS problem")


add(
    "problem_types",
    _problem_types,
    _SCORED + "SELECT \"column\", inferred_type = 'numeric' AS promoted, CASE WHEN \"distinct\" <= 10 THEN 'classification' "
    "WHEN inferred_type = 'numeric' THEN 'regression' ELSE 'classification' END AS problem FROM scored",
)
add(
    "feature_stats",
    lambda spark, d: rounded(automl.feature_stats(table(spark, d, "labelled"), ["doc_id", "text", "lang", "source", "n_chars", "toxic"])),
    _SCORED + f"SELECT \"column\" AS name, non_null_count, {r('non_null_count / \"rows\" AS coverage')}, "
    "\"distinct\" AS unique_values FROM scored WHERE \"column\" <> 'quality'",
)
add(
    "class_distribution",
    lambda spark, d: automl.class_distribution(table(spark, d, "labelled"), "quality"),
    f"SELECT CAST(quality AS VARCHAR) AS label, count(*) AS \"rows\" FROM {duck_source('labelled')} WHERE quality IS NOT NULL GROUP BY 1",
)


def _number_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_retailprice")
    stats = profile.moments(df)
    return rounded(automl.number_distribution(stats, exact_quantiles(df, stats, [0.5])))


add(
    "number_distribution",
    _number_distribution,
    "SELECT 'p_retailprice' AS \"column\", "
    + r("min(p_retailprice) AS min", "max(p_retailprice) AS max", "avg(p_retailprice) AS mean", "median(p_retailprice) AS median")
    + " FROM part",
)


def _chosen_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labelled")
    named = automl.choose_target([*df.columns, "Label"], profile.kind_counts(df).limit(0))
    scored = automl.choose_target(df.columns, automl.target_scores(profile.kind_counts(df), profile.distinct_counts(df)))
    return spark.createDataFrame([("by name", named), ("by score", scored)], "rule string, target string")


add(
    "chosen_target_labelled",
    _chosen_target,
    _SCORED + "SELECT 'by name' AS rule, 'Label' AS target UNION ALL SELECT 'by score', (SELECT \"column\" FROM scored ORDER BY "
    "CASE WHEN inferred_type = 'text' THEN 0.1 ELSE 0 END + CASE WHEN ratio > 0.98 AND \"rows\" > 50 THEN 0.2 ELSE 0 END "
    "+ CASE WHEN ratio < 0.02 THEN 0.2 ELSE 0 END + abs(0.5 - least(ratio, 1.0)), \"column\" LIMIT 1)",
)


def _promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of texts of which about 55, 60 and 65 % are numbers, and one of two values."""
    parts = [f"CASE WHEN o_orderkey % 20 < {n} THEN '1.5' ELSE 'x' END AS share{n}" for n in (11, 12, 13)]
    df = table(spark, sf_dir, "orders").selectExpr(*parts, "CASE WHEN o_orderkey < 2 THEN '7' END AS few")
    return profile.kind_counts(df).selectExpr("column", "numeric_count", "non_null_count", f"{automl.promoted_sql()} AS promoted")


add(
    "numeric_promotion_orders",
    _promotion,
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({hit}) AS numeric_count, count(*) FILTER ({some}) AS non_null_count, "
        f"count(*) FILTER ({hit}) > 0 AND count(*) FILTER ({hit}) >= greatest(3, floor(0.6::DOUBLE * count(*) FILTER ({some}))) AS promoted FROM orders"
        for c, hit, some in [*((f"share{n}", f"o_orderkey % 20 < {n}", "true") for n in (11, 12, 13)), ("few", "o_orderkey < 2", "o_orderkey < 2")]
    ),
)


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").selectExpr("conv_id", "role", "array(role) AS listed", "struct(turn) AS held", "string(null) AS none", "nullif(turn, 0) AS turn")
    return spark.createDataFrame([(n,) for n in automl.usable_columns(df, profile.kind_counts(df))], "column string")


add(
    "usable_columns_conversations",
    _usable,
    "SELECT c AS \"column\" FROM (SELECT unnest([CASE WHEN count(conv_id) > 0 THEN 'conv_id' END, CASE WHEN count(role) > 0 THEN 'role' END, "
    "CASE WHEN count(nullif(turn, 0)) > 0 THEN 'turn' END]) AS c FROM conversations) WHERE c IS NOT NULL",
)


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automl.model_frame(table(spark, sf_dir, "labelled"), ["doc_id", "n_chars"], ["lang", "source", "text"], "quality", False)


add(
    "model_rows_labelled",
    lambda spark, d: rounded(_model_rows(spark, d).selectExpr("n0", "n1", "c0", "c1", "md5(c2) AS c2", "target")),
    f"SELECT CAST(doc_id AS DOUBLE) AS n0, CAST(n_chars AS DOUBLE) AS n1, {duck.text('lang', 'string')} AS c0, {duck.text('source', 'string')} AS c1, "
    f"md5({duck.text('text', 'string')}) AS c2, CAST(quality AS VARCHAR) AS target FROM {duck_source('labelled')} WHERE quality IS NOT NULL",
)
add(
    "category_positions_labelled",
    lambda spark, d: automl.category_dictionary(_model_rows(spark, d), 3).selectExpr("int(position) AS position", "column", "md5(value) AS value", "n"),
    "WITH cells AS ("
    + " UNION ALL ".join(
        f"SELECT {i} AS \"column\", {duck.text(c, 'string')} AS value FROM {duck_source('labelled')} WHERE quality IS NOT NULL"
        for i, c in enumerate(("lang", "source", "text"))
    )
    + "), counted AS (SELECT \"column\", value, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY ALL) "
    "SELECT CAST(row_number() OVER (ORDER BY n DESC, \"column\", value) - 1 AS INT) AS position, \"column\", md5(value) AS value, n FROM counted",
)


def _classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = materialize(table(spark, sf_dir, "labelled"), "labelled")  # a join, of which several passes follow
    return automl.candidate_table(automl.train(df, "quality", key=["doc_id"]), df)


def _regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automl.train(table(spark, sf_dir, "part"), "p_retailprice", key=["p_partkey"]).predictions


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automl.cluster_sizes(automl.cluster(table(spark, sf_dir, "part"), key=["p_partkey"]))


def _split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows held out and learned from, of the two classes of quality and of every source."""
    df = table(spark, sf_dir, "labelled")
    parts = [df.where(f"{name} IS NOT NULL").selectExpr("doc_id", f"string({name}) AS target") for name in ("quality", "source")]
    split = [automl.split_rows(part, True, ["doc_id"]) for part in parts]
    return split[0].unionByName(split[1]).groupBy("target").agg(
        F.count_if("held_out").alias("held_out"), F.count_if(~F.col("held_out")).alias("learned")
    )


_SPLIT_SQL = (
    "(SELECT target, CASE WHEN n >= 100 THEN chance < 200000 ELSE place <= greatest(1, round(0.2 * n)) AND n > 1 END AS held FROM ("
    "SELECT target, chance, count(*) OVER (PARTITION BY target) AS n, row_number() OVER (PARTITION BY target ORDER BY chance, doc_id) AS place "
    "FROM (SELECT doc_id, CAST({c} AS VARCHAR) AS target, CAST(concat('0x', substr(md5(concat('42:', doc_id)), 1, 8)) AS BIGINT) % 1000000 AS chance "
    "FROM {t} WHERE {c} IS NOT NULL)))"
)
add(
    "split_counts",
    _split_counts,
    "SELECT target, count(*) FILTER (held) AS held_out, count(*) FILTER (NOT held) AS learned FROM ("
    + " UNION ALL ".join("SELECT * FROM " + _SPLIT_SQL.format(c=c, t=duck_source("labelled")) for c in ("quality", "source"))
    + ") GROUP BY 1",
)
add(
    "classification_scores",
    lambda spark, d: rounded(
        automl.classification_metrics(table(spark, d, "labelled").where("quality IS NOT NULL").selectExpr("quality AS label", "toxic AS prediction"))
    ),
    "WITH p AS (SELECT quality AS label, toxic AS prediction FROM labels), classes AS (SELECT DISTINCT label AS class FROM p UNION SELECT prediction FROM p), "
    "f AS (SELECT 2 * count(*) FILTER (label = class AND prediction = class) / (count(*) FILTER (label = class) + count(*) FILTER (prediction = class)) AS f1 "
    f"FROM p, classes GROUP BY class) SELECT {r('(SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0 END) FROM p) AS accuracy', 'avg(f1) AS f1_macro')} FROM f",
)
add(
    "regression_scores",
    lambda spark, d: rounded(
        automl.regression_metrics(table(spark, d, "part").selectExpr("p_retailprice AS label", "p_retailprice * 0.9D + p_size AS prediction"))
    ),
    "WITH p AS (SELECT p_retailprice AS label, p_retailprice * 0.9::DOUBLE + p_size AS prediction FROM part), m AS (SELECT avg(label) AS mean FROM p) "
    + f"SELECT {r('1 - sum((label - prediction) ** 2) / sum((label - mean) ** 2) AS r2', 'sqrt(avg((label - prediction) ** 2)) AS rmse', 'avg(abs(label - prediction)) AS mae')} FROM p, m",
)
add("automl_classify", _classify)
add("automl_regress", _regress)
add("cluster_sweep", _clusters)


# --- streaming ---------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running profile after all available events; the sink keeps the latest one."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    path = scratch_path(spark, "stream")

    def keep(current: DataFrame, batch: int) -> None:
        current.write.mode("overwrite").parquet(f"{path}/profile")

    start_profile(stream, keep, f"{path}/state").awaitTermination()
    found = spark.read.parquet(f"{path}/profile")
    return rounded(found.select("column", "rows", "null_count", "non_null_count", "inferred_type", "count", "mean", "stddev", "min", "max"))


add(
    "stream_profile_events",
    _stream,
    f"WITH {duck.facts('events')} SELECT \"column\", \"rows\", null_count, non_null_count, inferred_type, n AS count, "
    f"{r('mean', 'stddev', 'lo AS min', 'hi AS max')} FROM facts",
)
