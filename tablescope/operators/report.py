"""Report: dataset metrics, narrative, extracts, manifest and the results document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions import values as V
from tablescope.operators.correlate import top_correlations
from tablescope.operators.profile import completeness
from tablescope.operators.quality import rules_evaluated
from tablescope.sources.sinks import CONTENT_TYPES

# Sizes of the extracts, sentences of the report and texts of the manifest.
REPORT_ISSUES = 20
REPORT_CORRELATIONS = 10
REPORT_OUTLIER_COLUMNS = 5
REPORT_OUTLIER_VALUES = 5
CLOSING_SENTENCE = "Further modeling pipelines can build on these profiling insights."
DEFAULT_DESCRIPTIONS = (
    (".html", "HTML artifact generated during dataset analysis."),
    (".txt", "Text artifact generated during dataset analysis."),
    (".csv", "Tabular artifact generated during dataset analysis."),
    (".json", "JSON artifact generated during dataset analysis."),
)
VISUAL_DESCRIPTION = "Visualization asset generated during dataset analysis."
OTHER_DESCRIPTION = "Generated artifact from the analytics pipeline."


def _one_struct(df: DataFrame) -> Column:
    """The only row of a one-row table as a scalar subquery; no join is involved."""
    return df.select(F.struct("*")).scalar()


def dataset_metrics(facts: DataFrame, severities: DataFrame, bytes_read: DataFrame | None = None) -> DataFrame:
    """One row: rows, columns, bytes, completeness, quality score and issue counts."""
    size = facts.selectExpr("coalesce(max(rows), 0L) AS rows", "count(1) AS columns")
    out = size.withColumn("completeness", completeness(facts).scalar())
    out = out.withColumn("rules_evaluated", rules_evaluated(facts).scalar())
    if bytes_read is not None:
        out = out.withColumn("bytes_read", bytes_read.agg(F.sum("bytes_read")).scalar())
    return out.withColumn("dq", _one_struct(severities)).select("*", "dq.*").drop("dq")


def narrative(metrics: DataFrame, correlations: DataFrame, outliers: DataFrame) -> DataFrame:
    """One row of text. All inputs are short lists."""
    strongest = correlations.orderBy(F.desc(F.abs("correlation")), "left", "right").limit(1).selectExpr(
        "concat('Strongest correlation observed between ', left, ' and ', right, ' (r=', "
        "format_string('%.2f', correlation), ').') AS text"
    )
    first_column = outliers.where("place <= 2").groupBy("column").agg(
        F.expr("array_sort(collect_list(struct(place, value))).value AS found")
    )
    far = first_column.orderBy("column").limit(1).selectExpr(
        "concat('Potential outliers detected in ', column, ': ', "
        "array_join(transform(found, v -> format_string('%.2f', v)), ', '), '.') AS text"
    )
    sized = metrics.selectExpr(
        "concat('The dataset contains ', CASE WHEN rows > 0 THEN concat(format_number(rows, 0), ' rows') "
        "ELSE 'an unknown number of rows' END, ' across ', columns, ' columns.') AS size_text",
        "concat('Data quality score ', format_string('%.2f', score), '.') AS score_text",
    )
    return sized.select(
        F.concat_ws(
            " ", "size_text", "score_text", strongest.scalar(), far.scalar(), F.lit(CLOSING_SENTENCE)
        ).alias("summary")
    )


def top_issues(issues: DataFrame) -> DataFrame:
    first = issues.orderBy(F.col("column").asc_nulls_last(), "seq").limit(REPORT_ISSUES)
    return first.select("rule", "column", "message", "severity")


def strongest_pairs(pairs: DataFrame) -> DataFrame:
    return top_correlations(pairs, REPORT_CORRELATIONS).select("left", "right", "correlation")


def top_outliers(outliers: DataFrame) -> DataFrame:
    """First five outlier columns, five values each; the input has ten rows per column at most."""
    columns = outliers.select("column").distinct().orderBy("column").limit(REPORT_OUTLIER_COLUMNS)
    return outliers.where(f"place <= {REPORT_OUTLIER_VALUES}").join(F.broadcast(columns), "column", "left_semi")


def content_type_sql() -> str:
    """By kind, else by name ending."""
    kinds = " ".join(f"WHEN '{kind}' THEN '{ctype}'" for kind, ctype in CONTENT_TYPES.items())
    ends = (
        "WHEN endswith(lower(key), '.csv') THEN 'text/csv' WHEN endswith(lower(key), '.json') THEN 'application/json' "
        "WHEN endswith(lower(key), '.txt') THEN 'text/plain' WHEN endswith(lower(key), '.html') THEN 'text/html' "
        "WHEN endswith(lower(key), '.png') THEN 'image/png' WHEN endswith(lower(key), '.zip') THEN 'application/zip'"
    )
    return f"coalesce(CASE kind {kinds} END, CASE {ends} ELSE 'application/octet-stream' END)"


def description_sql() -> str:
    ends = " ".join(f"WHEN endswith(key, '{end}') THEN {V.literal(text)}" for end, text in DEFAULT_DESCRIPTIONS)
    return (
        f"coalesce(nullif(trim(description), ''), CASE WHEN startswith(key, 'results/graphs/') OR kind = 'image' "
        f"THEN {V.literal(VISUAL_DESCRIPTION)} {ends} ELSE {V.literal(OTHER_DESCRIPTION)} END)"
    )


def manifest(spark: SparkSession, written: Sequence[tuple[str, str, str | None]], prefix: str) -> DataFrame:
    """One row per written table ``(key, kind, description)``: name, description, content type, key."""
    rows = spark.createDataFrame([*written], "key string, kind string, description string")
    return rows.selectExpr(
        "CASE WHEN startswith(key, 'phases/') THEN replace(substring(key, 8), '.json', '_json') "
        "WHEN key IN ('results/results.json', 'results/manifest.json') THEN replace(replace(key, '/', '_'), '.json', '') "
        "ELSE replace(key, '/', '_') END AS name",
        f"{description_sql()} AS description",
        f"{content_type_sql()} AS content_type",
        f"concat({V.literal(prefix + '/')}, key) AS key",
    )


def results_document(
    metrics: DataFrame,
    schema: DataFrame,
    correlations: DataFrame,
    outliers: DataFrame,
    entries: DataFrame,
    inference: DataFrame | None = None,
) -> DataFrame:
    """One row of JSON with summary, schema, metrics, extracts, manifest and links; all inputs are short lists."""

    def listed(df: DataFrame) -> Column:
        return df.agg(F.sort_array(F.collect_list(F.struct("*")))).scalar()

    parts = [
        F.struct("rows", "columns", "completeness", F.col("score").alias("dq_score")).alias("summary"),
        listed(schema).alias("schema"),
        F.struct("*").alias("metrics"),
        listed(correlations).alias("correlations"),
        listed(outliers).alias("outliers"),
        listed(entries).alias("manifest"),
        entries.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "key"))))).scalar().alias("links"),
    ]
    if inference is not None:
        parts.append(listed(inference).alias("ml_inference"))
    return metrics.select(F.to_json(F.struct(*parts)).alias("document"))

