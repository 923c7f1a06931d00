"""The full profile of a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.operators import correlate, describe, profile, quality, report
from tablescope.operators.automl import ModelReport, candidate_table, cluster, train
from tablescope.session import POSITION, at_once, key_of, materialize, pinned
from tablescope.sources import sinks


# What the manifest says of a phase and of the tables that have a text of their own.
PHASE_TEXT = "Serialized output for the {} phase."
TEXTS = {
    "results/descriptive_stats.csv": "Descriptive statistics for numeric columns.",
    "results/correlations.csv": "Pairwise Pearson correlations for numeric columns.",
    "results/outliers.json": "Detected outliers per column using a z-score heuristic.",
    "results/results.json": "Consolidated analytics results payload.",
    "results/manifest.json": "Manifest describing generated analytics artifacts.",
}
MANIFEST, DOCUMENT = "results/manifest.json", "results/results.json"


@dataclass
class Report:
    """Result tables of a profile. The tables with one row per column are settled; the others run when used."""

    profile: DataFrame
    schema: DataFrame
    facts: DataFrame
    checks: DataFrame
    ranges: DataFrame
    cardinality: DataFrame
    duplicates: DataFrame
    issues: DataFrame
    severities: DataFrame
    descriptive: DataFrame
    correlations: DataFrame
    matrix: DataFrame
    outliers: DataFrame
    histograms: DataFrame
    boxes: DataFrame
    metrics: DataFrame
    summary: DataFrame
    preview: DataFrame | None = None
    scatter: DataFrame | None = None
    inference: ModelReport | None = None

    def tables(self) -> dict[str, tuple[str, DataFrame]]:
        """All result tables by relative key, with their kind; what is not there was not asked for."""
        found = {
            "phases/ingest.json": ("json", self.metrics.select("rows", "columns")),
            "phases/profile.json": ("json", self.profile),
            "phases/dq_validate.json": ("json", self.issues),
            "phases/dq_severities.json": ("json", self.severities),
            "phases/dq_ranges.json": ("json", self.ranges),
            "phases/dq_cardinality.json": ("json", self.cardinality),
            "phases/dq_duplicates.json": ("json", self.duplicates),
            "phases/descriptive_stats.json": ("json", self.descriptive),
            "phases/nl_report.json": ("json", self.summary),
            "phases/finalize.json": ("json", self.metrics),
            "results/descriptive_stats.csv": ("csv", self.descriptive),
            "results/correlations.csv": ("csv", self.correlations),
            "results/outliers.json": ("json", self.outliers),
            "results/graphs/histograms.csv": ("csv", self.histograms),
            "results/graphs/box_plots.csv": ("csv", self.boxes),
            "results/graphs/correlation_matrix.csv": ("csv", self.matrix),
            "results/report.txt": ("text", self.summary),
        }
        if self.preview is not None:
            found["results/preview.csv"] = ("csv", self.preview)
        if self.scatter is not None:
            found["results/graphs/scatter.csv"] = ("csv", self.scatter)
        if self.inference is not None:
            found["phases/ml_inference.json"] = ("json", candidate_table(self.inference, self.summary))
            if self.inference.predictions is not None:
                found["results/predictions.csv"] = ("csv", self.inference.predictions)
        return found

    def manifest(self, path: str) -> DataFrame:
        """Every table that ``write`` writes below ``path``."""
        listed = [(key, kind) for key, (kind, _) in self.tables().items()] + [(DOCUMENT, "json"), (MANIFEST, "json")]
        if self.inference is not None and self.inference.model is not None:
            listed.append(("results/model", "model"))
        phase = lambda key: PHASE_TEXT.format(key[7:].removesuffix(".json")) if key.startswith("phases/") else None
        return report.manifest(self.summary.sparkSession, [(k, kind, TEXTS.get(k) or phase(k)) for k, kind in listed], path)

    def document(self, entries: DataFrame) -> DataFrame:
        inference = candidate_table(self.inference, self.summary) if self.inference is not None else None
        return report.results_document(self.metrics, self.schema, self.correlations, self.outliers, entries, inference)

    def write(self, path: str, mode: str = "ignore") -> DataFrame:
        """Write all tables below ``path`` and return the manifest.

        The manifest is written last and marks a finished result. ``ignore`` keeps a finished
        result as it is; whatever an unfinished run left is written anew, so no result
        holds tables of two runs. Results are read back before they are reported.
        """
        spark = self.summary.sparkSession
        if mode == "ignore" and (finished := finished_manifest(spark, path)) is not None:
            return finished
        writers = {"csv": sinks.write_csv, "json": sinks.write_json, "text": sinks.write_text}
        tables = self.tables().items()
        at_once(spark, *[partial(writers[kind], table, f"{path}/{key}", "overwrite") for key, (kind, table) in tables])
        if self.inference is not None and self.inference.model is not None:
            self.inference.model.write().overwrite().save(f"{path}/results/model")
        entries = self.manifest(path)
        sinks.write_text(self.document(entries), f"{path}/{DOCUMENT}", "overwrite")
        sinks.write_json(entries, f"{path}/{MANIFEST}", "overwrite")
        return entries


def finished_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifest of a finished result below ``path``; None if there is none."""
    return sinks.read_finished(spark, f"{path}/{MANIFEST}", "name string, description string, content_type string, key string")


def write_profile(df: DataFrame, path: str, **options) -> DataFrame:
    """Profile ``df`` and write the result below ``path``, unless a finished one is there; returns the manifest.

    A finished result is found before anything is computed.
    """
    finished = finished_manifest(df.sparkSession, path)
    return profile_dataset(df, **options).write(path) if finished is None else finished


def profile_dataset(
    df: DataFrame,
    order_by: Sequence[str] | None = None,
    write_source: bool = False,
    settle: bool = True,
    modelling: bool = False,
    clustering: bool = False,
    scatter_rows: int = profile.NUMERIC_SAMPLE_ROWS,
    charts: int | None = None,
    bytes_read: DataFrame | None = None,
) -> Report:
    """Profile every column of ``df`` over all rows.

    ``order_by`` names a key and adds first values, first rows and scatter points. Tables
    that know the places of their rows in files (``read_dataset(position=True)``) have them without a key.
    ``write_source`` stores the input once as Parquet in the shared folder, for sources that
    are slow to parse. ``settle`` keeps the tables with a few rows per column that later steps
    build on, so the scans behind them run once; they run before this returns, those that don't need each other at once. ``modelling``
    adds the automated models, ``clustering`` the clusters instead. ``charts`` limits the columns with
    histograms, box plots and a place in the matrix to those with the most numbers.
    ``bytes_read`` is the size of the source (see ``source_metadata``).
    """

    spark = df.sparkSession

    def kept(table: DataFrame, name: str) -> DataFrame:
        return materialize(table, name) if settle else table

    def small(table: DataFrame) -> DataFrame:
        return pinned(table) if settle else table

    if write_source:
        df = materialize(df, "source")
    keyed, key, order_by, df = df, order_by or (), key_of(df, order_by), df.drop(POSITION)
    facts, duplicates = at_once(
        spark, lambda: small(profile.column_facts(df)), lambda: small(profile.duplicate_rows(df))
    )
    stats = facts.where("count > 0")
    # What needs the facts alone, in jobs that share the executors.
    columns, ranges, descriptive, pairs, far = at_once(
        spark,
        lambda: kept(profile.column_profile(keyed, order_by, facts), "profile").orderBy("column"),
        lambda: small(quality.numeric_range(df, facts)),
        lambda: small(describe.descriptive_table(df, stats)).orderBy("column"),
        lambda: kept(correlate.all_correlations(df, stats=stats), "pairs"),
        lambda: small(describe.outliers(df, stats)).orderBy("column", "place"),
    )
    cardinality = quality.categorical_cardinality(
        facts, columns.select("column", "distinct_count", "distinct_overflow")
    )
    checks = quality.column_checks(facts, ranges, cardinality)
    issues = small(quality.issues_table(checks, duplicates)).orderBy(F.col("column").asc_nulls_last(), "seq")
    severities = quality.severity_summary(issues)
    correlations = correlate.top_correlations(pairs)
    bins = describe.histogram_bins(descriptive)
    mapped = describe.numeric_ranking(stats, charts)
    charted = mapped.select("column")

    metrics = small(report.dataset_metrics(facts, severities, bytes_read))
    inference = train(df, key=key) if modelling else cluster(df, key=key) if clustering else None
    scatter = None
    if order_by:
        numbers = [r["column"] for r in stats.select("column").orderBy("column").collect()]
        strongest = correlate.top_correlations(pairs, describe.MAX_SCATTERS)
        scatter = describe.scatter_points(keyed, strongest, numbers, order_by, scatter_rows) if numbers else None
    return Report(
        profile=columns,
        schema=profile.schema_table(columns),
        facts=facts,
        checks=checks,
        ranges=ranges,
        cardinality=cardinality,
        duplicates=quality.duplicate_severity(duplicates),
        issues=issues,
        severities=severities,
        descriptive=descriptive,
        correlations=correlations,
        matrix=correlate.correlation_matrix(pairs, mapped),
        outliers=far,
        histograms=describe.histogram(df, bins.join(F.broadcast(charted), "column", "left_semi")),
        boxes=describe.box_stats(df, descriptive.join(F.broadcast(charted), "column", "left_semi")),
        metrics=metrics,
        summary=small(report.narrative(metrics, correlations, far)),
        preview=profile.preview(keyed, order_by) if order_by else None,
        scatter=scatter,
        inference=inference,
    )
