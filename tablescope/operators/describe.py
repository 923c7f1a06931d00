"""Descriptive statistics: quantile tables, outliers, histograms, box plots, scatter points."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.values import literal, number_literal, quoted
from tablescope.operators.cells import aggregate_numbers, numeric_slots
from tablescope.operators.profile import moments, numeric_row_sample
from tablescope.operators.quantiles import exact_quantiles, quantile_columns
from tablescope.session import per_column, pinned

# Reported quantiles, outlier rule and how many pairs get scatter points.
QUANTILES = {0.05: "q5", 0.25: "q25", 0.5: "q50", 0.75: "q75", 0.95: "q95"}
OUTLIER_SIGMAS = 3.0
OUTLIER_LEAST_VALUES = 5
OUTLIERS_PER_COLUMN = 10
MAX_SCATTERS = 3


def descriptive_table(
    df: DataFrame, stats: DataFrame | None = None, names: dict[float, str] = QUANTILES
) -> DataFrame:
    """count, mean, stddev, min, max and quantiles of every column holding a number."""
    stats = pinned(moments(df)) if stats is None else stats
    quantiles = quantile_columns(exact_quantiles(df, stats, list(names)), names)
    table = stats.select("column", "count", "mean", "stddev", "min", "max")
    return table.join(F.broadcast(quantiles), "column").orderBy("column")


def scores(df: DataFrame, stats: DataFrame, least: int, sigmas: float) -> DataFrame:
    """Rows ``(column, value, z)`` of the values at least ``sigmas`` deviations from the mean."""
    usable = per_column(stats.where(f"count >= {least} AND stddev > 0 AND stddev < double('inf')"))
    if not usable:
        return df.sparkSession.createDataFrame([], "column string, value double, z double")
    far = {}
    for name, f in usable.items():
        z = f"(({{x}} - {number_literal(f['mean'])}) / {number_literal(f['stddev'])})"
        far[name] = {"z": f"CASE WHEN abs({z}) >= {number_literal(sigmas)} THEN {z} END"}
    return numeric_slots(df, far).selectExpr("column", "num AS value", "z")


def outliers(df: DataFrame, stats: DataFrame | None = None, limit: int = OUTLIERS_PER_COLUMN) -> DataFrame:
    """The ``limit`` values per column farthest from the mean, three deviations or more."""
    far = scores(df, moments(df) if stats is None else stats, OUTLIER_LEAST_VALUES, OUTLIER_SIGMAS)
    far = far.selectExpr("column", "value", "abs(z) AS zscore")
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("zscore"), "value"))
    return far.withColumn("place", place).where(f"place <= {limit}").select("column", "place", "value", "zscore")


def numeric_ranking(stats: DataFrame, limit: int | None = None) -> DataFrame:
    """Columns with the most numbers first, ties alphabetical; all of them or the first ``limit``."""
    top = stats.where("count > 0").orderBy(F.desc("count"), "column")
    top = top if limit is None else top.limit(limit)
    return top.select(
        "column", "count", F.row_number().over(Window.orderBy(F.desc("count"), "column")).alias("place")
    )


def histogram_bins(table: DataFrame) -> DataFrame:
    """Number of bins per row of a descriptive table: Freedman-Diaconis, else the square root rule."""
    root = "bround(sqrt(count))"
    width = "2D * (q75 - q25) * power(double(count), -1D / 3D)"
    return table.selectExpr(
        "column",
        "count",
        "min",
        "max",
        f"int(CASE WHEN count < 2 THEN 1 WHEN q75 - q25 <> 0 AND max - min <> 0 AND {width} > 0 "
        f"THEN least(greatest(1, bround((max - min) / ({width}))), greatest(1, {root} * 10)) "
        f"ELSE greatest(1, {root}) END) AS bins",
    )


def _edge(i: str) -> str:
    return f"(first + ({i}) * ((last - first) / bins))"


def histogram(df: DataFrame, bins: DataFrame) -> DataFrame:
    """Counts in equal-width bins over each column's range; empty bins are listed too.

    The last bin includes the maximum. A column with one distinct value is
    spread half a unit to each side. ``bins`` has one row per column.
    """
    spread = pinned(
        bins.where("count >= 2").selectExpr(
            "column",
            "bins",
            "CASE WHEN min = max THEN min - 0.5D ELSE min END AS first",
            "CASE WHEN min = max THEN max + 0.5D ELSE max END AS last",
        )
    )
    every = spread.selectExpr("*", "explode(sequence(0, bins - 1)) AS bin")
    slots = {}
    for name, b in per_column(spread).items():
        known = {"first": number_literal(b["first"]), "last": number_literal(b["last"]), "bins": str(b["bins"])}
        raw = "least(int(floor(({x} - first) / (last - first) * bins)), bins - 1)"
        fixed = (
            f"{raw} - CASE WHEN {{x}} < {_edge(raw)} THEN 1 ELSE 0 END "
            f"+ CASE WHEN {raw} < bins - 1 AND {{x}} >= {_edge(raw + ' + 1')} THEN 1 ELSE 0 END"
        )
        slots[name] = {"bin": re.sub(r"\b(first|last|bins)\b", lambda m: known[m[1]], fixed)}
    if not slots:
        return every.selectExpr("column", "bin", "first AS low", "last AS high", "0L AS size")
    counted = numeric_slots(df, slots).groupBy("column", "bin").agg(F.expr("count(1) AS size"))
    return every.join(counted, ["column", "bin"], "left").selectExpr(
        "column",
        "bin",
        f"{_edge('bin')} AS low",
        f"CASE WHEN bin = bins - 1 THEN last ELSE {_edge('bin + 1')} END AS high",
        "coalesce(size, 0L) AS size",
    )


def box_stats(df: DataFrame, table: DataFrame) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and the number of fliers."""
    boxes = pinned(table.where("count >= 2").select("column", "count", "q25", "q50", "q75"))
    fences = {}
    for name, b in per_column(boxes).items():
        reach = 1.5 * (b["q75"] - b["q25"])
        low, high = number_literal(b["q25"] - reach), number_literal(b["q75"] + reach)
        fences[name] = {
            "low_value": f"min(CASE WHEN {{x}} >= {low} THEN {{x}} END)",
            "high_value": f"max(CASE WHEN {{x}} <= {high} THEN {{x}} END)",
            "fliers": f"count_if({{x}} < {low} OR {{x}} > {high})",
        }
    if not fences:
        return boxes.selectExpr("column", "count", "q25 AS whisker_low", "q25", "q50", "q75", "q75 AS whisker_high", "0L AS fliers")
    return boxes.join(F.broadcast(aggregate_numbers(df, fences)), "column").selectExpr(
        "column",
        "count",
        "least(low_value, q25) AS whisker_low",
        "q25",
        "q50",
        "q75",
        "greatest(high_value, q75) AS whisker_high",
        "fliers",
    )


def scatter_points(
    df: DataFrame, pairs: DataFrame, columns: Sequence[str], order_by: Sequence[str], limit: int
) -> DataFrame:
    """Points of each pair ``(left, right)`` for a sample of ``limit`` rows holding a number.

    The sample is those rows whose key has the smallest MD5, so it favours no part of the
    table; it is one top-k. ``pairs`` is a short list and is broadcast to it.
    """
    sample = numeric_row_sample(df, order_by, columns, limit, shuffled=True)
    names, numbers_of = ", ".join(literal(n) for n in columns), ", ".join(quoted(n) for n in columns)
    numbers = sample.selectExpr("key", f"map_from_arrays(array({names}), array({numbers_of})) AS num")
    return (
        numbers.selectExpr("key", "num", "explode(map_keys(num)) AS left")
        .join(F.broadcast(pairs.select("left", "right")), "left")
        .selectExpr("left", "right", "key", "num[left] AS x", "num[right] AS y")
        .where("x IS NOT NULL AND y IS NOT NULL")
    )

