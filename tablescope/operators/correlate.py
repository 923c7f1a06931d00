"""Pairwise Pearson correlations over all rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.values import literal, number_literal
from tablescope.operators.cells import typed_columns
from tablescope.operators.profile import moments
from tablescope.session import per_column

TOP_PAIRS = 20

# A variance smaller than this part of the mean square is rounding: the values are all the same.
SAME = 1e-12
_SUMS = ("n", "xy", "x", "y", "xx", "yy")


def all_correlations(
    df: DataFrame, columns: Sequence[str] | None = None, stats: DataFrame | None = None
) -> DataFrame:
    """Rows ``(left, right, correlation, sample_size)`` for every pair of numeric columns.

    Pairs come in the order of ``columns`` (alphabetical by default) and use the rows where
    both sides hold a number. Values enter as standard scores, so sums of products lose no
    precision. One scan, however many columns: each task turns its batches into products of
    matrices and sends one row per pair; pairs without variance are left out.
    """
    facts = per_column((moments(df, columns) if stats is None else stats).where("count >= 2 AND stddev > 0 AND stddev < double('inf')"))
    names = [n for n in (facts if columns is None else columns) if n in facts]
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "left string, right string, correlation double, sample_size bigint")
    scores = typed_columns(df, names, (), ("num",)).selectExpr(
        *[
            f"(num{i} - {number_literal(facts[n]['mean'])}) / {number_literal(facts[n]['stddev'])} AS z{i}"
            for i, n in enumerate(names)
        ]
    )
    cells = scores.mapInArrow(_pair_sums(len(names)), "i int, j int, n bigint, " + ", ".join(f"{c} double" for c in _SUMS[1:]))
    sums = cells.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])
    listed = f"array({', '.join(literal(n) for n in names)})"
    spread_x, spread_y = "(xx - x * x / n)", "(yy - y * y / n)"
    found = sums.where(f"n >= 2 AND {spread_x} > {SAME}D * xx AND {spread_y} > {SAME}D * yy").selectExpr(
        f"{listed}[i] AS left",
        f"{listed}[j] AS right",
        f"(xy - x * y / n) / (sqrt({spread_x}) * sqrt({spread_y})) AS correlation",
        "n AS sample_size",
    )
    return found.where("correlation IS NOT NULL AND NOT isnan(correlation)")


def _pair_sums(width: int):
    """A task's sums over the rows where both columns of a pair hold a number, for all pairs i < j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, width, width))
        for batch in batches:
            for low in range(0, len(batch), 4096):
                part = batch.slice(low, 4096)
                held = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in part.columns]).astype(float)
                z = np.column_stack([c.fill_null(0).to_numpy(zero_copy_only=False) for c in part.columns]).astype(float)
                total += np.stack([held.T @ held, z.T @ z, z.T @ held, (z * z).T @ held])
        i, j = np.triu_indices(width, 1)
        n, xy, x, xx = total
        sums = [n[i, j].astype(np.int64), xy[i, j], x[i, j], x[j, i], xx[i, j], xx[j, i]]
        columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, sums)]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "n", "xy", "x", "y", "xx", "yy"])

    return run


def top_correlations(pairs: DataFrame, limit: int = TOP_PAIRS) -> DataFrame:
    """Strongest pairs first; ties by name."""
    return pairs.orderBy(F.desc(F.abs("correlation")), "left", "right").limit(limit)


def correlation_matrix(pairs: DataFrame, ranking: DataFrame) -> DataFrame:
    """Long form ``(left, right, correlation)`` over the ranked columns, both directions and a diagonal of 1.

    Undefined pairs are NaN. ``ranking`` is a short top-k list of columns.
    """
    names = ranking.select("column")
    both = pairs.select("left", "right", "correlation").unionByName(
        pairs.selectExpr("right AS left", "left AS right", "correlation")
    )
    listed = names.agg(F.collect_list("column").alias("others"))
    grid = listed.selectExpr("others", "explode(others) AS left").selectExpr("left", "explode(others) AS right")
    return grid.join(both, ["left", "right"], "left").selectExpr(
        "left", "right", "CASE WHEN left = right THEN 1D ELSE coalesce(correlation, double('NaN')) END AS correlation"
    )
