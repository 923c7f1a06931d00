"""The quick profile: lenient numbers, header-order statistics, global top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions import values as V
from tablescope.functions.values import literal, quoted
from tablescope.operators.cells import column_of
from tablescope.operators.correlate import all_correlations, top_correlations
from tablescope.operators.describe import descriptive_table, scores
from tablescope.operators.profile import moments
from tablescope.session import POSITION

# Fixed values of the quick profile.
TYPE_SAMPLE_ROWS = 200
NUMBER_SHARE = 0.8
TOP_PAIRS = 100
TOP_OUTLIERS = 50
OUTLIER_SIGMAS = 3.0
OUTLIER_LEAST_VALUES = 3
HEAD_ROWS = 3
QUANTILES = {0.05: "p5", 0.25: "p25", 0.5: "p50", 0.75: "p75", 0.95: "p95"}


def column_types(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """``number`` where at least 80 % of the non-empty values among the first 200 rows parse.

    The rows are one top-k over string columns; ``position`` keeps the header order.
    """
    names = [n for n in df.columns if n != POSITION]
    first = df.orderBy(*[column_of(k) for k in order_by]).limit(TYPE_SAMPLE_ROWS)
    aggregates, entries = [], []
    for i, name in enumerate(names):
        x = f"CAST({quoted(name)} AS STRING)"
        text = f"nullif({V.strip_sql(x)}, '')"
        aggregates += [f"count({text}) AS filled{i}", f"count({_any_number_sql(x)}) AS hits{i}"]
        entries.append(
            f"struct({i + 1} AS position, {literal(name)} AS column, "
            f"CASE WHEN filled{i} > 0 AND hits{i} / filled{i} >= {NUMBER_SHARE}D THEN 'number' ELSE 'string' END AS type)"
        )
    return first.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(entries)}))")


def _any_number_sql(x: str) -> str:
    """Lenient number, where ``nan`` also counts as one."""
    s = f"(replace({V.strip_sql(x)}, ','))"
    return f"CASE WHEN {V.number_word_sql(s)} OR lower({s}) IN ('nan', '+nan', '-nan') THEN 1 END"


def number_names(types: DataFrame) -> list[str]:
    """Columns of type ``number`` in header order; one short list decides which columns are read."""
    rows = types.where("type = 'number'").select("position", "column").collect()
    return [r["column"] for r in sorted(rows)]


def lenient_frame(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The number columns as finite doubles."""
    wide = df.selectExpr(*[f"{V.lenient_number_sql(f'CAST({quoted(n)} AS STRING)')} AS {quoted(n)}" for n in names])
    return wide.selectExpr(*[f"{V.finite_sql(quoted(n))} AS {quoted(n)}" for n in names])


def stats_table(numbers: DataFrame) -> DataFrame:
    """One row per column of ``lenient_frame`` output, also for columns without any value."""
    table = descriptive_table(numbers, names=QUANTILES).withColumnRenamed("stddev", "std")
    listed = ", ".join(literal(n) for n in numbers.columns)
    names = numbers.sparkSession.range(1).selectExpr(f"explode(array({listed})) AS column")
    return names.join(F.broadcast(table), "column", "left").na.fill({"count": 0})


def correlations(numbers: DataFrame, limit: int = TOP_PAIRS) -> DataFrame:
    """Strongest pairs, each in header order."""
    top = top_correlations(all_correlations(numbers, numbers.columns), limit)
    return top.selectExpr("left AS feature_x", "right AS feature_y", "correlation AS pearson_r", "sample_size AS n")


def outliers(numbers: DataFrame, limit: int = TOP_OUTLIERS) -> DataFrame:
    """The values with the largest signed z-scores over all columns."""
    far = scores(numbers, moments(numbers), OUTLIER_LEAST_VALUES, OUTLIER_SIGMAS)
    return far.orderBy(F.desc(F.abs("z")), "column", "value").limit(limit)


def shape(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.selectExpr("count(1) AS rows", f"{len(columns)}L AS columns")


def head_rows(df: DataFrame, order_by: Sequence[str], limit: int = HEAD_ROWS) -> DataFrame:
    return df.orderBy(*[column_of(k) for k in order_by]).limit(limit).drop(POSITION)
