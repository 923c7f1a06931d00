"""Exact quantiles of every numeric column without sorting or shuffling the values.

The quantile at ``p`` interpolates between the order statistics at
``floor(p (n - 1))`` and ``ceil(p (n - 1))``. They are found by counting:

1. count the values of each column in a fixed number of intervals, with the smallest
   and largest value of each; running totals name the intervals that hold the wanted ranks;
2. wanted intervals that hold very many values are counted again in finer ones, until none is left;
3. the values inside the wanted intervals are counted one by one.

Each step is one scan with a map-side partial aggregate whose result is bounded by the
number of intervals, not by the data: no task ever collects a column, and a value
that fills a third of the table is just one large count. The interval scale only decides
how fast the search closes in; the result is exact for any distribution. The wanted intervals
(at most two per column and probability) are read after each step and become literals
of the next one, so no step joins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.values import number_literal
from tablescope.operators.cells import numeric_slots
from tablescope.session import per_column

INTERVALS = 2048
# A wanted interval holding more values than this is split before values are counted singly.
INTERVAL_ROWS = 1_000_000

_FOUND = "column string, p double, rank bigint, num double"


class Span(NamedTuple):
    """A range of a column's values, the rows below it and the wanted ranks inside it."""

    column: str
    lo: float
    hi: float
    below: int
    size: int
    wanted: tuple[tuple[float, int], ...]


def _even(span: Span) -> str:
    """Position inside the span on an even scale; halves keep the width finite."""
    lo, hi = number_literal(span.lo / 2), number_literal(span.hi / 2)
    return f"try_divide({{x}} / 2 - {lo}, {hi} - {lo})"


def _curved(span: Span, mean: float, stddev: float) -> str:
    """Position on a monotone scale, linear near the mean and logarithmic in the tails."""
    if not (math.isfinite(mean) and 0 < stddev < math.inf):
        return _even(span)
    x, lo, hi = (
        f"signum(({v} - {number_literal(mean)}) / {number_literal(stddev)}) "
        f"* log1p(abs(({v} - {number_literal(mean)}) / {number_literal(stddev)}))"
        for v in ("{x}", number_literal(span.lo), number_literal(span.hi))
    )
    return f"(({x} - {lo}) / ({hi} - {lo}))"


def _ranks(p: float, count: int) -> tuple[int, int, float]:
    """Both order statistics of the quantile and the weight of the upper one."""
    position = p * (count - 1)
    return math.floor(position), math.ceil(position), position - math.floor(position)


def _count_intervals(df: DataFrame, spans: list[Span], positions: list[str]) -> list[Span]:
    """Count each span in intervals and return those that hold a wanted rank.

    ``positions`` scales the values of each span to 0..1. The counted intervals stay in Spark.
    """
    slots: dict[str, str] = {}
    for number, (span, position) in enumerate(zip(spans, positions)):
        place = f"greatest(0L, least(bigint(floor({position} * {INTERVALS})), {INTERVALS - 1}L))"
        inside = f"{{x}} BETWEEN {number_literal(span.lo)} AND {number_literal(span.hi)}"
        slots[span.column] = slots.get(span.column, "") + f" WHEN {inside} THEN {number * INTERVALS}L + {place}"
    counted = (
        numeric_slots(df, {column: {"slot": f"CASE{cases} END"} for column, cases in slots.items()})
        .groupBy("slot")
        .agg(F.expr("count(1) AS size"), F.expr("min(num) AS lo"), F.expr("max(num) AS hi"))
        .selectExpr("*", f"slot DIV {INTERVALS} AS span")
        .selectExpr("*", "sum(size) OVER (PARTITION BY span ORDER BY slot) AS stop")
    )
    ranks = [(i, p, rank - span.below) for i, span in enumerate(spans) for p, rank in span.wanted]
    listed = df.sparkSession.createDataFrame(ranks, "span bigint, p double, rank bigint")
    hits = (
        counted.join(F.broadcast(listed), "span")
        .where("rank >= stop - size AND rank < stop")
        .groupBy("span", "slot", "lo", "hi", "size", "stop")
        .agg(F.expr("collect_list(struct(p, rank)) AS wanted"))
    )
    return [
        Span(
            spans[h["span"]].column, h["lo"], h["hi"], spans[h["span"]].below + h["stop"] - h["size"], h["size"],
            tuple((w["p"], w["rank"] + spans[h["span"]].below) for w in h["wanted"]),
        )
        for h in hits.collect()
    ]


def exact_quantiles(
    df: DataFrame, stats: DataFrame, probs: Sequence[float], interval_rows: int = INTERVAL_ROWS
) -> DataFrame:
    """Rows ``(column, p, q)`` for the numeric columns of ``df``, whose moments are ``stats``."""
    spark = df.sparkSession
    facts = per_column(stats.where("count > 0"))
    probs = [float(p) for p in probs]
    whole = [
        Span(c, f["min"], f["max"], 0, f["count"], tuple(sorted({(p, k) for p in probs for k in _ranks(p, f["count"])[:2]})))
        for c, f in facts.items()
    ]
    varied = [s for s in whole if s.lo < s.hi]
    positions = [_curved(s, facts[s.column]["mean"], facts[s.column]["stddev"]) for s in varied]
    spans = _count_intervals(df, varied, positions) if varied else []
    while crowded := [s for s in spans if s.size > interval_rows and s.lo < s.hi]:
        finer = _count_intervals(df, crowded, [_even(s) for s in crowded])
        spans = [s for s in spans if s not in crowded] + finer
        if set(finer) == set(crowded):  # neighbouring numbers, nothing left to split
            break

    # Count the single values of every wanted interval that holds more than one.
    closed = [s for s in [*whole, *spans] if s.lo == s.hi]
    found = spark.createDataFrame([(s.column, p, rank, s.lo) for s in closed for p, rank in s.wanted], _FOUND)
    open_spans = [s for s in spans if s.lo < s.hi]
    if open_spans:
        found = found.unionByName(_count_singles(df, open_spans))
    weights = [(c, p, _ranks(p, f["count"])[2]) for c, f in facts.items() for p in probs]
    weights = F.broadcast(spark.createDataFrame(weights, "column string, p double, frac double"))
    return (
        found.groupBy("column", "p")
        .agg(F.expr("min_by(num, rank) AS low"), F.expr("max_by(num, rank) AS high"))
        .join(weights, ["column", "p"])
        .selectExpr("column", "p", "CASE WHEN frac = 0 THEN low ELSE low * (1 - frac) + high * frac END AS q")
    )


def _count_singles(df: DataFrame, spans: list[Span]) -> DataFrame:
    slots: dict[str, str] = {}
    for number, span in enumerate(spans):
        inside = f"{{x}} BETWEEN {number_literal(span.lo)} AND {number_literal(span.hi)}"
        slots[span.column] = slots.get(span.column, "") + f" WHEN {inside} THEN {number}"
    wanted = [(i, s.column, p, rank, rank - s.below) for i, s in enumerate(spans) for p, rank in s.wanted]
    listed = df.sparkSession.createDataFrame(wanted, "slot int, column string, p double, rank bigint, within bigint")
    return (
        numeric_slots(df, {column: {"slot": f"CASE{cases} END"} for column, cases in slots.items()})
        .groupBy("slot", "num")
        .agg(F.expr("count(1) AS single"))
        .selectExpr("*", "sum(single) OVER (PARTITION BY slot ORDER BY num) AS stop")
        .join(F.broadcast(listed), "slot")
        .where("within >= stop - single AND within < stop")
        .select("column", "p", "rank", "num")
    )


def quantile_columns(quantiles: DataFrame, names: dict[float, str]) -> DataFrame:
    """One row per column with each quantile under its own name."""
    return quantiles.groupBy("column").agg(
        *[F.expr(f"max(CASE WHEN p = {float(p)!r}D THEN q END) AS {name}") for p, name in names.items()]
    )


def approximate_quantiles(values: DataFrame, probs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Sketch-based rows ``(column, p, q)``: one pass, rank error 1/accuracy, no interpolation."""
    listed = ", ".join(f"{float(p)!r}D" for p in probs)
    return values.groupBy("column").agg(F.expr(f"percentile_approx(num, array({listed}), {accuracy}) AS q")).selectExpr(
        "column", f"inline(arrays_zip(array({listed}), q)) AS (p, q)"
    )
