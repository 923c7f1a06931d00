"""A column profile that keeps up with a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablescope.functions import values as V
from tablescope.operators.cells import cells
from tablescope.operators.profile import inferred_type_sql, moment_sql


def profile_stream(stream: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Running counts, kinds, moments and approximate distinct values per column.

    Every aggregate merges, so the state is one row per column however long the stream runs.
    """
    counted = cells(stream, columns).groupBy("column").agg(
        F.expr("count(1) AS rows"),
        *[F.expr(f"count_if(kind = '{k}') AS {k}_count") for k in V.KINDS],
        *[F.expr(f"{sql} AS {label}") for label, sql in moment_sql("num").items()],
        F.expr("approx_count_distinct(text) AS approx_distinct"),
    )
    return counted.selectExpr(
        "*", "rows - null_count AS non_null_count", "null_count / rows AS null_ratio", f"{inferred_type_sql()} AS inferred_type"
    )


def start_profile(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, columns: Sequence[str] | None = None
) -> StreamingQuery:
    """Hand the current profile to ``sink`` after each batch of available data; restarts resume the state."""
    return (
        profile_stream(stream, columns)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
