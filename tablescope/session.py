"""Session helpers: a local session for tests, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession


#: Independent jobs that are submitted together; their tasks share the executors.
JOBS_AT_ONCE = 6

#: The column that holds a row's place in the files it was read from, where one was asked for.
POSITION = "__position"


def local_session(cores: str = "8", app: str = "tablescope") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    Only a ``local`` master may fall back to a temporary folder of this machine,
    because there every task sees it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="tablescope-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where several passes follow over a source that is slow to parse or a
    result that is slow to compute. The written table survives lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pinned(df: DataFrame) -> DataFrame:
    """Run ``df`` once and keep its rows as a local relation.

    Only for tables whose size depends on the number of columns, not of rows. What
    follows then has a short plan and never repeats the scan behind them.
    """
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def at_once(spark: SparkSession, *steps: Callable[[], Any]) -> list[Any]:
    """The results of independent ``steps``, in their order, run by up to ``JOBS_AT_ONCE`` threads of the driver.

    Most steps of a profile are short jobs, whose cost is in planning and in waiting for last tasks; both overlap.
    The first step that fails ends the call, after all those that have begun.
    """
    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
        try:
            return [step.result() for step in running]
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise


def key_of(df: DataFrame, order_by: Sequence[str] | None) -> list[str]:
    """The columns that put rows in order: those that are named, else the place in the files, else none."""
    return list(order_by or ([POSITION] if POSITION in df.columns else []))


def per_column(df: DataFrame) -> dict[str, Row]:
    """The rows of a table with one row per column, by column name, alphabetical.

    The next pass over the data uses them as literals, so it needs no join to know a
    column's mean or bounds.
    """
    return {row["column"]: row for row in sorted(df.collect(), key=lambda row: row["column"])}
