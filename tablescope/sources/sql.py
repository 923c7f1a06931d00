"""Tables and queries from databases and warehouses."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession

# Warehouse names and the Spark connector format each one uses when its package is present.
WAREHOUSE_FORMATS = {"snowflake": "snowflake", "bigquery": "bigquery", "redshift": "jdbc", "databricks": "jdbc"}


#: What a query is made of: literals, quoted names and comments, which are left alone; casts; placeholders.
_TOKENS = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|::|:([A-Za-z_]\w*)", re.DOTALL)


def _sql_literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int) or (isinstance(value, float) and math.isfinite(value)):
        return repr(value)
    if not isinstance(value, (str, date)):  # a datetime is a date
        raise ValueError(f"no SQL literal for a {type(value).__name__}")
    text = str(value)
    # Databases differ in what a backslash means in a literal, so there is no safe way to write one.
    if "\\" in text or any(ord(c) < 32 or ord(c) == 127 for c in text):
        raise ValueError("SQL params must not hold backslashes or control characters")
    return "'" + text.replace("'", "''") + "'"


def bind(query: str, params: Mapping[str, object] | None) -> str:
    """Replace every ``:name`` that has a parameter by its SQL literal, outside of literals, quoted names and comments."""
    if params is not None and not isinstance(params, Mapping):
        raise ValueError("SQL params must be a mapping")
    known = {name: _sql_literal(value) for name, value in (params or {}).items()}
    return _TOKENS.sub(lambda token: known.get(token[1], token[0]) if token[1] else token[0], query)


def jdbc_options(
    url: str,
    query: str,
    params: Mapping[str, object] | None = None,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int | None = None,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Reader options. With a partition column the database serves many tasks at once."""
    text = bind(query, params)
    options = {"url": url, **(properties or {})}
    if partition_column is None:
        return options | {"query": text}
    if bounds is None or partitions is None:
        raise ValueError("a partitioned read needs bounds and a number of partitions")
    return options | {
        "dbtable": f"({text}) source",
        "partitionColumn": partition_column,
        "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]),
        "numPartitions": str(partitions),
    }


def read_sql(spark: SparkSession, url: str, query: str, warehouse: str | None = None, **options) -> DataFrame:
    """The rows of a query. Filters and columns used later are pushed into it by Spark."""
    if warehouse is not None and warehouse not in WAREHOUSE_FORMATS:
        raise ValueError(f"unknown warehouse: {warehouse}")
    fmt = WAREHOUSE_FORMATS.get(warehouse, "jdbc")
    return spark.read.format(fmt).options(**jdbc_options(url, query, **options)).load()
