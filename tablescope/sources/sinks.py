"""Writing result tables, their manifest and the results document."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tablescope.functions import values as V
from tablescope.functions.values import quoted

# Content types by artifact kind.
CONTENT_TYPES = {
    "html": "text/html",
    "text": "text/plain",
    "json": "application/json",
    "csv": "text/csv",
    "image": "image/png",
}


def content_type(key: str) -> str:
    """Content type of a written table by its name ending."""
    kinds = {".csv": "csv", ".json": "json", ".txt": "text", ".html": "html", ".png": "image"}
    return next((CONTENT_TYPES[k] for end, k in kinds.items() if key.endswith(end)), "application/octet-stream")


def read_finished(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The JSON table that marks a finished result; None if there is none."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def csv_ready(df: DataFrame) -> DataFrame:
    """Every cell as CSV text; nested cells as JSON."""
    cells = []
    for field in df.schema.fields:
        x = quoted(field.name)
        if field.dataType.typeName() in ("array", "map", "struct"):
            cells.append(V.csv_cell(f"to_json({x})").alias(field.name))
        else:
            cells.append(V.csv_cell(x, field.dataType).alias(field.name))
    return df.select(*cells)


def write_csv(df: DataFrame, path: str, mode: str = "ignore") -> None:
    """CSV with a header; missing and non-finite cells are empty. ``ignore`` keeps an existing result."""
    layout = dict(header=True, emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    csv_ready(df).write.mode(mode).options(**layout).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "ignore") -> None:
    df.write.mode(mode).json(path)


def write_text(df: DataFrame, path: str, mode: str = "ignore") -> None:
    df.write.mode(mode).text(path)


def write_parquet(df: DataFrame, path: str, mode: str = "ignore") -> None:
    df.write.mode(mode).parquet(path)
