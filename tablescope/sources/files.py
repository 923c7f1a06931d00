"""JSON, JSON Lines, Parquet, file catalogs and tagged unions."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import values as V
from tablescope.functions.values import quoted
from tablescope.session import materialize
from tablescope.sources import blocks
from tablescope.sources.blocks import POSITION
from tablescope.sources.delimited import normalize_headers, read_csv, read_tsv

#: How an object of a variant's schema is written, and names, which may hold the same letters.
_OBJECT = re.compile(r"`(?:[^`]|``)*`|OBJECT<")


def _settled(kind: T.DataType) -> T.DataType:
    """The type that values of a variant's type are read as: mixed ones as text, fractions as doubles.

    Objects whose keys differ only in case stay text, as Spark can't tell such fields apart.
    """
    if isinstance(kind, T.StructType):
        if len({f.name.lower() for f in kind.fields}) < len(kind.fields):
            return T.StringType()
        return T.StructType([T.StructField(f.name, _settled(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_settled(kind.elementType))
    if isinstance(kind, T.DecimalType):
        return T.DoubleType() if kind.scale else kind
    return T.StringType() if isinstance(kind, (T.NullType, T.VariantType)) else kind


def _value_sql(key: str, kind: T.DataType) -> str:
    """The value of a key, whose letter case counts, as a type."""
    quote = next((q for q in "'\"" if q not in key), None)
    place, path = ("v", f"$[{quote}{key}{quote}]") if quote else (f"try_element_at(cast(v AS map<string, variant>), {V.literal(key)})", "$")
    return f"try_variant_get({place}, {V.literal(path)}, {V.literal(kind.simpleString())})"


def _records(spark: SparkSession, records: DataFrame, position: bool) -> DataFrame:
    """A table from texts (value, path, block, at, place) that hold one object each; other texts are dropped.

    Texts are parsed to variants. One pass over them finds all keys and types, late and
    mixed ones included; the rows are parsed again where they are used, and nothing is
    written in between. Keys that differ only in case become columns of their own, and the
    last of equal keys counts, for which the session's setting for variants is switched on.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    objects = records.where("startswith(trim(LEADING ' \\t\\r\\n' FROM value), '{')").withColumn("v", F.expr("try_parse_json(value)")).where("v IS NOT NULL")
    found = objects.agg(F.expr("schema_of_variant_agg(v)").alias("schema")).first()["schema"]
    kind = T.DataType.fromDDL(_OBJECT.sub(lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], found or "VOID"))
    if not isinstance(kind, T.StructType) or not kind.fields:
        return spark.createDataFrame([], "column_1 string")
    names = normalize_headers(kind.names)
    columns = [f"{_value_sql(f.name, _settled(f.dataType))} AS {quoted(n)}" for f, n in zip(kind.fields, names)]
    place = [f"struct(path, block, at, place) AS {POSITION}"] if position else []
    return objects.selectExpr(*columns, *place)


def read_json(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    """Documents that hold one object or a list; the objects of a list are rows, its other items are dropped.

    A large document is cut into its items by many tasks. Items that are no JSON are dropped.
    """
    segments = blocks.lines_of(spark, path, "}")
    many = not segments.where("block > 0").isEmpty()
    entered = blocks.depth_states(segments) if many else blocks.Entered([], (0, 0, None), None)
    cut = blocks.cut_documents(segments, entered)
    names = ["value", "path", "block", "at", "place"]
    items = cut.where("whole").withColumnRenamed("text", "value").select(names)
    if many:
        pieces = materialize(cut.where("NOT whole").drop("whole", "place"), "pieces")
        items = items.unionAll(blocks.joined(pieces, "").withColumn("place", F.lit(1 << 30)).select(names))
    return _records(spark, items, position)


def read_jsonl(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    """One object per line; blank, malformed and non-object lines are dropped."""
    lines = blocks.lines_of(spark, path, None).withColumn("place", F.lit(0))
    return _records(spark, lines.withColumn("value", F.ltrim("value", F.lit("\ufeff"))), position)


def read_parquet(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    table = spark.read.parquet(path)
    if not position:
        return table
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"))
    return table.select("*", place.alias(POSITION))


def union_tagged(frames: Mapping[str, DataFrame], tag: str = "__sheet__") -> DataFrame:
    """Named tables below each other, the name in the first column; tables without rows add nothing."""
    parts = [df.select(F.lit(name).alias(tag), "*") for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def file_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and detected format of every file below a path, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), V.detect_format("path").alias("format"))


def source_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes per format below a path."""
    return file_catalog(spark, path).groupBy("format").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes_read")
    )


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None, position: bool = False) -> DataFrame:
    """Any supported file, by name ending; unknown endings are read as CSV.

    A ``.gz`` file is read by one task and its rows are dealt out again. ``position`` adds a
    column by which rows sort as they stand in the files; profiles use it as their key.
    """
    lowered = path.lower().rstrip("/")
    base = lowered.removesuffix(".gz")
    if fmt is None:
        fmt = _ending_format(base)
    if fmt in _UNREAD or (lowered != base and fmt == "parquet"):
        raise ValueError(f"{fmt} files are not read as they are: {_UNREAD.get(fmt, 'unpack the file first')}")
    readers = {"tsv": read_tsv, "json": read_json, "jsonl": read_jsonl, "parquet": read_parquet}
    table = readers.get(fmt, read_csv)(spark, path, position=position)
    return table.hint("rebalance") if lowered != base else table


_UNREAD = {
    "zip": "unpack the archive first",
    "tar": "unpack the archive first",
    "gzip": "name the file .gz",
    "sqlite": "export the tables first",
    "excel": "read the sheets yourself and use union_tagged",
}


def _ending_format(name: str) -> str:
    for fmt, ends in V.FORMAT_SUFFIXES:
        if name.endswith(ends):
            return fmt
    return "unknown"

