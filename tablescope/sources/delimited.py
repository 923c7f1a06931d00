"""Delimited text: header rules, ragged rows, blank rows, quoted line breaks.

Files are read by many tasks in every case. Without quotes a line is a record; with
quotes, the states in which splits are entered are worked out first (see ``blocks``).
"""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.functions import values as V
from tablescope.functions.values import quoted
from tablescope.session import materialize
from tablescope.sources import blocks
from tablescope.sources.blocks import POSITION

# Delimiters the sniffer tries and how much text it looks at.
DELIMITERS = (",", ";", "\t", "|")
SNIFF_CHARS = 64 * 1024


def normalize_headers(names: Sequence[str | None]) -> list[str]:
    """Trim names and the byte order mark, name blanks ``column_i``, number repeats ``_2``, ``_3``.

    Names that differ only in case are repeats: Spark would not tell them apart. A number
    that makes a name another column has already goes up until it makes a new one.
    """
    plain = [(name or "").strip("\ufeff \t\r\n").strip() or f"column_{i}" for i, name in enumerate(names, start=1)]
    groups: dict[str, list[int]] = {}
    for place, name in enumerate(plain):
        groups.setdefault(name.lower(), []).append(place)
    number = {place: k for places in groups.values() for k, place in enumerate(places, start=1)}
    given: dict[str, str] = {}
    for place, name in enumerate(plain):
        tries = (name if k == 1 else f"{name}_{k}" for k in count(number[place]))
        own = next(t for t in tries if t.lower() not in given)
        given[own.lower()] = own
    return list(given.values())


def quick_headers(names: Sequence[str | None], width: int) -> list[str]:
    """The quick profile's rule: blanks and missing names become ``col_i``."""
    padded = [*names, *[None] * (width - len(names))]
    return [n if n and n.strip() else f"col_{i}" for i, n in enumerate((_unmark(p) for p in padded), start=1)]


def _unmark(name: str | None) -> str | None:
    return name.removeprefix("\ufeff") if name else name


def has_quoted_line_breaks(spark: SparkSession, path: str, delimiter: str = ",") -> bool:
    """Whether some line leaves a quoted cell open, so that a record spans lines."""
    return blocks.quote_states(blocks.lines_of(spark, path), delimiter)[1]


def _stripped(value: str = "value") -> Column:
    """A line without the carriage return of its end."""
    return F.expr(f"CASE WHEN endswith({value}, '\\r') THEN left({value}, length({value}) - 1) ELSE {value} END")


def _plain_records(lines: DataFrame, firsts: DataFrame, delimiter: str) -> DataFrame:
    """(path, block, at, place, cells) of files without quotes, where lines are records; ``firsts`` (at) are their headers."""
    rows = lines.join(F.broadcast(firsts), "at", "left_anti")  # one number for a file
    rows = rows.where(_filled("value", delimiter))
    return rows.select("path", "block", "at", F.lit(0).alias("place"), F.split(_stripped(), re.escape(delimiter), -1).alias("cells"))


def _filled(value: str, delimiter: str) -> Column:
    """Whether some cell of a line without quotes is not blank."""
    return F.expr(f"trim(BOTH {V.literal(V.WHITESPACE + delimiter)} FROM {value}) <> ''")


def _quoted_records(lines: DataFrame, delimiter: str) -> DataFrame:
    """(path, block, at, place, head, cells) of files with quotes, stored once, as they are slow to parse."""
    entered, shared = blocks.quote_states(lines, delimiter)
    cut = materialize(blocks.cut_tables(lines, delimiter, entered), "records")
    names = ["path", "block", "at", "place", "head", "cells"]
    records = cut.where("cells IS NOT NULL").select(names)
    if shared:
        pieces = blocks.joined(cut.where("cells IS NULL").drop("cells", "place"), "\n")
        records = records.unionAll(materialize(blocks.cut_pieces(pieces, delimiter), "pieces").select(names))
    return records


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", quick: bool = False, position: bool = False) -> DataFrame:
    """A delimited file or folder as string columns.

    The first record of each file is its header; the first file's names the columns. Short rows are
    padded, long rows add columns, blank rows are dropped. Records are those of Python's
    reader, quoted line breaks and stray quotes included. ``position`` adds the column
    ``POSITION``, by which rows sort as they stand in the files.
    """
    lines = blocks.lines_of(spark, path)
    first = (F.col("block") == 0) & (F.length(_stripped()) > 0)
    marks = F.length("value") - F.length(F.replace("value", F.lit(delimiter)))
    facts = lines.groupBy("path").agg(
        F.min(F.when(first, F.struct("at", "value"))).alias("first"),
        F.count_if(F.contains("value", F.lit('"')) | F.contains(_stripped(), F.lit("\r"))).alias("quoted"),
        F.max(F.when(_filled("value", delimiter), marks + 1)).alias("width"),
    )
    facts = materialize(facts, "files")  # a row for a file
    found = facts.agg(F.min(F.struct("path", "first")).alias("top"), F.sum("quoted").alias("quoted"), F.max("width").alias("width")).first()
    if not found["quoted"]:
        line = found["top"] and found["top"]["first"]
        header = line["value"].removesuffix("\r").split(delimiter) if line else []
        rows, width = _plain_records(lines, facts.select("first.at").where("at IS NOT NULL"), delimiter), found["width"] or 0
    else:
        rows = _quoted_records(lines, delimiter)
        top = F.min(F.when(F.col("head"), F.struct("path", "block", "at", "place", "cells"))).alias("top")
        found = rows.agg(top, F.max(F.size("cells")).alias("width")).first()
        header, width = list(found["top"]["cells"]) if found["top"] else [], found["width"] or 0
        rows = rows.where("NOT head")
    if not header:
        return spark.createDataFrame([], "column_1 string")
    width = max(width, len(header))
    names = quick_headers(header, width) if quick else normalize_headers([*header, *[None] * (width - len(header))])
    cells = [f"coalesce(get(cells, {i}), '') AS {quoted(n)}" for i, n in enumerate(names)]
    place = [f"struct(path, block, at, place) AS {POSITION}"] if position else []
    return rows.selectExpr(*cells, *place)


def read_csv(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    return read_delimited(spark, path, ",", position=position)


def read_tsv(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    return read_delimited(spark, path, "\t", position=position)


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Delimiter of the first 64 KiB; else the most frequent candidate; else a comma.

    Lines are cut before they are taken, a few of them first and eight times as many while
    their text is too short: every line takes a character at least.
    """
    sample, lines = "", 64
    while True:
        taken = spark.read.text(path).selectExpr(f"substring(value, 1, {SNIFF_CHARS}) AS line").limit(lines)
        taken = taken.withColumn("place", F.monotonically_increasing_id())
        before = F.sum(F.length("line") + 1).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
        first = taken.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < SNIFF_CHARS)
        rows = sorted(first.select("place", "line").collect())
        sample = "\n".join(r["line"] for r in rows)[:SNIFF_CHARS]
        if len(sample) == SNIFF_CHARS or len(rows) < lines or lines >= SNIFF_CHARS:
            break
        lines *= 8
    try:
        return csv.Sniffer().sniff(sample, delimiters="".join(DELIMITERS)).delimiter
    except csv.Error:
        common = Counter(c for c in sample if c in DELIMITERS).most_common(1)
        return common[0][0] if common else ","


def read_quick(spark: SparkSession, path: str, delimiter: str | None = None, position: bool = False) -> DataFrame:
    """A delimited file as the quick profile sees it: sniffed delimiter, ``col_i`` names."""
    return read_delimited(spark, path, delimiter or sniff_delimiter(spark, path), quick=True, position=position)
