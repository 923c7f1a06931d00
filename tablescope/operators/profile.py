"""Column profiles: counts, kinds, moments, distinct values, duplicates, first rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions import values as V
from tablescope.functions.values import quoted
from tablescope.operators.cells import (
    canonical_frame,
    chunks,
    column_of,
    field_types,
    native_cells,
    native_families,
    native_frame,
    native_value_sql,
    typed_columns,
    unpivot,
)
from tablescope.session import POSITION, at_once, key_of, materialize

# How many values, rows and distinct strings a profile shows.
PREVIEW_ROWS = 5
SAMPLE_VALUES = 5
DISTINCT_LIMIT = 25
NUMERIC_SAMPLE_ROWS = 500
TRAINING_ROWS = 2000

# First rows that are looked at for the first values of all columns at once.
SAMPLE_ROWS = 100

# One row in this many helps to find the cut below which the smallest values lie.
DISTINCT_PROBE = 256


MOMENTS = ("count", "mean", "stddev", "min", "max")


def inferred_type_sql() -> str:
    """Most frequent kind; ties go to numeric, then boolean, then text."""
    return (
        "CASE WHEN numeric_count + boolean_count + text_count = 0 THEN 'unknown' "
        "WHEN numeric_count >= boolean_count AND numeric_count >= text_count THEN 'numeric' "
        "WHEN boolean_count >= text_count THEN 'boolean' ELSE 'text' END"
    )


def moment_sql(num: str) -> dict[str, str]:
    return {
        "count": f"count({num})",
        "mean": f"avg({num})",
        "stddev": f"CASE WHEN count({num}) > 0 THEN coalesce(stddev_samp({num}), 0D) END",
        "min": f"min({num})",
        "max": f"max({num})",
    }


def _aggregate_each(df: DataFrame, names: Sequence[str], counts: bool, moments: bool) -> DataFrame:
    """One aggregate over the typed table, turned into one row per column.

    Every task sends a single row; tables wider than one scan become a union of
    scans that read disjoint columns. A table without rows yields no column.
    """
    types = field_types(df)
    want = (["kind"] if counts else []) + (["num"] if moments else [])
    parts = []
    for chunk in chunks(names):
        aggregates = ["count(1) AS rows"]
        entries = []
        for i, name in enumerate(chunk):
            entry = [f"{V.literal(name)} AS column", "rows AS rows"]
            if counts:
                possible = V.possible_kinds(types[name])
                aggregates += [f"count_if(kind{i} = '{kind}') AS {kind}{i}" for kind in possible[:-1]]
                known = {kind: f"{kind}{i}" for kind in possible[:-1]}
                known[possible[-1]] = " - ".join(["rows", *known.values()])
                entry += [f"{known.get(k, '0L')} AS {k}_count" for k in V.KINDS]
            if moments and V.may_hold_numbers(types[name]):
                aggregates += [f"{sql} AS {label}{i}" for label, sql in moment_sql(f"num{i}").items()]
                entry += [f"{label}{i} AS {label}" for label in MOMENTS]
            elif moments:
                entry += ["0L AS count", *[f"cast(NULL AS DOUBLE) AS {label}" for label in MOMENTS[1:]]]
            entries.append(f"struct({', '.join(entry)})")
        one_row = typed_columns(df, chunk, (), want).selectExpr(*aggregates).where("rows > 0")
        parts.append(one_row.selectExpr(f"inline(array({', '.join(entries)}))"))
    out = reduce(DataFrame.unionByName, parts)
    if counts:
        out = out.selectExpr(
            "*",
            "rows - null_count AS non_null_count",
            "null_count / rows AS null_ratio",
            f"{inferred_type_sql()} AS inferred_type",
        )
    return out


def kind_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, missing values, values of each kind and inferred type per column."""
    return _aggregate_each(df, list(df.columns if columns is None else columns), counts=True, moments=False)


def moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """rows, count, mean, stddev, min and max of the finite numbers of each column having any."""
    types = field_types(df)
    names = [n for n in (df.columns if columns is None else columns) if V.may_hold_numbers(types[n])]
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column string, rows bigint, count bigint, mean double, stddev double, min double, max double"
        )
    return _aggregate_each(df, names, counts=False, moments=True).where("count > 0")


def column_facts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Counts and moments of every column from one pass over the data."""
    facts = _aggregate_each(df, list(df.columns if columns is None else columns), counts=True, moments=True)
    return facts.withColumn("non_finite_count", F.expr("numeric_count - count"))


def distinct_values(df: DataFrame, columns: Sequence[str] | None = None, limit: int = DISTINCT_LIMIT) -> DataFrame:
    """The ``limit`` smallest distinct values of each column, and whether there are more.

    Grouping every cell by its value would shuffle a whole unique text column. Instead a
    cut is found first: any ``limit + 1`` distinct values of a column bound its
    ``limit + 1`` smallest from above, so the smallest values of a part of the rows
    will do. Tasks keep no more than ``limit + 1`` of those for a column. Only values
    up to the cut are then grouped, some thousands in a rich column however many
    rows there are; a column too poor to have a cut has so few distinct values that
    the map side collapses them. Two scans in all, and the result is exact in every case.
    """
    types = field_types(df)
    names = list(df.columns if columns is None else columns)
    families = {n: native_value_sql(n, types[n])[0] for n in names}
    cuts = _cuts(df, families, limit)
    parts = []
    for chunk in chunks(names):
        # Instants are compared as microseconds, so that equal local times stay apart.
        texts = []
        for i, name in enumerate(chunk):
            x, cut = _native_sql(name, families[name]), cuts.get(name)
            kind = "bigint" if families[name] == "timestamp" else families[name]
            kept = x if cut is None else f"CASE WHEN {x} <= cast({V.literal(cut)} AS {kind}) THEN {x} END"
            texts.append(f"string({kept}) AS value{i}")
        parts.append(unpivot(native_frame(df.select(*map(column_of, chunk))).selectExpr(*texts), chunk, ("value",)))
    values = reduce(DataFrame.unionByName, parts).where("value IS NOT NULL").distinct()
    of = lambda *kinds: f"column IN ({', '.join(['NULL', *[V.literal(n) for n in names if families[n] in kinds]])})"
    order = (
        f"struct(CASE WHEN {of('bigint', 'timestamp')} THEN try_cast(value AS bigint) END AS whole, "
        f"CASE WHEN {of('double')} THEN try_cast(value AS double) END AS real, value AS text)"
    )
    shown = f"CASE WHEN {of('timestamp')} THEN string(timestamp_micros(try_cast(value AS bigint))) ELSE value END"
    placed = values.selectExpr("column", f"{order} AS key", f"{shown} AS value")
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy("key"))).where(f"place <= {limit + 1}")
    listed = f"collect_list(CASE WHEN place <= {limit} THEN struct(place, value) END)"
    return placed.groupBy("column").agg(
        F.expr(f"least(count(1), {limit}) AS distinct_count"),
        F.expr(f"count(1) > {limit} AS distinct_overflow"),
        F.expr(f"sort_array({listed}).value AS distinct_sample"),
    )


def _native_sql(name: str, family: str) -> str:
    return f"unix_micros({quoted(name)})" if family == "timestamp" else quoted(name)


#: How values of a family are read back from their text; all others are compared as text.
_READ = {"bigint": int, "timestamp": int, "double": float}


def _cuts(df: DataFrame, families: dict[str, str], limit: int) -> dict[str, str]:
    """One value as text for every column rich enough to have a cut: at most ``limit + 1`` values of a column leave a task."""
    names = list(families)

    def smallest(wide: DataFrame, chunk: Sequence[str]) -> DataFrame:
        chosen = wide.selectExpr(*[f"{_native_sql(n, families[n])} AS value{i}" for i, n in enumerate(chunk)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: list[list] = [[] for _ in chunk]
            for batch in batches:
                for i, column in enumerate(batch.columns):
                    new = column.drop_null().unique().to_pylist()
                    if new:
                        kept[i] = sorted({*kept[i], *new})[: limit + 1]
            found = [(names.index(chunk[i]), v if isinstance(v, str) else repr(v) if isinstance(v, float) else str(v)) for i, vs in enumerate(kept) for v in vs]
            yield pa.RecordBatch.from_pydict({"i": [i for i, _ in found], "value": [v for _, v in found]}, _CELLS)

        return chosen.mapInArrow(run, "i int, value string")

    def merge(table: pa.Table) -> pa.Table:
        number = table["i"][0].as_py()
        read = _READ.get(families[names[number]], str)
        found = sorted({(read(v), v) for v in table["value"].to_pylist()})
        return pa.table({"i": [number], "value": [found[limit][1] if len(found) > limit else None]}, _CELLS)

    # Any rows will do; a value stands in them with this chance at least, so a column without a cut has few values.
    some = df.where(f"rand(42) * {DISTINCT_PROBE} < 1")
    parts = [smallest(native_frame(some.select(*map(column_of, chunk))), chunk) for chunk in chunks(names)]
    merged = reduce(DataFrame.unionByName, parts).groupBy("i").applyInArrow(merge, "i int, value string")
    return {names[r["i"]]: r["value"] for r in merged.where("value IS NOT NULL").collect()}


_CELLS = pa.schema([("i", pa.int32()), ("value", pa.string())])


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-missing values per column, unbounded.

    The exact count shuffles a 128-bit fingerprint of each value, never the text itself.
    """
    prints = [
        native_cells(df, family, names).selectExpr("column", "xxhash64(value) AS h1", "xxhash64('again', value) AS h2")
        for family, names in native_families(df, columns).items()
    ]
    values = reduce(DataFrame.unionByName, prints)
    if approximate:
        return values.groupBy("column").agg(F.approx_count_distinct("h1").alias("distinct"))
    return values.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))


def sample_values(
    df: DataFrame,
    order_by: Sequence[str],
    columns: Sequence[str] | None = None,
    limit: int = SAMPLE_VALUES,
) -> DataFrame:
    """First ``limit`` non-missing values of each column in key order.

    No task sorts or holds more than ``SAMPLE_ROWS`` rows.
    """
    names = list(df.columns if columns is None else columns)
    key = f"struct({', '.join(quoted(k) for k in order_by)}) AS key"
    raw = [f"c{i}" for i in range(len(names))]

    def texts_of(rows: DataFrame) -> DataFrame:
        wide = rows.selectExpr(key, *[f"{quoted(n)} AS {c}" for n, c in zip(names, raw)])
        return typed_columns(wide, raw, ("key",), ("text",)).toDF("key", *[f"t{i}" for i in range(len(names))])

    # One scan: the first rows hold enough values of nearly all columns. Only columns that lack some there get a scan of their own.
    # Texts are made of the first rows alone: they cost far more than finding those.
    texts = texts_of(df)
    first = materialize(texts_of(df.orderBy(*map(column_of, order_by)).limit(SAMPLE_ROWS)), "first")
    filled = first.selectExpr(*[f"count(t{i}) AS t{i}" for i in range(len(names))], "count(1) AS rows").first()
    parts = []
    for i, name in enumerate(names):
        enough = filled[f"t{i}"] >= limit or filled["rows"] < SAMPLE_ROWS
        top = (first if enough else texts).selectExpr("key", f"t{i} AS text").where("text IS NOT NULL")
        parts.append(top.orderBy("key").limit(limit).selectExpr(f"{V.literal(name)} AS column", "key", "text"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("key"))
    return reduce(DataFrame.unionByName, parts).select("column", place.alias("place"), "text")


def column_profile(df: DataFrame, order_by: Sequence[str] | None = None, facts: DataFrame | None = None) -> DataFrame:
    """One row per column, alphabetical: type, missing values, distinct and (given a key) sample values.

    Rows that know their place in the files they come from need no other key.
    """
    keyed, order_by, df = df, key_of(df, order_by), df.drop(POSITION)
    counts = (kind_counts(df) if facts is None else facts).select(
        "column", "inferred_type", "null_count", "null_ratio", "non_null_count"
    )
    # Both look for bounds in jobs of their own, and neither needs the other's.
    distinct, first = at_once(
        df.sparkSession,
        lambda: distinct_values(df),
        lambda: sample_values(keyed, order_by, df.columns) if order_by else None,
    )
    profile = counts.join(F.broadcast(distinct), "column", "left").selectExpr(
        *counts.columns,
        "coalesce(distinct_count, 0) AS distinct_count",
        "coalesce(distinct_overflow, false) AS distinct_overflow",
        "coalesce(distinct_sample, cast(array() AS array<string>)) AS distinct_sample",
    )
    if first is not None:
        firsts = first.groupBy("column").agg(F.expr("sort_array(collect_list(struct(place, text))).text AS firsts"))
        profile = profile.join(F.broadcast(firsts), "column", "left").selectExpr(
            *profile.columns, "coalesce(firsts, cast(array() AS array<string>)) AS sample_values"
        )
    return profile.orderBy("column")


def completeness(counts: DataFrame) -> DataFrame:
    """Mean over columns of the share of non-missing values; 0 for an empty table."""
    return counts.selectExpr("coalesce(avg(1 - null_ratio), 0D) AS completeness")


def schema_table(profile: DataFrame) -> DataFrame:
    return profile.select(F.col("column").alias("name"), F.col("inferred_type").alias("type"))


def row_fingerprint_sql(names: Sequence[str]) -> str:
    """128 bits over all cells of a row; missing cells take part through their own flag."""
    parts = ", ".join(f"isnull({quoted(n)}), {quoted(n)}" for n in names)
    return f"struct(xxhash64({parts}) AS h1, xxhash64('again', {parts}) AS h2)"


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows, duplicates (every repeat of an earlier row counts once) and their ratio.

    Rows are grouped by a 128-bit fingerprint of their typed cells, so the shuffle
    carries 16 bytes per distinct row however wide the table is, and repeats of a
    hot row collapse on the map side. Two different rows among 10^12 share a fingerprint
    with a probability of about 10^-15.
    """
    prints = native_frame(df).selectExpr(f"inline(array({row_fingerprint_sql(df.columns)}))")
    groups = prints.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
    sums = groups.selectExpr("coalesce(sum(copies), 0L) AS rows", "coalesce(sum(copies - 1), 0L) AS duplicates")
    return sums.selectExpr("*", "coalesce(try_divide(duplicates, rows), 0D) AS ratio")


def preview(df: DataFrame, order_by: Sequence[str], limit: int = PREVIEW_ROWS) -> DataFrame:
    """First rows in key order, cells shortened for display, missing cells empty."""
    first = canonical_frame(df.orderBy(*[column_of(k) for k in order_by]).limit(limit).drop(POSITION))
    return first.selectExpr(*[f"coalesce({V.preview_sql(quoted(n))}, '') AS {quoted(n)}" for n in first.columns])


def numeric_row_sample(
    df: DataFrame, order_by: Sequence[str], columns: Sequence[str], limit: int = NUMERIC_SAMPLE_ROWS, shuffled: bool = False
) -> DataFrame:
    """First rows in key order, or in the order of the key's MD5, that hold at least one number: the key and the numeric cells."""
    types = field_types(df)
    key = f"struct({', '.join(quoted(k) for k in order_by)}) AS key"
    numbers = df.selectExpr(key, *[f"{V.number_sql(quoted(n), types[n])} AS {quoted(n)}" for n in columns])
    some = f"coalesce({', '.join(quoted(n) for n in columns)}) IS NOT NULL"
    mixed = [F.md5(F.concat_ws(":", *[F.col("key").getField(k).cast("string") for k in order_by]))] if shuffled else []
    return numbers.where(some).orderBy(*mixed, "key").limit(limit)


def training_sample(df: DataFrame, order_by: Sequence[str], limit: int = TRAINING_ROWS) -> DataFrame:
    """First canonical rows in key order, as input for a quick modelling run."""
    return canonical_frame(df.orderBy(*[column_of(k) for k in order_by]).limit(limit).drop(POSITION))
