"""A table as one row per cell.

Operators that compare values turn the table into ``(column, num)`` or
``(column, value)`` rows, so that each of them is one ``groupBy("column", ...)`` however
many columns there are. The rows come out of an Expand node: columns nobody asks for
are never read and nothing is shuffled to make them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import values as V
from tablescope.functions.values import quoted

# Columns handled by one scan; wider tables become a union of pruned scans so that no
# single generated method has to handle hundreds of fields.
COLUMNS_PER_SCAN = 24


def column_of(name: str) -> Column:
    return F.col(quoted(name))


def field_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def chunks(names: Sequence[str], size: int = COLUMNS_PER_SCAN) -> list[Sequence[str]]:
    return [names[start : start + size] for start in range(0, len(names), size)]


def typed_columns(
    df: DataFrame, names: Sequence[str], keep: Sequence[str] = (), want: Sequence[str] = ("kind", "text", "num")
) -> DataFrame:
    """Columns ``kind0,text0,num0,kind1,...`` for each input column, as far as wanted.

    The steps (strip, parse, classify) are separate projections so that each string is
    trimmed and parsed once however many results are made from it.
    """
    types = field_types(df)
    kept = [quoted(k) for k in keep]
    strings = [i for i, n in enumerate(names) if isinstance(types[n], T.StringType)]
    out = df.selectExpr(
        *kept,
        *[f"{V.strip_sql(quoted(n)) if i in strings else quoted(n)} AS s{i}" for i, n in enumerate(names)],
    )
    if strings:
        out = out.selectExpr("*", *[f"{V.parse_number_sql(f's{i}')} AS x{i}" for i in strings])
    if "kind" in want or ("text" in want and strings):
        out = out.selectExpr(
            "*",
            *[
                f"{V.kind_of_stripped_sql(f's{i}', f'x{i}') if i in strings else V.kind_sql(f's{i}', types[n])} AS kind{i}"
                for i, n in enumerate(names)
                if "kind" in want or i in strings
            ],
        )
    fields = []
    for i, name in enumerate(names):
        if "kind" in want:
            fields.append(f"kind{i}")
        if "text" in want:
            text = V.text_of_stripped_sql(f"s{i}", f"x{i}", f"kind{i}") if i in strings else V.text_sql(f"s{i}", types[name])
            fields.append(f"{text} AS text{i}")
        if "num" in want:
            num = V.finite_sql(f"x{i}") if i in strings else V.number_sql(f"s{i}", types[name])
            fields.append(f"{num} AS num{i}")
    return out.selectExpr(*kept, *fields)


def unpivot(wide: DataFrame, names: Sequence[str], want: Sequence[str]) -> DataFrame:
    groups = ", ".join(
        f"({', '.join(f'{w}{i}' for w in want)}) AS {quoted(n)}" if len(want) > 1 else f"{want[0]}{i} AS {quoted(n)}"
        for i, n in enumerate(names)
    )
    head = f"(({', '.join(want)}) FOR column IN (" if len(want) > 1 else f"({want[0]} FOR column IN ("
    escaped = groups.replace("{", "{{").replace("}", "}}")
    return wide.sparkSession.sql("SELECT * FROM {wide} UNPIVOT INCLUDE NULLS " + head + escaped + "))", wide=wide)


def numeric_slots(df: DataFrame, expressions: dict[str, dict[str, str]]) -> DataFrame:
    """Rows ``(num, <labels>)`` of the numeric cells for which an expression is not null.

    ``expressions`` maps a column to labelled SQL over ``{x}``, its number; every column has the
    same labels. The first label decides which cells are kept.
    """
    parts = []
    for chunk in chunks(list(expressions)):
        labels = list(expressions[chunk[0]])
        wide = typed_columns(df, chunk, (), ("num",)).selectExpr(
            *[f"num{i}" for i in range(len(chunk))],
            *[f"{expressions[n][label].format(x=f'num{i}')} AS {label}{i}" for i, n in enumerate(chunk) for label in labels],
        )
        rows = unpivot(wide, chunk, ("num", *labels))
        parts.append(rows.where(f"num IS NOT NULL AND {labels[0]} IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts)


def aggregate_numbers(df: DataFrame, aggregates: dict[str, dict[str, str]]) -> DataFrame:
    """One row per column with labelled aggregates over ``{x}``, its number, from one pass."""
    parts = []
    for chunk in chunks(list(aggregates)):
        labels = list(aggregates[chunk[0]])
        one_row = typed_columns(df, chunk, (), ("num",)).selectExpr(
            *[f"{aggregates[n][label].format(x=f'num{i}')} AS {label}{i}" for i, n in enumerate(chunk) for label in labels]
        )
        rows = [
            f"struct({V.literal(n)} AS column, {', '.join(f'{label}{i} AS {label}' for label in labels)})"
            for i, n in enumerate(chunk)
        ]
        parts.append(one_row.selectExpr(f"inline(array({', '.join(rows)}))"))
    return reduce(DataFrame.unionByName, parts)


def cells(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    keep: Sequence[str] = (),
    want: Sequence[str] = ("kind", "text", "num"),
) -> DataFrame:
    """Rows ``(*keep, column, *want)``, one per cell of ``columns``."""
    names = list(df.columns if columns is None else columns)
    if not names:
        raise ValueError("a table needs at least one column to be profiled")
    parts = [unpivot(typed_columns(df, chunk, keep, want), chunk, want) for chunk in chunks(names)]
    return reduce(DataFrame.unionByName, parts)


def numeric_cells(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*keep, column, num)`` for every finite numeric cell.

    Columns whose Spark type can never hold a number are not read.
    """
    types = field_types(df)
    names = [n for n in (df.columns if columns is None else columns) if V.may_hold_numbers(types[n])]
    if not names:
        schema = T.StructType(
            [df.schema[k] for k in keep]
            + [T.StructField("column", T.StringType()), T.StructField("num", T.DoubleType())]
        )
        return df.sparkSession.createDataFrame([], schema)
    return cells(df, names, keep, ("num",)).where("num IS NOT NULL")


# Column families that are compared in their own type rather than as text.
_NATIVE = {
    "bigint": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "double": (T.FloatType, T.DoubleType),
    "date": (T.DateType,),
    "timestamp": (T.TimestampType,),
    "timestamp_ntz": (T.TimestampNTZType,),
}


def native_value_sql(name: str, dtype: T.DataType) -> tuple[str, str]:
    """``(family, expression)`` giving the cell's value in the family's type, null if missing.

    Equal cells give equal values. Strings give their canonical text.
    """
    x = quoted(name)
    for family, members in _NATIVE.items():
        if isinstance(dtype, members):
            if family == "double":
                return family, f"CASE WHEN NOT isnan({x}) THEN double({x}) + 0D END"
            return family, f"cast({x} AS {family})"
    return "string", V.text_sql(x, dtype)


def native_families(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, list[str]]:
    """Columns by the type their values are compared in."""
    types = field_types(df)
    families: dict[str, list[str]] = {}
    for name in df.columns if columns is None else columns:
        families.setdefault(native_value_sql(name, types[name])[0], []).append(name)
    return families


def native_cells(df: DataFrame, family: str, names: Sequence[str]) -> DataFrame:
    """Rows ``(column, value)`` of every non-missing cell of columns of one family."""
    types = field_types(df)
    parts = []
    for chunk in chunks(names):
        if family == "string":
            wide = typed_columns(df, chunk, (), ("text",))
            wide = wide.toDF(*[f"value{i}" for i in range(len(chunk))])
        else:
            wide = df.selectExpr(*[f"{native_value_sql(n, types[n])[1]} AS value{i}" for i, n in enumerate(chunk)])
        parts.append(unpivot(wide, chunk, ("value",)))
    return reduce(DataFrame.unionByName, parts).where("value IS NOT NULL")


def canonical_frame(df: DataFrame) -> DataFrame:
    """The table with every cell in canonical string form, same column names."""
    wide = typed_columns(df, df.columns, (), ("text",))
    return wide.toDF(*df.columns)


def native_frame(df: DataFrame) -> DataFrame:
    """The table with every cell in its family's type and missing cells null, same names."""
    types = field_types(df)
    strings = [n for n in df.columns if native_value_sql(n, types[n])[0] == "string"]
    others = [n for n in df.columns if n not in strings]
    wide = df.selectExpr(
        *[f"{native_value_sql(n, types[n])[1]} AS {quoted(n)}" for n in others], *[quoted(n) for n in strings]
    )
    if strings:
        wide = typed_columns(wide, strings, others, ("text",)).toDF(*others, *strings)
    return wide.select(*[column_of(n) for n in df.columns])


def numeric_frame(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The table with ``columns`` as finite doubles (null elsewhere), same names."""
    return typed_columns(df, columns, keep, ("num",)).toDF(*keep, *columns)
