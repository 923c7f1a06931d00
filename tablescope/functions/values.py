"""Typing of single values: missing, boolean, numeric or text.

Expressions are written as Spark SQL text, one string per value, so that plans over
hundreds of columns are built with one call per column; everything runs
inside generated code. Functions ending in ``_sql`` take and return SQL text; the others
wrap them for a column name or SQL expression and return a Column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The strings that stand for a missing value.
NULL_SENTINELS = ("", "null", "NULL", "NaN", "nan")

# Further spellings of "not a number", compared in lower case.
NAN_WORDS = ("nan", "+nan", "-nan")

# Every character a string strip removes; all of them lie below U+3001.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

# A decimal literal or an infinity. Keeps Java-only spellings (1d, 0x1p3) out of the cast.
NUMBER_PATTERN = r"^([+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity))\z"

KINDS = ("null", "numeric", "boolean", "text")

STRING = T.StringType()


def quoted(name: str) -> str:
    """A column name as a SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A Python string as a SQL string literal, every unusual character escaped."""
    safe = "".join(ch if ch.isalnum() and ch.isascii() or ch in " -_.+,:;/|()[]" else _escape(ch) for ch in text)
    return f"'{safe}'"


def number_literal(value: float) -> str:
    value = float(value)
    return f"({value!r}D)" if math.isfinite(value) else f"double('{value!r}')"


def _escape(ch: str) -> str:
    return f"\\u{ord(ch):04x}" if ord(ch) < 0x10000 else f"\\U{ord(ch):08x}"


def _words(words: tuple[str, ...]) -> str:
    return ", ".join(literal(w) for w in words)


def may_hold_numbers(dtype: T.DataType) -> bool:
    """Whether values of this Spark type can classify as numeric at all."""
    return isinstance(dtype, (T.NumericType, T.StringType))


def possible_kinds(dtype: T.DataType) -> tuple[str, ...]:
    """Kinds a value of this Spark type can have, missing first."""
    if isinstance(dtype, T.StringType):
        return KINDS
    if isinstance(dtype, T.BooleanType):
        return ("null", "boolean")
    return ("null", "numeric") if isinstance(dtype, T.NumericType) else ("null", "text")


def _is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def strip_sql(x: str) -> str:
    """Strip all Unicode white space; texts with printable ASCII at both ends are passed through."""
    return (
        f"CASE WHEN substring({x}, 1, 1) BETWEEN '!' AND '~' AND substring({x}, -1, 1) BETWEEN '!' AND '~' THEN {x} "
        f"ELSE trim(BOTH {literal(WHITESPACE)} FROM {x}) END"
    )


def blank_word_sql(s: str) -> str:
    """A stripped string that stands for a missing value; the length keeps long texts out of lower()."""
    return (
        f"({s} IN ({_words(NULL_SENTINELS)}) "
        f"OR (octet_length({s}) <= 4 AND lower({s}) IN ({_words(NAN_WORDS)})))"
    )


def boolean_word_sql(s: str) -> str:
    return f"(octet_length({s}) <= 5 AND lower({s}) IN ('true', 'false'))"


def number_word_sql(s: str) -> str:
    """A stripped string spelling a number; the first character decides whether the pattern is tried."""
    return (
        f"((substring({s}, 1, 1) BETWEEN '+' AND '9' OR substring({s}, 1, 1) IN ('i', 'I')) "
        f"AND {s} RLIKE r'{NUMBER_PATTERN}')"
    )


def parse_number_sql(s: str) -> str:
    """Stripped string to double, null when it is not a number."""
    return f"CASE WHEN {number_word_sql(s)} THEN try_cast({s} AS DOUBLE) END"


def finite_sql(x: str) -> str:
    """The number, or null for NaN and the infinities; -0.0 becomes 0.0."""
    return f"CASE WHEN abs({x}) < double('inf') THEN {x} + 0D END"


def missing_sql(x: str, dtype: T.DataType = STRING) -> str:
    if isinstance(dtype, T.StringType):
        return f"({x} IS NULL OR {blank_word_sql('(' + strip_sql(x) + ')')})"
    if _is_float(dtype):
        return f"({x} IS NULL OR isnan({x}))"
    return f"({x} IS NULL)"


def kind_of_stripped_sql(s: str, number: str) -> str:
    """Kind of a stripped string whose parsed number (or null) is at hand."""
    return (
        f"CASE WHEN {number} IS NOT NULL THEN 'numeric' "
        f"WHEN {s} IS NULL OR {blank_word_sql(s)} THEN 'null' "
        f"WHEN {boolean_word_sql(s)} THEN 'boolean' ELSE 'text' END"
    )


def text_of_stripped_sql(s: str, number: str, kind: str) -> str:
    return (
        f"CASE {kind} WHEN 'text' THEN {s} "
        f"WHEN 'numeric' THEN string({number} + 0D) WHEN 'boolean' THEN lower({s}) END"
    )


def kind_sql(x: str, dtype: T.DataType = STRING) -> str:
    """One of ``null``, ``boolean``, ``numeric``, ``text``."""
    if isinstance(dtype, T.StringType):
        s = f"({strip_sql(x)})"
        return kind_of_stripped_sql(s, f"({parse_number_sql(s)})")
    return f"CASE WHEN {missing_sql(x, dtype)} THEN 'null' ELSE '{possible_kinds(dtype)[1]}' END"


def number_sql(x: str, dtype: T.DataType = STRING) -> str:
    """The value as a finite double, or null."""
    if isinstance(dtype, T.StringType):
        return finite_sql(f"({parse_number_sql('(' + strip_sql(x) + ')')})")
    if _is_float(dtype):
        return finite_sql(f"double({x})")
    if isinstance(dtype, T.NumericType):
        return f"double({x})"
    return "cast(NULL AS DOUBLE)"


def text_sql(x: str, dtype: T.DataType = STRING) -> str:
    """String form after typing: trimmed text, a plain number, ``true``/``false``, or null."""
    if isinstance(dtype, T.StringType):
        s = f"({strip_sql(x)})"
        number = f"({parse_number_sql(s)})"
        return text_of_stripped_sql(s, number, f"({kind_of_stripped_sql(s, number)})")
    if _is_float(dtype):
        return f"CASE WHEN NOT isnan({x}) THEN string(double({x}) + 0D) END"
    if isinstance(dtype, T.BinaryType):
        return f"base64({x})"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return f"to_json({x})"
    return f"string({x})"


def lenient_number_sql(x: str) -> str:
    """Number with thousands commas allowed, else null (the quick profile's rule)."""
    return parse_number_sql(f"(replace({strip_sql(x)}, ','))")


def preview_sql(x: str) -> str:
    """Cells longer than 80 characters keep 77 and end in three dots."""
    return f"CASE WHEN length({x}) > 80 THEN concat(substring({x}, 1, 77), '...') ELSE {x} END"


def value_kind(x: str, dtype: T.DataType = STRING) -> Column:
    return F.expr(kind_sql(x, dtype))


def is_missing(x: str, dtype: T.DataType = STRING) -> Column:
    return F.expr(missing_sql(x, dtype))


def canonical_text(x: str, dtype: T.DataType = STRING) -> Column:
    return F.expr(text_sql(x, dtype))


def numeric_value(x: str, dtype: T.DataType = STRING) -> Column:
    return F.expr(number_sql(x, dtype))


def to_float_lenient(x: str) -> Column:
    return F.expr(lenient_number_sql(x))


def format_preview(x: str) -> Column:
    return F.expr(preview_sql(x))


def binary_to_text(x: str) -> Column:
    return F.base64(F.expr(x))


def slug(x: str) -> Column:
    """A name safe for a file: letters, digits, ``-`` and ``_`` only."""
    safe = F.trim(F.regexp_replace(F.expr(x), r"[^\p{L}\p{N}_-]", "_"), F.lit("_"))
    return F.when(F.length(safe) > 0, safe).otherwise(F.lit("column"))


def csv_cell(x: str, dtype: T.DataType = STRING) -> Column:
    """String form for a CSV sink: null, NaN and the infinities become empty."""
    if _is_float(dtype):
        return F.expr(f"CASE WHEN abs({x}) < double('inf') THEN string({x}) ELSE '' END")
    return F.expr(f"coalesce(string({x}), '')")


def safe_filename(x: str, fallback: str) -> Column:
    """Last path part with ``..`` replaced; the fallback when nothing is left."""
    default = literal(fallback)
    name = f"coalesce(nullif({strip_sql(x)}, ''), {default})"
    base = f"replace(element_at(split({name}, '/'), -1), '..', '_')"
    return F.expr(f"coalesce(nullif({base}, ''), {default})")


# File name endings and the format each one means, first match wins.
FORMAT_SUFFIXES = (
    ("csv", (".csv",)),
    ("tsv", (".tsv", ".tab")),
    ("jsonl", (".jsonl", ".ndjson")),
    ("json", (".json",)),
    ("excel", (".xlsx", ".xls", ".xlsm")),
    ("parquet", (".parquet", ".pq", ".pqt", ".parq")),
    ("sqlite", (".sqlite", ".sqlite3", ".db")),
    ("zip", (".zip",)),
    ("tar", (".tar.gz", ".tgz", ".tar")),
    ("gzip", (".gz", ".gzip")),
)

# Parts of a content type and the format each one means, first match wins.
FORMAT_CONTENT_TYPES = (
    ("csv", ("csv",)),
    ("tsv", ("tsv", "tab-separated")),
    ("json", ("json",)),
    ("excel", ("spreadsheet", "ms-excel")),
    ("parquet", ("parquet",)),
    ("tar", ("tar",)),
    ("zip", ("zip",)),
    ("gzip", ("gzip",)),
)


def detect_format(path: str, content_type: str | None = None) -> Column:
    """Data format by file name, then by content type, else ``unknown``."""
    branches = [
        f"WHEN {' OR '.join(f'endswith(lower({path}), {literal(end)})' for end in ends)} THEN '{fmt}'"
        for fmt, ends in FORMAT_SUFFIXES
    ]
    if content_type is not None:
        branches += [
            f"WHEN {' OR '.join(f'contains(lower({content_type}), {literal(part)})' for part in parts)} THEN '{fmt}'"
            for fmt, parts in FORMAT_CONTENT_TYPES
        ]
    return F.expr(f"CASE {' '.join(branches)} ELSE 'unknown' END")
