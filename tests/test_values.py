import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows, strings
from tablescope.functions import values as V

KINDS = {
    "": "null", "  ": "null", "\t": "null", "null": "null", "NULL": "null", "NaN": "null", "nan": "null", "+nan": "null",
    " nan　": "null", "Null": "text", "N/A": "text", "None": "text",
    "1": "numeric", "+1": "numeric", ".5": "numeric", "5.": "numeric", "1e5": "numeric", " -2.5 ": "numeric",
    "inf": "numeric", "-Infinity": "numeric", "1d": "text", "1.0f": "text", "0x1p3": "text", "1_000": "text", "1,000": "text",
    ".": "text", "e5": "text", "1e": "text", "٣": "text", "infinit": "text", "1\n2": "text",
    "true": "boolean", "FALSE": "boolean", " True\n": "boolean", "yes": "text",
}


def test_kinds_of_strings(spark):
    df = strings(spark, v=list(KINDS))
    found = dict(rows(df.select("v", V.value_kind("v"))))
    assert found == KINDS
    missing = dict(rows(df.select("v", V.is_missing("v"))))
    assert missing == {v: k == "null" for v, k in KINDS.items()}


def test_none_is_missing(spark):
    df = strings(spark, v=[None])
    assert rows(df.select(V.value_kind("v"), V.is_missing("v"), V.canonical_text("v"), V.numeric_value("v"))) == [
        ("null", True, None, None)
    ]


def test_numbers_and_texts(spark):
    df = strings(spark, v=[" 1e2 ", "inf", "TRUE", " a b ", "nan", "-0.0"])
    assert rows(df.select(V.numeric_value("v"), V.canonical_text("v"))) == [
        (100.0, "100.0"), (None, "Infinity"), (None, "true"), (None, "a b"), (None, None), (0.0, "0.0"),
    ]


def test_typed_columns(spark):
    df = spark.createDataFrame([(float("nan"), True, 1, bytearray(b"ab"), [1, 2])], "d double, b boolean, i int, y binary, a array<int>")
    types = {f.name: f.dataType for f in df.schema.fields}
    assert rows(df.select(*[V.value_kind(n, t) for n, t in types.items()])) == [("null", "boolean", "numeric", "text", "text")]
    assert rows(df.select(*[V.canonical_text(n, t) for n, t in types.items()])) == [(None, "true", "1", "YWI=", "[1,2]")]


def test_lenient_numbers(spark):
    df = strings(spark, v=["1,234.5", "1,000", "x", "", "7"])
    assert rows(df.select(V.to_float_lenient("v"))) == [(1234.5,), (1000.0,), (None,), (None,), (7.0,)]


def test_presentation(spark):
    df = strings(spark, v=["a" * 81, "a" * 80, "a/b c!", "__", "../x..y", ""])
    found = rows(df.select(V.format_preview("v"), V.slug("v"), V.safe_filename("v", "file")))
    assert found[0][0] == "a" * 77 + "..." and found[1][0] == "a" * 80
    assert found[2][1:] == ("a_b_c", "b c!")
    assert found[3][1] == "column"
    assert found[4][2] == "x_y" and found[5][2] == "file"
    cells = spark.createDataFrame([(1.5,), (float("inf"),), (float("nan"),), (None,)], "x double")
    assert rows(cells.select(V.csv_cell("x", T.DoubleType()))) == [("1.5",), ("",), ("",), ("",)]


@pytest.mark.parametrize(
    ("path", "ctype", "fmt"),
    [
        ("a.CSV", None, "csv"), ("a.tab", None, "tsv"), ("a.ndjson", None, "jsonl"), ("a.xlsm", None, "excel"),
        ("a.parq", None, "parquet"), ("a.db", None, "sqlite"), ("a.tar.gz", None, "tar"), ("a.csv.gz", None, "gzip"),
        ("a", "text/csv", "csv"), ("a", "application/json; x", "json"), ("a", "application/gzip", "zip"),
        ("a", "text/html", "unknown"),
    ],
)
def test_formats(spark, path, ctype, fmt):
    df = strings(spark, p=[path], c=[ctype])
    expected = "zip" if fmt == "zip" else fmt
    assert rows(df.select(V.detect_format("p", "c"))) == [(expected,)]


def test_literals_survive_quotes_and_unicode(spark):
    odd = "a'b\\c\né\U0001f600`{x}"
    assert spark.range(1).select(F.expr(V.literal(odd))).first()[0] == odd
