import csv
import gzip
import io
import json
import random
from datetime import date

import pytest

from conftest import by, rows
from tablescope.operators import profile
from tablescope.sources import blocks, delimited, files, sinks
from tablescope.sources.sql import bind, jdbc_options

ROWS = "city,height\n" + "".join(f"c{i},{i % 4}.5\n" for i in range(12))


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        (["﻿id", " a "], ["id", "a"]),
        (["", None, "x"], ["column_1", "column_2", "x"]),
        (["kg", "cm", "kg", "kg"], ["kg", "cm", "kg_2", "kg_3"]),
        (["kg", "KG", "Kg_2"], ["kg", "KG_2", "Kg_2_2"]),
    ],
)
def test_headers(raw, clean):
    assert delimited.normalize_headers(raw) == clean


def test_quick_headers():
    assert delimited.quick_headers(["﻿a", " "], 4) == ["a", "col_2", "col_3", "col_4"]


def write(tmp_path, name, text, mode="w"):
    path = tmp_path / name
    if isinstance(text, bytes):
        path.write_bytes(text)
    else:
        path.write_text(text, encoding="utf8", newline="")
    return str(path)


def test_ragged_csv(spark, tmp_path):
    path = write(tmp_path, "r.csv", '﻿id,,name\n1,a\n\n , ,\n2,b,"x, ""y""",late\n3,c,d\n')
    df = delimited.read_csv(spark, path)
    assert df.columns == ["id", "column_2", "name", "column_4"]
    assert sorted(rows(df)) == [("1", "a", "", ""), ("2", "b", 'x, "y"', "late"), ("3", "c", "d", "")]


def test_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path, "q.csv", 'id,text\n1,"a\nb, c",more\n2,"line ""two""\n\nend"\n3,x\n')
    assert delimited.has_quoted_line_breaks(spark, path)
    df = delimited.read_csv(spark, path)
    assert df.columns == ["id", "text", "column_3"]
    assert sorted(rows(df)) == [("1", "a\nb, c", "more"), ("2", 'line "two"\n\nend', ""), ("3", "x", "")]


def test_stray_quotes_keep_files_splittable(spark, tmp_path):
    lines = ["id,thing"] + [f'{i},5" pipe {i}' if i % 50 == 0 else f'{i},"a ""b"", c"' for i in range(4000)]
    path = write(tmp_path, "stray.csv", "\n".join(lines) + "\n")
    assert not delimited.has_quoted_line_breaks(spark, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = delimited.read_csv(spark, path)
        assert blocks.lines_of(spark, path).select("block").distinct().count() > 1 and df.count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r[0] for r in df.select("thing").distinct().collect()} == {'a "b", c'} | {f'5" pipe {i}' for i in range(0, 4000, 50)}


def test_csv_inputs_and_repeated_headers(spark, tmp_path):
    df = files.read_dataset(spark, write(tmp_path, "c.csv", ROWS))
    assert df.count() == 12 and df.columns == ["city", "height"]
    assert files.read_dataset(spark, write(tmp_path, "c.csv.gz", gzip.compress(ROWS.encode()))).count() == 12
    df = files.read_dataset(spark, write(tmp_path, "d.csv", "Kg,kg,place\n80,81,x\n60,59,y\n"))
    assert df.columns == ["Kg", "kg_2", "place"] and {"Kg", "kg_2"} <= by(profile.moments(df)).keys()
    tabbed = write(tmp_path, "t.tab", "a\tb\n1\t x\n")
    assert rows(files.read_dataset(spark, tabbed)) == [("1", " x")]
    assert delimited.read_csv(spark, write(tmp_path, "h.csv", "a,b\n")).count() == 0


def test_sniffing(spark, tmp_path):
    assert delimited.sniff_delimiter(spark, write(tmp_path, "s.txt", "a;b;c\n1;2;3\n4;5;6\n")) == ";"
    assert delimited.sniff_delimiter(spark, write(tmp_path, "n.txt", "word\nother\n")) == ","
    # The first 64 KiB count, however many lines they are.
    assert delimited.sniff_delimiter(spark, write(tmp_path, "l.txt", "x\n" * 1000 + "a|b|c\n" * 9000)) == "|"
    assert delimited.sniff_delimiter(spark, write(tmp_path, "m.txt", "a;b;c\n" * 12000 + "a|b|c\n" * 90000)) == ";"
    df = delimited.read_quick(spark, write(tmp_path, "p.txt", "a||c\n1|2|3|4\n5|6|7\n"))
    assert df.columns == ["a", "col_2", "c", "col_4"] and df.count() == 2


def test_json_and_jsonl(spark, tmp_path):
    lines = '{"id": 1}\n\nnot json\n[1, 2]\n{"id": 2, "late": "x"}\n'
    df = files.read_dataset(spark, write(tmp_path, "a.jsonl", lines))
    assert sorted(rows(df.select("id", "late")), key=str) == [(1, None), (2, "x")]
    assert by(profile.kind_counts(df))["late"]["null_count"] == 1
    many = files.read_dataset(spark, write(tmp_path, "a.json", json.dumps([{"a": 1}, {"a": "x"}])))
    assert many.count() == 2
    one = files.read_dataset(spark, write(tmp_path, "b.json", json.dumps({"a": 1}, indent=1)))
    assert rows(one) == [(1,)]
    some = files.read_dataset(spark, write(tmp_path, "c.json", '[{"a":1},5,\n{"a":2, "b": "[x"}, null, [{"a": 3}]]'))
    assert sorted(rows(some.select("a"))) == [(1,), (2,)]
    assert rows(files.read_dataset(spark, write(tmp_path, "l.jsonl", '[{"a": 9}]\n{"a": 1}\n'))) == [(1,)]
    assert files.read_dataset(spark, write(tmp_path, "n.jsonl", "3\n")).count() == 0


def test_catalog_and_union(spark, tmp_path):
    write(tmp_path, "a.csv", "x\n1\n")
    write(tmp_path, "b.bin", "12")
    found = {r["format"]: (r["files"], r["bytes_read"]) for r in files.source_metadata(spark, str(tmp_path)).collect()}
    assert found == {"csv": (1, 4), "unknown": (1, 2)}
    both = files.union_tagged({"one": spark.range(2), "none": spark.range(0), "two": spark.range(1).selectExpr("id AS other")})
    assert both.columns == ["__sheet__", "id", "other"] and both.count() == 3
    for name in ("a.xlsx", "a.zip", "a.tar.gz", "a.db", "a.parquet.gz"):
        with pytest.raises(ValueError):
            files.read_dataset(spark, name)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), ' "q", x\ny ', [1]), (2, 1.5, None, None)], "i int, d double, s string, a array<int>")
    path = str(tmp_path / "out.csv")
    sinks.write_csv(df, path)
    back = delimited.read_csv(spark, path)
    assert sorted(rows(back)) == [("1", "", ' "q", x\ny ', "[1]"), ("2", "1.5", "", "")]
    sinks.write_csv(df.limit(1), path)  # an existing result is kept
    assert delimited.read_csv(spark, path).count() == 2


def test_sql_options():
    assert bind("SELECT :a, :ab, '::a' , x::int", {"a": 1, "ab": "o'k"}) == "SELECT 1, 'o''k', '::a' , x::int"
    text = "SELECT ':a', \":a\" -- :a\n/* :a */ FROM t WHERE x = :a AND d = :d"
    assert bind(text, {"a": None, "d": date(2020, 1, 2)}) == text.replace("x = :a", "x = NULL").replace(":d", "'2020-01-02'")
    for bad in ([1], {"a": "\\' OR 1=1 --"}, {"a": "x\n"}, {"a": float("nan")}, {"a": object()}):
        with pytest.raises(ValueError):
            bind("SELECT :a", bad)
    assert jdbc_options("jdbc:x", "SELECT 1")["query"] == "SELECT 1"
    split = jdbc_options("jdbc:x", "SELECT * FROM t", partition_column="id", bounds=(0, 9), partitions=3)
    assert split["dbtable"] == "(SELECT * FROM t) source" and split["numPartitions"] == "3"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "SELECT 1", partition_column="id")


# --- records cut by many tasks -------------------------------------------------------------


@pytest.fixture
def small_splits(spark):
    """Files of some hundred bytes are many splits."""
    options = {"spark.sql.files.maxPartitionBytes": "6k", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for name, value in options.items():
        spark.conf.set(name, value)
    yield
    for name in options:
        spark.conf.unset(name)


def messy_table(rng, n):
    """A table whose records have quoted breaks, stray quotes and carriage returns, and long cells without any break."""
    plain = ["a", "b c", "é", "", " ", "1.5", '5" pipe', 'x"y"', "日本"]
    inside = ["a, b", "line\none", 'say ""hi""', "\r\nq", "x" * 1500, "\n\n", '""', "c,\n" * 2500, "end"]
    cell = lambda: rng.choice(plain) if rng.random() < 0.7 else '"' + rng.choice(inside) + '"' + rng.choice(["", "", "tail"])
    return "id,one,two\n" + "".join(f"{i}," + ",".join(cell() for _ in range(rng.choice([1, 2, 2, 2, 3]))) + rng.choice(["\n", "\n", "\r\n"]) for i in range(n))


def test_tables_of_many_splits_equal_pythons_reader(spark, tmp_path, small_splits):
    rng = random.Random(3)
    for number, tail in enumerate(("", '900,"never closed\nto the end, of it\n' + "y\n" * 8000 + "y")):
        text = messy_table(rng, 120) + tail
        path = write(tmp_path, f"m{number}.csv", text)
        assert blocks.lines_of(spark, path).select("block").distinct().count() > 6
        want = [r for r in csv.reader(io.StringIO(text, newline="")) if any(c.strip() for c in r)][1:]
        df = delimited.read_csv(spark, path, position=True)
        names = [c for c in df.columns if c != blocks.POSITION]
        got = [list(r) for r in df.orderBy(blocks.POSITION).select(names).collect()]
        assert names[:4] == ["id", "one", "two", "column_4"] and len(names) == max(map(len, want))
        assert got == [r + [""] * (len(names) - len(r)) for r in want]


def test_one_cell_over_many_splits(spark, tmp_path, small_splits):
    cell = "".join(f"line {i}, of it\n" for i in range(4000))
    path = write(tmp_path, "one.csv", f'id,text\n1,"{cell}"\n2,"x"\n3,{"z" * 15000}\n')
    assert blocks.quote_states(blocks.lines_of(spark, path), ",")[1]
    assert sorted(rows(delimited.read_csv(spark, path))) == [("1", cell), ("2", "x"), ("3", "z" * 15000)]


def test_files_without_quotes_in_order(spark, tmp_path, small_splits):
    (tmp_path / "many").mkdir()
    for k in range(3):
        write(tmp_path / "many", f"{k}.csv", "id,v\r\n" + "".join(f"{k * 10000 + i},{'v' * (i % 9)}\r\n" for i in range(1200)) + " , \r\n")
    df = delimited.read_csv(spark, str(tmp_path / "many"), position=True)
    got = [tuple(r) for r in df.orderBy(blocks.POSITION).select("id", "v").collect()]
    assert got == [(str(k * 10000 + i), "v" * (i % 9)) for k in range(3) for i in range(1200)]
    wide = write(tmp_path, "wide.csv", ",".join(f"c{i}" for i in range(700)) + "\n" + ",".join(map(str, range(700))) + "\n")
    assert rows(delimited.read_csv(spark, wide)) == [tuple(map(str, range(700)))]


def test_invalid_bytes_become_marks(spark, tmp_path):
    path = write(tmp_path, "bytes.csv", b'id,v\n1,"a\xff\nb"\n2,\xfe\n')
    assert sorted(rows(delimited.read_csv(spark, path))) == [("1", "a\ufffd\nb"), ("2", "\ufffd")]


def test_large_lists_are_cut_by_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(5)
    text = lambda: rng.choice(["plain", 'a "quoted" }{][, one', "back\\\\ slash\\", "é日", "}" * 40, "x" * 3000, ""])
    items = []
    for i in range(400):
        items.append({"id": i, "text": text(), "deep": {"list": [text(), {"k": [1, {"z": text()}]}]}})
        if i % 7 == 0:
            items += [rng.choice([5, "st}r", None, [{"id": 7}], [], {}])]
    for number, indent in enumerate((None, 1)):
        path = write(tmp_path, f"l{number}.json", "\ufeff" * number + json.dumps(items, indent=indent, ensure_ascii=bool(number)))
        assert blocks.lines_of(spark, path, "}").select("block").distinct().count() > 6
        df = files.read_json(spark, path, position=True)
        got = [tuple(r) for r in df.orderBy(blocks.POSITION).select("id", "text").collect()]
        want = [(x.get("id"), x.get("text")) for x in items if isinstance(x, dict)]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert df.filter("id IS NOT NULL").selectExpr("deep.list[0] AS x").collect() is not None
    one = write(tmp_path, "o.json", json.dumps({"a": 1, "rest": ["}" * 50] * 100}) + "\n")
    assert [r.a for r in files.read_json(spark, one).select("a").collect()] == [1]


def test_late_mixed_and_clashing_keys(spark, tmp_path):
    lines = ['{"a": 1, "A": "x", "n": {"k": 1, "K": 2}}', '{"a": 2.5, "late": [1, 2], "m": 1}', '{"m": "t", "a": 3, "d`q \'k": true, "a": 4}',
             '{"big": 123456789012345678901, "s": {"x": 1}}', "{broken", "[1]", '"text"', ""]
    df = files.read_jsonl(spark, write(tmp_path, "k.jsonl", "\n".join(lines) + "\n"), position=True).orderBy(blocks.POSITION)
    assert df.columns[:-1] == ["A", "a_2", "big", "d`q 'k", "late", "m", "n", "s"]
    got = df.selectExpr("A", "a_2", "late", "m", "n", "s.x", "string(big)", "`d``q 'k`").collect()
    assert [tuple(r) for r in got] == [
        ("x", 1.0, None, None, '{"K":2,"k":1}', None, None, None), (None, 2.5, [1, 2], "1", None, None, None, None),
        (None, 4.0, None, "t", None, None, None, True), (None, None, None, None, None, 1, "123456789012345678901", None),
    ]
    assert files.read_jsonl(spark, write(tmp_path, "none.jsonl", "\n5\n")).columns == ["column_1"]
