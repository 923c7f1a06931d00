"""Tables the queries run on: the given ones, and a few derived from them as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablescope.sources.files import read_parquet

# Column families of the tables, as the SQL side sees them.
I, D, S, T = "int", "double", "string", "time"
COLUMNS = {
    "customer": {"c_custkey": I, "c_name": S, "c_nationkey": I, "c_acctbal": D, "c_mktsegment": S},
    "part": {"p_partkey": I, "p_name": S, "p_brand": S, "p_type": S, "p_size": I, "p_retailprice": D},
    "orders": {
        "o_orderkey": I, "o_custkey": I, "o_orderstatus": S, "o_totalprice": D, "o_orderdate": T, "o_orderpriority": S,
    },
    "lineitem": {
        "l_orderkey": I, "l_partkey": I, "l_suppkey": I, "l_linenumber": I, "l_quantity": D, "l_extendedprice": D,
        "l_discount": D, "l_tax": D, "l_returnflag": S, "l_linestatus": S, "l_shipdate": T,
    },
    "events": {"event_id": I, "ts": T, "user_id": I, "event_type": S, "value": D, "props": S},
    "documents": {"doc_id": I, "text": S, "lang": S, "source": S, "n_chars": I},
    "conversations": {"conv_id": I, "turn": I, "role": S, "text": S},
    # Derived: documents with their labels (null where there is none).
    "labelled": {"doc_id": I, "text": S, "lang": S, "source": S, "n_chars": I, "quality": I, "toxic": I},
    # Derived: orders with a column of texts and numbers, and one of flags and blanks.
    "mixed": {"o_orderkey": I, "remark": S, "flag": S},
    # Derived: events as a delimited file would hold them, one number with thousands commas.
    "raw_events": {"event_id": I, "user_id": S, "event_type": S, "value": S, "amount": S, "ts": S},
}

_VIEWS = {
    "labelled": "SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "mixed": (
        "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN concat(' ', o_custkey, '.5 ') ELSE o_orderpriority END AS remark, "
        "CASE WHEN o_orderstatus = 'O' THEN 'TRUE' WHEN o_orderstatus = 'F' THEN 'false' ELSE ' NaN ' END AS flag FROM orders"
    ),
    "raw_events": (
        "SELECT event_id, cast(user_id AS {string}) AS user_id, event_type, cast(value AS {string}) AS value, "
        "{amount} AS amount, cast(ts AS {string}) AS ts FROM events"
    ),
}
_SPARK = {"string": "STRING", "amount": "format_number(user_id * 1000, 0)"}
_DUCK = {"string": "VARCHAR", "amount": "format('{:,}', user_id * 1000)"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "labelled":
        documents, labels = (read_parquet(spark, f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
        return documents.join(labels, "doc_id", "left")
    if name in _VIEWS:
        base = "events" if name == "raw_events" else "orders"
        sql = _VIEWS[name].format(**_SPARK).replace(f"FROM {base}", "FROM {base}")
        return spark.sql(sql, base=read_parquet(spark, f"{sf_dir}/{base}.parquet"))
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def duck_source(name: str) -> str:
    """The table as a FROM item for DuckDB."""
    return f"({_VIEWS[name].format(**_DUCK)})" if name in _VIEWS else name
