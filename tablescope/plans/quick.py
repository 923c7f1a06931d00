"""The quick profile of a delimited file or string table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.operators import quality, quick
from tablescope.operators.cells import column_of
from tablescope.session import POSITION, key_of
from tablescope.sources import sinks

REPORT, DOCUMENT, MANIFEST = "results/report.txt", "results/results.json", "results/manifest.json"


@dataclass
class QuickReport:
    """Result tables of a quick profile; each runs when it is used."""

    types: DataFrame
    shape: DataFrame
    checks: DataFrame
    stats: DataFrame | None
    correlations: DataFrame | None
    outliers: DataFrame | None
    head: DataFrame
    delimiter: str | None = None

    def document(self, path: str = "") -> DataFrame:
        """One row of JSON: shape, schema, delimiter, the head of the table and where its results are below ``path``."""
        schema = self.types.agg(F.sort_array(F.collect_list(F.struct("position", "column", "type")))).scalar()
        head = self.head.agg(F.collect_list(F.struct("*"))).scalar()
        links = {"manifest": MANIFEST, "results": DOCUMENT, "report": REPORT}
        links = F.struct(*[F.lit(f"{path}/{key}" if path else key).alias(name) for name, key in links.items()])
        parts = {"summary": F.struct("rows", "columns"), "schema": schema, "delimiter": F.lit(self.delimiter), "head": head, "links": links}
        return self.shape.select(F.to_json(F.struct(*[part.alias(name) for name, part in parts.items()])).alias("document"))

    def tables(self, path: str = "") -> dict[str, tuple[str, DataFrame]]:
        """Result tables by relative key, with their kind; links in them go below ``path``."""
        text = self.shape.selectExpr("concat('Rows: ', rows, ', columns: ', columns) AS value")
        found = {REPORT: ("text", text), DOCUMENT: ("text", self.document(path))}
        if self.stats is not None:
            found |= {
                "results/descriptive_stats.csv": ("csv", self.stats),
                "results/descriptiveTable.json": ("json", self.stats),
                "results/correlations.csv": ("csv", self.correlations),
                "results/outliers.json": ("json", self.outliers),
            }
        return found

    def write(self, path: str, mode: str = "ignore") -> DataFrame:
        """Write all tables below ``path`` and return the list of what was written.

        The list is written last and marks a finished result, which ``ignore`` keeps; what an
        unfinished run left is written anew, so no result holds tables of two runs.
        """
        spark = self.shape.sparkSession
        if mode == "ignore":
            finished = sinks.read_finished(spark, f"{path}/{MANIFEST}", "key string, content_type string")
            if finished is not None:
                return finished
        writers = {"csv": sinks.write_csv, "json": sinks.write_json, "text": sinks.write_text}
        tables = self.tables(path)
        for key, (kind, table) in tables.items():
            writers[kind](table, f"{path}/{key}", "overwrite")
        written = [(key, sinks.content_type(key)) for key in sorted(tables)]
        entries = spark.createDataFrame(written, "key string, content_type string")
        sinks.write_json(entries, f"{path}/{MANIFEST}", "overwrite")
        return entries


def quick_profile(df: DataFrame, order_by: Sequence[str] | None = None, delimiter: str | None = None) -> QuickReport:
    """Types from the first 200 rows in key order, statistics over all rows; ``delimiter`` is named in the document.

    Without ``order_by``, ``df`` must know the places of its rows (see ``read_quick``).
    """
    order_by = key_of(df, order_by)
    if not order_by:
        raise ValueError("name a key, or read the file with its rows' positions")
    names = [n for n in df.columns if n != POSITION]
    types = quick.column_types(df, order_by)
    numbers = quick.number_names(types)
    frame = quick.lenient_frame(df, numbers) if numbers else None
    table = df.select(*[column_of(n) for n in names])
    return QuickReport(
        types=types,
        shape=quick.shape(df, names),
        checks=quality.non_empty(table),
        stats=quick.stats_table(frame) if numbers else None,
        correlations=quick.correlations(frame) if numbers else None,
        outliers=quick.outliers(frame) if numbers else None,
        head=quick.head_rows(df, order_by),
        delimiter=delimiter,
    )
