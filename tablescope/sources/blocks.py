"""Records of text files, cut by many tasks.

Where a record ends in a quoted table or in a JSON document depends on all text before
it. Each split of a file is therefore summarised first: in which state it is left, for
every state in which it may be entered. The summaries of a file, one for every split,
are put together in order, which gives the state that each split is entered in; then all
splits are cut at the same time. What a split holds of records that begin or end in
others is put together by records. A record's position is its file, split and place.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.session import POSITION as POSITION

#: Bytes of a JSON text that are looked at at once.
CHUNK = 1 << 20


def lines_of(spark: SparkSession, path: str, separator: str | None = "\n") -> DataFrame:
    """(value, path, block, at): the lines of all files; ``at`` rises within a split and is met once."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(path).select(
        F.expr("make_valid_utf8(value)").alias("value"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def splits_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, list]]:
    """(path, block, whether the split begins here, columns) of runs of rows of one split, in the order of the file."""
    last = None
    for batch in batches:
        paths, blocks = batch.column(1), batch.column(2).to_numpy()
        if not len(blocks):
            continue
        codes = paths.dictionary_encode().indices.to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1).tolist(), len(blocks)]
        for low, high in zip(edges, edges[1:]):
            key = (paths[low].as_py(), int(blocks[low]))
            yield (*key, key != last, [c.slice(low, high - low) for c in batch.columns])
            last = key


class Entered:
    """The states that splits are entered in; splits without a summary leave the state as it was."""

    def __init__(self, summaries: list[tuple], start, leave: Callable):
        self.files: dict[str, tuple[list[int], list]] = {}
        for path, block, *summary in sorted(summaries):
            blocks, states = self.files.setdefault(path, ([], []))
            states.append(leave(states[-1] if states else start, *summary))
            blocks.append(block)
        self.start = start

    def state(self, path: str, block: int):
        blocks, states = self.files.get(path, ((), ()))
        before = bisect_left(blocks, block)
        return states[before - 1] if before else self.start


def joined(pieces: DataFrame, separator: str) -> DataFrame:
    """(path, block, at, head, value): the records of which several splits hold a piece.

    ``pieces`` (path, block, at, head, begins, text) has at most one row of a split that goes on
    with a record and one that begins one, so counting the latter numbers a file's records.
    """
    order = Window.partitionBy("path").orderBy("block", "begins")
    numbered = pieces.withColumn("record", F.sum(F.col("begins").cast("int")).over(order))
    first = lambda c: F.min_by(c, F.struct("block", "begins")).alias(c)
    return numbered.groupBy("path", "record").agg(
        *(first(c) for c in ("block", "at", "head")),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "begins", "text"))), lambda p: p["text"]), separator).alias("value"),
    ).drop("record")


# --- quoted tables -----------------------------------------------------------------------


def cell_break(delimiter: str) -> re.Pattern:
    return re.compile(f"[{re.escape(delimiter)}\r]")


def left_open(line: str, is_open: bool, delimiter: str, breaks: re.Pattern) -> bool:
    """Whether a quoted cell is open at the end of a line, given whether one is at its begin.

    A quote opens a cell only as its first character; in any other cell, and behind the
    quote that closes one, quotes are ordinary text. Two quotes in a row stand for one.
    """
    at = 0
    while True:
        if is_open:
            at = line.find('"', at) + 1
            if not at:
                return True
            if line[at : at + 1] == '"':
                at += 1
                continue
            is_open = False
        else:
            quote = line.find('"', at)
            if quote < 0:
                return False
            if quote == at and (at == 0 or line[at - 1] in (delimiter, "\r")) or quote > at and line[quote - 1] in (delimiter, "\r"):
                is_open, at = True, quote + 1
                continue
            at = quote
        end = breaks.search(line, at)
        if not end:
            return False
        at = end.end()


def quote_states(lines: DataFrame, delimiter: str) -> tuple[Entered, bool]:
    """Whether a cell is open where splits are entered, and whether any line leaves one open.

    Lines without quotes change no state, so only the others are looked at. What comes to
    the driver is one row of four flags for a split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaks, key, state, ever = cell_break(delimiter), None, [False, True], [False, True]
        for path, block, begins, columns in splits_in_order(batches):
            if begins:
                if key:
                    yield _rows([(*key, *state, *ever)], SUMMARY)
                key, state, ever = (path, block), [False, True], [False, False]
            for line in columns[0].to_pylist():
                state = [left_open(line, s, delimiter, breaks) for s in state] if state[0] != state[1] else [left_open(line, state[0], delimiter, breaks)] * 2
                ever = [e or s for e, s in zip(ever, state)]
        if key:
            yield _rows([(*key, *state, *ever)], SUMMARY)

    quoted = lines.filter(F.contains("value", F.lit('"'))).select("value", "path", "block")
    found = [tuple(r) for r in quoted.mapInArrow(run, SUMMARY).collect()]
    entered = Entered([r[:4] for r in found], False, lambda state, closed, opened: opened if state else closed)
    return entered, any(r[5] if entered.state(r[0], r[1]) else r[4] for r in found)


SUMMARY = "path string, block long, closed boolean, opened boolean, any_closed boolean, any_opened boolean"
RECORD = "path string, block long, at long, place int, head boolean, begins boolean, text string, cells array<string>"
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def cells_of(record: str, delimiter: str) -> list[list[str]]:
    """The rows of a record's text; more than one if a lone carriage return stands outside of quotes."""
    if '"' not in record and "\r" not in record[:-1]:
        return [record.removesuffix("\r").split(delimiter)]
    csv.field_size_limit(sys.maxsize)
    return list(csv.reader(io.StringIO(record, newline=""), delimiter=delimiter))


def cut_tables(lines: DataFrame, delimiter: str, entered: Entered) -> DataFrame:
    """(path, block, at, place, head, begins, text, cells): the records of quoted tables, and pieces (text) of those that splits share.

    ``head`` marks the first record of a file. Blank records are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaks, key, is_open, begun, head, pending, first = cell_break(delimiter), None, False, False, False, [], 0

        def piece() -> tuple:
            return (*key, first, 0, head and begun, begun, "\n".join(pending), None)

        for path, block, begins, columns in splits_in_order(batches):
            out = []
            if begins:
                if key and pending:
                    out.append(piece())
                key, pending, begun = (path, block), [], False
                is_open, head = entered.state(path, block), block == 0
            for line, at in zip(columns[0].to_pylist(), columns[3].to_pylist()):
                if not pending:
                    first, begun = at, not is_open
                pending.append(line)
                if '"' in line:
                    is_open = left_open(line, is_open, delimiter, breaks)
                if is_open:
                    continue
                if begun:
                    for place, cells in enumerate(cells_of("\n".join(pending), delimiter)):
                        if head and any(cells):
                            out.append((*key, first, place, True, True, None, cells))
                            head = False
                        elif any(c.strip() for c in cells):
                            out.append((*key, first, place, False, True, None, cells))
                else:
                    out.append(piece())
                pending = []
            if out:
                yield _rows(out, RECORD)
        if key and pending:
            yield _rows([piece()], RECORD)

    return lines.select("value", "path", "block", "at").mapInArrow(run, RECORD)


def cut_pieces(records: DataFrame, delimiter: str) -> DataFrame:
    """The records of ``joined`` (path, block, at, head, value) with their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, block, at, head, value in zip(*(c.to_pylist() for c in batch.columns)):
                for place, cells in enumerate(cells_of(value, delimiter)):
                    if any(c.strip() for c in cells):
                        out.append((path, block, at, place, head and place == 0, True, None, cells))
            if out:
                yield _rows(out, RECORD)

    return records.select("path", "block", "at", "head", "value").mapInArrow(run, RECORD)


# --- JSON documents ----------------------------------------------------------------------

_STRUCTURE = np.zeros(256, bool)
_STRUCTURE[[ord(c) for c in '"{}[],']] = True
_STEP = np.zeros(256, np.int64)
_STEP[[ord(c) for c in "{["]], _STEP[[ord(c) for c in "}]"]] = 1, -1
JSON_SUMMARY = "path string, block long, quotes long, outside long, inside long, first string"


def structure(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, bytes, quotes so far) of the structural characters; quotes behind an odd run of backslashes are none.

    Data begin behind a ``}``, so no run goes on from what stood before.
    """
    at = np.flatnonzero(_STRUCTURE[data])
    codes = data[at]
    escaped = (codes == 34) & (at > 0) & (data[at - 1] == 92)
    if escaped.any():
        drop = []
        for k in np.flatnonzero(escaped).tolist():
            low = at[k] - 1
            while low >= 0 and data[low] == 92:
                low -= 1
            if (at[k] - 1 - low) % 2:
                drop.append(k)
        at, codes = np.delete(at, drop), np.delete(codes, drop)
    return at, codes, np.cumsum(codes == 34)


def _chunks(values: pa.Array) -> Iterator[bytes]:
    """The text of segments, each with the ``}`` behind it, in pieces of about ``CHUNK`` bytes that end with one."""
    held, size = [], 0
    for text in values.to_pylist():
        held.append(text.encode())
        size += len(held[-1]) + 1
        if size >= CHUNK:
            yield b"}".join(held) + b"}"
            held, size = [], 0
    if held:
        yield b"}".join(held) + b"}"


def depth_states(segments: DataFrame) -> Entered:
    """(In a string, depth, whether the document is a list) where splits are entered. One row for a split comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums, first = None, [0, 0, 0], ""
        for path, block, begins, columns in splits_in_order(batches):
            if begins:
                if key:
                    yield _rows([(*key, *sums, first)], JSON_SUMMARY)
                key, sums, first = (path, block), [0, 0, 0], ""
            for chunk in _chunks(columns[0]):
                if not first:
                    first = chunk.decode().lstrip(" \t\r\n﻿")[:1]
                _, codes, quotes = structure(np.frombuffer(chunk, np.uint8))
                step, odd = _STEP[codes], (quotes + sums[0]) % 2 == 1
                sums = [sums[0] + int((codes == 34).sum()), sums[1] + int(step[~odd].sum()), sums[2] + int(step[odd].sum())]
        if key:
            yield _rows([(*key, *sums, first)], JSON_SUMMARY)

    def leave(state: tuple, quotes: int, outside: int, inside: int, first: str) -> tuple:
        in_string, depth, is_list = state
        kind = is_list if is_list is not None or not first else first == "["
        return (in_string + quotes) % 2, depth + (inside if in_string else outside), kind

    found = [tuple(r) for r in segments.select("value", "path", "block").mapInArrow(run, JSON_SUMMARY).collect()]
    return Entered(found, (0, 0, None), leave)


ITEM = "path string, block long, at long, place int, head boolean, begins boolean, text string, whole boolean"


def cut_documents(segments: DataFrame, entered: Entered) -> DataFrame:
    """(path, block, at, place, begins, text, whole): the items of a list or the one object of a document, and pieces of those that splits share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, pending, begun, place, at0 = None, (0, 0, None), [], False, 0, 0

        def item(whole: bool) -> tuple:
            nonlocal place
            place += 1
            return (*key, at0, place, False, begun, b"".join(pending).decode(), whole and begun)

        for path, block, begins, columns in splits_in_order(batches):
            out = []
            if begins:
                if key and pending:
                    out.append(item(False))
                key, state, place = (path, block), entered.state(path, block), 0
                pending, begun, at0 = [], False, columns[3][0].as_py()
            in_string, depth, is_list = state
            for chunk in _chunks(columns[0]):
                if is_list is None:
                    first = chunk.decode().lstrip(" \t\r\n﻿")[:1]
                    is_list = first == "[" if first else None
                data = np.frombuffer(chunk, np.uint8)
                at, codes, quotes = structure(data)
                outside = (quotes + in_string) % 2 == 0
                at, codes = at[outside], codes[outside]
                step = _STEP[codes]
                after = depth + np.cumsum(step)
                before = after - step
                # What ends an item, and what begins one: a comma does both.
                if is_list:
                    ends = (codes == 44) & (after == 1) | (step < 0) & (after == 0)
                    opens = (codes == 44) & (after == 1) | (step > 0) & (before == 0)
                else:
                    ends, opens = (step < 0) & (after == 0), (step > 0) & (before == 0)
                low, inside = 0, depth > 0
                for k in np.flatnonzero(ends | opens).tolist():
                    if ends[k] and inside:
                        pending.append(chunk[low : at[k] if is_list else at[k] + 1])
                        out.append(item(True))
                        pending, inside = [], False
                    if opens[k]:
                        low, inside, begun = int(at[k]) + (1 if is_list else 0), True, True
                if inside:
                    pending.append(chunk[low:])
                in_string = (in_string + int(quotes[-1] if len(quotes) else 0)) % 2
                depth = int(after[-1]) if len(after) else depth
            state = (in_string, depth, is_list)
            if out:
                yield _rows(out, ITEM)
        if key and pending:
            yield _rows([item(False)], ITEM)

    return segments.select("value", "path", "block", "at").mapInArrow(run, ITEM)
