"""Packing of tokenised documents into sequences by Karmarkar-Karp multiway differencing.

A document's tokens are cut into full sequences, which need no packing, and a rest, which
is cut into equal pieces no longer than ``PIECE``. The pieces of a block of documents are
dealt to windows: the differencing method merges the two partial partitions with the
largest imbalance, full windows of one with empty windows of the other, until one
partition into near-equal windows is left. If a window holds more than a sequence takes,
the number of windows rises.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.utf8 import blocks, column_bytes
from tablescope.session import materialize

SEQUENCE = 2048
#: The longest piece that is dealt; a sequence then holds enough pieces to come out even.
PIECE = 512
#: Tokens of pieces in a block, about, and so the work of one group.
BLOCK_TOKENS = 128 * SEQUENCE
# Fixed value: how a byte-level tokenizer cuts texts into pieces before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The id after each document.
END = 1


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each piece, by multiway differencing; ties go by the order of the pieces."""
    if windows == 1 or not len(sizes):
        return np.zeros(len(sizes), np.int64)
    # A partition: its windows' sums, ascending and less the smallest; and the two it came from.
    sums = [np.append(np.zeros(windows - 1, np.int64), size) for size in sizes]
    heap = [(-int(size), i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        (_, one), (_, two) = heapq.heappop(heap), heapq.heappop(heap)
        joined = sums[one] + sums[two][::-1]
        order = np.argsort(joined, kind="stable")
        merges.append((one, two, order))
        sums[one] = sums[two] = None
        sums.append(joined[order] - joined[order[0]])
        heapq.heappush(heap, (-int(sums[-1][-1]), len(sums) - 1))
    # Down from the last partition: which of the final windows each of a partition's windows became.
    places = {len(sums) - 1: np.arange(windows)}
    for made in range(len(merges) - 1, -1, -1):
        one, two, order = merges[made]
        place = np.empty(windows, np.int64)
        place[order] = places.pop(len(sizes) + made)
        places[one], places[two] = place, place[::-1]
    return np.array([places[i][-1] for i in range(len(sizes))])


def deal(sizes: np.ndarray, capacity: int = SEQUENCE) -> np.ndarray:
    """The window of each piece, in as few windows as differencing manages within the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, windows)
        if not len(sizes) or np.bincount(window, weights=sizes).max() <= capacity:
            return window
        windows += 1


def byte_of() -> dict[str, int]:
    """The byte for which each letter of a byte-level vocabulary stands: itself if it can be shown, else 256 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Token ids of whole texts, as bytes of little-endian 32-bit numbers.

    The ids are those of the ``tokenizers`` library with ``add_special_tokens=False``: strings
    of special tokens in a text are those tokens. A byte-level vocabulary whose ids follow
    the order of its merges gives the same ids as ranks of ``tiktoken``, which takes a third of
    the time and remembers nothing between texts; any other file is used as it is.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.ranked = path, self._ranked(path)

    def _ranked(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        model, before, added = known["model"], known.get("pre_tokenizer") or {}, known.get("added_tokens") or []
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        if known.get("normalizer") or model.get("type") != "BPE" or any(model.get(o) for o in options) or any(before.get(k) != v for k, v in plain.items()):
            return None
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            return None
        vocab, letters = model["vocab"], byte_of()
        special = {t["content"]: t["id"] for t in added}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        own = {token: rank for token, rank in vocab.items() if token not in special}
        if merged != sorted(merged) or len(merged) + 256 != len(own) or any(c not in letters for token in own for c in token):
            return None
        ranks = {bytes(letters[c] for c in token): rank for token, rank in own.items()}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, without an end."""
        if self.ranked:
            for text in texts:
                yield self.ranked.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        else:
            from tokenizers import Tokenizer

            for found in Tokenizer.from_file(self.path).encode_batch_fast(texts, add_special_tokens=False):
                yield np.array(found.ids, "<u4").tobytes()


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker process."""
    return Encoder(path)


def cuts(tokens: int, sequence: int = SEQUENCE, piece: int = PIECE) -> list[tuple[int, int]]:
    """Where a document of so many tokens is cut: (start, length)."""
    full, rest = divmod(tokens, sequence)
    found = [(k * sequence, sequence) for k in range(full)]
    if rest:
        parts = -(-rest // piece)
        edges = [full * sequence + rest * k // parts for k in range(parts + 1)]
        found += [(a, b - a) for a, b in zip(edges, edges[1:])]
    return found


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(documents: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """The pieces of every document: tokenised, ended and cut. ``salt`` tells equal rows of a task apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, salt = encoder(tokenizer), 0
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for row, _, starts in blocks(data, offsets, 1 << 20):
                part = batch.slice(row, len(starts) - 1)
                rows = []
                for key, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                    ids = memoryview(ids + END.to_bytes(4, "little"))
                    for start, length in cuts(len(ids) // 4):
                        rows.append((key, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, salt))
                    salt += 1
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])

    return documents.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, PIECES)


def pack(documents: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """The pieces (doc_id, start, length, ids_crc32, doc_tokens) of all ``documents`` and their places (sequence_id, offset).

    A null text counts as empty: its document is the end alone. Rows with equal or null
    doc_id are documents of their own. Other columns play no part. An empty table gives
    no pieces. Sequence ids are unique, not gapless.

    Blocks are made by a hash of the pieces, so no block depends on where a document lies,
    and their number follows the number of tokens. Full sequences need no block: each gets
    a number by its place in the table of pieces.
    """
    cut = materialize(pieces(documents, tokenizer, text), "pieces")
    full, part = cut.filter(F.col("length") == SEQUENCE), cut.filter(F.col("length") < SEQUENCE)
    tokens = part.agg(F.sum("length").alias("n")).first()["n"] or 0
    count = max(1, round(tokens / BLOCK_TOKENS))
    block = F.pmod(F.xxhash64("doc_id", "ids_crc32", "salt", "start"), F.lit(count))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "salt")])
        size, number = table["length"].to_numpy(), int(table["block"][0].as_py())
        window = deal(size)
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(size[order])
        first = np.flatnonzero(np.append(True, np.diff(window[order]) > 0))
        base = np.repeat((ends - size[order])[first], np.diff(np.append(first, len(order))))
        placed = table.take(pa.array(order)).select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        placed = placed.append_column("sequence_id", pa.array((number << 32) + window[order]))
        return placed.append_column("offset", pa.array(ends - size[order] - base))

    # Block numbers are below count, so these ids are beyond those of all windows.
    own = (F.lit(count << 32) + F.monotonically_increasing_id()).alias("sequence_id")
    alone = full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", own, F.lit(0).cast("long").alias("offset"))
    return part.withColumn("block", block).groupBy("block").applyInArrow(place, PLACED).unionAll(alone)
