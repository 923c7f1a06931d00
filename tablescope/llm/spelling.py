"""Spelling variants: words one insertion, deletion or replacement apart, by pairs of trie nodes.

The nodes of a trie of all words (prefixes) and of a trie of all reversed words (suffixes)
are numbered. A word without its code point at place i is the pair (prefix node up to i,
suffix node behind i); a word cut before place i is the pair (prefix node, suffix node) of
both parts. So two words that differ in one replaced code point share a skipped pair, and
a word and one with an inserted code point share a cut pair of the one and a skipped pair
of the other. Pairs of integers are exact: no text is compared and none is generated.

Nodes are numbered while words stream past in sorted order: a word shares the nodes of its
common prefix with the word before it and opens new ones for the rest. Nodes that words of
two ranges share are known beforehand from the ranges' bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.session import materialize

#: Code points of a word by which words are dealt to ranges; words that agree in all of them share a range.
HEAD = 32
#: Node numbers of a range begin at the range's number shifted by this many bits.
BITS = 40
#: Node numbers in one batch, about.
BATCH = 1 << 19

RUNS = r"[A-Za-zÀ-ÿ]"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged_counts(documents: DataFrame, text: str = "text", least_length: int = 7, one_in: int = 31) -> DataFrame:
    """(word, n): the runs of letters of all texts, each with one code point deleted where a hash of doc_id and run says so."""
    # A deletion only shortens, so shorter runs give no word.
    runs = F.regexp_extract_all(F.col(text), F.lit(f"{RUNS}{{{least_length},}}"), F.lit(0))
    found = documents.filter(F.col(text).isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.explode(runs).alias("run"))
    # Most runs have no capital; lower() leaves those as they are, and translate() is slower.
    small = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", CAPITALS, SMALL))
    found = found.select("key", small.alias("run"))
    found = found.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run"))
    return found.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))


def _shared_heads(ranges: DataFrame) -> dict[str, int]:
    """A number below zero for every prefix that words of two ranges share; with a prefix all shorter ones are here.

    Ranges follow each other in order and no two words of different ranges agree in their
    first ``HEAD`` code points, so these are prefixes of the ranges' first words, at most
    ``HEAD`` for a range.
    """
    bounds = ranges.groupBy("part").agg(F.min("head").alias("low"), F.max("head").alias("high")).orderBy("low").collect()
    shared = {"": -1}
    for before, own in zip(bounds, bounds[1:]):
        for end in range(1, min(len(before["high"]), len(own["low"])) + 1):
            if before["high"][:end] != own["low"][:end]:
                break
            shared.setdefault(own["low"][:end], -len(shared) - 1)
    return shared


def numbered(words: DataFrame, key: str, name: str) -> DataFrame:
    """(key, nodes): the numbers of the trie nodes of ``name`` that other words share, from the root on; keys are kept.

    Without a ``key`` in ``words`` (name, n), words are numbered in their order as well, and n is kept.
    """
    own = key in words.columns
    head = F.substring(name, 1, HEAD)
    ranges = words.withColumn("head", head).repartitionByRange("head").withColumn("part", F.spark_partition_id())
    ranges = materialize(ranges, f"{name}-ranges")
    shared = _shared_heads(ranges)
    columns = [key, "nodes"] if own else [key, "word", "n", "nodes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counter, row, word, stack, kept, held = -1, 0, 0, "", [], 0, None
        out: list[list] = [[], [], []]
        nodes: list[int] = []
        offsets = [0]

        def flush() -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(nodes, pa.int64()))
            arrays = [pa.array(out[0], pa.int64()), lists] if own else [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), lists]
            batch = pa.RecordBatch.from_arrays(arrays, columns)
            for column in out:
                column.clear()
            nodes.clear()
            del offsets[1:]
            return batch

        def close(common: int) -> None:
            """Put the word that is held; the next one shares ``common`` code points with it."""
            depth = max(kept, common)
            while depth < min(len(word), HEAD) and word[: depth + 1] in shared:
                depth += 1
            out[0].append(held[0])
            if not own:
                out[1].append(word)
                out[2].append(held[1])
            nodes.extend(stack[: depth + 1])
            offsets.append(len(nodes))

        for batch in batches:
            others = batch.column(2).to_pylist()
            for number, new, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), others):
                common, end = 0, min(len(word), len(new)) if number == part else 0
                while common < end and word[common] == new[common]:
                    common += 1
                if held is not None:
                    close(common)
                    if len(nodes) >= BATCH:
                        yield flush()
                if number != part:
                    part, counter, row, stack = number, number << BITS, number << BITS, [-1]
                del stack[common + 1 :]
                # Prefixes shared with other ranges have numbers already.
                depth = common
                while depth < min(len(new), HEAD) and new[: depth + 1] in shared:
                    depth += 1
                    stack.append(shared[new[:depth]])
                rest = len(new) - depth
                stack.extend(range(counter, counter + rest))
                counter += rest
                word, kept, held = new, common, (other, None) if own else (row, other)
                row += 1
        if held is not None:
            close(0)
            yield flush()

    schema = f"{key} long, nodes array<long>" if own else f"{key} long, word string, n long, nodes array<long>"
    dealt = ranges.select("part", name, key if own else "n").repartition("part").sortWithinPartitions("part", name)
    return dealt.mapInArrow(run, schema)


def _pairs(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """(p, s, kind, n, id): the pairs that another word may share. kind 0: cut, 1: skipped, 2: skipped, and the first of equal skips.

    A pair of which one node belongs to one word alone meets no other word and is left out:
    a word has the shared nodes of its first ``a`` and last ``b`` code points, so only places
    in between matter.
    """
    both = forward.join(backward.withColumnRenamed("nodes", "back"), "id")
    size, a, b = F.length("word"), F.size("nodes") - 1, F.size("back") - 1

    def run(skip: int):
        # Prefix node i goes with the suffix node of size - i - skip code points.
        first = F.greatest(F.lit(0), size - skip - b)
        count = F.greatest(F.lit(0), F.least(a, size - skip) - first + 1)
        return first, count, F.slice("nodes", first + 1, count), F.slice(F.reverse("back"), b - (size - skip - first) + 1, count)

    first, skips, p1, s1 = run(1)
    _, cuts, p0, s0 = run(0)
    # Skipping any of some equal neighbours gives the same word: the first stands for all.
    letters = F.split("word", "")
    here, before = F.slice(letters, first + 1, skips), F.slice(F.concat(F.array(F.lit("")), letters), first + 1, skips)
    kinds = F.transform(F.arrays_zip(here.alias("x"), before.alias("y")), lambda z: F.when(z["x"] == z["y"], 1).otherwise(2))
    zipped = F.arrays_zip(F.concat(p1, p0).alias("p"), F.concat(s1, s0).alias("s"), F.concat(kinds, F.array_repeat(F.lit(0), cuts)).alias("kind"))
    return both.select("id", "n", F.inline(zipped)).select("p", "s", "kind", "n", "id")


def variants(counts: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``counts`` (word, n), whose words are distinct and not null.

    ``n_near`` counts the words one inserted, deleted or replaced code point away; ``form`` is
    the one of them with the largest n, the smallest in code-point order among equals, if
    its n is at least ``factor`` times the word's own; ``root`` is where forms lead from the
    word. Words without a form are their own root. No words give an empty table.
    """
    forward = materialize(numbered(counts.select("word", "n"), "id", "word"), "forward")
    reverse = forward.select("id", F.reverse("word").alias("drow"))
    pairs = _pairs(forward, numbered(reverse, "id", "drow"))
    # Words that share a pair differ in one letter between two nodes, so a group is no larger than the alphabet, and one.
    every = Window.partitionBy("p", "s")
    ranked = every.orderBy(F.col("kind") == 0, F.desc("n"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.struct("n", (-F.col("id")).alias("order"))
    skipped, cut, canon = F.col("kind") > 0, F.col("kind") == 0, F.col("kind") == 2
    groups = pairs.select(
        "*", best.alias("own"), F.count("*").over(ranked).alias("members"), F.count_if(skipped).over(ranked).alias("skips"), F.count_if(canon).over(ranked).alias("canons"),
        F.first(best).over(ranked).alias("first"), F.nth_value(best, 2).over(ranked).alias("second"),
        F.max(F.when(cut, best)).over(ranked).alias("whole"), F.max(F.when(canon, best)).over(ranked).alias("canon"),
    ).filter("members > 1")
    other = F.when(F.col("skips") > 1, F.when(F.col("first") == F.col("own"), F.col("second")).otherwise(F.col("first")))
    shorter = F.when(canon, F.col("whole"))
    near = groups.select(
        "id",
        F.when(cut, F.col("canons")).otherwise(F.col("skips") - 1 + shorter.isNotNull().cast("int")).alias("near"),
        F.when(cut, F.col("canon")).otherwise(F.greatest(other, shorter)).alias("best"),
    )
    near = near.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best")).filter("n_near > 0")
    joined = forward.select("id", "word", "n").join(near, "id", "left")
    formed = joined.withColumn("to", F.when(F.col("best.n") >= F.col("n") * factor, -F.col("best.order")))
    formed = materialize(formed.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "to"), "forms")
    links = formed.filter("to IS NOT NULL").select(F.col("id").alias("own"), F.col("to").alias("root"))
    moved = True
    while moved:  # pointer doubling: counts grow by the factor at every step, so five rounds reach any root
        further = links.select(F.col("own").alias("root"), F.col("root").alias("next"))
        further = links.join(further, "root", "left").select("own", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        links = materialize(further, "links")
        moved = not links.filter("moved").isEmpty()
    names = formed.select(F.col("id").alias("to"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    roots = links.join(formed.select(F.col("id").alias("root"), F.col("word").alias("name")), "root").select(F.col("own").alias("id"), "name")
    found = formed.join(names, "to", "left").join(roots, "id", "left")
    return found.select("word", "form", F.coalesce("name", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(documents: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """The variants of all words of ``documents`` (doc_id, text) that occur at least ``least`` times.

    Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF of at least seven code
    points, A-Z lower-cased, with the deletions of ``damaged_counts``. Null and empty texts
    have none. A null doc_id counts as an empty one in the hash. Repeated rows count as
    often as they occur; other columns play no part.
    """
    counts = materialize(damaged_counts(documents, text).filter(F.col("n") >= least), "words")
    return variants(counts)
