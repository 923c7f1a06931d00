"""Benchmark decontamination by SimHash over windows as long as each benchmark item.

All in DataFrame functions. A document's words are hashed into shingles of five. Wherever
a run of shingles starts that also stand in an item, at the same distances, the document
has windows of the item's length: one from there and one where the item would start. No
window anywhere is more similar than the best of these: one can be moved right to the next
shared shingle without losing any, and from within a run left to its start, as a shared
shingle comes in for each that goes out. Only if that shingle stands in the window
already this may lose one, so there a window starts as well. The SimHash of a window is compared
with the items' by a multi-index: fingerprints are cut into ``BLOCKS`` blocks, and two of
them within ``RADIUS`` bits differ by at most RADIUS // BLOCKS bits in some block, so an
item is posted under every block value within that distance. Whatever shares a posting
and lies within the radius is verified by the exact similarity of the weighted shingles
(the sum of the smaller counts over the sum of the larger ones).

Items are worked on in groups of a bounded number of shingles; what is broadcast has
that bound, whatever the size of the benchmark, and documents are never shuffled.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.session import materialize

WORDS = 5
#: Two fingerprints of 64 bits within RADIUS bits agree in one of the blocks but for three bits.
RADIUS, BLOCKS = 21, 6
#: Shingles of the items that are looked up at once: about 20 MB when broadcast; and items, each with 1280 postings.
GROUP_SHINGLES, GROUP_ITEMS = 200_000, 2000


def words(text: str) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in lower case; one empty word if there are none."""
    return F.split(F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+")


def shingles(words: str, size: int = WORDS) -> Column:
    """The hashes of all runs of ``size`` words of a column, in order; none for a shorter list."""
    run = ", ".join(f"{words}[i + {k}]" for k in range(size))
    return F.expr(f"IF(size({words}) < {size}, array(), transform(sequence(0, size({words}) - {size}), i -> xxhash64({run})))")


def simhash(shingles: Column) -> Column:
    """64 bits; each is 1 if most of the shingles' hashes have it. Repeated shingles weigh as often as they occur."""
    size = F.size(shingles)

    def bit(so_far: Column, i: Column) -> Column:
        ones = F.aggregate(shingles, F.lit(0), lambda n, h: n + F.getbit(h, i).cast("int"))
        return so_far.bitwiseOR(F.when(2 * ones > size, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def block_edges(blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _flipped(value: Column, mask: Column) -> Column:
    return value.bitwiseXOR(mask)


def postings(fingerprint: Column, radius: int = 0) -> Column:
    """(block, value) for every block of a fingerprint, and every value within ``radius`` bits of it."""
    found = []
    for block, (first, bits) in enumerate(block_edges()):
        masks = [sum(1 << k for k in at) for flips in range(radius + 1) for at in combinations(range(bits), flips)]
        own = F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << bits) - 1))
        place = own + (block << 32)  # one number for the block and its value
        found.append(F.transform(F.lit(masks), partial(_flipped, place)))
    return F.flatten(F.array(*found))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two lists of shingles, counting repeats."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    least = F.aggregate(
        F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x))
    )
    return least / (F.size(a) + F.size(b) - least)


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, size, n, item): an item's shingle size (five, or all its words if fewer), count and shingles."""
    cut = benchmark.select("item_id", words("text").alias("w")).filter("w[0] <> ''").distinct()
    lists = F.array(*(shingles("w", size) for size in range(1, WORDS + 1)))
    size = F.least(F.size("w"), F.lit(WORDS))
    items = cut.select("item_id", size.alias("size"), F.element_at(lists, size).alias("item"))
    return items.withColumn("n", F.size("item"))


def windows(documents: DataFrame, places: DataFrame, size: int, text: str) -> DataFrame:
    """(doc_id, start, window) where a run of an item's shingles starts, and where an item with this run would.

    ``places`` (bounded): the items' shingles of this size as (shingle, before, at, n), with
    the shingle before it in the item, its place from 0 and the item's number of shingles.
    """
    hashed = documents.select("doc_id", words(text).alias("w")).select("doc_id", shingles("w", size).alias("all"))
    # The outer form: from the inner one a filter is inferred and pushed down, which works the lists out once more.
    each = hashed.select("doc_id", "all", F.posexplode_outer("all").alias("p", "shingle"))
    met = each.join(F.broadcast(places), "shingle")
    # Only where a run starts: the shingle before is not the item's; or where that shingle comes again in the window.
    starts = (F.col("p") == 0) | F.col("before").isNull() | ~F.expr("all[p - 1]").eqNullSafe(F.col("before"))
    again = F.expr("p > 0 AND array_contains(slice(all, p + 1, n), all[p - 1])")
    met = met.withColumn("run", starts).filter(F.col("run") | again)
    # A window from p has the whole length where the document allows it.
    whole = F.greatest(F.least(F.col("p"), F.size("all") - F.col("n")), F.lit(0))
    aligned = F.when(F.col("run"), F.greatest(F.col("p") - F.col("at"), F.lit(0))).otherwise(whole)
    met = met.select("doc_id", "all", "n", F.explode(F.array_distinct(F.array(whole, aligned))).alias("start"))
    return met.select("doc_id", "start", F.slice("all", F.col("start") + 1, F.col("n")).alias("window"))


def contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, item_id, similarity, start, windows): each document with each item it contains.

    ``similarity`` is that of the best window (``percent`` / 100 or more), ``start`` the
    number of words before the first such window and ``windows`` how many there are.
    Benchmark columns are item_id and text; an item of fewer than five words is one
    shingle of all of them, and items without words are in nothing.

    Null and empty texts contain nothing. Rows with the same doc_id (or a null one) are
    reported as one document. Repeated items with one id count once. Further columns of
    either table play no part. Empty tables give no rows.
    """
    items = materialize(_items(benchmark), "items")
    parts = F.greatest(F.ceil(F.sum("n") / GROUP_SHINGLES), F.ceil(F.count("*") / GROUP_ITEMS))
    sizes = {r["size"]: r["groups"] for r in items.groupBy("size").agg(parts.alias("groups")).collect()}  # five rows at most
    found = None
    for size, groups in sorted(sizes.items()):
        for group in range(groups):
            part = items.filter((F.col("size") == size) & (F.pmod(F.xxhash64("item_id", "item"), F.lit(groups)) == group))
            hits = _group(documents, part, size, text, percent)
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        schema = documents.select("doc_id").schema.simpleString()[7:-1] + ", " + benchmark.select("item_id").schema.simpleString()[7:-1]
        return documents.sparkSession.createDataFrame([], schema.replace(":", " ") + ", similarity double, start int, windows long")
    best = found.groupBy("doc_id", "item_id").agg(
        F.max("similarity").alias("similarity"), F.min("start").alias("start"), F.countDistinct("start").alias("windows")
    )
    return best


def _group(documents: DataFrame, items: DataFrame, size: int, text: str, percent: int) -> DataFrame:
    """The verified (doc_id, item_id, similarity, start) of one group of items with shingles of one size."""
    each = items.select("n", "item", F.posexplode("item").alias("at", "shingle"))
    before = F.when(F.col("at") > 0, F.expr("item[at - 1]"))
    places = each.select("shingle", before.alias("before"), "at", "n").distinct()
    seen = windows(documents, places, size, text).distinct()
    seen = materialize(seen.withColumn("mark", simhash(F.col("window"))), "windows")
    marked = items.withColumn("item_key", F.xxhash64("item_id", "item")).withColumn("item_mark", simhash(F.col("item")))
    posted = marked.select("item_key", "item_mark", F.explode(postings(F.col("item_mark"), RADIUS // BLOCKS)).alias("posting"))
    asked = seen.withColumn("posting", F.explode(postings(F.col("mark"))))
    # As many postings as the items of one group allow: bounded like the shingles.
    near = asked.join(F.broadcast(posted), "posting")
    near = near.filter(F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark"))) <= RADIUS)
    near = near.select("doc_id", "start", "window", "item_key").distinct().join(F.broadcast(marked.select("item_key", "item_id", "item")), "item_key")
    near = near.select("doc_id", "item_id", "start", similarity(F.col("window"), F.col("item")).alias("similarity"))
    return near.filter(F.col("similarity") >= percent / 100)
