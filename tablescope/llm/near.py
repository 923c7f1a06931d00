"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidates.

One hash per shingle fills ``BINS`` bins with the smallest hash that falls into each; an
empty bin borrows from a bin drawn by a hash of its number until a full one is met
(optimal densification). ``ROWS`` bins make a band, and documents that agree in a band
share a bucket. A bucket of any size gives a star: its smallest document with each of the
others. Candidates are confirmed on their full shingle sets.

A star may miss a link between two of its points when neither links with the centre.
So the documents of buckets that are not one component by then get exact buckets: the
rarest shingles of each, chosen such that two sets that link must share one. These make
stars again, with more centres each time, until what is left of every bucket is one
component or has been compared; no bucket is capped and nothing is compared within a confirmed component.

A node is a text: equal texts are one node, so large groups of copies cost one comparison,
and different texts are different nodes, also under one doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tablescope.llm.names import spare
from tablescope.llm.shingles import BASE, shingle_sets
from tablescope.llm.utf8 import blocks, column_bytes, mix
from tablescope.session import materialize

#: A pair at similarity 0.75 shares a band with a probability of 1 - 5e-6.
BINS, ROWS = 128, 4
#: Donors that an empty bin asks, in this order; the first full bin of all if none of them is.
DONORS = np.random.default_rng(17).integers(0, BINS, (BINS, 512))
#: A node below this is the smallest doc_id of its text; above are numbered those of further texts of a doc_id and of no doc_id.
NAMELESS = 1 << 62
#: Parts into which the rows of one component are dealt when its smallest doc_id is looked up.
SALTS = 64


def signature(shingles: np.ndarray) -> np.ndarray:
    """The bins of a non-empty sorted set of hashes. The first bits of a hash are its bin."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    first = np.searchsorted(shingles, edges)
    end = np.append(first[1:], len(shingles))
    full = end > first
    values = shingles[np.minimum(first, len(shingles) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        met = full[DONORS[empty]]
        donor = DONORS[empty, met.argmax(1)]
        values[empty] = values[np.where(met.any(1), donor, full.argmax())]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    parts = values.reshape(-1, ROWS)
    out = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * BASE + parts[:, k])
    return out.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.int64)
    for batch in batches:
        data, offsets = column_bytes(batch.column(2))
        for row, own, starts in blocks(data, offsets):
            sets = shingle_sets(own, starts)
            part = batch.slice(row, len(sets))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            marks = _lists([bands(signature(s)) if len(s) else none for s in sets])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sizes, marks], ["doc_id", "key", "n_shingles", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for row, own, starts in blocks(data, offsets):
            sets = shingle_sets(own, starts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), _lists(sets)], ["node", "shingles"])


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of (centre, node) whose sets have 100 * intersection >= percent * union."""
    own = sets.select(F.col("node"), F.col("shingles").alias("mine"))
    other = sets.select(F.col("node").alias("centre"), F.col("shingles").alias("theirs"))
    both = edges.join(own, "node").join(other, "centre")
    shared = F.size(F.array_intersect("mine", "theirs"))
    return both.filter(100 * shared >= percent * (F.size("mine") + F.size("theirs") - shared)).select("centre", "node")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``edges`` (centre, node), for every node in an edge.

    Each round a node takes the smallest label around it, then its label's own label, so
    the rounds grow with the logarithm of the longest path.
    """
    both = materialize(edges.unionByName(edges.select(F.col("node").alias("centre"), F.col("centre").alias("node"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("centre").alias("node")).agg(F.least(F.first("centre"), F.min("node")).alias("label")), "labels")
    while True:
        near = both.join(labels, "node").groupBy(F.col("centre").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("next"))
        target = labels.select(F.col("node").alias("next"), F.col("label").alias("further"))
        step = materialize(step.join(target, "next").select("node", "old", F.least("next", "further").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return labels


def _labelled(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return nodes.withColumn("label", F.col("node"))
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _apart(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Those of (node, band) whose bucket holds more than one component."""
    known = _labelled(members.select("node", "band"), labels)
    mixed = known.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return known.join(mixed.select("band"), "band").select("node", "band")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Exact buckets (node, band, size, left, small) of some nodes: two sets that link share a shingle of their prefixes.

    With shingles ordered from the rarest among these nodes, a set of n has its first
    n - ceil(t * n) + 1 shingles as its prefix, t being the similarity; ``small`` marks the
    first n - ceil(2 * t / (1 + t) * n) + 1, which are enough for the smaller set of a pair.
    Lines that many documents share come last in that order, so they hardly bring any two
    documents together. ``left`` counts the shingles from this one on: no more than these
    can be shared if this is the first one that is.
    """
    each = sets.select("node", F.explode("shingles").alias("band"))
    often = each.groupBy("band").agg(F.count("*").alias("n"))
    ranked = each.join(often, "band").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "band"))).alias("order"))
    size = F.size("order")
    up = lambda over, under: F.floor((over * size + under - 1) / under).cast("int")
    prefix, short = size - up(percent, 100) + 1, size - up(2 * percent, 100 + percent) + 1
    placed = ranked.select("node", size.alias("size"), short.alias("short"), F.posexplode(F.slice("order", F.lit(1), prefix)).alias("at", "best"))
    return placed.filter("best.n > 1").select(
        "node", F.col("best.band").alias("band"), "size", (F.col("size") - F.col("at")).alias("left"), (F.col("at") < F.col("short")).alias("small")
    )


class _Found:
    """The confirmed links so far and the components they make."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def confirm(self, edges: DataFrame) -> None:
        """Add the links among some pairs (centre, node) of different components."""
        new = materialize(_confirmed(edges.distinct(), self.sets, self.percent), "found")
        if not new.isEmpty():
            self.links = new if self.links is None else self.links.unionByName(new)
            self.labels = components(self.links)

    def stars(self, members: DataFrame) -> DataFrame:
        """Compare the smallest node of each bucket (node, band) with the others, and return the members without it."""
        smallest = members.groupBy("band").agg(F.min("node").alias("centre"))
        points = members.join(smallest, "band").filter("node <> centre")
        self.confirm(points.select("centre", "node"))
        return points.select("node", "band")

    def open_buckets(self, buckets: DataFrame) -> DataFrame:
        """The exact buckets that hold more than one component and a set not yet compared as the smaller one."""
        known = _labelled(buckets.drop("label"), self.labels)
        mixed = known.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count_if("small").alias("open"))
        return known.join(mixed.filter("low < high AND open > 0").select("band", "open"), "band")

    def prefix_stars(self, buckets: DataFrame, centres: int) -> DataFrame:
        """Compare about ``centres`` sets of each bucket as the smaller one with all that may link with it."""
        drawn = F.col("small") & (F.pmod(F.xxhash64("node", "band"), F.lit(1 << 20)) * F.col("open") <= centres << 20)
        buckets = buckets.withColumn("is_centre", drawn)
        other = buckets.drop("open", "is_centre", "small").withColumnsRenamed({"node": "other", "size": "other_size", "left": "other_left", "label": "other_label"})
        pairs = buckets.filter("is_centre").join(other, "band").filter("label <> other_label AND size <= other_size")
        # Sizes too far apart, or too few shingles left to share.
        pairs = pairs.filter(100 * F.col("size") >= self.percent * F.col("other_size"))
        most = F.least("left", "other_left")
        pairs = pairs.filter((100 + self.percent) * most >= self.percent * (F.col("size") + F.col("other_size")))
        self.confirm(pairs.select(F.least("node", "other").alias("centre"), F.greatest("node", "other").alias("node")))
        return buckets.withColumn("small", F.col("small") & ~F.col("is_centre")).drop("open", "is_centre")


def _key(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _texts(sketches: DataFrame) -> DataFrame:
    """(key, low, n_shingles, node) for every text, ``low`` being its smallest doc_id. The first text of a doc_id has it as its node."""
    texts = sketches.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("n_shingles").alias("n_shingles"))
    first = texts.filter(F.col("low") < NAMELESS).groupBy("low").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    numbered = texts.join(first, ["low", "key"], "left").withColumn("n", F.monotonically_increasing_id())
    node = F.when(F.col("first"), F.col("low")).otherwise(F.col("n").bitwiseOR(F.lit(NAMELESS)))
    return materialize(numbered.select("key", "low", "n_shingles", node.alias("node")), "texts")


def _nodes(documents: DataFrame, text: str, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, key, n_shingles, node, low, label) for every row, and (label, least) of components with numbered nodes.

    Rows of one component have one label. Its smallest doc_id is the smallest of label (below
    NAMELESS), least and low.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = documents.select(F.col("doc_id").cast("long"), _key(text).alias("key"), body.alias("text"))
    sketches = materialize(keyed.mapInArrow(_sketches, "doc_id long, key binary, n_shingles long, bands array<long>"), "sketches")

    texts = _texts(sketches)
    named = sketches.join(texts.select("key", "low", "node"), "key")
    # Equal texts have equal bands: their buckets hold one node, which the first count drops.
    members = named.filter("n_shingles > 0").select("node", F.explode("bands").alias("band")).distinct()
    crowded = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    members = materialize(members.join(crowded, "band"), "members")

    wanted = members.select("node").distinct()
    nodes = texts.filter("n_shingles > 0").join(wanted, "node", "left_semi").select("node", "low", F.col("key").alias("own"))
    # Joined by the text's smallest doc_id as well, so copies of a text don't meet.
    own = keyed.join(nodes, F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("key") == F.col("own")))
    once = own.groupBy("node").agg(F.min("text").alias("text"))
    sets = materialize(once.mapInArrow(_sets, "node long, shingles array<long>"), "sets")

    # One star for each bucket. What stays apart in a bucket without its centre goes on to exact buckets.
    found = _Found(sets, percent)
    members = found.stars(members)
    rest = _apart(members, found.labels).select("node").distinct()
    buckets, centres = _prefixes(sets.join(rest, "node", "left_semi"), percent), 4
    while True:
        buckets = materialize(found.open_buckets(buckets), "prefixes")
        if buckets.isEmpty():
            break
        buckets, centres = found.prefix_stars(buckets, centres), 8 * centres
    least = None
    if found.labels is not None:
        numbered = texts.filter((F.col("node") >= NAMELESS) & F.col("low").isNotNull()).join(found.labels, "node")
        least = numbered.groupBy("label").agg(F.min("low").alias("least"))
    return _labelled(named.select("doc_id", "key", "n_shingles", "node", "low"), found.labels), least


def near_duplicates(documents: DataFrame, text: str = "text", percent: int = 75) -> DataFrame:
    """One row (doc_id, text_md5, n_shingles, component_id, kept) per row of ``documents``.

    Documents with a similarity of ``percent`` or more are linked; ``component_id`` is the
    smallest doc_id reachable over links and equal texts, and ``kept`` marks the
    rows whose doc_id it is. ``text_md5`` is that of the text, or of '' for a null text.

    Null and empty texts, and texts without words, have no shingles and are linked with
    nothing. A component in which no doc_id is known has a null ``component_id`` and its
    rows are kept. Different texts under one doc_id are told apart: every row goes by its own
    text, so a doc_id may stand in several components, be kept for one text and not for
    another, and unlike texts have one ``component_id`` only if the same doc_id is the smallest of
    both. Repeated rows are all returned. Other columns play no part. An empty table gives no rows.
    """
    rows, least = _nodes(documents, text, percent)
    lowest = [F.when(F.col("label") < NAMELESS, F.col("label")), F.col("low")]
    if least is not None and not (least := materialize(least, "least")).isEmpty():
        # A large component is dealt out by its rows.
        salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["label", "salt"], "left")
        lowest.append(F.col("least"))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.least(*lowest))
    return rows.select(
        "doc_id", F.lower(F.hex("key")).alias("text_md5"), "n_shingles",
        component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def keep_one(documents: DataFrame, text: str = "text", percent: int = 75) -> DataFrame:
    """``documents`` with one row of each component of near-duplicates: the one of the smallest doc_id.

    If no doc_id is known or several rows share it, the smallest MD5 of the text decides; of
    rows equal in both the one with the smallest hash of all columns stays. Rows without words are no duplicates of anything and all
    stay, and different texts of one doc_id are duplicates only if they are linked. All columns are kept.
    """
    wordless = F.coalesce(F.col(text), F.lit("")).rlike("^[\\x20\\x09-\\x0D]*$")
    found = _nodes(documents, text, percent)[0].filter("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")
    best = found.groupBy("label").agg(F.min(order).alias("best")).select("best.doc_id", "best.key")
    node, digest = spare(documents, "node", "digest")
    best = best.select(F.col("doc_id").alias(node), F.col("key").alias(digest))
    # Repeated rows go before the exchange; the join then finds the rows where they are.
    keyed = documents.filter(~wordless).withColumn(node, F.col("doc_id").cast("long")).withColumn(digest, _key(text))
    told = [F.col(f"`{f.name}`") for f in documents.schema if not isinstance(f.dataType, MapType)]  # maps have no hash
    once = keyed.groupBy(node, digest).agg(F.min_by(F.struct(*documents.columns), F.xxhash64(*told)).alias("row"))
    same = once[node].eqNullSafe(best[node]) & (once[digest] == best[digest])
    return once.join(best, same, "left_semi").select("row.*").unionByName(documents.filter(wordless))
