"""Random forests and boosted trees for rows that hold few of very many features.

Spark's tree learners keep a number for every row and every feature, so their work grows with the
square of the rows where each row brings a feature of its own. These estimators keep only what rows
hold. They grow the same trees (bins, impurity, stopping, pruning) with the parameters of Spark's
estimators, on all rows, and return Spark's own models. Bins come from all values, not from a sample.

Rows are written once as blocks with the rows of each feature side by side. Each level of all trees
is one job: blocks send the sums of the features they hold, tasks bring the sums of a feature
together and send the best split of each node; the driver holds trees and nothing of the rows.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.session import materialize, scratch_path

# Tasks get this module's code with their work, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 1 << 16
# Numbers of a chunk of class counts that are worked on at once.
CHUNK_CELLS = 1 << 22
# Impurities below this are none, as in Spark.
EPSILON = 2.0**-52

_BLOCKS = "block long, width int, labels binary, features binary, starts binary, rows binary, numbers binary"
_SUMS = "slot int, feature int, bin int, class int, block long, n double, total double, squares double"
_SPLITS = "slot int, gain double, feature int, split int, right array<double>"


@dataclass
class Tree:
    """Nodes level by level, the right child after the left one; a node without children has ``left`` 0."""

    stats: list[np.ndarray] = field(default_factory=list)
    impurity: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    split: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    levels: list[int] = field(default_factory=lambda: [0])

    def add(self, stats: np.ndarray, impurity: float) -> int:
        self.stats.append(stats)
        self.impurity.append(impurity)
        self.gain.append(-1.0)
        for part in (self.feature, self.split, self.left):
            part.append(0)
        return len(self.left) - 1

    def shape(self) -> tuple:
        """What rows need to find their node."""
        return (*(np.array(x, np.int32) for x in (self.feature, self.split, self.left)), list(self.levels))


# --- rows as blocks ----------------------------------------------------------------------


def _encoded(label: list, row: list, index: list, value: list, width: int, number: int) -> pa.RecordBatch:
    y, rows, features, numbers = (np.concatenate(x) for x in (label, row, index, value))
    order = np.argsort(features, kind="stable")
    found, starts = np.unique(features[order], return_index=True)
    cells = [y.astype("f8"), found.astype("i4"), np.append(starts, len(order)).astype("i4"), rows[order].astype("i4"), numbers[order].astype("f8")]
    fields = [pa.array([number], pa.int64()), pa.array([width], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in cells)]
    return pa.RecordBatch.from_arrays(fields, names=["block", "width", "labels", "features", "starts", "rows", "numbers"])


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, parts, held, width = TaskContext.get().partitionId() << 32, ([], [], [], []), 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        vector, y = batch.column("features"), batch.column("label").to_numpy(zero_copy_only=False)
        values, sparse = vector.field("values"), vector.field("type").to_numpy(zero_copy_only=False) == 0
        sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(y)), sizes)
        index = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        index[np.repeat(sparse, sizes)] = vector.field("indices").flatten().to_numpy(zero_copy_only=False)
        width = int(vector.field("size")[0].as_py() if sparse[0] else sizes[0])
        value = values.flatten().to_numpy(zero_copy_only=False)
        some = value != 0
        for part, x in zip(parts, (y, row[some] + held, index[some], value[some]), strict=True):
            part.append(x)
        held += len(y)
        if held >= BLOCK_ROWS:
            yield _encoded(*parts, width, number)
            number, parts, held = number + 1, ([], [], [], []), 0
    if held:
        yield _encoded(*parts, width, number)


class _Block:
    """Rows of a block. Features of ``thresholds`` are held as bins of all rows, others by the rows that hold a 1."""

    def __init__(self, row: dict, thresholds: dict[int, np.ndarray]):
        self.number, self.y = row["block"], np.frombuffer(row["labels"])
        features, starts, rows = (np.frombuffer(row[x], np.int32) for x in ("features", "starts", "rows"))
        numbers, sizes = np.frombuffer(row["numbers"]), np.diff(starts)
        self.bins = {}
        for f, bounds in thresholds.items():
            column, i = np.zeros(len(self.y)), np.searchsorted(features, f)
            if i < len(features) and features[i] == f:
                column[rows[starts[i] : starts[i + 1]]] = numbers[starts[i] : starts[i + 1]]
            self.bins[f] = np.searchsorted(bounds, column, "left")
        plain = ~np.isin(features, list(thresholds))
        self.features, self.rows = features[plain], rows[np.repeat(plain, sizes)]
        self.starts = np.append(0, np.cumsum(sizes[plain]))

    def held(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``features``, row) of every row that holds one of them."""
        if not len(self.features):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        i = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
        some = np.flatnonzero(self.features[i] == features)
        sizes = self.starts[i[some] + 1] - self.starts[i[some]]
        shift = np.repeat(self.starts[i[some]] - (np.cumsum(sizes) - sizes), sizes)
        return np.repeat(some, sizes), self.rows[shift + np.arange(len(shift))]

    def nodes(self, shape: tuple) -> np.ndarray:
        """The node of a tree that each row has come to."""
        feature, split, left, levels = shape
        at = np.zeros(len(self.y), np.int32)
        for first, end in zip(levels, [*levels[1:], len(left)], strict=True):
            inner = first + np.flatnonzero(left[first:end])
            if not len(inner):
                break
            to = np.where((at >= first) & (left[at] > 0), left[at], at)
            for n in inner:
                if feature[n] in self.bins:
                    to[(at == n) & (self.bins[feature[n]] > split[n])] += 1
            places, rows = self.held(feature[inner])
            to[rows[at[rows] == inner[places]]] += 1
            at = to
        return at


def _blocks_of(batches: Iterator[pa.RecordBatch], thresholds: dict[int, np.ndarray]) -> Iterator[_Block]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _Block(row, thresholds)


def _other_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features with a value that is neither 0 nor 1."""
    for batch in batches:
        for row in batch.to_pylist():
            features, sizes = np.frombuffer(row["features"], np.int32), np.diff(np.frombuffer(row["starts"], np.int32))
            found = np.unique(np.repeat(features, sizes)[np.frombuffer(row["numbers"]) != 1])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], names=["feature"])


def _value_counts(numbered: Sequence[int]) -> Callable:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                features, starts = (np.frombuffer(row[x], np.int32) for x in ("features", "starts"))
                numbers, rows = np.frombuffer(row["numbers"]), len(row["labels"]) // 8
                for f in numbered:
                    i = np.searchsorted(features, f)
                    held = numbers[starts[i] : starts[i + 1]] if i < len(features) and features[i] == f else numbers[:0]
                    values, n = np.unique(np.append(held, np.zeros(rows - len(held))), return_counts=True)
                    columns = [pa.array(np.full(len(n), f), pa.int32()), pa.array(values), pa.array(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["feature", "value", "n"])

    return counted


def _walked(values: list, rows: int, splits: int) -> np.ndarray:
    """Thresholds halfway between values where the rows up to there come nearest to the next of ``splits`` even shares."""
    found, stride = [], rows / (splits + 1)
    target = stride
    for a, b in zip(values, values[1:], strict=False):
        if b["nth"] == a["nth"] + 1 and abs(a["upto"] - target) < abs(b["upto"] - target):
            found.append((a["value"] + b["value"]) / 2)
            target += stride
    return np.array(found)


def thresholds_of(blocks: DataFrame, rows: int, bins: int) -> dict[int, np.ndarray]:
    """Spark's thresholds of the features that hold other values than 0 and 1, from all their values.

    Values are sorted and counted up by many tasks; the driver gets those around the even shares.
    """
    numbered = sorted(r["feature"] for r in blocks.mapInArrow(_other_numbers, "feature int").distinct().collect())
    if not numbered:
        return {}
    counts = blocks.mapInArrow(_value_counts(numbered), "feature int, value double, n long").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    parts = counts.repartitionByRange("feature", "value").sortWithinPartitions("feature", "value")
    # The number of a row's part is in the upper bits of its place.
    placed = materialize(parts.withColumn("place", F.monotonically_increasing_id()), "numbers").withColumn("part", F.shiftright("place", 33))
    earlier = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("feature", "part").agg(F.sum("n").alias("size"), F.count("*").alias("values"))
    before = sizes.select("feature", "part", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(x) for x in ("size", "values")], F.sum("values").over(Window.partitionBy("feature")).alias("distinct"))
    here = Window.partitionBy("feature", "part").orderBy("place")
    upto = placed.join(F.broadcast(before), ["feature", "part"]).select(
        "feature", "value", "n", "distinct", (F.col("values") + F.row_number().over(here)).alias("nth"), (F.col("size") + F.sum("n").over(here)).alias("upto")
    )
    upto = materialize(upto, "numbers")
    share = rows / bins
    passed = upto.where((F.col("distinct") > bins) & (F.floor(F.col("upto") / share) > F.floor((F.col("upto") - F.col("n")) / share)))
    # A threshold is next to the value that passes an even share, or follows at once on the threshold before it.
    near = passed.select("feature", F.explode(F.sequence(F.col("nth") - 1, F.col("nth") + bins + 1)).alias("nth")).distinct()
    few = upto.where(F.col("distinct") <= bins).unionByName(upto.join(F.broadcast(near), ["feature", "nth"], "left_semi"))
    held: dict[int, list] = {f: [] for f in numbered}
    for r in few.collect():
        held[r["feature"]].append(r)
    found = {}
    for f, values in held.items():
        values.sort(key=lambda r: r["nth"])
        if values and values[0]["distinct"] <= bins:
            found[f] = np.array([(a["value"] + b["value"]) / 2 for a, b in zip(values, values[1:], strict=False)])
        else:
            found[f] = _walked(values, rows, bins - 1)
    return found


# --- sums and splits ---------------------------------------------------------------------


def _summed(columns: Sequence[np.ndarray], by_block: bool = False) -> list[np.ndarray]:
    """Sums of equal (slot, feature, bin, class), in this order; blocks are added in their order."""
    slot, feature, at, kind, block, *numbers = columns
    order = np.lexsort((block, kind, at, feature, slot) if by_block else (kind, at, slot, feature))
    slot, feature, at, kind, block = (x[order] for x in (slot, feature, at, kind, block))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(slot) != 0) | (np.diff(feature) != 0) | (np.diff(at) != 0) | (np.diff(kind) != 0)
    first = np.flatnonzero(new)
    return [slot[first], feature[first], at[first], kind[first], block[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in numbers)]


def _batch(columns: Sequence[np.ndarray]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 4 + [pa.int64()] + [pa.float64()] * 3
    names = ["slot", "feature", "bin", "class", "block", "n", "total", "squares"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)


def _columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    found = [x for x in batches if x.num_rows]
    return [x.to_numpy() for x in pa.Table.from_batches(found).columns] if found else None


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _columns(batches)
    if found:
        yield _batch(_summed(found, True))


def _sums(level: _Level, root: bool) -> Callable:
    """Blocks to sums of the features of each open node, or to sums of all rows of each tree."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = {} if root else level.chosen()
        for block in _blocks_of(batches, level.thresholds):
            parts = []
            for t, tree in enumerate(level.trees):
                slots = level.slots[t]
                if not (root or (slots >= 0).any()):
                    continue
                weight, kind, number = level.rows_of(block, t)
                open_rows = np.flatnonzero(weight > 0)

                def add(rows, slot, feature, at, weight=weight, kind=kind, number=number, block=block, parts=parts):
                    n = weight[rows]
                    parts.append([slot, feature, at, kind[rows], np.full(len(rows), block.number), n, n * number[rows], n * number[rows] ** 2])

                if root:
                    zero = np.zeros(len(open_rows), np.int32)
                    add(open_rows, zero + t, zero, zero)
                    parts[-1] = _summed(parts[-1])
                    continue
                at = slots[block.nodes(tree)]
                at[weight <= 0] = -1
                if t in chosen:
                    slot, feature = chosen[t]
                    places, rows = block.held(feature)
                    here = at[rows] == slot[places]
                    rows, places = rows[here], places[here]
                    add(rows, slot[places], feature[places], np.ones(len(rows), np.int32))
                    some = np.isin(feature, list(block.bins))
                    numbered = list(zip(slot[some], feature[some], strict=True))
                else:
                    rows = block.rows
                    here = at[rows] >= 0
                    feature = np.repeat(block.features, np.diff(block.starts))[here]
                    add(rows[here], at[rows[here]], feature, np.ones(len(feature), np.int32))
                    numbered = [(None, f) for f in block.bins]
                for s, f in numbered:
                    rows = np.flatnonzero(at >= 0 if s is None else at == s)
                    add(rows, at[rows], np.full(len(rows), f), block.bins[f][rows])
                parts[-1 - len(numbered) :] = [_summed([np.concatenate(x) for x in zip(*parts[-1 - len(numbered) :], strict=True)])]
            if parts:
                yield _batch([np.concatenate(x) for x in zip(*parts, strict=True)])

    return summed


def _gini(stats: np.ndarray) -> np.ndarray:
    n, out = stats.sum(-1), np.ones(stats.shape[:-1])
    for c in range(stats.shape[-1]):
        out -= (stats[..., c] / n) ** 2
    return out


def _variance(stats: np.ndarray) -> np.ndarray:
    n, total, squares = stats[..., 0], stats[..., 1], stats[..., 2]
    return (squares - total * total / n) / n


def _size(stats: np.ndarray, classes: int) -> np.ndarray:
    return stats.sum(-1) if classes else stats[..., 0]


def _best(totals: np.ndarray, classes: int, numbered: Sequence[int], least: int, least_gain: float) -> Callable:
    """Sums to the best split of each node among these features; of equal ones that of the first feature and bin."""
    impurity, width = (_gini, classes) if classes else (_variance, 3)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _columns(batches)
        if not found:
            return
        slot, feature, at, kind, _, *numbers = _summed(found, True)
        new = np.append(True, (np.diff(slot) != 0) | (np.diff(feature) != 0))
        group = np.cumsum(new) - 1
        cells = np.append(True, new[1:] | (np.diff(at) != 0))
        first = np.flatnonzero(cells)
        place, kept = np.cumsum(cells) - 1, []
        step = max(1, CHUNK_CELLS // width)
        begin = 0
        while begin < len(first):
            end = min(begin + step, len(first))
            while end < len(first) and group[first[end]] == group[first[end - 1]]:  # a feature's bins stay together
                end += 1
            some = slice(first[begin], first[end] if end < len(first) else len(slot))
            right = np.zeros((end - begin, width))
            if classes:
                right[place[some] - begin, kind[some]] = numbers[0][some]
            else:
                right[:] = np.stack([x[some] for x in numbers], 1)
            f, s, lower = feature[first[begin:end]], slot[first[begin:end]], at[first[begin:end]] - 1
            g = group[first[begin:end]]
            for x in np.unique(g[np.isin(f, numbered)]):
                i = np.flatnonzero(g == x)
                right[i] = np.cumsum(right[i[::-1]], 0)[::-1]
                lower[i[1:]] = at[first[begin:end]][i[:-1]]  # the first of equal splits: bins between hold no row
            with np.errstate(divide="ignore", invalid="ignore"):
                left, n = totals[s] - right, _size(totals[s], classes)
                a, b = _size(left, classes), _size(right, classes)
                gain = impurity(totals[s]) - a / n * impurity(left) - b / n * impurity(right)
            valid = np.flatnonzero((a >= least) & (b >= least) & (a > 0) & (b > 0) & (gain >= least_gain))
            order = valid[np.lexsort((lower[valid], f[valid], -gain[valid], s[valid]))]
            order = order[np.append(True, np.diff(s[order]) != 0)] if len(order) else order
            kept.append((s[order], gain[order], f[order], lower[order], right[order]))
            begin = end
        s, gain, f, lower, right = (np.concatenate(x) for x in zip(*kept, strict=True))
        rights = pa.ListArray.from_arrays(np.arange(0, len(s) * width + 1, width, dtype=np.int32), pa.array(right.ravel()))
        columns = [pa.array(s, pa.int32()), pa.array(gain), pa.array(f, pa.int32()), pa.array(lower, pa.int32()), rights]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "gain", "feature", "split", "right"])

    return best


# --- growing -----------------------------------------------------------------------------


@dataclass
class _Level:
    """What tasks know of the trees that are grown."""

    thresholds: dict[int, np.ndarray]
    trees: list[tuple]
    # For each tree the slot of each node, -1 if the node is not open.
    slots: list[np.ndarray]
    classes: int
    width: int
    subset: int
    seed: int
    bagged: float | None = None
    # Earlier trees of boosting, with the values of their nodes.
    boosted: list[tuple] = field(default_factory=list)

    def chosen(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """(slot, feature) of the features that the open nodes of each tree choose from; none if they take all."""
        found = {}
        for t, slots in enumerate(self.slots):
            nodes = np.flatnonzero(slots >= 0)
            if self.subset >= self.width or not len(nodes):
                continue
            some = [np.sort(np.random.default_rng([self.seed, 1, t, n]).choice(self.width, self.subset, False, shuffle=False)) for n in nodes]
            found[t] = np.repeat(slots[nodes], self.subset), np.concatenate(some)
        return found

    def rows_of(self, block: _Block, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight, class and number of each row in a tree."""
        rows = len(block.y)
        weight = np.ones(rows) if self.bagged is None else np.random.default_rng([self.seed, 0, t, block.number]).poisson(self.bagged, rows).astype(float)
        if self.classes:
            return weight, block.y.astype(np.int32), np.zeros(rows)
        y = 2 * block.y - 1
        if not self.boosted:
            return weight, np.zeros(rows, np.int32), y
        margin = np.zeros(rows)
        for shape, values in self.boosted:
            margin += values[block.nodes(shape)]
        return weight, np.zeros(rows, np.int32), 4 * y / (1 + np.exp(2 * y * margin))


def _grown(blocks: DataFrame, level: _Level, trees: int, depth: int, least: int, least_gain: float) -> list[Tree]:
    """Trees grown side by side, one job for each level."""
    width, impurity = (level.classes, _gini) if level.classes else (3, _variance)
    grown = [Tree() for _ in range(trees)]
    level.trees, level.slots = [()] * trees, [np.empty(0, np.int32)] * trees
    stats = np.zeros((trees, width))
    sums = blocks.mapInArrow(_sums(level, True), _SUMS)
    if level.classes:
        sums = sums.repartition("slot").mapInArrow(_added, _SUMS)
    # Without classes there is a row for a tree and block, so no exchange, which keeps a thread of the driver for a minute.
    for r in sorted(sums.collect(), key=lambda r: r["block"]):
        if level.classes:
            stats[r["slot"], r["class"]] = r["n"]
        else:
            stats[r["slot"]] += r["n"], r["total"], r["squares"]
    with np.errstate(divide="ignore", invalid="ignore"):
        open_nodes = [(t, tree.add(s, float(i))) for t, (tree, s, i) in enumerate(zip(grown, stats, impurity(stats), strict=True)) if _size(s, level.classes) > 0]
    for d in range(depth):
        if not open_nodes:
            break
        level.trees = [tree.shape() for tree in grown]
        level.slots = [np.full(len(tree.left), -1, np.int32) for tree in grown]
        for slot, (t, n) in enumerate(open_nodes):
            level.slots[t][n] = slot
        totals = np.array([grown[t].stats[n] for t, n in open_nodes])
        sums = blocks.mapInArrow(_sums(level, False), _SUMS).repartition("slot", "feature")
        found = sums.mapInArrow(_best(totals, level.classes, list(level.thresholds), least, least_gain), _SPLITS).collect()
        best = {}
        for r in found:
            order = (-r["gain"], r["feature"], r["split"])
            if r["gain"] > 0 and (r["slot"] not in best or order < best[r["slot"]][0]):
                best[r["slot"]] = order, r
        for tree in grown:
            tree.levels.append(len(tree.left))
        opened = []
        for slot, (_, r) in sorted(best.items()):
            t, n = open_nodes[slot]
            tree, right = grown[t], np.array(r["right"])
            sides = np.array([tree.stats[n] - right, right])
            tree.gain[n], tree.feature[n], tree.split[n], tree.left[n] = r["gain"], r["feature"], r["split"], len(tree.left)
            opened += [(t, tree.add(s, float(i))) for s, i in zip(sides, impurity(sides), strict=True)]
        open_nodes = [(t, n) for t, n in opened if abs(grown[t].impurity[n]) >= EPSILON]
    return grown


def _blocks(estimator, dataset: DataFrame) -> tuple[DataFrame, int, int, int]:
    """The blocks, and the numbers of rows, features and classes."""
    label = F.col(estimator.getLabelCol()).cast("double").alias("label")
    rows = dataset.select(F.unwrap_udt(estimator.getFeaturesCol()).alias("features"), label)
    blocks = materialize(rows.mapInArrow(_to_blocks, _BLOCKS), "blocks")
    facts = blocks.selectExpr("sum(length(labels) DIV 8) AS n", "max(width) AS width").first()
    if not facts["n"]:
        raise ValueError("no rows to learn from")
    named = dataset.select(estimator.getLabelCol()).schema[0].metadata.get("ml_attr", {}).get("vals")
    return blocks, facts["n"], facts["width"], len(named) if named else 1 + int(dataset.agg(F.max(label)).first()[0])


def _loaded(estimator, kind: type, tree_kind: str, dataset: DataFrame, trees: list[Tree], weights: Sequence[float], predict: Callable, thresholds: dict, **facts):
    """Spark's model of these trees, by way of the format that Spark saves models in."""
    spark, path = dataset.sparkSession, scratch_path(dataset.sparkSession, "model")
    classes = facts.get("numClasses", 0)

    def node(tree: Tree, n: int) -> tuple:
        """(prediction, impurity, stats, gain, split, left, right); leaves that say the same are one, as in Spark."""
        prediction, sides, stats = predict(tree.stats[n]), None, tree.stats[n].tolist()
        if tree.left[n]:
            sides = node(tree, tree.left[n]), node(tree, tree.left[n] + 1)
            if sides[0][4] is None and sides[1][4] is None and sides[0][0] == sides[1][0]:
                sides = None
        if not sides:
            return prediction, tree.impurity[n], stats, -1.0, None, None, None
        f = tree.feature[n]
        threshold = float(thresholds[f][tree.split[n]]) if f in thresholds else 0.5
        return prediction, tree.impurity[n], stats, tree.gain[n], (f, [threshold], -1), *sides

    def listed(t: int, top: tuple) -> list[tuple]:
        out: list = []

        def walk(x: tuple) -> int:
            i = len(out)
            out.append(None)
            left, right = (walk(x[5]), walk(x[6])) if x[4] else (-1, -1)
            out[i] = (t, (i, x[0], x[1], x[2], int(sum(x[2]) if classes else x[2][0]), x[3], left, right, x[4] or (-1, [], -1)))
            return i

        walk(top)
        return out

    nodes = "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: long, gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
    params = {p.name: v for p, v in estimator.extractParamMap().items()}
    head = {"timestamp": 0, "sparkVersion": spark.version, "defaultParamMap": {}}
    about = head | {"class": f"org.apache.spark.ml.classification.{kind.__name__}", "uid": estimator.uid, "paramMap": params, "numFeatures": facts["numFeatures"], "numTrees": len(trees)} | facts
    each = json.dumps(head | {"class": f"org.apache.spark.ml.{tree_kind}", "uid": f"{estimator.uid}_tree", "paramMap": {}})
    rows = [x for t, tree in enumerate(trees) for x in listed(t, node(tree, 0))]
    spark.createDataFrame(rows, nodes).coalesce(1).write.parquet(f"{path}/data")
    spark.createDataFrame([(t, each, float(w)) for t, w in enumerate(weights)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return kind.load(path)


class SparseForestClassifier(RandomForestClassifier):
    """Spark's random forest, grown on what rows hold; rows and features of a tree are drawn by seed, tree, node and block."""

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        blocks, rows, width, classes = _blocks(self, dataset)
        trees, strategy = self.getNumTrees(), self.getFeatureSubsetStrategy()
        strategy = ("sqrt" if trees > 1 else "all") if strategy == "auto" else strategy
        subset = {"all": width, "sqrt": math.ceil(math.sqrt(width))}[strategy]
        thresholds = thresholds_of(blocks, rows, min(self.getMaxBins(), rows))
        bagged = self.getSubsamplingRate() if self.getBootstrap() else None
        level = _Level(thresholds, [], [], classes, width, subset, self.getSeed() % 2**63, bagged)
        grown = _grown(blocks, level, trees, self.getMaxDepth(), self.getMinInstancesPerNode(), self.getMinInfoGain())
        return _loaded(
            self, RandomForestClassificationModel, "classification.DecisionTreeClassificationModel", dataset, grown, [1.0] * trees,
            lambda stats: float(np.argmax(stats)), thresholds, numFeatures=width, numClasses=classes,
        )


class SparseBoostedClassifier(GBTClassifier):
    """Spark's boosted trees for two classes, grown on what rows hold."""

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        blocks, rows, width, _ = _blocks(self, dataset)
        thresholds = thresholds_of(blocks, rows, min(self.getMaxBins(), rows))
        level, trees, weights = _Level(thresholds, [], [], 0, width, width, self.getSeed() % 2**63), [], []
        for m in range(self.getMaxIter()):
            trees += _grown(blocks, level, 1, self.getMaxDepth(), self.getMinInstancesPerNode(), self.getMinInfoGain())
            weights.append(self.getStepSize() if m else 1.0)
            values = np.array([s[1] / s[0] for s in trees[-1].stats])
            level.boosted = [*level.boosted, (trees[-1].shape(), weights[-1] * values)]
        return _loaded(
            self, GBTClassificationModel, "regression.DecisionTreeRegressionModel", dataset, trees, weights,
            lambda stats: float(stats[1] / stats[0]), thresholds, numFeatures=width,
        )
