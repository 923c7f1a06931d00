"""LM scoring by cross-entropy difference.

A bigram model of the target documents and one of all documents share a vocabulary: all
words of the corpus. Both have the same form: absolute discounting, what is discounted
going to a unigram model with add-one smoothing. A document's score is the mean over its
words of the loss under the target model less the loss under the background model: the
lower, the more the document is like the target.

Words and bigrams are counted over all documents, and none is left out; what is gathered
grows with the corpus. Bigrams move once, as compressed blocks: all with the same word
before go to one range, where they are counted, settled and summed for each row. What a
range can't know, how often its words occur, is counted in an earlier pass, which notes the
ranges that ask, so uncommon words are sent to these alone. A sample of all words names the
common ones (bounded lists). It only decides how counts travel, never what they are:

* counts of common words are known to all tasks;
* followers of a word that would fill more than a range are dealt to several ranges, and
  its counts come from the earlier pass;
* bigrams that alone would fill much of a range are counted in the earlier pass, and settled
  where they are met.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.shingles import BASE, word_hashes
from tablescope.llm.utf8 import blocks, column_bytes, mix
from tablescope.session import materialize

DISCOUNT = 0.75
#: What stands before a first word, and the one word that stands for all outside a vocabulary of a given size.
START, UNKNOWN = 0, 1
#: One word in so many is in the sample.
SAMPLE = 64
#: The most words that are known to all tasks, words whose followers are dealt to several ranges, bigrams settled where they are met.
COMMON_WORDS, COMMON_BEFORES, COMMON_PAIRS = 1 << 16, 1 << 13, 1 << 13
#: Bigrams of a range, about; a bigram of an eighth of that is common.
RANGE = 1 << 21
#: Words that a task gathers before it sends them on, and bigrams whose losses are computed at once.
PENDING, STEP = 1 << 20, 1 << 17
#: Codes of words: places among the common words, or hashes with this bit. Common bigrams have codes between.
UNCOMMON, PAIRS = np.uint64(1 << 63), 1 << 40
#: As many ids of targets are broadcast at most (8 bytes each for integers); more are joined by their keys, once.
FEW_TARGETS = 1 << 20
#: Rows whose sums come together, about, as a power of two.
GROUP_BITS = 14
#: The range of counts that no range asks for.
NOWHERE = -1


def _words(column: pa.Array, known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words, the word before each, for every row the index of its first word) of runs of rows."""
    data, offsets = column_bytes(column)
    for row, own, starts in blocks(data, offsets):
        words, first = word_hashes(own, starts)
        if known is not None:
            place = np.searchsorted(known, words).clip(max=max(len(known) - 1, 0))
            words = np.where(known[place] == words, words, np.uint64(UNKNOWN)) if len(known) else np.full_like(words, UNKNOWN)
        before = np.append(np.uint64(START), words[:-1])[: len(words)]
        before[first[:-1][first[:-1] < first[1:]]] = START
        yield row, words, before, first


def _pairs(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(mix(before * BASE) + words)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [words for _, words, _, _ in _words(batch.column(0))]
        words, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])


def vocabulary(documents: DataFrame, size: int) -> np.ndarray:
    """The sorted hashes of the ``size`` most frequent words of all documents (text), ties to the smaller hash."""
    counts = documents.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    best = counts.orderBy(F.desc("n"), "word").limit(size).collect()
    return np.sort(np.array([row["word"] for row in best], np.int64).view(np.uint64))


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key is among the sorted keys, -1 for those that are not there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted).clip(max=len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass(frozen=True)
class Common:
    """What the sample found to be common, and the ranges that follow from it."""

    #: Hashes of words, codes of words before, and keys of bigrams (of codes), each sorted; both codes of those bigrams.
    words: np.ndarray
    befores: np.ndarray
    pairs: np.ndarray
    pair_codes: np.ndarray
    #: The number of ranges for all words before but the common ones; the first range and number of ranges of those.
    ranges: int
    first: np.ndarray
    parts: np.ndarray

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        at = _place(self.words, hashes)
        return np.where(at >= 0, at.astype(np.uint64), hashes | UNCOMMON)

    def dealt(self, before: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The range of each bigram (of codes)."""
        at = _place(self.befores, before)
        ranges = (mix(before + np.uint64(1)) % np.uint64(self.ranges)).astype(np.int64)
        met = np.flatnonzero(at >= 0)
        ranges[met] = self.first[at[met]] + (mix(words[met] * BASE) % self.parts[at[met]].astype(np.uint64)).astype(np.int64)
        return ranges


def _sampled(documents: DataFrame, known: np.ndarray | None, sample: int) -> DataFrame:
    """(before, word, n, t) of the sampled words of (text, is_target), and rows without words that hold the numbers of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            flags, kept, targets, begun = batch.column(1).to_numpy(zero_copy_only=False), [], 0, seen
            for row, words, before, first in _words(batch.column(0), known):
                n = np.diff(first)
                targets += int(n[flags[row : row + len(n)]].sum())
                chosen = mix(np.arange(seen, seen + len(words), dtype=np.uint64) * BASE) % np.uint64(sample) == 0
                kept.append((before[chosen], words[chosen]))
                seen += len(words)
            before, words = map(np.concatenate, zip(*kept)) if kept else (np.zeros(0, np.uint64),) * 2
            _, at, n = np.unique(_pairs(before, words), return_index=True, return_counts=True)
            numbers = [pa.array(x.view(np.int64)) for x in (before[at], words[at])] + [pa.array(n.astype(np.int64)), pa.nulls(len(at), pa.int64())]
            yield pa.RecordBatch.from_arrays(numbers, ["before", "word", "n", "t"])
            every = [pa.array([x], pa.int64()) for x in (None, None, seen - begun, targets)]
            yield pa.RecordBatch.from_arrays(every, ["before", "word", "n", "t"])

    found = documents.select("text", "is_target").mapInArrow(run, "before long, word long, n long, t long")
    return found.groupBy("before", "word").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def common(documents: DataFrame, known: np.ndarray | None = None, sample: int = SAMPLE, size: int = RANGE) -> tuple[Common, int, int]:
    """What is common in documents (text, is_target), the number of their words, and that of the targets' words."""
    found = materialize(_sampled(documents, known, sample), "sample")
    total = found.filter("word IS NULL").first()
    every, targets = (total["n"], total["t"]) if total else (0, 0)
    counted = found.filter("word IS NOT NULL")

    def most(keys: list[str], least: float, limit: int) -> tuple[list[np.ndarray], np.ndarray]:
        best = counted.groupBy(*keys).agg(F.sum("n").alias("n")).filter(F.col("n") * sample > least).orderBy(F.desc("n"), *keys).limit(limit).toArrow()
        return [best[k].to_numpy().view(np.uint64) for k in keys], best["n"].to_numpy() * sample

    (pair_before, pair_word), _ = most(["before", "word"], size / 8, COMMON_PAIRS)
    (befores,), n = most(["before"], size / 2, COMMON_BEFORES)
    (words,), _ = most(["word"], 2 * sample, COMMON_WORDS - COMMON_PAIRS)
    # A common bigram's words are common, so that all it takes to settle it is known.
    words = np.union1d(words, pair_word)
    none = np.zeros(0, np.uint64)
    codes = Common(words, none, none, none, 1, none, none).codes
    pair_codes = np.stack([codes(pair_before), codes(pair_word)])
    pairs, order = np.unique(_pairs(*pair_codes), return_index=True)
    befores, at = np.unique(np.concatenate([codes(befores), pair_codes[0]]), return_index=True)
    parts = np.ceil(np.concatenate([n, np.zeros(len(pair_before))])[at] / size).astype(np.int64).clip(min=1)
    ranges = max(1, -(-every // size))
    first = ranges + np.cumsum(parts) - parts
    return Common(words, befores, pairs, pair_codes[:, order], ranges, first, parts), every, targets


def word_counts(documents: DataFrame, plan: Common, known: np.ndarray | None = None) -> DataFrame:
    """(word, t, a, parts) for the codes of all words of (text, is_target) and of common bigrams.

    ``parts`` has (range, t, a) for every range that needs the counts of an uncommon word.
    """

    def counted(pending: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        words, ranges, target = map(np.concatenate, zip(*pending))
        _, at, own, n = np.unique(_pairs(words, ranges.astype(np.uint64)), return_index=True, return_inverse=True, return_counts=True)
        columns = [words[at].view(np.int64), ranges[at], np.bincount(own, target, len(at)).astype(np.int64), n.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["word", "range", "t", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = [], 0
        for batch in batches:
            flags = batch.column(1).to_numpy(zero_copy_only=False)
            for row, words, before, first in _words(batch.column(0), known):
                target = np.repeat(flags[row : row + len(first) - 1], np.diff(first))
                words, before = plan.codes(words), plan.codes(before)
                ranges = plan.dealt(before, words)
                pending.append((words, np.where(words < UNCOMMON, NOWHERE, ranges), target))
                pair = _place(plan.pairs, _pairs(before, words))
                met = pair >= 0
                pending.append(((pair[met] + PAIRS).astype(np.uint64), np.full(met.sum(), NOWHERE), target[met]))
                size += len(words)
                if size >= PENDING:
                    yield counted(pending)
                    pending, size = [], 0
        if size:
            yield counted(pending)

    cells = documents.select("text", "is_target").mapInArrow(run, "word long, range long, t long, a long").repartition("word")
    cells = cells.groupBy("word", "range").agg(F.sum("t").alias("t"), F.sum("a").alias("a"))
    parts = F.collect_list(F.struct("range", "t", "a")).alias("parts")
    return cells.groupBy("word").agg(F.sum("t").alias("t"), F.sum("a").alias("a"), parts)


def common_followers(documents: DataFrame, plan: Common, known: np.ndarray | None = None) -> DataFrame:
    """(place, t, a, kinds_t, kinds_a) of the common words before, by place among them: bigrams with common words, and different ones.

    A task marks followers in bits, one row for each word before, so what moves is bounded by
    tasks and never by words; bits are united in two steps.
    """
    width, columns = len(plan.words), "place long, part int, t long, a long, bits binary"

    def one(place: int, part: int, sums: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
        values = [[place], [part], [int(sums[0])], [int(sums[1])], [pa.compress(np.packbits(met).tobytes(), "zstd", asbytes=True)]]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["place", "part", "t", "a", "bits"])

    def marked(keys: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
        # A key is a place, a follower and whether it is in a target document.
        keys, n = np.unique(keys, return_counts=True)
        places = keys // (2 * width)
        bounds = np.append(_runs(places), len(keys))
        for low, high in zip(bounds[:-1], bounds[1:]):
            word, target, of = (keys[low:high] >> 1) % width, (keys[low:high] & 1).astype(bool), n[low:high]
            met = np.zeros((2, width), bool)
            met[1, word] = met[0, word[target]] = True
            yield one(int(places[low]), part, np.array([of[target].sum(), of.sum()]), met)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size, part = [], 0, 0
        for batch in batches:
            flags, part = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)[0].as_py() if len(batch) else part
            for row, words, before, first in _words(batch.column(0), known):
                target = np.repeat(flags[row : row + len(first) - 1], np.diff(first))
                words, place = plan.codes(words), _place(plan.befores, plan.codes(before))
                chosen = np.flatnonzero((place >= 0) & (words < UNCOMMON))
                pending.append(2 * (place[chosen] * width + words[chosen].astype(np.int64)) + target[chosen])
                size += len(chosen)
                if size >= 2 * PENDING:
                    yield from marked(np.concatenate(pending), part)
                    pending, size = [], 0
        if size:
            yield from marked(np.concatenate(pending), part)

    def united(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        raw, met = 2 * width, np.zeros(2 * width, bool)
        for bits in found["bits"]:
            data = pa.decompress(bits.as_py(), -(-raw // 8), "zstd", asbytes=True)
            met |= np.unpackbits(np.frombuffer(data, np.uint8), count=raw).astype(bool)
        return np.array([pc.sum(found[c]).as_py() for c in ("t", "a")]), met.reshape(2, width)

    def first_step(found: pa.Table) -> pa.Table:
        return pa.Table.from_batches([one(found["place"][0].as_py(), 0, *united(found))])

    def last_step(found: pa.Table) -> pa.Table:
        sums, met = united(found)
        numbers = [found["place"][0].as_py(), *sums, *met.sum(axis=1)]
        return pa.Table.from_arrays([pa.array([int(x)]) for x in numbers], ["place", "t", "a", "kinds_t", "kinds_a"])

    part = F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")
    found = documents.select("text", "is_target", part).mapInArrow(run, columns)
    found = found.groupBy("place", "part").applyInArrow(first_step, columns)
    return found.groupBy("place").applyInArrow(last_step, "place long, t long, a long, kinds_t long, kinds_a long")


#: The arrays of a block of words, and of a block of bigrams: words before and their numbers of followers; which followers are
#: common, the common and the other followers, their numbers of rows; rows (twice the place, one more for targets) and counts.
#: Of a block of sums: the rows' places in their group and both losses, which travel in single precision.
WORD_BLOCK, PAIR_BLOCK, SUM_BLOCK = ("u8", "u8", "u8"), ("u8", "u4", "u1", "u2", "u8", "u4", "u4", "u4"), ("u2", "f4", "f4")


def _packed(arrays: list[np.ndarray], kinds: tuple[str, ...]) -> bytes:
    """Arrays as one compressed string, the bytes of equal weight side by side."""
    sides = [np.ascontiguousarray(a.astype(k)).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a, k in zip(arrays, kinds)]
    data = b"".join([np.array([len(a) for a in arrays], "u8").tobytes(), *sides])
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(block: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    data = np.frombuffer(pa.decompress(block[8:], int.from_bytes(block[:8], "little"), "zstd", asbytes=True), np.uint8)
    lengths, low, arrays = data[: 8 * len(kinds)].view("u8"), 8 * len(kinds), []
    for n, kind in zip(lengths.astype(int), kinds):
        width = np.dtype(kind).itemsize
        arrays.append(np.ascontiguousarray(data[low : low + n * width].reshape(width, n).T).view(kind).reshape(n))
        low += n * width
    return arrays


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins in sorted columns."""
    new = np.ones(len(sorted_columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in sorted_columns], axis=0)
    return np.flatnonzero(new)


def _pair_blocks(ranges: np.ndarray, before: np.ndarray, words: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(range, block) of bigrams of rows in ascending order."""
    order = np.lexsort((words, before, ranges))  # stable: rows stay in order
    ranges, before, words, rows = (x[order] for x in (ranges, before, words, rows))
    at = _runs(ranges, before, words, rows)
    counts = np.diff(np.append(at, len(rows)))
    ranges, before, words, rows = (x[at] for x in (ranges, before, words, rows))
    bounds = np.append(_runs(ranges), len(ranges))
    for low, high in zip(bounds[:-1], bounds[1:]):
        b, w = before[low:high], words[low:high]
        pair = _runs(b, w)
        own, followers = b[pair], w[pair]
        begin, near = _runs(own), followers < UNCOMMON
        numbers = [np.diff(np.append(begin, len(own))), np.packbits(near), followers[near], followers[~near]]
        arrays = [own[begin], *numbers, np.diff(np.append(pair, high - low)), rows[low:high], counts[low:high]]
        yield int(ranges[low]), _packed(arrays, PAIR_BLOCK)


def _pairs_of(block: bytes) -> tuple[np.ndarray, ...]:
    """(before, word, number of rows) of the bigrams of a block, and (row, count) of all their rows."""
    own, kinds, near, common_words, others, sizes, rows, counts = _unpacked(block, PAIR_BLOCK)
    near = np.unpackbits(near, count=len(sizes)).astype(bool)
    words = np.empty(len(sizes), np.uint64)
    words[near], words[~near] = common_words, others
    return np.repeat(own, kinds), words, sizes, rows, counts


def _word_blocks(words: DataFrame) -> DataFrame:
    """(range, block) of uncommon words (range, word, t, a)."""

    def packed(pending: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(pending).sort_by([("range", "ascending"), ("word", "ascending")])
        ranges, *columns = (table[c].to_numpy() for c in ("range", "word", "t", "a"))
        bounds = np.append(_runs(ranges), len(ranges))
        found = [_packed([c[low:high].view(np.uint64) for c in columns], WORD_BLOCK) for low, high in zip(bounds[:-1], bounds[1:])]
        return pa.RecordBatch.from_arrays([pa.array(ranges[bounds[:-1]]), pa.array(found, pa.binary())], ["range", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = [], 0
        for batch in batches:
            pending.append(batch)
            size += len(batch)
            if size >= PENDING:
                yield packed(pending)
                pending, size = [], 0
        if size:
            yield packed(pending)

    return words.select("range", "word", "t", "a").mapInArrow(run, "range long, block binary")


@dataclass(frozen=True)
class Model:
    """Numbers known to all tasks: of all words, of common words and words before, and the losses of common bigrams."""

    sums: tuple[int, int]
    vocabulary: int
    words: np.ndarray
    befores: np.ndarray
    pairs: np.ndarray | None = None

    def losses(self, counts: np.ndarray, befores: np.ndarray, kinds: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Both models' losses of bigrams; all arguments have a row for each model."""
        low = (words + 1) / (np.array(self.sums, float)[:, None] + self.vocabulary + 2)
        of = np.maximum(befores, 1)
        seen = np.maximum(counts - DISCOUNT, 0) / of + DISCOUNT * kinds / of * low
        return -np.log(np.where(befores > 0, seen, low))


def _model(documents: DataFrame, words: DataFrame, plan: Common, sums: tuple[int, int], known: np.ndarray | None) -> Model:
    def table(rows: DataFrame, key: str, columns: list[str], size: int) -> np.ndarray:
        found, out = rows.toArrow(), np.zeros((len(columns), size))
        for i, c in enumerate(columns):
            out[i, found[key].to_numpy()] = found[c].to_numpy()
        return out

    near = table(words.filter((F.col("word") >= 0) & (F.col("word") < PAIRS)).select("word", "t", "a"), "word", ["t", "a"], len(plan.words))
    pairs = words.filter(F.col("word") >= PAIRS).select((F.col("word") - PAIRS).alias("word"), "t", "a")
    pairs = table(pairs, "word", ["t", "a"], len(plan.pairs))
    vocabulary = words.filter(F.col("word") < PAIRS).count() if known is None else len(known)
    befores = np.zeros((4, len(plan.befores)))
    if len(plan.befores):
        columns = ["t", "a", "kinds_t", "kinds_a"]
        befores = table(common_followers(documents, plan, known), "place", columns, len(plan.befores))
        # An uncommon follower is in one range of its word before, so numbers of followers add up over the ranges.
        ranges = words.select(F.explode("parts").alias("p")).select("p.*").filter(F.col("range") >= plan.ranges)
        ranges = ranges.groupBy((F.col("range") - plan.ranges).alias("range")).agg(
            F.sum("t").alias("t"), F.sum("a").alias("a"), F.count_if(F.col("t") > 0).alias("kinds_t"), F.count("*").alias("kinds_a")
        )
        befores += np.add.reduceat(table(ranges, "range", columns, int(plan.parts.sum())), plan.first - plan.ranges, axis=1)
    model = Model(sums, vocabulary, near, befores)
    of = befores[:, np.searchsorted(plan.befores, plan.pair_codes[0])]
    return replace(model, pairs=model.losses(pairs, of[:2], of[2:], near[:, plan.pair_codes[1].astype(np.int64)]))


def _settled(found: pa.Table, plan: Common, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, target loss, background loss) summed for the rows of a range's blocks (base, block)."""
    blocks_of, pairs, sent = [], [], []
    for base, block in zip(found["base"].to_pylist(), found["block"]):
        if base is None:
            sent.append(_unpacked(block.as_py(), WORD_BLOCK))
        else:
            before, words, sizes, rows, n = _pairs_of(block.as_py())
            blocks_of.append((base, block))
            begin = np.cumsum(sizes, dtype=np.int64) - sizes
            pairs.append((before, words, *(np.add.reduceat(c, begin, dtype="u4") if len(n) else n for c in (n * (rows & 1), n))))
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    before, words, *counts = map(np.concatenate, zip(*pairs))
    pairs, lengths = [], [len(p[0]) for p in pairs]
    # From here on by distinct bigrams; ``own`` leads back to those of the blocks.
    _, at, own = np.unique(_pairs(before, words), return_index=True, return_inverse=True)
    own, before, words = own.astype("u4"), before[at], words[at]
    counts = [np.bincount(own, c, len(at)) for c in counts]
    if sent:
        codes, *sent = map(np.concatenate, zip(*sent))
        order = np.argsort(codes)
        codes, sent = codes[order], [c[order] for c in sent]
    begins, group = np.unique(before, return_inverse=True)
    befores = np.stack([np.bincount(group, c) for c in (*counts, counts[0] > 0, counts[1] > 0)])
    place = _place(plan.befores, begins)
    befores[:, place >= 0] = model.befores[:, place[place >= 0]]
    losses = np.empty((2, len(at)))
    for low in range(0, len(at), STEP):
        part = slice(low, low + STEP)
        of, word = befores[:, group[part]], words[part]
        occurring, near = np.zeros((2, len(word))), word < UNCOMMON
        occurring[:, near] = model.words[:, word[near].astype(np.int64)]
        if sent:
            where = np.searchsorted(codes, word[~near])
            occurring[:, ~near] = [c[where] for c in sent]
        losses[:, part] = model.losses(np.stack([c[part] for c in counts]), of[:2], of[2:], occurring)
    sums, low = [], 0
    for (base, block), length in zip(blocks_of, lengths):
        _, _, sizes, rows, n = _pairs_of(block.as_py())
        rows, back = np.unique(rows >> 1, return_inverse=True)
        loss = losses[:, own[low : low + length]]
        sums.append((base + rows.astype(np.int64), *(np.bincount(back, n * np.repeat(one, sizes), len(rows)) for one in loss)))
        low += length
    return tuple(map(np.concatenate, zip(*sums)))


def cross_entropy_difference(
    documents: DataFrame, targets: DataFrame, size: int | None = None, sample: int = SAMPLE, range_size: int = RANGE
) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score) for every row of ``documents`` (doc_id, text).

    ``targets`` names the target documents by doc_id. The losses are means per word in nats
    and ``score`` is target_loss - background_loss. Null and empty texts have no words and
    zero for all. A null doc_id is never a target; rows that repeat a target's doc_id are
    targets too. Without any target the score is 0 for all. Repeated rows are counted and
    returned as often as they occur. Other columns play no part. With ``size``, only the most
    frequent words are told apart and all others are one unknown word. ``sample`` and
    ``range_size`` bear on how counts travel, not on results.
    """
    known = None if size is None else vocabulary(documents, size)
    named = materialize(targets.select("doc_id").filter("doc_id IS NOT NULL").distinct().withColumn("is_target", F.lit(True)), "targets")
    few = named.count() <= FEW_TARGETS
    flagged = documents.select("doc_id", "text").join(F.broadcast(named) if few else named, "doc_id", "left")
    flagged = flagged.withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    if not few:  # texts move once, not in every pass
        flagged = materialize(flagged, "flagged")
    plan, every, of_targets = common(flagged, known, sample, range_size)
    if not of_targets:  # both models are the background
        flagged, of_targets = flagged.withColumn("is_target", F.lit(True)), every
    words = materialize(word_counts(flagged, plan, known), "words")
    model = _model(flagged, words, plan, (of_targets, every), known)
    asked = words.filter("word < 0").select("word", "t", "a", F.explode("parts.range").alias("range"))

    kind = flagged.schema["doc_id"].dataType.simpleString()
    row_schema = {"row": "long", "doc_id": kind, "n_words": "long", "t": "double", "b": "double"}
    group_schema = {"group": "long", "block": "binary"} | row_schema
    schema = {"range": "long", "base": "long", "block": "binary"} | row_schema

    def filled(n: int, own_type: pa.DataType, **columns: object) -> pa.RecordBatch:
        types = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
        arrays = []
        for name, of in schema.items():
            kind_of = own_type if name == "doc_id" else types[of]
            arrays.append(pa.nulls(n, kind_of) if name not in columns else columns[name] if name == "doc_id" else pa.array(columns[name], kind_of))
        return pa.RecordBatch.from_arrays(arrays, list(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, waiting, base, own_type = [], 0, 0, None

        def sent() -> Iterator[pa.RecordBatch]:
            for place, block in _pair_blocks(*map(np.concatenate, zip(*pending))):
                yield filled(1, own_type, range=[place], base=[base], block=[block])

        for batch in batches:
            ids, own_type = batch.column(0).to_numpy(), batch.column(1).type
            flags = batch.column(3).to_numpy(zero_copy_only=False)
            for row, hashes, before, first in _words(batch.column(2), known):
                docs, n_words = len(first) - 1, np.diff(first)
                of, words, before = np.repeat(np.arange(docs), n_words), plan.codes(hashes), plan.codes(before)
                at = _place(plan.pairs, _pairs(before, words))
                met, rest = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
                sums = [np.bincount(of[met], loss[at[met]], docs) for loss in model.pairs]
                own = ids[row : row + docs]
                # The row itself passes through some range.
                yield filled(docs, own_type, range=own % plan.ranges, row=own, doc_id=batch.column(1).slice(row, docs), n_words=n_words, t=sums[0], b=sums[1])
                if not waiting:
                    base = int(own[0])
                target = flags[row : row + docs].astype(np.int64)
                marked = (2 * (own - base) + target)[of[rest]]
                pending.append((plan.dealt(before[rest], words[rest]), before[rest], words[rest], marked))
                waiting += len(words)
                if waiting >= PENDING:
                    yield from sent()
                    pending, waiting = [], 0
        if waiting:
            yield from sent()

    def settle(found: pa.Table) -> pa.Table:
        rows, t, b = _settled(found.filter(pc.is_valid(found["block"])), plan, model)
        order = np.argsort(rows, kind="stable")
        rows, t, b = rows[order], t[order], b[order]
        groups = rows >> GROUP_BITS
        bounds = np.append(_runs(groups), len(rows))
        own = [(rows[i:j] & ((1 << GROUP_BITS) - 1), t[i:j], b[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
        sums = pa.table({"group": pa.array(groups[bounds[:-1]]), "block": pa.array([_packed(x, SUM_BLOCK) for x in own], pa.binary())})
        whole = found.filter(pc.is_null(found["block"]))
        whole = whole.append_column("group", pc.shift_right(whole["row"], GROUP_BITS)).select(list(group_schema))
        missing = [sums[c] if c in sums.column_names else pa.nulls(len(sums), whole.schema.field(c).type) for c in group_schema]
        return pa.concat_tables([whole, pa.Table.from_arrays(missing, schema=whole.schema)])

    def added(found: pa.Table) -> pa.Table:
        whole = found.filter(pc.is_null(found["block"]))
        at, sums = whole["row"].to_numpy() & ((1 << GROUP_BITS) - 1), np.zeros((2, 1 << GROUP_BITS))
        for block in found.filter(pc.is_valid(found["block"]))["block"]:
            rows, *losses = _unpacked(block.as_py(), SUM_BLOCK)
            for one, loss in zip(sums, losses):
                one += np.bincount(rows, loss, len(one))
        for i, c in enumerate(("t", "b")):
            place = whole.schema.get_field_index(c)
            whole = whole.set_column(place, c, pa.array(whole[c].to_numpy() + sums[i][at]))
        return whole.select(list(row_schema))

    columns = lambda names: ", ".join(f"{c} {k}" for c, k in names.items())
    numbered = flagged.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "is_target")
    parts = numbered.mapInArrow(run, columns(schema))
    parts = parts.unionByName(_word_blocks(asked), allowMissingColumns=True)
    settled = parts.groupBy("range").applyInArrow(settle, columns(group_schema))
    summed = settled.groupBy("group").applyInArrow(added, columns(row_schema))
    mean = lambda loss: F.when(F.col("n_words") > 0, F.col(loss) / F.col("n_words")).otherwise(0.0)
    scored = summed.select("doc_id", "n_words", mean("t").alias("target_loss"), mean("b").alias("background_loss"))
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))
