"""Repair of conversations: a grammar-compressed dynamic program over roles and faults.

A conversation becomes a sequence of symbols, one for each row: its role and its fault. A
repair keeps, re-roles or deletes every row and inserts rows so that the roles alternate.
What a symbol does to a repair is a min-plus matrix over the four states that the roles
written so far can be in: from state to state, the cheapest edits and their audit string.

Pairs of symbols that are frequent over all conversations are replaced by new symbols
(Re-Pair), round after round. Each rule's matrix is the product of its two symbols'
matrices, so it is worked out once and serves all conversations that hold the rule. Audit
strings are ropes that rules share; two are compared by their hashes down to the first
part in which they differ.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.session import materialize

#: Roles by their initials, all others being one more, and faults; a symbol is a letter for each pair of them.
ROLES, FAULTS = "sua", ("none", "blank", "duplicate", "truncated")
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, STAYS = 1, 2, 5, 5
#: Symbols of a conversation that one row of the table of blocks holds.
BLOCK = 4096
#: Rounds of replacement and the rules each one may add. They bound what tasks are sent; what no rule replaces is worked through symbol by symbol.
ROUNDS, RULES = 12, 48
#: Ropes up to this length are plain strings.
LEAF = 64
#: Short sequences whose repairs a task remembers.
REMEMBERED = 1 << 16

PRIME, BASE = (1 << 61) - 1, 0x1D2F_3A4B_5C6D_7E8F
WHITE = " \t\n\x0b\x0c\r"


class Rope:
    """A string as a tree of shared parts; ``power`` is BASE to the length."""

    __slots__ = ("size", "hash", "power", "text", "left", "right")

    def __init__(self, size, hash_, power, text=None, left=None, right=None):
        self.size, self.hash, self.power, self.text, self.left, self.right = size, hash_, power, text, left, right

    @staticmethod
    def of(text: str) -> Rope:
        value, power = 0, 1
        for c in text:
            value, power = (value * BASE + ord(c)) % PRIME, power * BASE % PRIME
        return Rope(len(text), value, power, text)

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return self if self.size else other
        size, value, power = self.size + other.size, (self.hash * other.power + other.hash) % PRIME, self.power * other.power % PRIME
        if size <= LEAF:
            return Rope(size, value, power, self.text + other.text)
        return Rope(size, value, power, None, self, other)

    def same(self, other: Rope) -> bool:
        return self is other or (self.size == other.size and self.hash == other.hash)

    def __lt__(self, other: Rope) -> bool:
        ones, others = [self], [other]
        while ones and others:
            one, two = ones.pop(), others.pop()
            if one.same(two):
                continue
            if one.text is not None and two.text is not None:
                both = min(one.size, two.size)
                if one.text[:both] != two.text[:both]:
                    return one.text < two.text
                if one.size > both:
                    ones.append(Rope.of(one.text[both:]))
                if two.size > both:
                    others.append(Rope.of(two.text[both:]))
            elif two.text is not None or (one.text is None and one.size >= two.size):
                others.append(two)
                ones += [one.right, one.left]
            else:
                ones.append(one)
                others += [two.right, two.left]
        return bool(others)

    def __str__(self) -> str:
        found, waiting = [], [self]
        while waiting:
            rope = waiting.pop()
            if rope.text is not None:
                found.append(rope.text)
            else:
                waiting += [rope.right, rope.left]
        return "".join(found)


# States of what is written: nothing, a system row, up to a user row, up to an assistant row.
STATES = range(4)
NOTHING = Rope.of("")


def after(state: int, role: str) -> int | None:
    """The state behind a row of this role, None if it can't stand there."""
    if role == "s":
        return 1 if state == 0 else None
    if role == "u":
        return 2 if state != 2 else None
    return 3 if role == "a" and state == 2 else None


def inserted(state: int) -> Iterator[tuple[int, int]]:
    """(state, inserts): where inserts alone can lead; more would come back to a state already met."""
    seen, inserts = set(), 0
    while state not in seen:
        seen.add(state)
        yield state, inserts
        state, inserts = after(state, "a" if state == 2 else "u"), inserts + 1


# A matrix is a list of rows of (cost, rope), or None where no repair leads. The strings of one matrix hold as many
# letters of rows, and each ends with one, so none begins with another: the least string of a product is made of the
# least strings of its factors.
Matrix = list


def symbol_matrix(symbol: str) -> Matrix:
    """What one row does: inserts before it, then one edit."""
    code = ord(symbol) - 65
    role, fault = (ROLES + "?")[code // 4], FAULTS[code % 4]
    best: Matrix = [[None] * 4 for _ in STATES]
    for start in STATES:
        for state, inserts in inserted(start):
            edits = [(state, DELETE, "D")]
            if fault in ("none", "truncated"):
                stays = STAYS * (fault == "truncated")
                edits += [(after(state, role), stays, "K")] + [(after(state, r), stays + REROLE, "R") for r in "ua"]
            for end, cost, letter in edits:
                if end is not None:
                    found = (cost + INSERT * inserts, "I" * inserts + letter)
                    if best[start][end] is None or found < best[start][end]:
                        best[start][end] = found
    return [[cell and (cell[0], Rope.of(cell[1])) for cell in row] for row in best]


def through(row: list, matrix: Matrix) -> list:
    """One row of a product: the best way from each state of ``row`` on."""
    out = [None] * 4
    for end in STATES:
        best = None
        for state in STATES:
            one, two = row[state], matrix[state][end]
            if one is None or two is None:
                continue
            cost = one[0] + two[0]
            if best is not None and cost >= best[0]:
                if cost > best[0] or (two[1].same(best[2]) or best[2] < two[1] if one[1].same(best[1]) else best[1] < one[1]):
                    continue
            best = (cost, one[1], two[1])
        out[end] = best and (best[0], best[1] + best[2])
    return out


class Grammar:
    """Rules (pairs of symbols, in the order they were made) and the matrices of all symbols."""

    def __init__(self, rules: Iterable[str] = ()):
        self.rules = list(rules)
        self.matrices = {s: symbol_matrix(s) for s in map(chr, range(65, 65 + 4 * (len(ROLES) + 1)))}
        for number, (one, two) in enumerate(self.rules):  # bottom-up: a rule's symbols come before it
            self.matrices[rule_symbol(number)] = [through(row, self.matrices[two]) for row in self.matrices[one]]
        self.known: dict[str, tuple[int, str]] = {}

    def compress(self, text: str) -> str:
        for number, pair in enumerate(self.rules):
            text = text.replace(pair, rule_symbol(number))
        return text

    def repair(self, sequence: str, compressed: str | None = None) -> tuple[int, str]:
        """(cost, audit) of the cheapest edits, and among equals the least string of their initials."""
        if sequence in self.known:
            return self.known[sequence]
        row = [(0, NOTHING), None, None, None]
        for symbol in self.compress(sequence) if compressed is None else compressed:
            row = through(row, self.matrices[symbol])
        ends = []
        for state, inserts in ((0, 0), (1, 2), (2, 1), (3, 0)):
            if row[state]:
                ends.append((row[state][0] + INSERT * inserts, str(row[state][1]) + "I" * inserts))
        if len(sequence) <= LEAF and len(self.known) < REMEMBERED:
            self.known[sequence] = min(ends)
        return min(ends)


def rule_symbol(number: int) -> str:
    return chr(0xE000 + number)


def learn(sequences: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> list[str]:
    """Re-Pair over all rows of ``sequences`` (symbols): a round replaces the most frequent pairs, which all tasks count."""
    known: list[str] = []
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], known: list[str] = list(known)) -> Iterator[pa.RecordBatch]:
            grammar, counts = Grammar(()), Counter()
            grammar.rules = known
            for batch in batches:
                codes = np.frombuffer(grammar.compress("\n".join(batch.column(0).to_pylist())).encode("utf-32-le"), "<u4").astype(np.int64)
                inside = (codes[:-1] != 10) & (codes[1:] != 10)
                pair, n = np.unique((codes[:-1] << 32 | codes[1:])[inside], return_counts=True)
                counts.update(dict(zip(pair.tolist(), n.tolist())))
                counts[0] += int((codes != 10).sum())
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["pair", "n"])

        # No more rows than pairs of symbols from any task; the rows that come to the driver are the round's rules and the total.
        counted = sequences.select("symbols").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        found = counted.filter("n > 1").orderBy(F.desc("n"), "pair").limit(rules + 1).collect()
        total = max((row["n"] for row in found if row["pair"] == 0), default=0)
        new = [row for row in found if row["pair"]][:rules]
        if sum(row["n"] for row in new) * 50 < total or not new:
            break
        known += [chr(row["pair"] >> 32) + chr(row["pair"] & 0xFFFFFFFF) for row in new]
    return known


def damaged(conversations: DataFrame) -> DataFrame:
    """(key, has_turn, turn, role, text, copies): all rows, damaged by a hash of conv_id and turn. ``key`` is conv_id as text, '' if null."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    damage = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(damage == 1, "").when(damage == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    return conversations.select(
        F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit(":"), F.col("conv_id").cast("string"))).alias("key"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.when(damage == 4, "user").otherwise(shown("role")).alias("role"),
        text.alias("text"),
        F.when(damage == 0, 0).when(damage == 3, 2).otherwise(1).alias("copies"),
    )


PLACE = ("key", "has_turn", "turn", "role", "digest")


def _digest() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def rows_with_faults(conversations: DataFrame) -> DataFrame:
    """(key, has_turn, turn, role, digest, n, symbol): equal rows are one, with the symbol of the first of them.

    A dropped row is one with n = 0, so that its conversation stays known.
    """
    stripped = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(stripped == "", 1).when(F.right(stripped, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3)
    rows = damaged(conversations).select("key", "has_turn", "turn", "role", _digest().alias("digest"), fault.alias("fault"), "copies")
    gone = F.col("copies") == 0
    none = {"has_turn": F.lit(False), "turn": F.lit(0).cast("long"), "role": F.lit(""), "digest": F.lit(b""), "fault": F.lit(0)}
    rows = rows.withColumns({c: F.when(gone, value).otherwise(F.col(c)) for c, value in none.items()})
    rows = rows.groupBy(*PLACE).agg(F.sum("copies").alias("n"), F.max("fault").alias("fault"))
    # Where each text of a role stands first: every key of this join is met once on both sides, so no text is a hot key.
    first = rows.groupBy("key", "role", "digest").agg(F.min(F.struct("has_turn", "turn")).alias("at"))
    first = first.select("key", F.col("at.has_turn").alias("has_turn"), F.col("at.turn").alias("turn"), "role", "digest", F.lit(True).alias("is_first"))
    joined = rows.join(first, list(PLACE), "left")
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    own = F.when((F.col("fault") == 1) | F.col("is_first"), F.col("fault")).otherwise(2)
    return joined.select(*PLACE, "n", F.char(65 + 4 * role + own).alias("symbol"))


#: The symbols of blank rows, whose repeats are blank as well; those of any other row are duplicates.
BLANKS = "BFJN"
BLOCKS = "key string, has_turn boolean, turn long, role string, digest binary, piece long, symbols string, low long, high long, distinct long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one conversation, in order, each with the place of its first row and its turns."""
    start, key, size, piece, turns, symbols = None, None, 0, 0, [], []

    def close() -> tuple:
        return (*start, piece, "".join(symbols), turns[0] if turns else None, turns[-1] if turns else None, len(turns))

    for batch in batches:
        out = []
        for *place, n, symbol in zip(*(c.to_pylist() for c in batch.columns)):
            if start is not None and key != place[0]:
                out.append(close())
                start = None
            left, letter = n, symbol
            while True:
                if start is not None and size == BLOCK:
                    out.append(close())
                    start = None
                if start is None:
                    # Pieces of equal rows differ in their number alone.
                    piece = piece + 1 if left < n else 0
                    start, key, size, turns, symbols = place, place[0], 0, [], []
                if place[1] and n and (not turns or turns[-1] != place[2]):
                    turns.append(place[2])
                if not left:
                    break
                take = min(left, BLOCK - size)
                again = letter if letter in BLANKS else chr(ord(letter) - (ord(letter) - 65) % 4 + 2)  # a blank stays one
                symbols.append((letter + again * (take - 1)) if left == n else again * take)
                size, left = size + take, left - take
        if out:
            yield _batch(out, BLOCKS)
    if start is not None:
        yield _batch([close()], BLOCKS)


KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[kind]) for c, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields])


def sequences(conversations: DataFrame) -> DataFrame:
    """(key, gaps, symbols): a row for every conversation.

    Rows are put in order by ranges that split a conversation wherever one is long, and
    each range gives blocks of ``BLOCK`` symbols; only these strings, a byte for a row as in
    the audit itself, are brought together.
    """
    rows = materialize(rows_with_faults(conversations), "turns")
    blocks = rows.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(_blocks, BLOCKS)
    parts = blocks.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("has_turn", "turn", "role", "digest", "piece", "symbols", "low", "high"))).alias("b"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("distinct").alias("distinct"),
    )
    # A turn that goes on in the next block was counted in both.
    again = F.size(F.filter("b", lambda x, i: (i > 0) & (x["low"] == F.get(F.col("b"), i - 1)["high"])))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    gaps = F.coalesce(wide("high") - wide("low") + 1 - wide("distinct") + again, F.lit(0)).cast("decimal(38,0)").try_cast("long")
    return parts.select("key", gaps.alias("gaps"), F.array_join(F.transform("b", lambda x: x["symbols"]), "").alias("symbols"))


AUDITS = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(found: DataFrame, rules: list[str]) -> DataFrame:
    """The counts, the cost and the audit of every conversation of ``found`` (key, gaps, symbols)."""
    legal = np.zeros((4, 4), bool)
    for one, two in ("su", "ua", "au"):
        legal[ROLES.index(one), ROLES.index(two)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        for batch in batches:
            keys, gaps, symbols = (c.to_pylist() for c in batch.columns)
            rows = []
            for key, gap, own, compressed in zip(keys, gaps, symbols, grammar.compress("\n".join(symbols)).split("\n")):
                codes = np.frombuffer(own.encode(), np.uint8) - 65
                faults, roles = np.bincount(codes % 4, minlength=4).tolist(), codes // 4
                illegal = int((~legal[roles[:-1], roles[1:]]).sum())
                rows.append((key, gap, *faults[1:], illegal, *grammar.repair(own, compressed)))
            if rows:
                yield _batch(rows, AUDITS)

    return found.select("key", "gaps", "symbols").mapInArrow(run, AUDITS)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``audits`` with the hash of what the edits make of the texts that follow each in order."""
    facts, audit, at, state, lines, digest = None, "", 0, 0, 0, None

    def write(role: str, text: str) -> None:
        nonlocal lines
        digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
        lines += 1

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = "assistant" if state == 2 else "user"
            write(role, "")
            state, at = after(state, role[0]), at + 1

    def close() -> tuple:
        inserts()
        return (*facts, audit, digest.hexdigest())

    for batch in batches:
        out = []
        columns = [c.to_pylist() for c in batch.columns]
        for *own, given, role, text, copies in zip(*columns):
            if given is not None:
                if facts is not None:
                    out.append(close())
                facts, audit, at, state, lines, digest = own, given, 0, 0, 0, hashlib.sha256()
                continue
            for _ in range(copies):
                inserts()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    role = "assistant" if state == 2 else "user"
                write(role, text)
                state = after(state, role[0])
        if out:
            yield _batch(out, REPAIRED)
    if facts is not None:
        yield _batch([close()], REPAIRED)


REPAIRED = AUDITS + ", repaired_sha256 string"


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conv_id of ``conversations``.

    Rows (conv_id, turn, role, text) are damaged by a hash first; nulls in them are one space,
    but a null turn stays none in ``gaps`` and comes first, and a null conv_id is a
    conversation of its own. Rows of one turn follow each other by role and by the MD5 of
    their text. Conversations without rows have zeros, an empty audit and the hash of an
    empty string. ``gaps`` is null where it is beyond a long. Other columns play no part; an
    empty table gives an empty one.

    The hash of a repaired conversation takes its rows one after another, so a conversation
    is read by one task there, as a stream in sorted order that is never held; everything
    else about a conversation is worked out in ranges and blocks.
    """
    found = materialize(sequences(conversations), "sequences")
    judged = audits(found, learn(found))
    names = [c.split()[0] for c in AUDITS.split(", ")]
    none = lambda kind: F.lit(None).cast(kind)
    heads = judged.select(
        F.lit(0).alias("flag"), none("boolean").alias("has_turn"), none("long").alias("turn"), none("binary").alias("digest"), *names,
        none("string").alias("role"), none("string").alias("text"), F.lit(0).alias("copies"),
    )
    facts = [none(c.split()[1]).alias(c.split()[0]) for c in AUDITS.split(", ")[1:]]
    texts = damaged(conversations).filter("copies > 0")
    texts = texts.select(F.lit(1).alias("flag"), "has_turn", "turn", _digest().alias("digest"), "key", *facts, "role", "text", "copies")
    streams = heads.unionAll(texts).repartition("key").sortWithinPartitions("key", "flag", "has_turn", "turn", "role", "digest")
    done = streams.select(*names, "role", "text", "copies").mapInArrow(_hashed, REPAIRED)
    kind = conversations.schema["conv_id"].dataType
    own = F.when(F.col("key") != "", F.substring(F.col("key"), F.lit(2), F.length("key"))).cast(kind)
    return done.select(own.alias("conv_id"), *names[1:], "repaired_sha256")
