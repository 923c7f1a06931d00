import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from tablescope.llm import queries, repair
from tests_llm_tools import table

SCHEMA = "conv_id long, turn long, role string, text string, key int, symbols string, n string"


def damage(rows):
    """The rows of every conversation after damage, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        out[conv]
        role, text = show(role), show(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest())
    return {c: sorted(own, key=order) for c, own in out.items()}


def faults(own):
    seen, found = set(), []
    for _, role, text in own:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "none"
        seen.add((role, text))
        found.append(fault)
    return found


def cheapest(own, marks):
    """All edits tried, prefix by prefix: for every string of roles written so far the best (cost, audit, rows)."""
    def legal(roles):
        return re.fullmatch("s?(ua)*u?", roles)

    best = {"": (0, "", [])}

    def better(table, roles, value):
        if legal(roles) and (roles not in table or value[:2] < table[roles][:2]):
            table[roles] = value

    def with_inserts(table):
        for _ in range(4):
            for roles, (cost, audit, rows) in list(table.items()):
                for role in ("user", "assistant"):
                    better(table, roles + role[0], (cost + 5, audit + "I", rows + [(role, "")]))

    for (_, role, text), mark in zip(own, marks):
        grown = dict(best)
        with_inserts(grown)
        new = {}
        for roles, (cost, audit, rows) in grown.items():
            better(new, roles, (cost + 2, audit + "D", rows))
            if mark in ("none", "truncated"):
                more = 5 * (mark == "truncated")
                if role[:1] in ("s", "u", "a"):
                    better(new, roles + role[:1], (cost + more, audit + "K", rows + [(role, text)]))
                for other in ("user", "assistant"):
                    better(new, roles + other[0], (cost + more + 1, audit + "R", rows + [(other, text)]))
        best = new
    with_inserts(best)
    return min(v for roles, v in best.items() if re.fullmatch("(s?(ua)+)?", roles))


def plain(rows):
    out = []
    for conv, own in damage(rows).items():
        marks, turns = faults(own), {t for t, *_ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, kept = cheapest(own, marks)
        text = "\n".join(f"{role}:{text}" for role, text in kept)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [marks.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def fixture():
    rng = random.Random(6)
    rows = []
    for conv in range(150):
        for turn in range(rng.choice([1, 2, 3, 5, 8])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "User", "u", None])
            text = rng.choice(["Yes.", "No!", "Why?", "and then", "", " \t", "é.", "Ends. ", None, f"own {conv}.", f"own {conv} {turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None, 0]), role, text))
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (900, None, "user", "Hi."), (901, 2**62, "user", "Hi."), (901, -(2**61), "assistant", "Ho.")]
    rows += rows[:40]
    return rows


def test_equal_to_trying_all_edits(spark):
    rows = fixture()
    df = table(spark, SCHEMA, [(*r, 1, "x", None) for r in rows])
    got = [tuple(r) for r in repair.repair(df).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_query_on_a_given_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = sorted(plain(rows), key=str)
    assert len({r[7] for r in want}) > 20
    got = queries.op11_grammar_repair(spark, path)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_blocks_of_a_long_conversation():
    import pyarrow as pa

    rows = [("a", True, t, "user", b"1", n, "F" if n > 9000 else "E") for t, n in ((1, 3), (2, 10000), (3, 2), (5, 5000))] + [("b", False, 0, "", b"", 0, "A"), ("c", False, 0, "x", b"2", 1, "P")]
    names = [*repair.PLACE, "n", "symbol"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
    blocks = [r for b in repair._blocks(iter([batch.slice(0, 2), batch.slice(2, 4)])) for r in b.to_pylist()]
    whole = {k: "".join(r["symbols"] for r in own) for k, own in itertools.groupby(blocks, lambda r: r["key"]) for own in [list(own)]}
    assert whole == {"a": "EGG" + "F" * 10000 + "EG" + "E" + "G" * 4999, "b": "", "c": "P"}
    assert all(len(r["symbols"]) <= repair.BLOCK for r in blocks)
    own = [r for r in blocks if r["key"] == "a"]
    order = [(r["has_turn"], r["turn"], r["role"], r["digest"], r["piece"]) for r in own]
    assert order == sorted(order) and len(set(order)) == len(order)
    assert sum(r["distinct"] for r in own) - sum(a["high"] == b["low"] for a, b in zip(own, own[1:])) == 4
    assert (own[0]["low"], own[-1]["high"]) == (1, 5) and blocks[-2]["low"] is None


def test_small_blocks_and_many_ranges(spark):
    """A conversation that is split among ranges and blocks comes out the same."""
    rng = random.Random(2)
    rows = [(1, t // 2, rng.choice(["user", "assistant"]), rng.choice(["A.", "B.", "c", f"{t}."])) for t in range(120)] + [(2, 1, "user", "Q?"), (2, 2, "assistant", "A.")]
    df = table(spark, SCHEMA, [(*r, 1, "x", None) for r in rows])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((tuple(r) for r in repair.repair(df).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(plain(rows), key=str)


def test_rules_do_not_change_repairs(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("AEIMBFGKHL") for _ in range(rng.choice([0, 1, 4, 30, 200]))) for _ in range(60)] + ["EI" * 900, "E" * 700]
    rules = repair.learn(table(spark, "symbols string", [(t,) for t in texts]), rounds=5, rules=20)
    assert len(rules) > 20
    plain_grammar, grammar = repair.Grammar(), repair.Grammar(rules)
    expand = {repair.rule_symbol(k): pair for k, pair in enumerate(rules)}
    for text in texts:
        back = grammar.compress(text)
        assert text == "" or len(back) <= len(text)
        while any(c in expand for c in back):
            back = "".join(expand.get(c, c) for c in back)
        assert back == text and grammar.repair(text) == plain_grammar.repair(text)


def test_ropes():
    rng = random.Random(1)
    for _ in range(300):
        parts = ["".join(rng.choice("DIKR"[: rng.choice([1, 2])]) for _ in range(rng.randint(0, 70))) for _ in range(12)]
        build = lambda order: sum((repair.Rope.of(p) for p in order[1:]), repair.Rope.of(order[0]))
        one, two = parts[:], parts[:]
        two[rng.randrange(12)] += rng.choice(["", "D", "K"])
        one, two = build(one), build(two[:3]) + build(two[3:])
        assert (one < two) == (str(one) < str(two)) and (two < one) == (str(two) < str(one)) and one.same(two) == (str(one) == str(two))


def test_empty(spark):
    assert repair.repair(table(spark, SCHEMA, [])).count() == 0
