from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm import shard
from tests_llm_tools import table


def brute(positions, shards, replicas, slack):
    """Key by key and step by step: who waits looks at the next node; arcs in ring order, keys in key order."""
    nodes = shard.ring(shards, replicas)
    room = shard.bounds(len(positions), shards, slack)
    waiting = []
    for i, at in positions:
        arc = next((k for k, (end, _) in enumerate(nodes) if end >= at), 0)
        waiting.append((arc, at, i))
    waiting.sort()
    placed, used, step = {}, [0] * shards, 0
    while waiting:
        left = []
        for arc, at, i in waiting:
            owner = nodes[(arc + step) % len(nodes)][1]
            if used[owner] < room[owner]:
                placed[i] = (owner, used[owner])
                used[owner] += 1
            else:
                left.append((arc, at, i))
        waiting, step = left, step + 1
    return placed


def test_ring_equals_walk_key_by_key(spark):
    df = spark.range(700).select(F.col("id").alias("doc_id"))
    positions = [(r[0], r[1]) for r in df.select("doc_id", shard.position(F.col("doc_id"))).collect()]
    for slack in (0.0, 0.1):
        got = {r.doc_id: (r.shard, r.slot) for r in shard.shard(df, ["doc_id"], 5, replicas=8, slack=slack).collect()}
        want = brute(positions, 5, 8, slack)
        assert got == want


def test_counts_slots_and_movement(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"))
    rows = shard.shard(df, ["doc_id"], 16, slack=0.0).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 3000 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    before = {r.doc_id: r.shard for r in rows}
    after = {r.doc_id: r.shard for r in shard.shard(df, ["doc_id"], 17, slack=0.0).collect()}
    assert sum(before[k] != after[k] for k in before) < 0.2 * 3000


def test_odd_rows(spark):
    df = table(spark, "doc_id long, shard string, text string", [(None, "x", None), (None, "x", None), (1, "y", ""), (1, "y", "a"), (2, None, None)])
    out = shard.shard(df, ["doc_id"], 4, slack=0.0)
    assert sorted(out.columns) == ["doc_id", "shard", "slot", "text"]
    assert out.count() == 5 and out.schema["shard"].dataType == T.IntegerType()
    assert shard.shard(df.limit(0), ["doc_id"], 4).count() == 0
    assert {r.shard for r in shard.shard(df, ["doc_id"], 1).collect()} == {0}


def test_names_that_clash_with_those_used_inside(spark):
    df = spark.range(50).selectExpr("id", "id % 3 AS at", "'x' AS row", "id AS rank", "0 AS arc", "1 AS first", "2 AS slot", "3 AS __arc")
    out = shard.shard(df, ["id"], shards=4, slack=0.0)
    assert out.columns == ["id", "at", "row", "rank", "arc", "first", "__arc", "shard", "slot"]
    assert sorted(r["count"] for r in out.groupBy("shard").count().collect()) == [12, 12, 13, 13]
