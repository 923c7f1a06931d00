import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tablescope.llm import queries, spelling
from tests_llm_tools import table

SCHEMA = "doc_id long, text string, word string, n int, id string"


def plain_counts(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    """Every pair of words compared."""
    forms, out = {}, {}
    for w, n in counts.items():
        own = [v for v in counts if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * n else None
        out[w] = len(own)
    rows = set()
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.add((w, forms[w], root, n, out[w], counts[forms[w]] if forms[w] else None))
    return rows


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(250)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaab", "Zeichen", "ÀÉÿÀÉÿÀ"]
    words += ["prefixed" * 5 + x for x in ("", "a", "ab", "b", "ba")] + ["x" * 5000, "x" * 4999 + "y", "x" * 5001]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 40])))) for i in range(120)]
    rows += [(500 + i, "hundreds " * 40 + "hundredz hundredy hundredz hundredy hundreds7hundredx-hundredx") for i in range(12)]
    rows += [(600 + i, " ".join(words[-8:])) for i in range(3)]
    return rows + [(None, None), (None, "aaaaaaa aaaaaaa"), (7, ""), (7, "short"), (7, "aaaaaaab aaaaaaab")] + rows[:4]


def test_equal_to_brute_force(spark):
    rows = corpus()
    df = table(spark, SCHEMA, [(*r, "clash", 1, None) for r in rows])
    want = plain(plain_counts(rows))
    assert any(form for _, form, *_ in want) and any(r[1] and r[2] != r[1] for r in want) and max(r[4] for r in want) > 3
    for parts in (1, 7):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false" if parts > 1 else "true")
        try:
            got = [tuple(r) for r in spelling.spelling_variants(df.repartition(parts)).collect()]
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(got) == len(set(got)) and set(got) == want


def test_chains_and_ties(spark):
    counts = {"abcdefg": 10**6, "abcdefgh": 10**5, "abcdefghi": 10**4, "abcdefghij": 100, "abcdefghijk": 10, "abcdefghijkl": 1, "abcdefghijkx": 1,
              "zzzzzzy": 50, "zzzzzza": 50, "zzzzzzq": 5, "zzzzzzzz": 4, "lonelyone": 3}
    df = table(spark, "word string, n long", list(counts.items()))
    assert {tuple(r) for r in spelling.variants(df).collect()} == plain(counts)


def test_empty(spark):
    assert spelling.spelling_variants(table(spark, SCHEMA, [])).count() == 0
    assert spelling.spelling_variants(table(spark, SCHEMA, [(1, None, "", 1, ""), (2, "few words", "", 1, "")])).count() == 0


def test_query_on_a_given_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    counts = plain_counts(rows)
    got = queries.op13_trie_pairs(spark, path)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {(r.word, r.n) for r in got.collect()} == set(counts.items())
    some = got.filter(F.col("n_near") > 0).orderBy("word").limit(40).collect()
    for r in some:
        own = [v for v in counts if abs(len(v) - len(r.word)) < 2 and near(r.word, v)]
        best = min(own, key=lambda v: (-counts[v], v))
        assert r.n_near == len(own) and r.form == (best if counts[best] >= 10 * r.n else None)
