import random
from collections import Counter

from pyspark.sql import functions as F

from tablescope.llm import decontaminate as dc
from tests_llm_tools import table, words


def brute(docs, items, percent=75):
    """All item-long windows of all documents, by exact weighted similarity."""
    found = {}
    for item, text in items.items():
        w = words(text)
        size = min(5, len(w))
        if not w:
            continue
        own = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
        for doc, body in docs.items():
            d = words(body)
            for at in range(max(1, len(d) - len(w) + 1)):
                part = d[at : at + len(w)]
                seen = Counter(tuple(part[i : i + size]) for i in range(len(part) - size + 1))
                both = sum((own & seen).values())
                if both and 100 * both >= percent * (sum(own.values()) + sum(seen.values()) - both):
                    found[doc, item] = max(found.get((doc, item), 0), both / (sum(own.values()) + sum(seen.values()) - both))
    return found


def test_equals_all_windows(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 6)))
    items = {i: " ".join(word() for _ in range(rng.randint(15, 50))) for i in range(30)}
    items |= {90: "one two three", 91: "", 92: items[3], 93: "x y z a b " * 6}
    docs = {}
    for i in range(120):
        body = [word() for _ in range(rng.randint(0, 200))]
        if i % 2:
            passage = items[rng.choice(sorted(items))].split()
            if i % 4 == 1 and len(passage) > 40:  # changed a little: still near
                passage[rng.randrange(len(passage))] = "zzz"
            if i % 8 == 3 and passage:  # cut by half: no longer
                passage = passage[: len(passage) // 2]
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() if i % 3 == 0 else w for w in passage]
        docs[i] = "\n ".join(body)
    df = table(spark, "doc_id long, text string, item_id string, start string", [(k, v, "c", "c") for k, v in docs.items()])
    marks = table(spark, "item_id long, text string, doc_id int", [(k, v, 1) for k, v in items.items()])
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.contaminated(df, marks).collect()}
    want = brute(docs, items)
    assert len(want) > 40 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 0.08 for k in want)  # the best window is one where the item would start


def test_odd_rows(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(None, item), (1, None), (2, ""), (3, item), (3, item), (4, "x " * 30000 + item), (5, item + " " + item)]
    docs = table(spark, "doc_id long, text string", rows)
    marks = table(spark, "item_id long, text string", [(7, item), (7, item), (8, None), (None, "only three words")])
    got = sorted(((r.doc_id, r.item_id, r.similarity, r.start, r.windows) for r in dc.contaminated(docs, marks).collect()), key=str)
    assert got == sorted([(None, 7, 1.0, 0, 1), (3, 7, 1.0, 0, 1), (4, 7, 1.0, 30000, 1), (5, 7, 1.0, 0, 2)], key=str)
    assert dc.contaminated(docs, marks.limit(0)).count() == 0 and dc.contaminated(docs.limit(0), marks).count() == 0


def test_postings_cover_the_radius(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        mark = rng.getrandbits(64)
        other = mark
        for k in rng.sample(range(64), rng.randint(0, dc.RADIUS)):
            other ^= 1 << k
        rows.append((i, *(x - (1 << 64) if x >> 63 else x for x in (mark, other))))
    df = table(spark, "i int, a long, b long", rows)
    shared = F.arrays_overlap(dc.postings(F.col("a"), dc.RADIUS // dc.BLOCKS), dc.postings(F.col("b")))
    assert df.filter(shared).count() == 300


def test_moved_and_repeated_parts(spark):
    """Windows that start where no item would: the end of the item stands first, or parts come twice."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 7)))
    some = lambda n: [word() for _ in range(n)]
    items, docs = {}, {}
    for i, (size, moved) in enumerate([(59, 9), (59, 15), (38, 6), (45, 12), (70, 20)]):
        w = some(size)
        items[i] = " ".join(w)
        docs[10 * i] = " ".join([*some(80), *w[-moved:], *w[:-moved], *some(80)])
        docs[10 * i + 1] = " ".join([*w[-moved:], *w[:-moved]])
        docs[10 * i + 2] = " ".join([*some(40), *w[:10], *w[:-moved], *w[-moved:], *some(2)])
        docs[10 * i + 3] = " ".join([*some(40), *w[5:], *w[:9]])
    table_of = lambda name, rows: table(spark, f"{name} long, text string", list(rows.items()))
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.contaminated(table_of("doc_id", docs), table_of("item_id", items)).collect()}
    want = brute(docs, items)
    assert len(want) >= 15 and want.keys() <= got.keys()
    assert all(got[k] >= want[k] - 1e-9 for k in want)
