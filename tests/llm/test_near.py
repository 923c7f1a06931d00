import hashlib
import random

import numpy as np
import pyarrow as pa

from tablescope.llm import near, shingles
from tablescope.llm.utf8 import column_bytes
from tests_llm_tools import components, near_links, shingle_set, table


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 6)))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 5, 8, 40, 90]))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    # A chain: neighbours alike, ends not.
    chain = [word() for _ in range(80)]
    for _ in range(12):
        texts.append(" ".join(chain))
        at = rng.randrange(80)
        chain[at] = word()
    texts += [texts[0], texts[0].upper(), texts[0].replace(" ", "\n\t "), texts[40] + " "]
    rng.shuffle(texts)
    return texts


def test_components_equal_all_pairs(spark):
    texts = corpus()
    rows = [(i, t, "x", None) for i, t in enumerate(texts)]
    df = table(spark, "doc_id long, text string, component_id string, kept string", rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(df).collect()}
    links = near_links(dict(enumerate(texts)))
    want = components(range(len(texts)), links)
    assert {i: c for i, (_, c, _) in got.items()} == want
    assert all(got[i][0] == len(shingle_set(t)) and got[i][2] == (want[i] == i) for i, t in enumerate(texts))


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t"), (None, "a b c d e f"), (None, "a b c d e f"), (5, long), (6, long + " end"), (7, "só um é dois"), (7, "só um é dois"), (8, "A")]
    got = sorted(
        ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(table(spark, "doc_id long, text string", rows)).collect()),
        key=str,
    )
    assert got == sorted(
        [(None, 0, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 2, None, True), (None, 2, None, True),
         (5, 29996, 5, True), (6, 29997, 5, False), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 8, True)], key=str)
    assert near.near_duplicates(table(spark, "doc_id long, text string", [])).count() == 0


def test_shingles_and_bins():
    texts = corpus(4) + ["", "x", "a b", "a  b", "A\vB c", "é è"]
    data, offsets = column_bytes(pa.array(texts))
    sets = shingles.shingle_sets(data, offsets)
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    alone = [shingles.shingle_sets(*column_bytes(pa.array([t])))[0] for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(sets, alone))
    assert np.array_equal(sets[texts.index("a b")], sets[texts.index("a  b")])
    rng = np.random.default_rng(3)
    same = []
    for _ in range(300):  # the share of equal bins estimates the similarity, also for small sets
        common = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
        a, b = (np.unique(np.append(common, rng.integers(0, 1 << 63, 1, dtype=np.uint64))) << np.uint64(1) for _ in range(2))
        same.append((near.signature(np.sort(a)) == near.signature(np.sort(b))).mean())
    assert abs(np.mean(same) - 6 / 8) < 0.04


def test_links_between_points_of_a_star(spark):
    """Short texts that share a line meet in crowded buckets; pairs among them still come out."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 6)))
    line = [word() for _ in range(16)]
    texts = [" ".join([*(word() for _ in range(rng.randint(3, 9))), *line]) for _ in range(150)]
    texts += [t + " " + word() for t in texts[50:60]] + [word() + " " + t for t in texts[55:65]]
    got = {r.doc_id: r.component_id for r in near.near_duplicates(table(spark, "doc_id long, text string", list(enumerate(texts)))).collect()}
    assert got == components(range(len(texts)), near_links(dict(enumerate(texts))))


def test_different_texts_of_one_doc_id(spark):
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(60))
    a, b, c, d, e, f, g = (text() for _ in range(7))
    rows = [(1, a), (1, b), (5, b), (7, b + " more"), (3, a + " more"), (3, c), (4, c + " end"), (2, d), (2, d + " end"), (6, e), (6, f), (None, f), (None, g), (None, g + " end"), (1 << 62, e)]
    df = table(spark, "doc_id long, text string", rows)
    got = {(r.doc_id, r.text_md5): (r.component_id, r.kept) for r in near.near_duplicates(df).collect()}
    of = lambda doc, body: got[doc, hashlib.md5(body.encode()).hexdigest()]
    assert [of(*row) for row in rows] == [
        (1, True), (1, True), (1, False), (1, False), (1, False), (3, True), (3, False), (2, True), (2, True),
        (6, True), (6, True), (6, False), (None, True), (None, True), (6, False),
    ]
    left = {(r.doc_id, r.text) for r in near.keep_one(df).collect()}
    # No text goes that isn't like one that stays.
    assert left - {(None, g), (None, g + " end"), (2, d), (2, d + " end")} == {(1, a), (1, b), (3, c), (6, e), (6, f)}
    assert len(left) == 7


def test_names_that_clash_with_those_used_inside(spark):
    rows = [(1, "a b c d e f g", "x", "s", 1.5, {"k": 1}), (1, "a b c d e f g", "w", "s", 2.5, None), (2, "other words are here now", "y", None, 0.5, {}), (3, "", "z", "s", 1.0, None)]
    df = table(spark, "doc_id long, text string, node string, digest string, __key double, m map<string,int>", rows)
    kept = near.keep_one(df).collect()
    assert sorted((r.doc_id, r["__key"]) for r in kept) in ([(1, 1.5), (2, 0.5), (3, 1.0)], [(1, 2.5), (2, 0.5), (3, 1.0)])
    again = near.keep_one(df.repartition(7, "node")).collect()
    assert sorted((r.doc_id, r["__key"]) for r in kept) == sorted((r.doc_id, r["__key"]) for r in again) and kept[0].asDict().keys() == set(df.columns)
