import math
import random
from collections import Counter

from tablescope.llm import lm
from tests_llm_tools import table, words


def brute(docs, targets, size):
    """Both models over plain dictionaries of words."""
    every = Counter(w for _, t in docs for w in words(t))
    known = {w for w, n in every.items() if n > sorted(every.values(), reverse=True)[size]} if len(every) > size else set(every)
    cut = [(k, [w if w in known else "<unk>" for w in words(t)]) for k, t in docs]
    total, scores = len(known) + 2, []
    models = []
    for chosen in ([d for k, d in cut if k in targets], [d for _, d in cut]):
        pairs = Counter(p for d in chosen for p in zip(["<s>", *d], d))
        uni, before, kinds = Counter(w for d in chosen for w in d), Counter(), Counter()
        for (a, _), n in pairs.items():
            before[a] += n
            kinds[a] += 1
        models.append((pairs, uni, before, kinds, sum(uni.values())))
    for k, d in cut:
        means = []
        for pairs, uni, before, kinds, n in models:
            loss = 0
            for a, b in zip(["<s>", *d], d):
                low = (uni[b] + 1) / (n + total)
                p = max(pairs[a, b] - 0.75, 0) / before[a] + 0.75 * kinds[a] / before[a] * low if before[a] else low
                loss -= math.log(p)
            means.append(loss / len(d) if d else 0)
        scores.append((k, len(d), *means))
    return scores


def corpus():
    rng = random.Random(2)
    names = [f"w{i}" for i in range(30)]
    weight = [2.0**-i for i in range(30)]
    docs = []
    for i in range(80):
        order = names if i % 4 else names[::-1]
        docs.append((i, " ".join(rng.choices(order, weight, k=rng.randint(1, 60)))))
    return docs, set(range(0, 40, 4))


def test_equals_plain_models(spark):
    docs, targets = corpus()
    size = next(s for s in (12, 11, 10, 9) if len(set(sorted(Counter(w for _, t in docs for w in words(t)).values(), reverse=True)[s - 1 : s + 1])) == 2)
    df = table(spark, "doc_id long, text string, score string", [(k, t, "c") for k, t in docs]).repartition(3)
    got = {r.doc_id: r for r in lm.cross_entropy_difference(df, table(spark, "doc_id long", [(t,) for t in targets]), size).collect()}
    for k, n, target, background in brute(docs, targets, size):
        assert got[k].n_words == n
        assert abs(got[k].target_loss - target) < 1e-4 and abs(got[k].background_loss - background) < 1e-4
    # Held out: the others of the target's kind score lower than the rest.
    like = [got[k].score for k in range(40, 80, 4)]
    unlike = [got[k].score for k in range(41, 80) if k % 4]
    assert sorted(like)[len(like) // 2] < sorted(unlike)[len(unlike) // 2]


def test_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "a " * 60000)]
    df = table(spark, "doc_id long, text string", rows)
    targets = table(spark, "doc_id long", [(3,), (3,), (None,)])
    got = lm.cross_entropy_difference(df, targets).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted([("None", 2), ("1", 0), ("2", 0), ("3", 3), ("3", 3), ("4", 60000)])
    assert all(r.score == 0 for r in got if r.n_words == 0)
    assert {r.score for r in lm.cross_entropy_difference(df, targets.limit(0)).collect()} == {0.0}
    assert lm.cross_entropy_difference(df.limit(0), targets).count() == 0


def test_every_word_has_its_own_counts(spark):
    """More words than any fixed vocabulary holds, common bigrams and rare ones."""
    rng = random.Random(5)
    docs = [(i, " ".join([rng.choice(["a b", "b a"]), *(f"r{rng.randrange(6000)}" for _ in range(60))])) for i in range(150)]
    targets = set(range(0, 150, 3))
    df = table(spark, "doc_id long, text string", docs).repartition(3)
    marks = table(spark, "doc_id long", [(t,) for t in targets])
    got = {r.doc_id: r for r in lm.cross_entropy_difference(df, marks).collect()}
    assert len({w for _, t in docs for w in words(t)}) > 4000 and len(got) == 150
    for k, n, target, background in brute(docs, targets, 1 << 20):
        assert got[k].n_words == n
        assert abs(got[k].target_loss - target) < 1e-4 and abs(got[k].background_loss - background) < 1e-4


def test_common_words_and_bigrams_travel_otherwise_with_the_same_result(spark):
    """A bigram and a word before that hold a third of all words, dealt to ranges of about 200 bigrams."""
    rng = random.Random(7)
    docs = [(i, "a b " * rng.randint(5, 20) + " ".join(rng.choice(["a", "c", f"r{rng.randrange(3000)}"]) for _ in range(50))) for i in range(120)]
    targets = set(range(0, 120, 5))
    df = table(spark, "doc_id long, text string", docs).repartition(5)
    marks = table(spark, "doc_id long", [(t,) for t in targets])
    flagged = df.selectExpr("text", "doc_id % 5 = 0 AS is_target")
    plan, every, of_targets = lm.common(flagged, sample=1, size=200)
    assert every == sum(len(words(t)) for _, t in docs) and of_targets == sum(len(words(t)) for i, t in docs if i in targets)
    assert len(plan.pairs) > 3 and plan.parts.max() > 5 and plan.ranges > 20
    for sample, size in ((1, 200), (3, 500)):
        got = {r.doc_id: r for r in lm.cross_entropy_difference(df, marks, sample=sample, range_size=size).collect()}
        assert len(got) == 120
        for k, n, target, background in brute(docs, targets, 1 << 20):
            assert got[k].n_words == n
            assert abs(got[k].target_loss - target) < 1e-5 and abs(got[k].background_loss - background) < 1e-5


def test_blocks_come_back(spark):
    """A round trip of bigrams of rows through blocks, with codes of common and other words."""
    rng = random.Random(3)
    rows = [(rng.choice([0, 5, 9 + (1 << 63)]), rng.choice([1, 2, 3 + (1 << 63), (1 << 64) - 1]), rng.randrange(6)) for _ in range(400)]
    rows.sort(key=lambda r: r[2])
    columns = [lm.np.array(c, kind) for c, kind in zip(zip(*rows), ("u8", "u8", "i8"))]
    got = Counter()
    for place, block in lm._pair_blocks((columns[0] % 3).astype(int), *columns):
        before, words_of, sizes, *of = lm._pairs_of(block)
        for before, word, row, n in zip(*(c.tolist() for c in (lm.np.repeat(before, sizes), lm.np.repeat(words_of, sizes), *of))):
            assert before % 3 == place
            got[before, word, row] += n
    assert got == Counter(rows)


def test_many_targets_are_joined_instead_of_broadcast(spark, monkeypatch):
    """Text ids, clashing names, a hot id and ids of no document; the same result both ways."""
    docs = [(None if i == 7 else f"d{i % 9}" if i < 30 else "hot", f"a b w{i} w{i % 5}" if i % 6 else None, i, "x") for i in range(60)]
    df = table(spark, "doc_id string, text string, row long, block string", docs).repartition(4)
    targets = table(spark, "doc_id string, word string", [("hot", "x"), ("d3", "x"), ("none", "x"), (None, "x"), ("d3", "y")])
    names = ["doc_id", "n_words", "target_loss", "background_loss", "score"]
    broadcast = lm.cross_entropy_difference(df, targets)
    assert broadcast.columns == names
    monkeypatch.setattr(lm, "FEW_TARGETS", 0)
    joined = lm.cross_entropy_difference(df, targets)
    key = lambda rows: sorted((str(r.doc_id), r.n_words, round(r.target_loss, 4), round(r.background_loss, 4)) for r in rows)
    assert key(joined.collect()) == key(broadcast.collect()) and joined.count() == 60
