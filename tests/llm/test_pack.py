import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tablescope.llm import pack
from tests_llm_tools import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", "a\n\nb", " x", "x ", "a \n b", "a\n b\t c", "\n", "é b c", "it's <|endoftext|> ok", "<|endoftext|>", "a\n<|endoftext|>b", " <|endoftext|> ", "a\nb\nc", "a b c",
       "a \x1c b", "a\n", "\na b", "\n a", "a\r\nb c", "日本 語 12 3.4", "a   b"]


def plain():
    return Tokenizer.from_file(PATH)


def test_ids_equal_whole_texts():
    want = [plain().encode(t, add_special_tokens=False).ids for t in ODD]
    encode = pack.Encoder(PATH)
    assert encode.ranked and [np.frombuffer(ids, "<u4").tolist() for ids in encode(ODD)] == want
    encode.ranked = None
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encode(ODD)] == want


def test_ids_of_all_code_points_and_random_texts():
    encode, whole = pack.Encoder(PATH), plain()
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b 1{c}2 {c}{c} {c}." for c in points[k : k + 16]) for k in range(0, len(points), 16)]
    rng = random.Random(7)
    bits = ["a", "Z", "é", " ", "  ", "\n", "\t", "1", "23", "'s", "'ll", "'", "_", "<|", "endoftext", "|>", "<|endoftext|>", "\u3000", "日", "\u0301", "😀", ".", "\x00", "\r\n", "word"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(20000)]
    want = [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encode(texts)] == want


def test_other_tokenizer_files_are_used_as_they_are():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, whole = pack.Encoder(path), Tokenizer.from_file(path)
    texts = ["Some Words  here", "", "<|endoftext|>"]
    assert encode.ranked is None
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_differencing():
    assert sorted(np.bincount(pack.difference(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]  # the textbook result
    rng = np.random.default_rng(2)
    for n, k in ((0, 3), (1, 4), (7, 1), (400, 40), (60, 9)):
        sizes = rng.integers(1, 513, n)
        window = pack.difference(sizes, k)
        assert len(window) == n and (n == 0 or window.max() < k)
        if n == 400:
            sums = np.bincount(window, weights=sizes, minlength=k)
            assert sums.max() - sums.min() < 30
    sizes = np.array([1500] * 5)
    assert sorted(np.bincount(pack.deal(sizes), weights=sizes)) == [1500] * 5  # the count rises until none is too full


def test_cuts():
    for n in (1, 2, 511, 512, 513, 2047, 2048, 2049, 9000):
        found = pack.cuts(n)
        assert [a for a, _ in found] == list(np.cumsum([0, *(b for _, b in found)]))[:-1]
        assert sum(b for _, b in found) == n and all(b == 2048 or b <= 512 for _, b in found)


def test_every_id_once(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "longerword"]) for _ in range(rng.randint(1, 1500))) for _ in range(120)]
    rows = [(i, t, 5) for i, t in enumerate(texts + ODD + ["word " * 40000])] + [(None, None, 1), (None, None, 1), (3, texts[3], 9)]
    got = pack.pack(table(spark, "doc_id long, text string, offset int", rows), PATH).collect()
    spans, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        spans[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for key, text, _ in rows:
        ids = np.array([*plain().encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[key] += [(s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for s, n in pack.cuts(len(ids))]
    assert {k: sorted(v) for k, v in spans.items()} == {k: sorted(v) for k, v in want.items()}
    for places in sequences.values():
        places.sort()
        assert [a for a, _ in places] == list(np.cumsum([0, *(b for _, b in places)]))[:-1] and sum(b for _, b in places) <= 2048
    tokens = sum(r.length for r in got)
    assert tokens > 0.9 * 2048 * len(sequences)
    assert pack.pack(table(spark, "doc_id long, text string", []), PATH).count() == 0


def test_full_sequences_need_no_group(spark):
    """Documents of whole sequences are not brought together; every sequence has a number of its own."""
    ids = len(plain().encode("word " * 8191, add_special_tokens=False).ids) + 1
    assert ids % 2048 in (0, 1)
    docs = table(spark, "doc_id long, text string", [(i, "word " * 8191) for i in range(60)] + [(100, "a b c")]).repartition(8)
    out = pack.pack(docs, PATH)
    rows = out.collect()
    full = [r for r in rows if r.length == 2048]
    assert len(full) >= 60 * 4 and len({r.sequence_id for r in full}) == len(full)
    assert not {r.sequence_id for r in full} & {r.sequence_id for r in rows if r.length < 2048}
