import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from calibra.llm import packing
from calibra.llm.common import stored
from calibra.llm.queries import vocabulary

TEXTS = [None, "", "  \n", "Hello, it's we'll 'tis!!", "naïve Ünïcode ÀÉ ß × 12.5", "<|endoftext|> x", "日本語 テスト",
         "a\x1cb c", "Σίσυφος ΟΔΟΣ", "word " * 9000, "x" * 30000, "same text", "same text"]


def test_word_ids_equal_the_tokenizer():
    w = packing.word_ids(vocabulary())
    rng = random.Random(4)
    some = ["".join(rng.choice("abÀé'ß!-., \n\tStdre ve1") for _ in range(60)) for _ in range(400)]
    for t in [t or "" for t in TEXTS] + some:
        assert w.ids([t])[0].tolist() == w.tokenizer.encode(t, add_special_tokens=False).ids


def brute(lengths, window):
    """Best fit, decreasing, one piece at a time: the sorted remaining capacities."""
    left = []
    for n in sorted(lengths, reverse=True):
        fit = [(c, i) for i, c in enumerate(left) if c >= n]
        if fit:
            left[min(fit)[1]] -= n
        else:
            left.append(window - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([1, 7, 64])
    counts = {rng.randint(1, window): rng.randint(1, 12) for _ in range(25)}
    made, windows = packing.best_fit(counts, window)
    bins = defaultdict(list)
    for length, r, n, m, first, offset in made:
        for j in range(n):
            k, i = divmod(j, m)
            bins[first + k].append((offset + i * length, length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(bins) == list(range(windows))
    got = sorted(window - sum(n for _, n in p) for p in bins.values())
    assert got == brute([k for k, n in counts.items() for _ in range(n)], window)


def test_pack_round_trip(frame):
    piece = stored(packing.pieces(frame(TEXTS, clash=("length", "offset", "__rank")), vocabulary(), window=256))
    rows = packing.pack(piece, 256).collect()
    w = packing.word_ids(vocabulary())
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for i, t in enumerate(TEXTS):
        want = w.encode(t or "").astype("<u4").tobytes() + (2).to_bytes(4, "little")
        parts = sorted(docs[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in parts) == want
        assert [r.start for r in parts] == [256 * k for k in range(len(parts))]
        assert all(r.length == len(r.ids) // 4 and r.doc_tokens == len(want) // 4 for r in parts)
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert sorted(bins) == list(range(len(bins)))
    short = [r.length for r in rows if r.length < 256]
    assert len(bins) == len(brute(short, 256)) + sum(r.length == 256 for r in rows)


def test_digest_and_sequences(frame):
    piece = stored(packing.pieces(frame(["one two", "three"]), vocabulary()))
    d = {r.doc_id: r.ids_crc32 for r in packing.digest(piece).collect()}
    assert d == {r.doc_id: zlib.crc32(bytes(r.ids)) for r in piece.collect()}
    (s,) = packing.sequences(packing.pack(piece)).collect()
    assert s.n_tokens == 5 and len(s.ids) == 20


def test_empty_and_null_ids(spark, frame):
    assert packing.pack_documents(frame([]), vocabulary()).collect() == []
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (3, "b"), (3, "b")], "doc_id long, text string")
    got = packing.pack_documents(rows, vocabulary()).collect()
    assert sorted((r.sequence_id, r.offset) for r in got) == [(0, 0), (0, 2), (0, 4), (0, 6)]
