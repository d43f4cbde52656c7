import hashlib
import random

import pytest
from pyspark.sql import functions as F

from calibra.llm import suffix


def brute(texts, length=200):
    """Every window of every text in one dictionary; bytes covered by a window seen twice go."""
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for x in raw:
        for s in range(len(x) - length + 1):
            seen[x[s:s + length]] = seen.get(x[s:s + length], 0) + 1
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for s in range(len(x) - length + 1):
            if seen[x[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def run(df, **kw):
    d = suffix.remove_repeats(df, **kw)
    return {r.doc_id: (r.n_bytes, sum(s.b - s.a for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
            for r in d.collect()}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß ") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(60), text(45)
    texts = [None, "", "short", "a" * 900, "ab" * 400, text(300), passage, passage + " x"]
    for i in range(12):
        texts.append(text(rng.randint(0, 60)) + passage[rng.randint(0, 40):] + text(rng.randint(0, 50)))
        texts.append(text(30) + other[:rng.randint(180, 230)] + text(30) + other[rng.randint(0, 9):])
    base = text(200).split(" ")
    for i in range(10):  # near copies
        w = list(base)
        w[rng.randrange(len(w))] = "zz"
        texts.append(" ".join(w))
    texts += [texts[5], texts[5], passage, "é" * 150]  # exact copies
    return texts


@pytest.mark.parametrize("group", [50_000, 3])
def test_matches_brute_force(frame, group):
    texts = corpus()
    got = run(frame(texts, clash=("k1", "body", "h")), group=group)
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_other_lengths_and_blocks(frame, monkeypatch):
    texts = corpus(5)
    monkeypatch.setattr(suffix, "_BLOCK", 256)
    got = run(frame(texts), length=90, gram=24)
    assert [got[i] for i in range(len(texts))] == brute(texts, 90)


def test_empty_table_and_repeated_rows(spark, frame):
    assert run(frame([])) == {}
    t = corpus(7)[5]
    d = spark.createDataFrame([(1, t), (1, t), (None, "x"), (None, None)], "doc_id long, text string")
    rows = suffix.remove_repeats(d).select("doc_id", F.length("kept").alias("k")).collect()
    assert sorted((r.doc_id is None, r.k) for r in rows) == [(False, 0), (False, 0), (True, 0), (True, 1)]


def test_deep_shallow_sorts():
    rng = random.Random(1)
    for _ in range(50):
        some = list({bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(rng.randint(1, 60))})
        assert suffix.deep_shallow(some, 0, rng.choice([0, 8, 16])) == sorted(some)
