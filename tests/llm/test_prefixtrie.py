"""The conversation trie against a plain version: given tables, odd rows, long conversations, copies, rounds of all shapes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from calibra.llm import prefixtrie as T
from calibra.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth string"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, rebuilt=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = convs.get(base, [])[:h] + own[h:] if rebuilt else own
    member = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            member[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in member:
        if p:
            kids[p[:-1]].append(p)
    total = {}
    for p in sorted(member, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves, saved = (0 if kids[p] else 1), (len(member[p]) - 1) * words
        for k in kids[p]:
            leaves, saved = leaves + total[k][0], saved + total[k][1]
        total[p] = leaves, saved
    ends = {p: ",".join(map(str, sorted(c for c in cs if len(whole[c]) == len(p)))) for p, cs in member.items()}
    return sorted((min(cs), len(p), min(member[p[:-1]]) if p else None, len(cs), len(kids[p]), *total[p],
                   hashlib.sha256(ends[p].encode()).hexdigest()) for p, cs in member.items())


def key(rows):
    return sorted(rows, key=lambda r: r[:2])


def run(spark, rows, rebuilt=True):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return key(map(tuple, (T.rebuilt_trie if rebuilt else T.conversation_trie)(df).select(*COLS).collect()))


def test_given_table(spark):
    for path in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        got = key(map(tuple, QUERIES["op12_prefixtrie"](spark, path).select(*COLS).collect()))
        assert got == key(plain(rows))


def shaped(seed, n):
    """Conversations that share prefixes, some of them whole copies, some prefixes of others."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c * rng.choice([1, 7]), t * 3, rng.choice(["u", "a"][:1 + t % 2]), rng.choice(["x y", "z"][:1 + (t > 6)])))
    return rows


@pytest.mark.parametrize("rebuilt", [True, False])
def test_shared_prefixes(spark, rebuilt):
    rows = shaped(1, 60)
    assert run(spark, rows, rebuilt) == key(plain(rows, rebuilt))


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, "u", "b"), (1, 0, "u", "a b  c\t\n"), (1, 0, "u", "a b  c\t\n"), (1, -5, "", ""),
            (None, 0, "u", "lost"), (-7, 2, "u", "x"), (-7, 1, None, " "), (-20, 0, "u", "base"), (2, 0, "a", "bu"), (3, 0, "ab", "u"),
            (20, 5, "u", "word " * 3000), (21, 5, "u", "word " * 3000), (39, 9, "é", "漢 字")]
    assert run(spark, rows) == key(plain(rows))
    assert run(spark, rows, False) == key(plain(rows, False))


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "u", "a")]) == []


def test_long_and_hot_conversations(spark, monkeypatch):
    """One conversation over many pieces, its copy that ends early, and many exact copies over several id pieces."""
    monkeypatch.setattr(T, "PIECE_BITS", 3)
    monkeypatch.setattr(T, "LIST_BITS", 2)
    rng = random.Random(8)
    texts = [rng.choice(["a", "b b", "c"]) for _ in range(120)]
    rows = [(4, t, "u", x) for t, x in enumerate(texts)] + [(400, t, "u", x) for t, x in enumerate(texts[:70])]
    rows += [(1000 + 3 * i, t, "a", "same words here") for i in range(40) for t in range(3)]
    assert run(spark, rows, False) == key(plain(rows, False))
    assert run(spark, rows) == key(plain(rows))
