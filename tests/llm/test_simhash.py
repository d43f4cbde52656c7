import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from calibra.llm import simhash


def plain(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, ids, distance=3):
    n = len(fps)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    out = {}
    for i in range(n):
        out.setdefault(find(i), []).append(ids[i])
    least = {k: min(v) for k, v in out.items()}
    return [least[find(i)] for i in range(n)]


def near_texts(seed=1):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "One", "one two", "A b c É", "a b c", "A B C"]
    base = ["w%d" % rng.randrange(900) for _ in range(400)]
    for k in range(30):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(400)] = "zz%d" % k
        texts.append(" ".join(w))
    return texts + [" ".join("v%d" % rng.randrange(50) for _ in range(rng.randint(0, 40))) for _ in range(30)]


def test_fingerprint_rule(spark):
    for t in near_texts():
        assert simhash.fingerprint(t) & (1 << 64) - 1 == plain(t)
    h = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert h == np.int64(np.uint64(xxhash.xxh64_intdigest(b"a b c", 42)))


def test_components_match_brute_force(frame):
    texts = near_texts()
    d = simhash.near_duplicates(frame(texts, clash=("fp", "node", "component_id"))).withColumn("x", simhash.hex_digits(F.col("fp")))
    rows = {r.doc_id: r for r in d.collect()}
    fps = [plain(t) for t in texts]
    assert [rows[i].x for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [rows[i].component_id for i in range(len(texts))] == brute(fps, list(range(len(texts))))


def test_links_of_random_clusters(spark, monkeypatch):
    rng = random.Random(9)
    fps = set()
    for _ in range(8):
        c = rng.getrandbits(64)
        fps.add(c)
        for _ in range(40):  # chains of few flips: some links, some just beyond
            c ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 4))) & (1 << 64) - 1
            fps.add(c)
    fps = sorted(fps)
    want = brute(fps, list(range(len(fps))))
    df = spark.createDataFrame([(int(np.int64(np.uint64(f))),) for f in fps], "fp long")
    # tallied at once, after refining, and under all guaranteed bytes: member by member and by neighbouring values
    for longest, pairwise in ((512, 1024), (20, 1024), (1, 1024), (1, 0)):
        monkeypatch.setattr(simhash, "LIST", longest)
        monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
        root = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
        signed = [int(np.int64(np.uint64(f))) for f in fps]
        groups = {}
        for f, c in zip(signed, want):
            groups.setdefault(c, set()).add(root.get(f, f))
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
    v = np.array(signed, np.int64)
    monkeypatch.setattr(simhash, "PAIRWISE", 1024)
    a = {frozenset(x) for x in simhash._links(v, 3)}
    monkeypatch.setattr(simhash, "PAIRWISE", 0)
    b = {frozenset(x) for x in simhash._links(v, 3)}
    assert len(a) == len(b)  # spanning forests of the same components


def test_no_row_meets_a_long_list_in_one_task_only(spark, monkeypatch):
    """Lists that go on over several Arrow batches, tallied or handed on."""
    monkeypatch.setattr(simhash, "LIST", 30)
    rng = random.Random(3)
    fps = {rng.getrandbits(16) << 40 | 7 << 8 | rng.getrandbits(3) for _ in range(400)}
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    want = brute(sorted(fps), sorted(fps))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        root = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [root.get(f, f) for f in sorted(fps)] == want


def test_hot_and_other_fingerprints(frame, monkeypatch):
    texts = near_texts() + ["hot text of some words"] * 50
    want = brute([plain(t) for t in texts], list(range(len(texts))))
    for share in (1.0, 0.2, 1e-9):
        monkeypatch.setattr(simhash, "HOT_SHARE", share)
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(texts)).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_long_chain_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in simhash.components(chain).collect()} == {0}


def test_keep_one_and_edges(spark, frame):
    texts = near_texts()
    want = brute([plain(t) for t in texts], list(range(len(texts))))
    kept = simhash.keep_one(frame(texts, clash=("fp",)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and "fp" in kept.columns
    assert simhash.near_duplicates(frame([])).collect() == []
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "q w e"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(rows).collect())
    assert got == [(-1, -1), (-1, -1), (1, 1), (1, 1)]
    assert simhash.keep_one(rows).count() == 3
