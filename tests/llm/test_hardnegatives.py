"""Hard negatives against a plain version: random vectors with ties, odd rows, wide integers, several groups and rounds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.llm import hardnegatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, scores string"


def plain(rows, every=50, positives=5, negatives=3):
    ok = []
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for n, (a, av, al) in enumerate(ok):
        if a % every:
            continue
        score = [sum(x * y for x, y in zip(av, v)) for _, v, _ in ok]
        order = sorted(range(len(ok)), key=lambda i: (-score[i], ok[i][0]))
        for p in [i for i in order if ok[i][2] == al and i != n][:positives]:
            hard = [i for i in order if ok[i][2] != al and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:negatives]
            out += [(a, ok[p][0], k + 1, ok[i][0], score[p], score[i]) for k, i in enumerate(hard)]
    return sorted(out)


def run(spark, rows, every=50, schema=SCHEMA):
    df = spark.createDataFrame([(*r, "clash") for r in rows], schema)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    got = H.mine(df, "vec_id", label, "embedding", F.col("vec_id") % every == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def vectors(n, dim, seed=1, grain=4, labels=10):
    rng = random.Random(seed)
    return [(i, [rng.randint(-grain, 2 * grain) / grain for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


def test_strassen_is_exact():
    rng = np.random.default_rng(3)
    for m, k, n in ((1, 1, 1), (3, 5, 7), (17, 64, 33), (40, 100, 70), (64, 64, 64), (5, 0, 4), (0, 3, 4)):
        a, c = rng.integers(-2 ** 20, 2 ** 20, (m, k)), rng.integers(-2 ** 20, 2 ** 20, (n, k))
        for leaf in (1, 4, 16):
            assert (H.strassen(a, c, leaf) == a @ c.T).all()
    a = np.array([[2 ** 70, -3], [1, 5]], object)
    assert (H.strassen(a, a, 1) == a @ a.T).all()


@pytest.mark.parametrize("tile,anchors,fan", [(4096, 256, 64), (64, 3, 2), (7, 1, 3)])
def test_random_vectors_with_ties(spark, monkeypatch, tile, anchors, fan):
    for name, v in (("TILE", tile), ("ANCHORS", anchors), ("FAN", fan)):
        monkeypatch.setattr(H, name, v)
    rows = vectors(300, 6)
    assert run(spark, rows, every=10) == plain(rows, every=10) != []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(60, 5, seed=2) + [
        (100, None, 1), (150, [], 1), (200, [1.0], 2), (250, [1.0, None, 2.0, 0.0, 0.0], 3), (300, [nan, 1.0], 3),
        (350, [inf, 1.0], 1), (400, [1.0] * 5, None), (None, [1.0] * 5, 1), (450, [0.5] * 9, 4), (-50, [1.0] * 5, 4),
        (50, [2.0] * 5, 5)] + [(500, [0.25] * 5, 6)] * 3 + [(501 + i, [0.3] * 5, 6 + i % 2) for i in range(9)]
    assert run(spark, rows) == plain(rows) != []


def test_one_label_and_empty(spark):
    rows = [(i, [1.0, 2.0], 1) for i in range(1, 7)] + [(50, [1.0, 1.0], 1)]
    assert run(spark, rows) == plain(rows) == []
    assert run(spark, []) == []


def test_wide_integers(spark):
    """Components beyond 16, 31 and 63 bits, and scores whose window products leave 64 bits."""
    schema = SCHEMA.replace("float", "double")
    for grain in (2.0 ** 12, 2.0 ** 19, 2.0 ** 20):
        rows = [(i, [float(v) * grain for v in x], label) for i, x, label in vectors(120, 3, seed=4)]
        assert run(spark, rows, schema=schema, every=10) == plain(rows, every=10) != []
    for far in (2.0 ** 30, 2.0 ** 70):  # meets zeros only
        rows = [(i, [0.0, *x], label) for i, x, label in vectors(120, 3, seed=5)] + [(1001, [far, 1.0, 1.0, 0.5], 3)]
        assert run(spark, rows, schema=schema, every=10) == plain(rows, every=10) != []


def test_hot_label(spark, monkeypatch):
    monkeypatch.setattr(H, "TILE", 50)
    rows = [(i, v, 3 if i % 3 else label) for i, v, label in vectors(250, 4, seed=6)]
    assert run(spark, rows) == plain(rows) != []
