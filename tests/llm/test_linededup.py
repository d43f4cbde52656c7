import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from calibra.llm import linededup


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        site = rng.choice([None, "a", "a", "a", "b", "c"])
        text = [rng.choice(["menu", " menu", "é foot", "", "  ", "\t"]) if rng.random() < .3 else f"line {rng.randrange(400)}"
                for _ in range(rng.randint(0, 12))]
        rows.append((i, rng.choice([None, ""]) if rng.random() < .05 else "\n".join(text), site))
    return rows


def brute(rows, ratio, least):
    pages, has = defaultdict(int), defaultdict(int)
    for t, s in {(t or "", s) for _, t, s in rows}:
        pages[s] += 1
        for x in set(t.split("\n")):
            if x.strip(" \t\n\x0b\x0c\r"):
                has[s, x] += 1
    bad = {k for k, n in has.items() if n >= least and n > ratio * pages[k[0]]}
    out = {}
    for i, t, s in rows:
        own = [] if t is None else t.split("\n")
        left = [x for x in own if (s, x) not in bad]
        out[i] = (t if len(left) == len(own) else "\n".join(left), len(own), len(own) - len(left))
    return out


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_matches_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(linededup, "BROADCAST_LINES", broadcast)
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lines", F.lit("clash"))
    for ratio, least in ((0.05, 5), (0.02, 2)):
        got = {r.doc_id: (r.text, r["__n_lines"], r["__n_dropped"])
               for r in linededup.drop_boilerplate(d, ratio=ratio, min_pages=least).collect()}
        assert got == brute(rows, ratio, least)


def test_empty(frame):
    assert linededup.drop_boilerplate(frame([])).collect() == []


def test_copies_of_one_text_keep_their_lines(spark):
    """A text on most pages of its site is one page; a line of many different pages is still boilerplate."""
    rows = [(i, "own line\nsecond line", "a") for i in range(60)]
    rows += [(100 + i, f"menu\npage {i}", "a") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in linededup.drop_boilerplate(d).collect()}
    assert all(got[i] == "own line\nsecond line" for i in range(60))
    assert all(got[100 + i] == f"page {i}" for i in range(40))
