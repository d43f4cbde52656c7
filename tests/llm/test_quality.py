import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from calibra.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t", "one two", "a b c d e a b c d e", "x " * 300, "a\nb\na\n \n \na\r\nb", "é ß\x0bü #*$%&|<> \x85 \xa0x",
         "The the THE " * 7 + "end", "lines\n" * 40, " ".join(f"w{i % 97}" for i in range(2500))]


def test_counts_match_plain_python(frame):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    d = quality.measure(frame(texts, clash=("n_words", "stratum")))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r.doc_id: tuple(r["__q"][f] for f in fields) for r in d.select("doc_id", "__q").collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]


@pytest.mark.parametrize("n,k,p", [(1, 0, .01), (50, 0, .05), (955, 3, .0083), (10_000, 80, .01), (2_000_000, 19_800, .01),
                                   (300, 3, .01), (20, 9, .3)])
def test_binomial_tail(spark, n, k, p):
    row = spark.range(1).select(quality.binomial_at_most(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()
    terms = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)
             for j in range(k + 1)]
    top = max(terms)
    want = 1.0 if k > n * p else math.exp(top) * sum(math.exp(t - top) for t in terms)
    assert row[0] == pytest.approx(want, rel=1e-6)


def labelled(spark, n=6000, seed=1):
    """Good prose, and junk with symbols; a few labels are wrong, some missing, one stratum is too small to certify."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        w = ["w%d" % rng.randrange(4000) for _ in range(30)]
        text = " ".join(x + ("###" if bad else "") for x in w)
        lang = "en" if i % 3 else ("de" if i % 2 else "fr") if i > 60 else None
        rows.append((i, text, lang))
        if rng.random() < 0.9:
            labels.append((i, None if rng.random() < .02 else int(not bad)))
    labels += labels[:50]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4),
            spark.createDataFrame(labels, "doc_id long, quality int"))


def brute_cutoffs(docs, labels):
    """The selection rule in plain Python on the measured counts."""
    good = {}
    for r in labels.collect():
        if r.quality is not None:
            good[r.doc_id] = min(r.quality, good.get(r.doc_id, 1))
    rows = [r for r in quality.measure(docs).select("doc_id", "lang", "__q").collect() if r.doc_id in good]
    rows = [r for r in rows if r["__q"].n_words >= 10 and 100 * r["__q"].n_repeat_words <= 20 * r["__q"].n_words]
    strata = {r.lang for r in rows}
    size = max(map(len, quality.GRID.values())) * len(quality.GRID)
    alpha = quality.ALPHA / len(quality.GRID)
    value = {"symbols_per_word": ("n_symbols", "n_words"), "upper_share": ("n_upper", "word_chars"),
             "shouts_per_word": ("n_shouts", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
             "repeat_word_share": ("n_repeat_words", "n_words"), "chars_per_word": ("word_chars", "n_words")}
    out = {}
    for s in strata:
        for rule, cuts in quality.GRID.items():
            a, b = value[rule]
            v = [(r["__q"][a] / max(1, r["__q"][b]), good[r.doc_id]) for r in rows if r.lang == s]
            n = sum(g for _, g in v)
            best = None
            for c in cuts:
                k, hit = sum(g for x, g in v if x > c), sum(1 - g for x, g in v if x > c)
                p = sum(math.comb(n, j) * alpha ** j * (1 - alpha) ** (n - j) for j in range(k + 1)) if k <= n * alpha else 1
                worth = hit - quality.GOOD_WEIGHT * k
                if p <= quality.DELTA / (len(strata) * size) and worth > 0 and (best is None or (worth, c) > best):
                    best = (worth, c)
            if best:
                out.setdefault("" if s is None else "=" + s, {})[rule] = best[1]
    return out


def test_cutoffs_match_brute_force_and_hold_the_risk(spark):
    docs, labels = labelled(spark)
    cuts = quality.cutoffs(quality.measure(docs), labels)
    got = {r.stratum: dict(r.cut) for r in cuts.collect()}
    assert got == brute_cutoffs(docs, labels) and "=en" in got and "" not in got
    kept = {r.doc_id for r in quality.filter_documents(docs, labels).collect()}
    junk = {r.doc_id for r in docs.collect() if "#" in r.text}
    en = {r.doc_id for r in docs.collect() if r.lang == "en"}
    assert not kept & junk & en and len(kept & en) == len(en - junk)


def test_without_labels_and_rows(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    d = frame([None, "", "a b c d e f g h i j k"], clash=("stratum", "cut"))
    kept = quality.filter_documents(d, labels)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [2]
    assert quality.filter_documents(frame([]), labels).collect() == []
