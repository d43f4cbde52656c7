"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Every document gets a few counts. Hard base rules reject first. Beyond them each rule has a fixed grid of cutoffs; in
every stratum (language) and for every rule, labelled documents decide which cutoffs are safe: with K of n good
documents rejected, a cutoff is certified if an exact binomial test rules out a false rejection rate above
``alpha / rules`` at level ``delta / (strata * rules * cutoffs)`` (Bonferroni, so that any choice among certified
cutoffs is covered and the union of all rules rejects at most ``alpha`` of a stratum's good documents, with probability
1 - delta over all strata). Among certified cutoffs the one that best separates the labelled bad from the good is
used; without a certified one the rule does not apply in that stratum. Counts and labels are all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
ALPHA, DELTA = 0.05, 0.05
#: A wrongly rejected good document weighs as much as this many rejected bad ones in the choice of a cutoff.
GOOD_WEIGHT = 20
#: Strata up to which the table of cutoffs is broadcast (a few hundred bytes each).
BROADCAST_STRATA = 10_000

#: Rule -> ascending cutoffs; a document is rejected when its value exceeds the cutoff.
GRID = {
    "symbols_per_word": [0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.5],
    "upper_share": [0.1, 0.2, 0.3, 0.45, 0.6, 0.8],
    "shouts_per_word": [0.05, 0.1, 0.25, 0.5, 0.9],
    "dup_line_share": [0.1, 0.2, 0.3, 0.5, 0.7],
    "repeat_word_share": [0.02, 0.05, 0.1, 0.15],
    "chars_per_word": [7.5, 8.5, 10.0, 12.0, 16.0],
}
MADE = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_shouts"]


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus a struct column ``__q`` of the counts (longs). A null text counts as empty.

    Repeated words are found inside the row: windows are hashed; only a text with a repeated window goes on to
    sort (hash, position) pairs, flag equal neighbours and add up the positions their windows cover.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("__t", t).withColumn("__w", F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)))
    d = d.withColumn("__n", F.size("__w"))
    d = d.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    grams = F.transform(F.sequence(F.lit(0), F.col("__n") - WINDOW),
                        lambda i: F.xxhash64(*[F.get(F.col("__h"), i + k) for k in range(WINDOW)]))
    none = F.array().cast("array<bigint>")
    d = d.withColumn("__g", F.when(F.col("__n") >= WINDOW, grams).otherwise(none))
    d = d.withColumn("__g", F.when(F.size(F.array_distinct("__g")) < F.size("__g"), F.col("__g")).otherwise(none))
    d = d.withColumn("__s", F.array_sort(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))

    def twin(x, j):
        same = [F.coalesce(F.get(F.col("__s"), j + k)["h"] == x["h"], F.lit(False)) for k in (-1, 1)]
        return same[0] | same[1]

    d = d.withColumn("__p", F.array_sort(F.transform(F.filter("__s", twin), lambda x: x["i"])))
    d = d.withColumn("__c", F.transform("__p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(
        F.get(F.col("__p"), j + 1) - p, F.lit(WINDOW)))))
    d = d.withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    q = {
        "n_words": F.col("__n"),
        "word_chars": F.length(F.array_join("__w", "")),
        "n_symbols": F.length("__t") - F.length(F.translate("__t", SYMBOLS, "")),
        "n_lines": F.size("__l"),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": F.aggregate("__c", F.lit(0), lambda a, x: a + x),
        "n_upper": F.length("__t") - F.length(F.translate("__t", UPPER + "ÀÂÄÇÈÉÊËÎÏÍÑÓÖÔÙÚÛÜ", "")),
        "n_shouts": F.length("__t") - F.length(F.translate("__t", "!", "")),
    }
    q = F.struct(*(F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in q.items()))
    # the id keeps the optimizer from pushing later filters on these counts through this projection, which would
    # write the nested expressions above out once per use
    q = F.when(F.monotonically_increasing_id() >= 0, q)
    return d.withColumn("__q", q).drop("__t", "__w", "__n", "__h", "__g", "__s", "__p", "__c", "__l")


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])


def _rates(q: Column) -> dict[str, Column]:
    def per(a, b):
        return q[a].cast("double") / F.greatest(q[b], F.lit(1))

    return {"symbols_per_word": per("n_symbols", "n_words"), "upper_share": per("n_upper", "word_chars"),
            "shouts_per_word": per("n_shouts", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"),
            "repeat_word_share": per("n_repeat_words", "n_words"), "chars_per_word": per("word_chars", "n_words")}


def stratum(lang: Column) -> Column:
    """Null languages are a stratum of their own."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: seven steps up, then Stirling's series (error below 1e-12)."""
    z = x + 7
    r = 1 / (z * z)
    series = (F.lit(1 / 12) - r * (F.lit(1 / 360) - r * (F.lit(1 / 1260) - r / 1680))) / z
    down = F.lit(0.0)
    for k in range(7):
        down = down + F.ln(x + k)
    return (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + series - down


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k <= n p, else 1: the largest term in logs, the others by their ratios downwards. Terms
    more than 40 standard deviations below are under 1e-300 of it."""
    kd, nd = k.cast("double"), n.cast("double")
    top = (log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * F.log(F.lit(p))
           + (nd - kd) * F.log(F.lit(1 - p)))
    steps = F.least(k, F.ceil(40 * F.sqrt(nd * p * (1 - p))) + 50)
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(a, i):
        j = kd - i + 1  # from the term of j to that of j - 1
        t = a["t"] * j * (1 - p) / ((nd - j + 1) * p)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    terms = F.when(steps >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1)))).otherwise(
        F.array().cast("array<bigint>"))
    total = F.aggregate(terms, start, step, lambda a: a["s"])
    return F.when(kd > nd * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top + F.ln(total))))


def cutoffs(measured: DataFrame, labels: DataFrame, lang_col: str = "lang", id_col: str = "doc_id",
            alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, cut): cut maps rule -> certified cutoff, one row per stratum that has any.

    ``measured`` has ``__q``; ``labels`` (doc_id, quality) may repeat a document (any 0 makes it bad) and hold
    nulls (ignored). Only documents that pass the base rules count: the others are rejected anyway.
    """
    known = (labels.where("quality is not null").groupBy(F.col("doc_id").alias("__id"))
             .agg(F.min("quality").alias("__good")))
    m = measured.select(F.col(id_col).alias("__id"), stratum(F.col(lang_col)).alias("stratum"), "__q")
    m = m.where(~base_failed(F.col("__q"))).join(known, "__id")
    rates = _rates(F.col("__q"))
    level = [F.struct(F.lit(rule).alias("rule"),
                      sum((F.when(rates[rule] > c, 1).otherwise(0) for c in cuts), F.lit(0)).alias("level"))
             for rule, cuts in GRID.items()]
    cells = (m.select("stratum", "__good", F.explode(F.array(*level)).alias("x"))
             .groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.level").alias("level"))
             .agg(F.sum(F.when(F.col("__good") > 0, 1).otherwise(0)).alias("good"),
                  F.sum(F.when(F.col("__good") > 0, 0).otherwise(1)).alias("bad")))
    per = (cells.groupBy("stratum", "rule")
           .agg(F.collect_list(F.struct("level", "good", "bad")).alias("cells"), F.sum("good").alias("n"))
           .withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy("rule"))))  # every stratum has every rule
    grid = F.create_map(*(x for rule, cuts in GRID.items() for x in (F.lit(rule), F.array(*map(F.lit, cuts)))))
    tests = per.select("stratum", "strata", "rule", "cells", "n", F.posexplode(grid[F.col("rule")]).alias("j", "cutoff"))

    def above(field):
        return F.aggregate(F.filter("cells", lambda c: c["level"] > F.col("j")), F.lit(0).cast("long"),
                           lambda a, c: a + c[field])

    tests = tests.withColumn("k", above("good")).withColumn("hit", above("bad"))
    size = max(map(len, GRID.values())) * len(GRID)
    p = binomial_at_most(F.col("k"), F.col("n"), alpha / len(GRID))
    worth = F.col("hit") - GOOD_WEIGHT * F.col("k")
    chosen = (tests.where((p <= F.lit(delta) / (F.col("strata") * size)) & (worth > 0))
              .groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(worth, "cutoff")).alias("cutoff")))
    return chosen.groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut"))


def rejected_by(q: Column, cut: Column) -> Column:
    """True if a certified rule rejects; no row of cutoffs, no rejection."""
    hit = F.lit(False)
    for rule, value in _rates(q).items():
        hit = hit | F.coalesce(value > F.element_at(cut, rule), F.lit(False))
    return hit


def judge(measured: DataFrame, cuts: DataFrame, lang_col: str = "lang") -> DataFrame:
    """Add ``__failed`` (base rules) and ``__kept``. ``cuts`` is a stored table; broadcast while it has few strata."""
    c = cuts.select(F.col("stratum").alias("__stratum"), F.col("cut").alias("__cut"))
    c = F.broadcast(c) if cuts.count() <= BROADCAST_STRATA else c
    d = measured.withColumn("__stratum", stratum(F.col(lang_col))).join(c, "__stratum", "left")
    d = d.withColumn("__failed", base_failed(F.col("__q")))
    return d.withColumn("__kept", ~F.col("__failed") & ~rejected_by(F.col("__q"), F.col("__cut"))).drop(
        "__stratum", "__cut")


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. Texts are measured twice and never shuffled: once for a
    light table of counts that meets the labels, once to be judged in place."""
    from .common import stored

    light = stored(measure(docs).select("doc_id", "lang", "__q"))
    return judge(measure(docs), stored(cutoffs(light, labels))).where("__kept").select(*docs.columns)
