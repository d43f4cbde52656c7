"""The pipeline against a plain version of each stage on a small corpus, on that stage's own input."""

import random

import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from calibra.llm import linededup, packing
from calibra.llm.common import stored
from calibra.llm.queries import ORACLES, QUERIES, vocabulary

from .test_linededup import brute as brute_lines
from .test_quality import plain as plain_counts
from .test_simhash import brute as brute_components
from .test_simhash import plain as plain_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string"


def tables(spark, path, empty=False):
    rng = random.Random(6)
    text = lambda n: " ".join("w%d" % rng.randrange(3000) for _ in range(n))
    items = [text(25) for _ in range(6)]
    rows, bases = [], [text(150) for _ in range(8)]
    for i in range(160):
        t = text(rng.randint(0, 80)) if i % 3 else rng.choice(bases)
        if i % 11 == 0:
            t += "\n" + items[i % 6]
        if i % 4 == 0:
            t += "\nfooter of the site"
        if i % 13 == 0:
            t = "again and again we say it " * 20
        rows.append((i, t, rng.choice(["en", None]), f"s{i % 2}", len(t), "clash"))
    rows += [(160, None, None, None, None, None), (161, "", "en", "s1", 0, None), rows[5], rows[6]]
    spark.createDataFrame([] if empty else rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return items


def test_stages_match_plain_versions(spark, tmp_path):
    items = tables(spark, tmp_path)
    docs = stored(P.documents(spark, str(tmp_path)))
    results = []
    for _, stage in P.STAGES:
        results.append(docs)
        docs = stored(stage(spark, docs, str(tmp_path)))
    results.append(docs)
    assert all(r.columns == results[0].columns for r in results[:-1])
    rows = [[r.asDict() for r in d.collect()] for d in results]

    def ok(t):
        n_words, _, _, _, repeat = plain_counts(t)
        return n_words >= 10 and 100 * repeat <= 20 * n_words

    # too few labels to certify a cutoff: the base rules alone decide
    key = lambda rs: sorted((r["doc_id"], r["text"]) for r in rs)
    assert key(rows[1]) == key([r for r in rows[0] if ok(r["text"])])
    want = brute_lines([(i, r["text"], r["source"]) for i, r in enumerate(rows[1])], linededup.RATIO, linededup.MIN_PAGES)
    assert key(rows[2]) == sorted((r["doc_id"], want[i][0]) for i, r in enumerate(rows[1]))
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2]) and any(want[i][2] for i in want)
    comp = brute_components([plain_fingerprint(r["text"]) for r in rows[2]], [r["doc_id"] for r in rows[2]])
    assert sorted(r["doc_id"] for r in rows[3]) == sorted(set(comp)) and len(rows[3]) < len(rows[2])
    assert key(rows[4]) == key([r for r in rows[3] if not any(t in r["text"] for t in items)]) and len(rows[4]) < len(rows[3])
    w = packing.word_ids(vocabulary())
    assert {r["doc_id"]: r["doc_tokens"] for r in rows[5]} == {r["doc_id"]: len(w.encode(r["text"])) + 1 for r in rows[4]}
    assert sum(r["length"] for r in rows[5]) == sum(len(w.encode(r["text"])) + 1 for r in rows[4])
    got = P.run(spark, str(tmp_path)).drop("sequence_id", "offset")
    assert sorted(got.collect()) == sorted(results[-1].drop("sequence_id", "offset").collect())


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, empty=True)
    assert P.run(spark, str(tmp_path)).count() == 0
    for name, fn in QUERIES.items():
        if name != "op9_urlfilter":
            assert fn(spark, str(tmp_path)).count() == 0, name


def test_registered():
    names = list(E.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in P.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]


NATIVE = ("op7_quality", "op8_sharding", "op9_urlfilter", "op10_linededup")


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_have_no_python(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


