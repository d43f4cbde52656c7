"""Queries with SQL against DuckDB on the given small tables, and on tables with nulls and odd rows."""

import duckdb
import pytest

from calibra.llm.queries import ORACLES, QUERIES


def same(spark, name, path):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet{'' if 'testdata' in path else '/*.parquet'}')")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, path)
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_given_tables(spark, name):
    same(spark, name, "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_odd_rows(spark, name, tmp_path):
    from .test_linededup import corpus
    from .test_quality import TEXTS, labelled
    from .test_urlfilter import URLS

    docs, labels = labelled(spark)
    odd = [(10_000 + i, t, None if i % 4 == 0 else "fr", "a") for i, t in enumerate(TEXTS)] + [
        (20_000 + i, t, "x", s) for i, t, s in corpus()] + [(None, None, None, None), (None, "a\nb", None, None)]
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string")
    docs.selectExpr("*", "'b' as source").unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(URLS + URLS[:6])), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    vectors = [(i, [float(i * k % 5 - 1) / 4 for k in (1, 2, 3)], i % 3) for i in range(160)] + [
        (1000, None, 1), (1050, [1.0, None, 1.0], 1), (1100, [float("nan")] * 3, 1), (1150, [1.0] * 3, None), (-50, [0.5] * 3, 2)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    same(spark, name, str(tmp_path))
