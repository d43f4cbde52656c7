"""Size-checked per-group attach and the streaming scoring path."""

from calibra.operators.joins import attach

import __spark_entry__ as E

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_attach_broadcasts_only_under_bound(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # isolate the explicit decision
    try:
        big = spark.range(1000).withColumnRenamed("id", "k")
        small = spark.range(10).withColumnRenamed("id", "k")
        assert "BroadcastHashJoin" in _plan(attach(big, small, "k", known_rows=10))
        assert "BroadcastHashJoin" not in _plan(attach(big, small, "k", known_rows=10, max_rows=5))
        assert attach(big, small, "k").count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stream_scoring_runs_over_whole_stream(spark):
    out = E.queries()["stream_scoring"](spark, SF_SMALL)
    rows = out.collect()
    assert rows and {r.model for r in rows} == {"linear", "ridge_0.1", "ridge_1", "ridge_10", "lasso", "elasticnet"}
    # every test and training row of lineitem is scored once per model across the windows
    n = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    assert sum(r.n for r in rows) == 6 * n
