import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from calibra.session import local_session
    return local_session(cores=4, shuffle_partitions=4, app="calibra-llm-tests")


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """(texts, extra columns) -> documents; ids count from 0 and wide rows get clashing names."""
    def make(texts, clash=()):
        rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCS)
        for c in clash:
            from pyspark.sql import functions as F
            df = df.withColumn(c, F.lit("clash"))
        return df
    return make
