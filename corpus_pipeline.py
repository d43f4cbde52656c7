"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; stages but the last return the
columns of ``docs``. ``run`` writes each stage's result as Parquet under the shared folder and reads it back as the
next one's input, so a lost executor costs at most one stage.

A null text counts as empty, and so fails the quality rules. Empty tables pass through every stage. Extra columns
are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm import decontaminate, linededup, packing, quality, simhash
from calibra.llm.common import documents, stored
from calibra.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs of their language."""
    return quality.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; ``n_chars`` follows a changed text."""
    d = linededup.drop_boilerplate(docs)
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.length("text").cast("long"))
                         .otherwise(F.col("n_chars")))
    return d.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or re-parameterised."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' token pieces, packed into sequences."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packed),
]

#: Components, templates and tokens are beyond SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
