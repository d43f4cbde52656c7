"""Tables written between the steps of one query, in the shared folder of ``spark.checkpoint.dir``.

A staged table cuts lineage: what several later steps read is computed once, and a lost executor costs one task
instead of the whole chain behind it. Its owner may delete the folder when the query's result has been written.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


def staged(df: DataFrame) -> DataFrame:
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/calibra-staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a staged table that no later step reads."""
    spark = table.sparkSession
    for folder in {os.path.dirname(f) for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("calibra-staged-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
