"""Cutting lineage at the edges of loops, in the folder that all machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: What a task sorts or groups at most, where rows are dealt by their number; adaptive execution alone merges partitions until there is one a core.
ROWS_A_TASK = 1_000_000


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in spark.checkpoint.dir; a temporary folder is set only where the session names none and is local."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessellate-"))
    return df.checkpoint(eager=True)


def parts(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: one a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))
