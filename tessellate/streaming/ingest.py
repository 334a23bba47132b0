"""An extension beyond the batch programs: models that arrive as files are aligned with those that are there.

Each micro-batch handles the pairs that its new models make and that the output doesn't hold yet, so a replayed batch
writes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessellate.operators.lexical import PAIR, match_lexical
from tessellate.sources.models import model_pairs, read_models
from tessellate.sources.sinks import not_yet_written

Aligner = Callable[[DataFrame, int], None]


def align_new_models(spark: SparkSession, models: str, output: str, kind: str = "all") -> Aligner:
    """A foreachBatch function: aligns the pairs of models below ``models`` that ``output`` doesn't hold yet."""

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        tables = read_models(spark, models)
        pairs = model_pairs(tables, kind)
        try:
            pairs = not_yet_written(pairs, spark.read.parquet(f"{output}/pairs"), PAIR)
        except Exception as e:  # nothing has been written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        pairs = pairs.persist()
        match_lexical(tables, pairs).write.mode("append").parquet(f"{output}/cells")
        pairs.write.mode("append").parquet(f"{output}/pairs")
        pairs.unpersist()

    return run


def watch_models(spark: SparkSession, models: str, output: str, checkpoint: str, kind: str = "all") -> StreamingQuery:
    """Starts the stream over the JSON files below ``models`` and handles what is there at once."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(models)
    return files.writeStream.foreachBatch(align_new_models(spark, models, output, kind)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
