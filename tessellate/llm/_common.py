"""Shared pieces of the training-data operators: table access, text normalisation, lineage cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word: a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty.

    ``lower`` takes the byte-wise path where a text is all ASCII (as many bytes as code points);
    elsewhere it would also fold other letters, so ``translate`` does those.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir; a temporary one only where none is set and the session is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessellate-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any store that Spark writes to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder and cuts its lineage.

    At most four files for each core are written, however many partitions there are: a task takes several in turn.
    """
    checkpoint_dir(df.sparkSession)
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism).checkpoint(eager=True)


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one, ``_row``: what stands beside it can't clash with them. ``select("_row.*")`` brings them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(
    df: DataFrame, columns: list, schema: str, function: Callable[[dict], dict], rows: int = 256
) -> DataFrame:
    """Applies ``function`` (dict of Python lists -> dict of equal-length lists) to Arrow slices.

    Slices of at most ``rows`` rows keep what Python holds at a time small, whatever the batch size is.
    """
    source = df.select(*columns)
    names = source.columns
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                got = function({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return source.mapInArrow(run, out)


def arrow_filter(df: DataFrame, column: str, keeps: Callable[[list], list[bool]], rows: int = 256) -> DataFrame:
    """The rows of ``df``, all columns kept, for which ``keeps`` says so of ``column``'s values."""
    at, rows_of = df.columns.index(column), df.select(whole_row(df))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                yield part.filter(pa.array(keeps(part.column(0).field(at).to_pylist()), pa.bool_()))

    return rows_of.mapInArrow(run, rows_of.schema).select("_row.*")
