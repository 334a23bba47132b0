"""Exact deduplication by skew-safe combining.

Rows with equal normalised text are combined three times, and each time by the text itself beside its digest:
within a map task (the partial aggregate), within a salt of the digest, and then over the salts. A group that
holds a third of all rows so reaches the last step as one row per salt at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellate.llm._common import ascii_lower, shuffle_partitions, table, whole_row


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None, digest_bits: int = 256
) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The largest id of a group stays.

    - null text: the same as an empty one; all of these are one group. Very long texts: compared whole, each shuffled twice at most.
    - null id: smaller than any other; a group of null ids alone has keep_id null and keeps its rows.
    - repeated rows (same id and text): each counts in group_size, and each of the kept id says kept; take one
      of them where single rows are wanted (the pipeline stage does).
    - empty table: no rows. Further columns, whatever they are called, are neither read nor returned.
    - two texts of one digest: the job fails rather than take them for one (never seen for SHA-256).
    """
    spark = df.sparkSession
    salts = salts or max(64, shuffle_partitions(spark))
    norm = ascii_lower(F.col(text_col))
    keyed = df.select(F.col(id_col).alias("_id"), norm.alias("_norm")).select(
        "_id", "_norm", F.sha2("_norm", digest_bits).alias("_digest")
    )
    salted = (
        keyed.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"))
        .groupBy("_digest", "_salt", "_norm")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    )
    winners = (
        salted.repartition("_digest")
        .groupBy("_digest", "_norm")
        .agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
        .groupBy("_digest")
        .agg(F.max("_keep").alias("_keep"), F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_texts"))
        .select(
            F.unhex("_digest").alias("_won"),
            "_keep",
            F.when(F.col("_texts") == 1, F.col("_n"))
            .otherwise(F.raise_error(F.lit("different texts share a digest")).cast("long"))
            .alias("_n"),
        )
        .filter("_n > 1")
    )
    # A hot digest gives a row for each of its copies here, without texts, and adaptive execution splits such a partition (spark.sql.adaptive.skewJoin).
    # Joined by the digest's bytes: the winners are dealt out anew for that, in a stage of their own, so that what
    # a hot digest gives on the other side is a plain shuffle that adaptive execution can split.
    rows = keyed.select("_id", F.unhex("_digest").alias("_bytes"))
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return rows.join(winners, F.col("_bytes") == F.col("_won"), "left").select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("_bytes")).alias("text_sha256"),
    )


def keep_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``exact_dedup`` keeps, with all their columns; one of those that repeat an id and a text.

    - null and empty texts are one group, of which one row stays. Very long texts: shuffled whole, once beside the dedup itself.
    - of rows that repeat an id and a text (but for case), the first by text and then by the other columns as JSON stays.
    - null ids: as in ``exact_dedup``; of rows with a null id and one text, one stays. Empty table: no rows.
    - further columns of any type and name, maps too, come back as they are.
    """
    # One key that is never null, so that the join and the window share one exchange of the texts.
    def key(digest: Column) -> Column:
        return F.concat(digest, F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary"))

    verdicts = exact_dedup(df, id_col, text_col).filter("kept").select(key(F.unhex("text_sha256")).alias("_key"))
    rows = df.select(whole_row(df), key(F.unhex(F.sha2(ascii_lower(F.col(text_col)), 256))).alias("_key"))
    others = [F.col("_row").getField(c).alias(c) for c in df.columns if c not in (id_col, text_col)]
    first = Window.partitionBy("_key").orderBy(F.col("_row").getField(text_col), *([F.to_json(F.struct(*others))] if others else []))
    return rows.join(verdicts, "_key", "left_semi").withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("_row.*")


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op2_exact_dedup": op2_exact_dedup}

ORACLE = {
    "op2_exact_dedup": """
        WITH k AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM k WINDOW g AS (PARTITION BY text_sha256)
    """
}
