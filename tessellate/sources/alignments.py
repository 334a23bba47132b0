"""Readers of alignments, links, labels and ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellate.functions.text import sanitize

CELL = "entity1 struct<`_rdf:resource`:string,_resource:string>, entity2 struct<`_rdf:resource`:string,_resource:string>, measure string, relation string"


def read_alignment_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, domain, stem, source, target, score, relation, pos) of all cells in the RDF alignment files below ``path``.

    A measure that isn't a number is 0. Files without cells, or that can't be parsed, give no rows.
    """
    schema = CELL.replace("measure string", "measure struct<_VALUE:string,`_rdf:datatype`:string>")
    raw = (
        spark.read.format("xml").option("rowTag", "Cell").option("mode", "DROPMALFORMED").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.rdf").schema(schema).load(path)
        .select("*", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("pos"))
    )
    parts = F.split("path", "/")
    resource = lambda c: F.coalesce(F.col(f"{c}.`_rdf:resource`"), F.col(f"{c}._resource"))
    return raw.select(
        "path", F.url_decode(F.element_at(parts, -2)).alias("domain"),
        F.regexp_replace(F.url_decode(F.element_at(parts, -1)), r"\.rdf$", "").alias("stem"),
        resource("entity1").alias("source"), resource("entity2").alias("target"),
        F.coalesce(F.col("measure._VALUE").try_cast("double"), F.lit(0.0)).alias("score"), "relation", "pos",
    ).filter("source IS NOT NULL AND target IS NOT NULL")


def best_cells(cells: DataFrame) -> DataFrame:
    """Each source's best target within a file, the first of equals."""
    order = Window.partitionBy("domain", "stem", "source").orderBy(F.col("score").desc(), "pos")
    return cells.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "pos")


def split_pair_stems(stems: DataFrame, names: DataFrame) -> DataFrame:
    """Adds from_safe and to_safe to ``stems`` (domain, stem): the halves around a ``_vs_`` that are both in ``names`` (domain, safe_name)."""
    cuts = F.split("stem", "_vs_")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size(cuts) - 1, F.lit(1))))
    rows = stems.filter(F.size(cuts) > 1).select("*", at.alias("_i"))
    halves = rows.select(
        *stems.columns, "_i", F.array_join(F.slice(cuts, F.lit(1), F.col("_i")), "_vs_").alias("from_safe"),
        F.array_join(F.slice(cuts, F.col("_i") + 1, F.size(cuts)), "_vs_").alias("to_safe"),
    )
    a, b = (names.select("domain", F.col("safe_name").alias(n)).distinct() for n in ("from_safe", "to_safe"))
    first = Window.partitionBy("domain", "stem").orderBy("_i")
    found = halves.select("domain", "stem", "_i", "from_safe", "to_safe").distinct().join(a, ["domain", "from_safe"]).join(b, ["domain", "to_safe"])
    return stems.join(
        found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("domain", "stem", "from_safe", "to_safe"), ["domain", "stem"]
    )


def read_model_alignments(spark: SparkSession, path: str, model: DataFrame) -> DataFrame:
    """(domain, from_model, to_model, source, target, score): best cells of files named by two known models."""
    cells = split_pair_stems(best_cells(read_alignment_cells(spark, path)), model)
    a, b = (model.select("domain", F.col("safe_name").alias(f"{n}_safe"), F.col("model").alias(f"{n}_model")) for n in ("from", "to"))
    return cells.join(a, ["domain", "from_safe"]).join(b, ["domain", "to_safe"]).select("domain", "from_model", "to_model", "source", "target", "score")


def _local(iri):
    return F.substring_index(iri, "#", -1)


def read_links(spark: SparkSession, path: str, keep_repeats: bool = False) -> DataFrame:
    """(src_id, tgt_id) of lines with three IRIs or more; blank lines and comments are skipped."""
    found = F.regexp_extract_all("value", F.lit("<([^>]+)>"), F.lit(1))
    lines = spark.read.text(path).filter(~F.trim("value").startswith("#")).select(found.alias("i")).filter(F.size("i") >= 3)
    links = lines.select(_local(F.col("i")[0]).alias("src_id"), _local(F.col("i")[2]).alias("tgt_id"))
    return links if keep_repeats else links.distinct()


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(kind, subject, predicate, object) of Turtle statements with whole IRIs, one subject each; names are what follows the last ``#``.

    A statement ends with a full stop at the end of a line, as line breaks within literals are written as escapes.
    """
    said = F.regexp_extract_all("value", F.lit(r'<([^>]+)> (?:<[^>]+>|"(?:[^"\\]|\\.)*")(?= ;| *$)'), F.lit(0))
    rows = spark.read.option("lineSep", " .\n").text(path).filter(F.trim("value") != "")
    rows = rows.select(F.regexp_extract("value", r"^\s*<([^>]+)>", 1).alias("s"), F.explode(said).alias("x"))
    parts = rows.select("s", F.regexp_extract("x", "^<([^>]+)>", 1).alias("p"), F.regexp_replace("x", "^<[^>]+> ", "").alias("o"))
    literal = F.substring("o", F.lit(2), F.length("o") - 2)
    plain = F.replace(literal, F.lit("\\\\"), F.lit("\0"))
    for sign, of in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\0", "\\")):
        plain = F.replace(plain, F.lit(sign), F.lit(of))
    data, kind = F.col("o").startswith('"'), F.when(F.col("p").endswith("#type"), "class")
    return parts.select(
        kind.when(data, "data").otherwise("object").alias("kind"), _local(F.col("s")).alias("subject"), _local(F.col("p")).alias("predicate"),
        F.when(data, plain).otherwise(_local(literal)).alias("object"),
    )


def class_labels(assertions: DataFrame, cls: str) -> DataFrame:
    """(id, label) of the instances of a class: the first of their names."""
    own = assertions.filter((F.col("kind") == "class") & (F.col("object") == cls)).select("subject").distinct()
    names = assertions.filter((F.col("kind") == "data") & (F.col("predicate") == "hasName")).groupBy("subject").agg(F.min_by("object", "pos").alias("label"))
    return own.join(names, "subject").select(F.col("subject").alias("id"), "label")


def measurement_details(assertions: DataFrame) -> DataFrame:
    """(id, label, value_type, unit, system) of logical measurements, by one step along their links."""
    out = class_labels(assertions, "LogicalMeasurement")
    data = assertions.filter("kind = 'data'")
    for link, prop, name in (
        ("measurementValueType", "valueTypeName", "value_type"), ("measurementUnit", "symbol", "unit"),
        ("measurementSystem", "measurementSystemName", "system"),
    ):
        to = assertions.filter((F.col("kind") == "object") & (F.col("predicate") == link)).select(F.col("subject").alias("id"), F.col("object").alias("_to"))
        value = data.filter(F.col("predicate") == prop).groupBy(F.col("subject").alias("_to")).agg(F.min_by("object", "pos").alias(name))
        out = out.join(to.join(value, "_to").drop("_to"), "id", "left")
    return out


def read_ground_truth(spark: SparkSession, path: str, src: DataFrame, tgt: DataFrame) -> DataFrame:
    """(src_id, tgt_id) of a JSON list that names pairs by id or by label; names that aren't known are dropped.

    Of several ids with one label the last counts.
    """
    schema = "src_id string, tgt_id string, src_name string, tgt_name string, src string, tgt string, note string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    sides = [df.groupBy("label").agg(F.max("id").alias(f"_{n}")).withColumnRenamed("label", f"{n}_name") for df, n in ((src, "src"), (tgt, "tgt"))]
    rows = rows.join(sides[0], "src_name", "left").join(sides[1], "tgt_name", "left")
    pairs = rows.select(F.coalesce("src_id", "_src", "src").alias("src_id"), F.coalesce("tgt_id", "_tgt", "tgt").alias("tgt_id"))
    return pairs.filter("src_id IS NOT NULL AND tgt_id IS NOT NULL").distinct()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as strings."""
    return spark.read.option("header", True).csv(path)


def safe_names(names: DataFrame, name: str) -> DataFrame:
    return names.withColumn("safe_name", sanitize(name))
