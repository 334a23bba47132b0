"""Writers: triples, alignment documents, nested reports and tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellate.functions.text import sanitize

INSTANCE = "http://example.org/instances/"
TERM = "http://example.org/metamodel#"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
OWL, RDFS = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#"
ALIGNMENT = "http://knowledgeweb.semanticweb.org/heterogeneity/alignment"


def _quoted(value: Column) -> Column:
    out = value
    for sign, with_ in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(sign), F.lit(with_))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _triples(assertions: DataFrame) -> DataFrame:
    """(s, p, o) as they are written, of each assertion."""
    own = F.concat(F.lit(INSTANCE), sanitize("message"), F.lit("#"))
    iri = lambda base, name: F.concat(F.lit("<"), base, name, F.lit(">"))
    subject = iri(own, F.col("subject"))
    predicate = F.when(F.col("kind") == "class", F.lit(f"<{TYPE}>")).otherwise(iri(F.lit(TERM), F.col("predicate")))
    object_ = F.when(F.col("kind") == "class", iri(F.lit(TERM), F.col("object"))).when(F.col("kind") == "object", iri(own, F.col("object"))).otherwise(_quoted(F.col("object")))
    return assertions.select(subject.alias("s"), predicate.alias("p"), object_.alias("o"))


def ntriples(assertions: DataFrame) -> DataFrame:
    """One N-Triples line (value) for each assertion."""
    return _triples(assertions).select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


def turtle(assertions: DataFrame) -> DataFrame:
    """One Turtle statement (value) for each subject: its predicates and objects, parted by semicolons."""
    said = F.array_sort(F.collect_set(F.concat_ws(" ", "p", "o")))
    return _triples(assertions).groupBy("s").agg(said.alias("said")).select(F.concat(F.col("s"), F.lit(" "), F.array_join("said", " ;\n    "), F.lit(" .")).alias("value"))


def write_turtle(assertions: DataFrame, path: str) -> None:
    turtle(assertions).write.mode("overwrite").text(path)


def metamodel_triples(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """One N-Triples line (value) for each statement on classes (class, parent) and properties (property, parent, domain, range)."""
    iri = lambda c: F.concat(F.lit(f"<{TERM}"), c, F.lit(">"))
    line = lambda s, p, o: F.concat_ws(" ", iri(s), F.lit(f"<{p}>"), o, F.lit(".")).alias("value")
    each = lambda c: properties.select("property", F.explode(F.split(c, r"\|")).alias("x"))
    kinds = [(classes, "class", "Class"), (properties, "property", "ObjectProperty")]
    parts = [df.select(line(F.col(c), TYPE, F.lit(f"<{OWL}{k}>"))) for df, c, k in kinds]
    parts += [df.filter("parent IS NOT NULL").select(line(F.col(c), f"{RDFS}sub{k}Of", iri(F.col("parent")))) for df, c, k in ((classes, "class", "Class"), (properties, "property", "Property"))]
    parts += [each(c).select(line(F.col("property"), f"{RDFS}{c}", iri(F.col("x")))) for c in ("domain", "range")]
    return functools.reduce(DataFrame.unionByName, parts).distinct()


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_ntriples(assertions: DataFrame, path: str) -> None:
    ntriples(assertions).write.mode("overwrite").text(path)


def _escaped(value: Column) -> Column:
    for sign, with_ in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(sign), F.lit(with_))
    return value


def alignment_documents(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): one RDF alignment document for each pair, from cells (keys, source, target, score, relation).

    The namespace is the one that the reader takes, and IRIs are written whole, so documents can be read back.
    """
    cell = F.concat(
        F.lit('<map><Cell><entity1 rdf:resource="'), _escaped(F.col("source")), F.lit('"/><entity2 rdf:resource="'), _escaped(F.col("target")),
        F.lit('"/><measure rdf:datatype="xsd:float">'), F.col("score").cast("string"), F.lit("</measure><relation>"), _escaped(F.col("relation")), F.lit("</relation></Cell></map>"),
    )
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "source", cell.alias("cell"))))
    head = f'<?xml version="1.0" encoding="utf-8"?>\n<rdf:RDF xmlns="{ALIGNMENT}" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><Alignment>\n'
    return cells.groupBy(*keys).agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda x: x["cell"]), "\n"), F.lit("\n</Alignment></rdf:RDF>")).alias("value"))


def write_partitioned_json(df: DataFrame, path: str, by: str = "domain") -> None:
    df.write.mode("overwrite").partitionBy(by).json(path)


def read_partitioned_json(spark, path: str, schema) -> DataFrame:
    """What ``write_partitioned_json`` wrote, under the schema that it had."""
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def not_yet_written(pairs: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs that earlier output lacks."""
    return pairs.join(written.select(*keys).distinct(), keys, "left_anti")
