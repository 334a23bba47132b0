"""Conceptual models: nested JSON of two spellings, read once and flattened into six tables.

Order in the JSON arrays carries meaning, so every exploded element keeps its position. Entities of one name are one, at
the first place and with the last definition. Models are keyed by (domain, model), the domain being the folder's name.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellate.functions.text import sanitize
from tessellate.plans.lineage import cut

ATTRIBUTES = "array<struct<name:string,type:string>>"
SCHEMA = f"""
    modelName string, modelDescription string, observables array<string>, topicDomain string, methodBasis string,
    entities array<struct<entityName:string,entityAttributes:{ATTRIBUTES},name:string,attributes:{ATTRIBUTES}>>,
    associations array<struct<associationName:string,associationParticipants:array<string>,
        associationAttributes:{ATTRIBUTES},name:string,participants:array<string>,attributes:{ATTRIBUTES}>>,
    _corrupt_record string
"""
KEY = ["domain", "model"]
BASE = "http://example.org/concept_instances/"


def _first_text(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def _first_list(a: Column, b: Column) -> Column:
    return F.when(F.size(a) > 0, a).otherwise(b)


def scan_models(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file below ``path``: domain, path, versioned (three forms), corrupt, and the content under one spelling.

    versioned: the file's name says ``_model_v`` and a digit. versioned_short: ``_v1`` to ``_v3`` before another part of it.
    original: it doesn't say ``variation``.

    A file that can't be parsed gives a row with ``corrupt`` set, instead of failing the others.
    """
    raw = (
        spark.read.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
        .option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
        .withColumn("path", F.input_file_name())
    )
    parts = F.split("path", "/")
    file = F.url_decode(F.element_at(parts, -1))
    return raw.select(
        F.url_decode(F.element_at(parts, -2)).alias("domain"),
        _first_text(F.col("modelName"), F.lit("UnknownModel")).alias("model"),
        "path",
        F.lower(file).rlike(r"_model_v\d").alias("versioned"), F.lower(file).rlike("_v[123][_.]").alias("versioned_short"),
        (~F.lower(file).contains("variation")).alias("original"),
        F.col("_corrupt_record").isNotNull().alias("corrupt"),
        F.when(F.col("observables").isNotNull(), "A").otherwise("B").alias("type_ab"),
        F.coalesce("observables", F.array()).alias("observables"),
        F.col("topicDomain").alias("topic_domain"), F.col("modelDescription").alias("description"), F.col("methodBasis").alias("method_basis"),
        F.transform(
            F.coalesce("entities", F.array()),
            lambda e: F.struct(
                F.coalesce(_first_text(e["entityName"], e["name"]), F.lit("")).alias("name"),
                F.coalesce(_first_list(e["entityAttributes"], e["attributes"]), F.array()).alias("attributes"),
            ),
        ).alias("entities"),
        F.transform(
            F.coalesce("associations", F.array()),
            lambda a: F.struct(
                F.coalesce(_first_text(a["associationName"], a["name"]), F.lit("")).alias("name"),
                F.coalesce(_first_list(a["associationParticipants"], a["participants"]), F.array()).alias("participants"),
                F.coalesce(_first_list(a["associationAttributes"], a["attributes"]), F.array()).alias("attributes"),
            ),
        ).alias("associations"),
    )


def batch_counts(scanned: DataFrame) -> DataFrame:
    """(converted, failed): how many files could be parsed, and how many couldn't."""
    # Spark parses no file for the corrupt mark alone, so what is counted is read with another field and cut first.
    read = cut(scanned.select("corrupt", F.size("entities").alias("entities")))
    return read.agg(F.count_if(~F.col("corrupt")).alias("converted"), F.count_if("corrupt").alias("failed"))


@dataclass
class ModelTables:
    """model, entity, attribute, association, participant and observable tables of any number of models."""

    model: DataFrame
    entity: DataFrame
    attribute: DataFrame
    association: DataFrame
    participant: DataFrame
    observable: DataFrame

    def where(self, condition: Column | str) -> ModelTables:
        """The tables of the models for which a condition on domain and model holds."""
        return ModelTables(*[getattr(self, f.name).filter(condition) for f in fields(self)])

    def of_domain(self, domain: str) -> ModelTables:
        """The tables of one domain, whatever the case of its name."""
        return self.where(F.lower("domain") == domain.lower())

    def cached(self) -> ModelTables:
        return ModelTables(*[getattr(self, f.name).persist() for f in fields(self)])


def flatten_models(scanned: DataFrame) -> ModelTables:
    """The six tables of scanned models. Of two files with one (domain, model) the one later by path counts."""
    last = Window.partitionBy(*KEY).orderBy(F.col("path").desc())
    rows = scanned.filter(~F.col("corrupt")).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    model = rows.select(
        *KEY, sanitize("model").alias("safe_name"), "type_ab", "versioned", "versioned_short", "original", "topic_domain", "description", "method_basis", "path",
        (F.size("observables") > 0).alias("declares"),
    )
    defined = rows.select(*KEY, F.posexplode("entities").alias("pos", "e"))
    same = Window.partitionBy(*KEY, "entity")
    entity_all = defined.select(*KEY, F.col("e.name").alias("entity"), "pos", F.col("e.attributes").alias("attributes"))
    entity_all = (
        entity_all.withColumns({"entity_pos": F.min("pos").over(same), "_last": F.max("pos").over(same)})
        .filter("pos = _last").drop("pos", "_last")
    )
    entity = entity_all.select(*KEY, "entity", "entity_pos")
    association_all = rows.select(*KEY, F.posexplode("associations").alias("assoc_pos", "a"))
    association = association_all.select(*KEY, F.col("a.name").alias("assoc"), "assoc_pos", F.col("a.participants").alias("participants"))

    owned = entity_all.select(*KEY, F.lit("entity").alias("owner_kind"), F.col("entity").alias("owner"), F.col("entity_pos").alias("owner_pos"), F.posexplode("attributes").alias("attr_pos", "x"))
    owned = owned.unionByName(
        association_all.select(*KEY, F.lit("association").alias("owner_kind"), F.col("a.name").alias("owner"), F.col("assoc_pos").alias("owner_pos"), F.posexplode("a.attributes").alias("attr_pos", "x"))
    )
    names = entity.select(*KEY, F.col("entity").alias("type"), F.lit(True).alias("is_entity_ref"))
    attribute = (
        owned.select(*KEY, "owner_kind", "owner", "owner_pos", "attr_pos", F.coalesce("x.name", F.lit("")).alias("attr"), F.coalesce("x.type", F.lit("")).alias("type"))
        .join(names, [*KEY, "type"], "left")
        .withColumn("is_entity_ref", F.coalesce("is_entity_ref", F.lit(False)))
        .select(*KEY, "owner_kind", "owner", "owner_pos", "attr", "type", "attr_pos", "is_entity_ref")
    )
    known = entity.select(*KEY, "entity", F.lit(True).alias("known"))
    participant = (
        association_all.select(*KEY, F.col("a.name").alias("assoc"), "assoc_pos", F.posexplode("a.participants").alias("part_pos", "entity"))
        .join(known, [*KEY, "entity"], "left")
        .select(*KEY, "assoc", "assoc_pos", "entity", "part_pos", F.coalesce("known", F.lit(False)).alias("known"))
    )
    declared = rows.select(*KEY, F.explode("observables").alias("observable"), F.lit(True).alias("declared"))
    used = attribute.filter("type <> '' AND NOT is_entity_ref").select(*KEY, F.col("type").alias("observable"), F.lit(False).alias("declared"))
    observable = declared.unionByName(used).groupBy(*KEY, "observable").agg(F.max("declared").alias("declared"))
    return ModelTables(model, entity, attribute, association, participant, observable)


def read_models(spark: SparkSession, path: str) -> ModelTables:
    return flatten_models(scan_models(spark, path))


def element_iris(tables: ModelTables) -> DataFrame:
    """(domain, model, kind, entity, name, iri) of all observables, associations, entities and attributes."""
    safe = tables.model.select(*KEY, F.col("safe_name").alias("_m"))
    head = F.concat(F.lit(BASE), F.col("_m"), F.lit("/"), F.col("_m"))
    null = F.lit(None).cast("string")

    def iri(kind: str, *names: str) -> Column:
        return F.concat_ws("_", head, F.lit(kind), *[sanitize(n) for n in names])

    parts = [
        tables.observable.join(safe, KEY).select(*KEY, F.lit("observable").alias("kind"), null.alias("entity"), F.col("observable").alias("name"), iri("obs", "observable").alias("iri")),
        tables.association.join(safe, KEY).select(*KEY, F.lit("association").alias("kind"), null.alias("entity"), F.col("assoc").alias("name"), iri("assoc", "assoc").alias("iri")),
        tables.entity.join(safe, KEY).select(*KEY, F.lit("entity").alias("kind"), F.col("entity"), F.col("entity").alias("name"), iri("ent", "entity").alias("iri")),
        tables.attribute.filter("owner_kind = 'entity'").join(safe, KEY).select(*KEY, F.lit("attribute").alias("kind"), F.col("owner").alias("entity"), F.col("attr").alias("name"), iri("attr", "owner", "attr").alias("iri")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def model_pairs(tables: ModelTables, kind: str = "within") -> DataFrame:
    """(domain, model_a, model_b[, domain_b]) by kind.

    ``within``: versioned with versioned and other with other models of a domain. ``all``: any two of a domain.
    ``crosstype``: a versioned with another model of its domain. ``cross_domain``: any two models of two domains.
    """
    m = tables.model.select("domain", "model", "versioned")
    a = m.select(F.col("domain"), F.col("model").alias("model_a"), F.col("versioned").alias("va"))
    b = m.select(F.col("domain").alias("domain_b"), F.col("model").alias("model_b"), F.col("versioned").alias("vb"))
    if kind == "cross_domain":
        return a.join(b, F.col("domain") < F.col("domain_b")).select("domain", "domain_b", "model_a", "model_b")
    same = a.join(b, F.col("domain") == F.col("domain_b"))
    if kind == "crosstype":
        return same.filter("va AND NOT vb").select("domain", "model_a", "model_b")
    same = same.filter("model_a < model_b")
    return (same.filter("va = vb") if kind == "within" else same).select("domain", "model_a", "model_b")
