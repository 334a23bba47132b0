"""Layered messages (conceptual, logical, platform): nested JSON into one table of assertions.

An assertion is (message, kind, predicate, subject, object, pos): of kind ``class`` (object is the class), ``object`` or
``data``. Equal ones are kept once. References go by id; ``compat="as_coded"`` resolves only those to what came before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellate.functions.text import local_name, sanitize
from tessellate.plans.lineage import cut

NAMED = "id:string,name:string,description:string"
BODY = f"""message_id:string,message_name:string,description:string,source:string,timestamp_utc:string,
    derived_from_icd:string,generation_model:string,
    conceptual:struct<basis_entities:array<struct<{NAMED}>>,
        entities:array<struct<{NAMED},specializes:string,compositions:array<struct<id:string,role_name:string,
            observable_ref:string,entity_ref:string,cardinality:string,description:string>>>>,
        observables:array<struct<{NAMED}>>>,
    logical:struct<entity_realizations:array<struct<{NAMED},realizes:string>>,
        measurements:array<struct<{NAMED},realizes:string,primitive_data_type:string,value_type:string,unit:string,
            measurement_system:string,coordinate_system:string,numeric_value:string>>>,
    platform:struct<message_type:string,serialization:string,
        entity_realizations:array<struct<{NAMED},realizes:string>>,
        platform_compositions:array<struct<id:string,role_name:string,data_type:string,cardinality:string,realizes:string,
            value:string,description:string>>>"""
SCHEMA = "uddl_layered_message struct<" + BODY + ">, " + ", ".join(
    part.replace(":", " ", 1) for part in ("message_id:string", "message_name:string", "description:string", "source:string", "timestamp_utc:string", "derived_from_icd:string", "generation_model:string")
) + ", " + BODY[BODY.index("conceptual:"):].replace("conceptual:", "conceptual ", 1).replace("\n    logical:", "\n    logical ", 1).replace("\n    platform:", "\n    platform ", 1)
#: The primitive type names.
PRIMITIVES = ("Double", "Float", "Int32", "Int64", "UInt32", "Char", "Boolean", "String", "Integer", "Natural")
WIDTH = 1 << 20


def parse_messages(text: DataFrame, column: str = "value") -> DataFrame:
    """Messages from a column of JSON texts, with or without their envelope."""
    raw = text.select(F.from_json(column, SCHEMA).alias("m")).select("m.*")
    return _opened(raw)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return _opened(spark.read.schema(SCHEMA).option("multiLine", True).json(path))


def _opened(raw: DataFrame) -> DataFrame:
    inner = [c for c in raw.columns if c != "uddl_layered_message"]
    rows = raw.select(*[F.coalesce(F.col(f"uddl_layered_message.{c}"), F.col(c)).alias(c) for c in inner])
    return rows.withColumn("message_id", F.coalesce("message_id", F.lit("unknown")))


def parse_cardinality(text: Column) -> tuple[Column, Column]:
    """(lower, upper) of ``l..u``: one number is both, ``*`` is -1, a lower bound that isn't a number is 0; null if upper isn't one."""
    parts = F.split(F.trim(text), r"\.\.")
    low, high = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))
    lower = F.when(low.rlike("^[0-9]+$"), low.try_cast("int")).otherwise(0)
    upper = F.when(high == "*", -1).when(F.trim(high).rlike("^[+-]?[0-9]+$"), F.trim(high).try_cast("int"))
    return F.when(upper.isNotNull(), lower), upper


def _elements(messages: DataFrame) -> DataFrame:
    """One row per element in the order of parsing: (message, dm, class, id, name, owner, pos and the fields links need)."""
    dm = local_name("message_id", F.lit("dm"))
    base = messages.select(F.col("message_id").alias("message"), dm.alias("dm"), "conceptual", "logical", "platform")
    null = F.lit(None).cast("string")
    fields = ("realizes", "specializes", "observable_ref", "entity_ref", "cardinality", "primitive_data_type", "value_type", "unit", "measurement_system", "numeric_value", "data_type", "value")

    def rows(df: DataFrame, cls: str, suffix: str, part: int, label: str = "name", owner: Column = null, pos: Column = F.col("i"), own: tuple = ()) -> DataFrame:
        x = lambda f: F.col(f"x.{f}")
        return df.select(
            "message", "dm", F.lit(cls).alias("class"), x("id").alias("id"), local_name(x("id"), F.lit(suffix)).alias("subject"), F.coalesce(x(label), x("id")).alias("label"),
            owner.alias("owner"), (F.lit(part * WIDTH * WIDTH).cast("long") + pos).cast("long").alias("pos"), *[(x(f) if f in own else null).cast("string").alias(f) for f in fields],
        )

    def each(path: str) -> DataFrame:
        return base.select("message", "dm", F.posexplode(path).alias("i", "x"))

    entities = each("conceptual.entities")
    parts = entities.select("message", "dm", "i", F.col("x.id").alias("_owner"), F.posexplode("x.compositions").alias("j", "x"))
    first = base.select("message", local_name(F.get("platform.entity_realizations", F.lit(0))["id"], F.lit("pentity")).alias("_first"))
    fields_of = each("platform.platform_compositions").join(first, "message", "left")
    out = [
        rows(each("conceptual.basis_entities"), "BasisEntity", "basis", 0),
        rows(each("conceptual.observables"), "ConceptualObservable", "obs", 1),
        rows(entities, "ConceptualEntity", "centity", 2, pos=F.col("i").cast("long") * WIDTH, own=("specializes",)),
        rows(parts, "ConceptualComposition", "ccomp", 2, label="role_name", owner=local_name("_owner", F.lit("centity")), pos=F.col("i").cast("long") * WIDTH + F.col("j") + 1, own=("observable_ref", "entity_ref", "cardinality")),
        rows(each("logical.entity_realizations"), "LogicalEntity", "lentity", 3, own=("realizes",)),
        rows(each("logical.measurements"), "LogicalMeasurement", "lmeas", 4, own=("realizes", "primitive_data_type", "value_type", "unit", "measurement_system", "numeric_value")),
        rows(each("platform.entity_realizations"), "PlatformEntity", "pentity", 5, own=("realizes",)),
        rows(fields_of, "PlatformComposition", "pcomp", 6, label="role_name", owner=F.nullif("_first", F.lit("pentity")), own=("realizes", "cardinality", "data_type", "value")),
    ]
    return reduce(DataFrame.unionByName, out)


def to_assertions(messages: DataFrame, compat: str = "resolve") -> DataFrame:
    """(message, kind, predicate, subject, object, pos) of all messages."""
    if compat not in ("resolve", "as_coded"):
        raise ValueError("compat is resolve or as_coded")
    e = cut(_elements(messages))  # it is read by each kind of assertion below
    target = e.select("message", F.col("id").alias("_id"), F.col("subject").alias("_target"), F.col("pos").alias("_tpos"))
    # An id that is given twice names the element parsed last.
    target = target.groupBy("message", "_id").agg(F.max_by("_target", "_tpos").alias("_target"), F.min("_tpos").alias("_tpos"))

    def out(df: DataFrame, kind: str, predicate: str | Column, subject: str | Column, object_: str | Column, step: int = 0) -> DataFrame:
        col = lambda c: c if isinstance(c, Column) else F.col(c)
        predicate = F.lit(predicate) if isinstance(predicate, str) else predicate
        return df.select("message", F.lit(kind).alias("kind"), predicate.alias("predicate"), col(subject).alias("subject"), col(object_).cast("string").alias("object"), (col("pos") * 100 + step).alias("pos"))

    def linked(ref: str, cls: str | None = None) -> DataFrame:
        own = e.filter(F.col(ref).isNotNull())
        own = own.filter(F.col("class") == cls) if cls else own
        found = own.join(target, [own["message"] == target["message"], own[ref] == target["_id"]]).drop(target["message"])
        return found.filter("_tpos < pos") if compat == "as_coded" else found

    top = messages.select(F.col("message_id").alias("message"), local_name("message_id", F.lit("dm")).alias("dm"), F.lit(-1).cast("long").alias("pos"))
    layers = {"conceptual": ("cdm", "ConceptualDataModel", "hasConceptualModel"), "logical": ("ldm", "LogicalDataModel", "hasLogicalModel"), "platform": ("pdm", "PlatformDataModel", "hasPlatformModel")}
    layer = lambda name: local_name("dm", F.lit(layers[name][0]))
    parts = [out(top, "class", "type", "dm", F.lit("DataModel"))]
    for name, (_, cls, prop) in layers.items():
        parts += [out(top, "class", "type", layer(name), F.lit(cls), 1), out(top, "object", prop, "dm", layer(name), 2)]
    parts.append(out(e, "class", "type", "subject", "class"))
    identified = e.filter(F.col("class") != "ConceptualComposition")
    parts.append(out(identified, "data", "hasIdentifier", "subject", "id", 1))
    roles = F.col("class").endswith("Composition")
    parts.append(out(e, "data", F.when(roles, "hasRoleName").otherwise("hasName"), "subject", "label", 2))
    for cls, prop, name in (
        ("BasisEntity", "hasBasisEntity", "conceptual"), ("ConceptualObservable", "hasConceptualObservable", "conceptual"), ("ConceptualEntity", "hasConceptualEntity", "conceptual"),
        ("LogicalEntity", "hasLogicalEntity", "logical"), ("LogicalMeasurement", "hasLogicalMeasurement", "logical"), ("PlatformEntity", "hasPlatformEntity", "platform"),
    ):
        parts.append(out(e.filter(F.col("class") == cls), "object", prop, layer(name), "subject", 3))
    owned = e.filter("owner IS NOT NULL")
    parts.append(out(owned, "object", F.when(F.col("class") == "PlatformComposition", "hasPlatformComposition").otherwise("hasConceptualComposition"), "owner", "subject", 3))
    parts.append(out(linked("specializes"), "object", "specializes", "subject", "_target", 4))
    seen = linked("observable_ref")
    parts += [out(seen, "object", "compositionTarget", "subject", "_target", 4), out(seen, "object", "appliesTo", "_target", "owner", 5)]
    parts.append(out(linked("entity_ref").join(seen.select("message", "subject"), ["message", "subject"], "left_anti"), "object", "compositionTarget", "subject", "_target", 4))
    for cls, prop in (("LogicalEntity", "logicalEntityRealizes"), ("LogicalMeasurement", "measurementRealizes"), ("PlatformEntity", "platformEntityRealizes"), ("PlatformComposition", "platformCompositionRealizes")):
        parts.append(out(linked("realizes", cls), "object", prop, "subject", "_target", 6))
    for field, prop in (("primitive_data_type", "primitiveDataType"), ("numeric_value", "numericValue"), ("value", "hasFieldValue")):
        rows = e.filter(F.col(field).isNotNull() & (F.col(field) != "")) if field == "primitive_data_type" else e.filter(F.col(field).isNotNull())
        parts.append(out(rows, "data", prop, "subject", field, 7))
    shared = [
        ("value_type", "vtype", "measurementValueType", F.lit("LogicalValueType"), ("hasName", "valueTypeName")), ("unit", "unit", "measurementUnit", F.lit("LogicalUnit"), ("hasName", "symbol")),
        ("measurement_system", "msys", "measurementSystem", F.lit("LogicalMeasurementSystem"), ("hasName", "measurementSystemName")),
        ("data_type", "dtype", "platformCompositionTarget", F.when(F.col("data_type").isin(*PRIMITIVES), "PlatformPrimitive").otherwise("PlatformDataType"), ("hasName", "primitiveName")),
        ("coordinate_system", "csys", None, F.lit("LogicalCoordinateSystem"), ("hasName",)),
    ]
    measures = messages.select(F.col("message_id").alias("message"), F.posexplode("logical.measurements").alias("i", "x")).select("message", (F.lit(4 * WIDTH * WIDTH).cast("long") + F.col("i")).alias("pos"), F.col("x.coordinate_system").alias("coordinate_system"))
    for field, prefix, link, cls, names in shared:
        source = measures if field == "coordinate_system" else e
        rows = source.filter(F.col(field).isNotNull() & (F.col(field) != "")).withColumn("_one", F.concat_ws("_", F.lit(prefix), sanitize(field)))
        # The first element that names a shared individual is what it is made from.
        made = rows.groupBy("message", "_one").agg(F.min("pos").alias("pos"), F.min_by(field, "pos").alias(field))
        parts.append(out(made, "class", "type", "_one", cls, 8))
        parts += [out(made, "data", n, "_one", field, 9) for n in names]
        if link:
            parts.append(out(rows, "object", link, "subject", "_one", 10))
    cards = e.filter(F.col("cardinality").isNotNull() & (F.col("cardinality") != "")).withColumn("_card", F.concat_ws("_", F.lit("card"), sanitize("id")))
    lower, upper = parse_cardinality(F.col("cardinality"))
    made = cards.withColumns({"_l": lower, "_u": upper})
    parts += [out(made, "class", "type", "_card", F.lit("Cardinality"), 11), out(made.filter("_u IS NOT NULL"), "data", "lowerBound", "_card", "_l", 12),
              out(made.filter("_u IS NOT NULL"), "data", "upperBound", "_card", "_u", 13), out(cards, "object", "hasCardinality", "subject", "_card", 14)]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("message", "kind", "predicate", "subject", "object").agg(F.min("pos").alias("pos"))


def functional(assertions: DataFrame, keys: list[str]) -> DataFrame:
    """The last value of each single-valued property."""
    return assertions.groupBy(*keys).agg(F.max_by("object", "pos").alias("object"))


def element_counts(assertions: DataFrame) -> DataFrame:
    return assertions.filter("kind = 'class'").groupBy("message", F.col("object").alias("class")).agg(F.count(F.lit(1)).alias("n"))
