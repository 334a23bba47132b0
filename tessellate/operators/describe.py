"""Descriptions of entities for text scorers and encoders: one row an entity, all of a kind built at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellate.functions.text import phrase, split_acronyms, split_case, verb_phrase
from tessellate.operators.graph import ancestors, parents
from tessellate.sources.models import KEY, ModelTables

MOST_ATTRIBUTES = 12
MOST_CHILDREN, MOST_CHILD_ATTRIBUTES = 3, 3
MOST_RELATIONS, MOST_PARTNER_TYPES, MOST_ASSOCIATION_TYPES = 4, 3, 2
MOST_NAME_TYPES, MOST_NAME_ANCESTORS = 5, 2
MOST_MEASURES, MOST_PARTNERS = 8, 2

EMPTY = "array<string>"


def _ordered(value: Column, *at: Column) -> Column:
    """collect_list of a value in the order of positions."""
    rows = F.array_sort(F.collect_list(F.struct(*[a.alias(f"p{i}") for i, a in enumerate(at)], value.alias("v"))))
    return F.transform(rows, lambda x: x["v"])


def _listed(values: Column, separator: str = ", ") -> Column:
    return F.array_join(values, separator)


def entity_context(tables: ModelTables) -> DataFrame:
    """(domain, model, entity, entity_pos, attributes, ancestors): attributes as (name, type, ref) in order."""
    own = tables.attribute.filter("owner_kind = 'entity'").groupBy(*KEY, F.col("owner").alias("entity")).agg(
        _ordered(F.struct(F.col("attr").alias("name"), F.col("type"), F.col("is_entity_ref").alias("ref")), F.col("attr_pos")).alias("attributes")
    )
    above = ancestors(parents(tables))
    empty = F.array().cast("array<struct<name:string,type:string,ref:boolean>>")
    return (
        tables.entity.join(own, [*KEY, "entity"], "left").join(above, [*KEY, "entity"], "left")
        .select(*KEY, "entity", "entity_pos", F.coalesce("attributes", empty).alias("attributes"), F.coalesce("ancestors", F.array().cast(EMPTY)).alias("ancestors"))
    )


def _ancestor_text(above: Column) -> Column:
    named = F.concat(F.lit(" (part of: "), _listed(F.transform(above, lambda a: phrase(a))), F.lit(")"))
    return F.when(F.size(above) > 0, named).otherwise("")


def _attribute_text(attributes: Column) -> Column:
    """The first attributes; a type follows the attribute that names it first."""
    types = F.transform(attributes, lambda a: a["type"])
    parts = F.transform(
        attributes,
        lambda a, i: F.concat(
            phrase(a["name"]),
            F.when((a["type"] != "") & (F.array_position(types, a["type"]) == i + 1), F.concat(F.lit(" ("), phrase(a["type"]), F.lit(")"))).otherwise(""),
        ),
    )
    return F.concat(F.lit(" entity with attributes: "), _listed(F.slice(parts, 1, MOST_ATTRIBUTES)), F.lit("."))


def base_text(name: Column, attributes: Column, above: Column | None = None) -> Column:
    head = F.concat(F.lit("A "), phrase(name), _ancestor_text(above) if above is not None else F.lit(""))
    return F.when(F.size(attributes) == 0, F.concat(head, F.lit(" entity."))).otherwise(F.concat(head, _attribute_text(attributes)))


def _observed(attributes: Column) -> Column:
    return F.filter(attributes, lambda a: ~a["ref"])


def _observed_types(attributes: Column) -> Column:
    """The types of attributes that are neither empty nor entities."""
    return F.transform(F.filter(attributes, lambda a: ~a["ref"] & (a["type"] != "")), lambda a: a["type"])


def describe_plain(tables: ModelTables) -> DataFrame:
    """Name, ancestors and attributes."""
    c = entity_context(tables)
    return c.select(*KEY, "entity", "entity_pos", base_text(F.col("entity"), F.col("attributes"), F.col("ancestors")).alias("description"))


def child_summaries(tables: ModelTables) -> DataFrame:
    """(domain, model, entity, children): the first entity-typed attributes as ``name [attributes]``."""
    c = entity_context(tables)
    names = F.slice(F.transform(_observed(F.col("attributes")), lambda a: phrase(a["name"])), 1, MOST_CHILD_ATTRIBUTES)
    text = F.concat(phrase("entity"), F.when(F.size(names) > 0, F.concat(F.lit(" ["), _listed(names), F.lit("]"))).otherwise(""))
    child = c.select(*KEY, F.col("entity").alias("type"), text.alias("child"))
    inside = tables.attribute.filter("owner_kind = 'entity' AND is_entity_ref").select(*KEY, F.col("owner").alias("entity"), "type", "attr_pos")
    return inside.join(child, [*KEY, "type"]).groupBy(*KEY, "entity").agg(F.slice(_ordered(F.col("child"), F.col("attr_pos")), 1, MOST_CHILDREN).alias("children"))


def describe_children(tables: ModelTables) -> DataFrame:
    """Name, ancestors, child components and the entity's own observables."""
    c = entity_context(tables).join(child_summaries(tables), [*KEY, "entity"], "left")
    own = _observed(F.col("attributes"))
    children = F.coalesce("children", F.array().cast(EMPTY))
    inside = F.when(F.size(children) > 0, F.concat(F.lit(" containing: "), _listed(children, "; "), F.lit(";"))).otherwise("")
    head = F.concat(F.lit("A "), phrase("entity"), _ancestor_text(F.col("ancestors")), F.lit(" entity"), inside)
    tail = F.element_at(F.split(base_text(F.col("entity"), own), " entity "), -1)
    text = (
        F.when(F.size(own) == 0, F.concat(head, F.lit(".")))
        .when(F.size(children) == 0, base_text(F.col("entity"), own, F.col("ancestors")))
        .otherwise(F.concat(head, F.lit(" "), tail))
    )
    return c.select(*KEY, "entity", "entity_pos", text.alias("description"))


def association_index(tables: ModelTables) -> DataFrame:
    """(domain, model, entity, assoc_pos, part_pos, verb, partner_types, association_types), a row each time an entity takes part.

    Partners are the other known participants by name; an association of an entity with itself has none.
    """
    types = entity_context(tables).select(*KEY, "entity", _observed_types(F.col("attributes")).alias("types"))
    part = tables.participant.filter("known").select(*KEY, "assoc_pos", "part_pos", "entity")
    other = part.join(types, [*KEY, "entity"]).select(*KEY, "assoc_pos", F.col("part_pos").alias("_p"), F.col("entity").alias("_e"), "types")
    partners = part.join(other, [*KEY, "assoc_pos"]).filter("entity <> _e").groupBy(*KEY, "assoc_pos", "part_pos").agg(
        F.slice(F.array_distinct(F.flatten(_ordered(F.col("types"), F.col("_p")))), 1, MOST_PARTNER_TYPES).alias("partner_types")
    )
    carried = tables.attribute.filter("owner_kind = 'association' AND NOT is_entity_ref AND type <> ''").groupBy(*KEY, F.col("owner_pos").alias("assoc_pos")).agg(
        F.slice(_ordered(F.col("type"), F.col("attr_pos")), 1, MOST_ASSOCIATION_TYPES).alias("association_types")
    )
    verbs = tables.association.select(*KEY, "assoc_pos", verb_phrase("assoc", "participants").alias("verb"))
    return (
        part.join(verbs, [*KEY, "assoc_pos"]).join(partners, [*KEY, "assoc_pos", "part_pos"], "left").join(carried, [*KEY, "assoc_pos"], "left")
        .select(*KEY, "entity", "assoc_pos", "part_pos", "verb", *[F.coalesce(c, F.array().cast(EMPTY)).alias(c) for c in ("partner_types", "association_types")])
    )


def relations(tables: ModelTables) -> DataFrame:
    """(domain, model, entity, relations): phrases of the first associations."""
    phrases = lambda c: _listed(F.transform(c, lambda t: phrase(t)))
    text = F.concat_ws(
        " ", "verb",
        F.when(F.size("partner_types") > 0, F.concat(F.lit("entity measuring "), phrases(F.col("partner_types")))),
        F.when(F.size("association_types") > 0, F.concat(F.lit("via "), phrases(F.col("association_types")))),
    )
    return association_index(tables).groupBy(*KEY, "entity").agg(
        F.slice(_ordered(text, F.col("assoc_pos"), F.col("part_pos")), 1, MOST_RELATIONS).alias("relations")
    )


def describe_associations(tables: ModelTables) -> DataFrame:
    """The plain description, and the entity's relations after it."""
    plain = describe_plain(tables).join(relations(tables), [*KEY, "entity"], "left")
    with_ = F.concat(F.regexp_replace("description", r"\.+$", ""), F.lit(". Relations: "), _listed(F.col("relations"), "; "), F.lit("."))
    return plain.select(*KEY, "entity", "entity_pos", F.when(F.coalesce(F.size("relations"), F.lit(0)) > 0, with_).otherwise(F.col("description")).alias("description"))


def describe_name_first(tables: ModelTables) -> DataFrame:
    """The name, then types, ancestors and relations, for encoders of synonyms."""
    c = entity_context(tables).join(relations(tables), [*KEY, "entity"], "left")
    types = F.slice(_observed_types(F.col("attributes")), 1, MOST_NAME_TYPES)
    above = F.slice("ancestors", 1, MOST_NAME_ANCESTORS)
    text = F.concat_ws(
        ". ", split_acronyms("entity"),
        F.when(F.size(types) > 0, F.concat(F.lit("measures "), _listed(F.transform(types, lambda t: phrase(t))))),
        F.when(F.size(above) > 0, F.concat(F.lit("part of "), _listed(F.transform(above, lambda a: split_case(a))))),
        F.when(F.coalesce(F.size("relations"), F.lit(0)) > 0, _listed(F.col("relations"), ". ")),
    )
    return c.select(*KEY, "entity", "entity_pos", text.alias("description"))


def describe_distribution(tables: ModelTables, anchors: DataFrame | None = None) -> DataFrame:
    """Name, measures, relations and category, for encoders of whole models. ``anchors``: (domain, model, entity, anchors)."""
    declared = tables.observable.filter("declared").groupBy(*KEY).agg(F.collect_set("observable").alias("declared"))
    c = entity_context(tables).join(declared, KEY, "left")
    given = F.coalesce("declared", F.array().cast(EMPTY))
    kept = F.filter("attributes", lambda a: (a["type"] != "") & F.when(F.size(given) > 0, F.array_contains(given, a["type"])).otherwise(~a["ref"]))
    types = F.slice(F.transform(kept, lambda a: a["type"]), 1, MOST_MEASURES)
    part = tables.participant.select(*KEY, "assoc_pos", "assoc", "part_pos", "entity")
    lists = tables.association.select(*KEY, "assoc_pos", "participants")
    rows = part.join(lists, [*KEY, "assoc_pos"])
    others = F.slice(F.filter("participants", lambda p: p != F.col("entity")), 1, MOST_PARTNERS)
    said = F.concat(phrase("assoc"), F.when(F.size(others) > 0, F.concat(F.lit(" ("), _listed(others), F.lit(")"))).otherwise(""))
    related = rows.groupBy(*KEY, "entity").agg(F.slice(_ordered(said, F.col("assoc_pos"), F.col("part_pos")), 1, MOST_RELATIONS).alias("said"))
    c = c.join(related, [*KEY, "entity"], "left")
    c = c.join(anchors, [*KEY, "entity"], "left") if anchors is not None else c.withColumn("anchors", F.array().cast(EMPTY))
    text = F.concat(
        F.lit("search_document: "), F.col("entity"), F.lit(": "), phrase("entity"), F.lit(". Measures: "),
        F.when(F.size(types) > 0, _listed(types)).otherwise("unspecified"), F.lit(". "),
        F.when(F.coalesce(F.size("said"), F.lit(0)) > 0, F.concat(F.lit("Relations: "), _listed(F.col("said"), "; "), F.lit(". "))).otherwise(""),
        F.lit("Category: "), F.when(F.coalesce(F.size("anchors"), F.lit(0)) > 0, _listed(F.col("anchors"))).otherwise("entity"), F.lit("."),
    )
    return c.select(*KEY, "entity", "entity_pos", text.alias("description"))


def terms(tables: ModelTables) -> DataFrame:
    """(domain, model, kind, term, tokens): entity and attribute names with their tokens, case kept."""
    from tessellate.functions.text import spaced_tokens

    rows = tables.entity.select(*KEY, F.lit("entity").alias("kind"), F.col("entity").alias("term")).unionByName(
        tables.attribute.filter("owner_kind = 'entity'").select(*KEY, F.lit("attribute").alias("kind"), F.col("attr").alias("term"))
    )
    return rows.withColumn("tokens", spaced_tokens("term", lower=False))
