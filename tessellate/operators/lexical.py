"""The lexical matcher: names, observable types and association words of entities, scored for each pair of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellate.functions.similarity import LEXICAL_THRESHOLD, combined_score, jaccard, sequence_ratio, token_similarity
from tessellate.functions.text import case_tokens
from tessellate.operators.assign import by_score, greedy_one_to_one
from tessellate.sources.models import KEY, ModelTables

PAIR = ["domain", "model_a", "model_b"]


def entity_features(tables: ModelTables) -> DataFrame:
    """(domain, model, entity, entity_pos, types, attrs, words, partners) with sets as arrays.

    types: declared observable types; all types that aren't empty where a model declares none. words: those of the names
    of the entity's associations. partners: those of the names of the other participants.
    """
    own = tables.attribute.filter("owner_kind = 'entity'")
    declared = tables.observable.filter("declared").select(*KEY, F.col("observable").alias("type"), F.lit(True).alias("_d"))
    typed = own.join(tables.model.select(*KEY, "declares"), KEY).join(declared, [*KEY, "type"], "left")
    counts = F.col("_d").isNotNull() | (~F.col("declares") & (F.col("type") != ""))
    sets = typed.groupBy(*KEY, F.col("owner").alias("entity")).agg(
        F.collect_set(F.when(counts, F.col("type"))).alias("types"), F.collect_set("attr").alias("attrs")
    )
    part = tables.participant.select(*KEY, "assoc_pos", "assoc", "entity", "known")
    other = part.select(*KEY, "assoc_pos", F.col("entity").alias("other")).distinct()
    words = part.filter("known").groupBy(*KEY, "entity").agg(
        F.array_distinct(F.flatten(F.collect_set(case_tokens("assoc")))).alias("words")
    )
    partners = part.filter("known").join(other, [*KEY, "assoc_pos"]).filter("entity <> other").groupBy(*KEY, "entity").agg(
        F.array_distinct(F.flatten(F.collect_set(case_tokens("other")))).alias("partners")
    )
    out = tables.entity
    for part_ in (sets, words, partners):
        out = out.join(part_, [*KEY, "entity"], "left")
    empty = F.array().cast("array<string>")
    return out.select(*KEY, "entity", "entity_pos", *[F.coalesce(c, empty).alias(c) for c in ("types", "attrs", "words", "partners")])


def candidate_pairs(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """All entities of model_a beside all of model_b, within each row of ``pairs``: the columns of both with _a and _b."""
    cols = [c for c in features.columns if c not in KEY]
    a, b = (features.select("domain", F.col("model").alias(f"model_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in cols]) for s in "ab")
    return pairs.select(*PAIR).join(a, ["domain", "model_a"]).join(b, ["domain", "model_b"])


def lexical_candidates(features: DataFrame, pairs: DataFrame, threshold: float = LEXICAL_THRESHOLD) -> DataFrame:
    """(pair, entity_a, entity_b, score) of ``threshold`` or more. A pair of names is compared once, in whichever models."""
    rows = candidate_pairs(features, pairs)
    names = rows.select("entity_a", "entity_b").distinct()
    tokens = (F.size(case_tokens("entity_a")) > 0) & (F.size(case_tokens("entity_b")) > 0)
    names = names.withColumn("_ratio", sequence_ratio("entity_a", "entity_b")).withColumn(
        "lexical", F.when(tokens, F.greatest("_ratio", token_similarity(F.col("entity_a"), F.col("entity_b")))).otherwise(0.0)
    )
    association = F.greatest(
        jaccard(F.col("words_a"), F.col("words_b")), jaccard(F.col("partners_a"), F.col("partners_b"))
    )
    types = jaccard(F.col("types_a"), F.col("types_b"))
    return (
        rows.join(names.drop("_ratio"), ["entity_a", "entity_b"])
        .select(*PAIR, "entity_a", "entity_b", combined_score(F.col("lexical"), types, association).alias("score"))
        .filter(F.col("score") >= threshold)
    )


def match_lexical(tables: ModelTables, pairs: DataFrame, threshold: float = LEXICAL_THRESHOLD) -> DataFrame:
    """Alignment cells (pair, entity_a, entity_b, score, relation): greedy one-to-one by score."""
    found = lexical_candidates(entity_features(tables), pairs, threshold)
    cells = greedy_one_to_one(found, PAIR, "entity_a", "entity_b", by_score("score", "entity_a", "entity_b"))
    return cells.withColumn("relation", F.lit("="))
