"""Confirming alignments from both sides, and the reports and coverages that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellate.operators.lexical import PAIR, match_lexical
from tessellate.sources.models import ModelTables

STATUSES = ("matched", "ambiguous", "missing")


def confirm(
    elements: DataFrame, forward: DataFrame, backward: DataFrame, keys: list[str], element: str = "element", mode: str = "mutual"
) -> DataFrame:
    """Adds status and matched_to to ``elements`` from two maps (keys, source, target), each of one target per source.

    ``mutual``: matched if the target's own target is the element, ambiguous if not, missing without a target.
    ``as_coded``: the backward map is inverted first, so that it is asked for a source with a target's name; only equal or
    swapped names so confirm. It is there to reproduce published counts.
    """
    fwd = forward.select(*keys, F.col("source").alias(element), F.col("target").alias("matched_to"))
    if mode == "mutual":
        back = backward.select(*keys, F.col("source").alias("matched_to"), F.col("target").alias("_back"))
    elif mode == "as_coded":
        back = backward.groupBy(*keys, F.col("target").alias("matched_to")).agg(F.max_by("source", "source").alias("_back"))
    else:
        raise ValueError("mode is mutual or as_coded")
    status = (
        F.when(F.col("matched_to").isNull(), "missing").when(F.col("_back") == F.col(element), "matched").otherwise("ambiguous")
    )
    return (
        elements.join(fwd, [*keys, element], "left").join(back, [*keys, "matched_to"], "left")
        .withColumn("status", status).select(*elements.columns, "status", "matched_to")
    )


def crosstype_status(tables: ModelTables, pairs: DataFrame, mode: str = "mutual") -> DataFrame:
    """element_status (pair, side, kind, entity, name, status, matched_to) of entities, from lexical runs in both directions."""
    swapped = pairs.select("domain", F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"))
    ab = match_lexical(tables, pairs).select(*PAIR, F.col("entity_a").alias("source"), F.col("entity_b").alias("target"))
    ba = match_lexical(tables, swapped).select(
        "domain", F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), F.col("entity_a").alias("source"), F.col("entity_b").alias("target")
    )
    out = None
    for side, model, forward, backward in (("a", "model_a", ab, ba), ("b", "model_b", ba, ab)):
        own = tables.entity.select("domain", F.col("model").alias(model), F.col("entity").alias("element"), "entity_pos")
        rows = pairs.select(*PAIR).join(own, ["domain", model]).select(*PAIR, "element", "entity_pos")
        rows = confirm(rows, forward, backward, PAIR, mode=mode).select(
            *PAIR, F.lit(side).alias("side"), F.lit("entity").alias("kind"), F.col("element").alias("entity"),
            F.col("element").alias("name"), "entity_pos", "status", "matched_to",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def rdf_status(tables: ModelTables, pairs: DataFrame, iris: DataFrame, cells: DataFrame) -> DataFrame:
    """element_status of entities and attributes from alignment cells (source, target: IRIs, one target per source).

    Cells of both directions are in one table; each is read as forward for the side whose elements are its sources.
    """
    info = iris.select(F.col("iri").alias("matched_iri"), F.when(F.col("kind") == "attribute", F.concat_ws(".", "entity", "name")).otherwise(F.col("name")).alias("matched_to"))
    out = None
    for side, model, other in (("a", "model_a", "model_b"), ("b", "model_b", "model_a")):
        own = iris.filter("kind IN ('entity', 'attribute')").withColumnRenamed("model", model)
        rows = pairs.select(*PAIR).join(own, ["domain", model])
        keys = ["domain", "from_model", "to_model"]
        cell = cells.select(*keys, "source", "target")
        fwd = cell.select("domain", F.col("from_model").alias(model), F.col("to_model").alias(other), F.col("source").alias("iri"), F.col("target").alias("matched_iri"))
        back = cell.select("domain", F.col("from_model").alias(other), F.col("to_model").alias(model), F.col("source").alias("matched_iri"), F.col("target").alias("_back"))
        rows = (
            rows.join(fwd, [*PAIR, "iri"], "left").join(back, [*PAIR, "matched_iri"], "left").join(info, "matched_iri", "left")
            .select(
                *PAIR, F.lit(side).alias("side"), "kind", "entity", "name",
                F.when(F.col("matched_iri").isNull(), "missing").when(F.col("_back") == F.col("iri"), "matched").otherwise("ambiguous").alias("status"),
                "matched_to",
            )
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def status_counts(status: DataFrame, kinds: tuple[str, ...] = ("entity", "attribute"), keys: list[str] = PAIR) -> DataFrame:
    """(keys, side, matched, ambiguous, missing) over elements of ``kinds``."""
    return status.filter(F.col("kind").isin(*kinds)).groupBy(*keys, "side").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def coverage(matched: Column, total: Column) -> Column:
    """Percent with one decimal; 0 without elements."""
    return F.when(total == 0, 0.0).otherwise(F.round(100 * matched / total, 1))


def smaller_side(counts: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """(keys, small, large, total, matched): the side of fewer elements, ``a`` when equal."""
    total = F.col("matched") + F.col("ambiguous") + F.col("missing")
    a, b = (counts.filter(F.col("side") == s).select(*keys, total.alias(f"_t{s}"), F.col("matched").alias(f"_m{s}")) for s in "ab")
    first = F.col("_ta") <= F.col("_tb")
    return a.join(b, keys).select(
        *keys, F.when(first, "a").otherwise("b").alias("small"), F.when(first, "b").otherwise("a").alias("large"),
        F.when(first, F.col("_ta")).otherwise(F.col("_tb")).alias("total"), F.when(first, F.col("_ma")).otherwise(F.col("_mb")).alias("matched"),
    )


def unmapped(status: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """The missing elements of each pair's smaller side, with its coverage."""
    side = smaller_side(status_counts(status, keys=keys), keys)
    return (
        status.join(side, keys).filter("side = small AND status = 'missing'")
        .select(*keys, "side", coverage(F.col("matched"), F.col("total")).alias("coverage_pct"), "kind", "entity",
                F.when(F.col("kind") == "attribute", F.col("name")).otherwise("").alias("attribute"))
    )


def statuses_of_reports(reports: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """(keys, side, kind, entity, name, status, matched_to): the elements of reports as ``pair_reports`` makes them, or as they were read back."""
    sides = [reports.select(*keys, F.lit(s).alias("side"), F.explode(f"side_{s}.elements").alias("e")) for s in "ab"]
    return sides[0].unionByName(sides[1]).select(*keys, "side", *[F.col(f"e.{c}").alias(c) for c in ("kind", "entity", "name", "status", "matched_to")])


def pair_reports(status: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """Nested reports, one row a pair: summary counts and the elements of each side."""
    item = F.struct("kind", "entity", "name", "status", "matched_to")
    sides = status.groupBy(*keys, "side").agg(
        F.array_sort(F.collect_list(item)).alias("elements"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    )
    whole = F.struct(F.struct(*STATUSES).alias("summary"), "elements")
    return sides.groupBy(*keys).agg(*[F.first(F.when(F.col("side") == s, whole), ignorenulls=True).alias(f"side_{s}") for s in "ab"])
