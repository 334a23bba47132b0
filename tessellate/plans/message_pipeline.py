"""Two layered messages from JSON to scores: assertions, labels, alignments of every method, precision, recall and F1."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellate.operators.evaluate import evaluate_methods, link_bands, missed, precision_recall_f1
from tessellate.operators.scorers import PairScorer
from tessellate.plans.lineage import cut
from tessellate.sources.alignments import class_labels, read_ground_truth
from tessellate.sources.messages import read_messages, to_assertions


@dataclass
class Comparison:
    """assertions of both messages, bands of trigram links, alignment by method, and scores and missed pairs where a truth is given."""

    assertions: DataFrame
    bands: DataFrame
    alignment: DataFrame
    scores: DataFrame | None
    missed: DataFrame | None


def compare_messages(
    spark: SparkSession, source: str, target: str, ground_truth: str | None = None, scorer: PairScorer | None = None,
    cls: str = "ConceptualObservable", compat: str = "resolve",
) -> Comparison:
    sides = [cut(to_assertions(read_messages(spark, path), compat)) for path in (source, target)]
    src, tgt = (cut(class_labels(a, cls)) for a in sides)
    bands = cut(link_bands(src, tgt))
    alignment = cut(evaluate_methods(src, tgt, links=bands.select("src_id", "tgt_id"), scorer=scorer))
    scores = lost = None
    if ground_truth:
        truth = cut(read_ground_truth(spark, ground_truth, src, tgt))
        scores = precision_recall_f1(alignment, truth, ["method"])
        lost = missed(alignment, truth, alignment.select("method").distinct())
    every = sides[0].withColumn("side", F.lit("source")).unionByName(sides[1].withColumn("side", F.lit("target")))
    return Comparison(every, bands, alignment, scores, lost)
