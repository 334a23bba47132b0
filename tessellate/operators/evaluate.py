"""Matching labels of two sides, and scoring alignments against a ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellate.functions.similarity import set_similarity_join
from tessellate.functions.text import about, camel_words, grams
from tessellate.operators.assign import by_score, greedy_one_to_one, links_one_to_one
from tessellate.operators.scorers import PairScorer, score_pairs, token_containment

GRAM_THRESHOLD, ENTAILMENT_THRESHOLD, FOUR_PASS_THRESHOLD = 0.2, 0.3, 0.35
ACCEPT, REVIEW = 0.5, 0.2


def _pairs(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Both sides' (id, label), each with each: a query set against all of the other side, which is the smaller one."""
    a, b = (df.select(F.col("id").alias(f"{s}_id"), F.col("label").alias(f"{s}_label")) for df, s in ((src, "src"), (tgt, "tgt")))
    return a.join(b, F.lit(True))


def gram_pairs(src: DataFrame, tgt: DataFrame, camel: bool = False, threshold: float = GRAM_THRESHOLD) -> DataFrame:
    """(src_id, tgt_id, score) of labels whose trigram Jaccard is ``threshold`` or more, by an inverted index of trigrams."""
    text = (lambda c: camel_words(c)) if camel else (lambda c: F.col(c))
    a = src.select(F.col("id").alias("src_id"), grams(text("label")).alias("s"))
    b = tgt.select(F.col("id").alias("tgt_id"), grams(text("label")).alias("t"))
    return set_similarity_join(a, b, "src_id", "tgt_id", "s", "t", threshold, both_empty=1.0)


def greedy_labels(scored: DataFrame) -> DataFrame:
    """One-to-one pairs by score, then ids, all descending; scores with four decimals."""
    found = greedy_one_to_one(scored, [], "src_id", "tgt_id", by_score("score", "src_id", "tgt_id"))
    return found.withColumn("score", F.bround("score", 4))


def entailed_pairs(src: DataFrame, tgt: DataFrame, scorer: PairScorer = token_containment) -> DataFrame:
    """(src_id, tgt_id, src_label, tgt_label, fwd, rev, score) of all pairs; the score is the larger of both directions'."""
    rows = _pairs(src, tgt).withColumns({"_a": about("src_label"), "_b": about("tgt_label")})
    return score_pairs(rows, scorer, "_a", "_b").withColumn("score", F.greatest("fwd", "rev")).drop("_a", "_b")


def evaluate_methods(
    src: DataFrame, tgt: DataFrame, links: DataFrame | None = None, scorer: PairScorer | None = None
) -> DataFrame:
    """alignment (method, src_id, tgt_id, score) of every method: given links, trigrams, camel-split trigrams and a text scorer."""
    parts = [
        greedy_labels(gram_pairs(src, tgt)).withColumn("method", F.lit("trigram")),
        greedy_labels(gram_pairs(src, tgt, camel=True)).withColumn("method", F.lit("camel_trigram")),
    ]
    if links is not None:
        known = links.join(src.select(F.col("id").alias("src_id")), "src_id", "left_semi").join(tgt.select(F.col("id").alias("tgt_id")), "tgt_id", "left_semi")
        own = links_one_to_one(known.select("src_id", "tgt_id").distinct(), [], "src_id", "tgt_id")
        parts.append(own.select("src_id", "tgt_id", F.lit(1.0).alias("score"), F.lit("links").alias("method")))
    if scorer is not None:
        scored = entailed_pairs(src, tgt, scorer).filter(F.col("score") >= ENTAILMENT_THRESHOLD).select("src_id", "tgt_id", "score")
        parts.append(greedy_labels(scored).withColumn("method", F.lit("entailment")))
    out = parts[0].select("method", "src_id", "tgt_id", "score")
    for p in parts[1:]:
        out = out.unionByName(p.select("method", "src_id", "tgt_id", "score"))
    return out


def true_positives(alignment: DataFrame, truth: DataFrame) -> DataFrame:
    return alignment.join(truth.select("src_id", "tgt_id"), ["src_id", "tgt_id"], "left_semi")


def missed(alignment: DataFrame, truth: DataFrame, methods: DataFrame) -> DataFrame:
    """(method, src_id, tgt_id) of the truth that a method hasn't found."""
    return methods.join(truth.select("src_id", "tgt_id"), F.lit(True)).join(alignment, ["method", "src_id", "tgt_id"], "left_anti")


def ratio(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(0.0)


def precision_recall_f1(alignment: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pairs, precision, recall, f1) with three decimals; 0 where there is nothing to divide by."""
    marked = alignment.join(truth.select("src_id", "tgt_id", F.lit(1).alias("_t")), ["src_id", "tgt_id"], "left")
    sums = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.count("_t").alias("_tp"))
    rows = sums.crossJoin(F.broadcast(truth.agg(F.count(F.lit(1)).alias("_all"))))
    return rows.select(*keys, "pairs", *scores(F.col("_tp"), F.col("pairs"), F.col("_all")))


def scores(tp: Column, predicted: Column, actual: Column) -> list[Column]:
    p, r = ratio(tp, predicted), ratio(tp, actual)
    return [F.bround(p, 3).alias("precision"), F.bround(r, 3).alias("recall"), F.bround(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 3).alias("f1")]


def link_bands(src: DataFrame, tgt: DataFrame, accept: float = ACCEPT, review: float = REVIEW) -> DataFrame:
    """Trigram links with their band, ``accept`` or ``review``: what an external linker would write to its two files."""
    scored = gram_pairs(src, tgt, threshold=review)
    return scored.withColumn("band", F.when(F.col("score") >= accept, "accept").otherwise("review"))


def four_passes(observables_a: DataFrame, entities_a: DataFrame, observables_b: DataFrame, entities_b: DataFrame, links: DataFrame | None = None,
                scorer: PairScorer = token_containment, threshold: float = FOUR_PASS_THRESHOLD) -> DataFrame:
    """(pass, src_id, tgt_id, src_label, tgt_label, score, linked): all pairs of four passes from ``threshold`` on, not one-to-one.

    Observables with observables and entities with entities by the larger direction; entities with the other side's
    observables by the forward one.
    """
    parts = []
    for name, src, tgt, score in (
        ("observable_observable", observables_a, observables_b, F.greatest("fwd", "rev")), ("entity_observable", entities_a, observables_b, F.col("fwd")),
        ("entity_observable_reverse", entities_b, observables_a, F.col("fwd")), ("entity_entity", entities_a, entities_b, F.greatest("fwd", "rev")),
    ):
        sentence = "This observable is about {}." if name == "observable_observable" else "This is about {}."
        rows = _pairs(src, tgt).withColumns({"_a": about("src_label", sentence), "_b": about("tgt_label", sentence)})
        rows = score_pairs(rows, scorer, "_a", "_b").withColumn("score", score).filter(F.col("score") >= threshold)
        parts.append(rows.select(F.lit(name).alias("pass"), "src_id", "tgt_id", "src_label", "tgt_label", "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if links is None:
        return out.withColumn("linked", F.lit(False))
    marks = links.select("src_id", "tgt_id").distinct().withColumn("_l", F.lit(True))
    return out.join(marks, ["src_id", "tgt_id"], "left").withColumn("linked", F.col("_l").isNotNull()).drop("_l")
