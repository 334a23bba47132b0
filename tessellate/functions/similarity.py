"""Similarities between sets, strings and vectors."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessellate.functions.text import camel_words, case_tokens, grams

LEXICAL, TYPE, ASSOCIATION = 0.50, 0.25, 0.25
LEXICAL_THRESHOLD = 0.28


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Shared over all elements of two sets; ``both_empty`` where neither has any, 0 where one has none."""
    shared, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ == 0, F.lit(both_empty)).otherwise(shared / all_)


def gram_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of trigram sets: 1 where both texts are empty."""
    return jaccard(grams(a), grams(b), both_empty=1.0)


def camel_gram_jaccard(a: Column, b: Column) -> Column:
    return gram_jaccard(camel_words(a), camel_words(b))


@F.pandas_udf(DoubleType())
def sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The ratio of matching blocks of two strings in lower case (not symmetric); equal second strings are indexed once."""
    for a, b in batches:
        out = pd.Series(0.0, index=a.index)
        for text, rows in b.groupby(b).groups.items():
            matcher = SequenceMatcher(None, "", text.lower())
            for i in rows:
                matcher.set_seq1(a[i].lower())
                out[i] = matcher.ratio()
        yield out


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two names' token sets, 0 where one has no token."""
    return jaccard(F.array_distinct(case_tokens(a)), F.array_distinct(case_tokens(b)))


def lexical_similarity(a: Column, b: Column) -> Column:
    """The larger of the token Jaccard and the sequence ratio of two names; 0 where one has no token."""
    none = (F.size(case_tokens(a)) == 0) | (F.size(case_tokens(b)) == 0)
    return F.when(none, 0.0).otherwise(F.greatest(token_similarity(a, b), sequence_ratio(a, b)))


def combined_score(lexical: Column, types: Column, association: Column) -> Column:
    return LEXICAL * lexical + TYPE * types + ASSOCIATION * association


def set_similarity_join(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_set: str, right_set: str, threshold: float, both_empty: float = 0.0
) -> DataFrame:
    """(left_id, right_id, score) for pairs of sets with a Jaccard of ``threshold`` (over 0) or more, by an inverted index.

    Pairs meet where they share an element, so those without one are never built. Of a set's elements only the prefix
    that a partner must share one of is indexed: all but ceil(threshold x size) - 1, the rarest first, so that
    frequent elements join as few rows as can be. Candidates are then compared in full.
    """
    if not threshold > 0:
        raise ValueError("an inverted index needs a threshold over 0")
    sides = [
        df.select(F.col(i).alias("id"), F.array_distinct(F.col(s)).alias("items"))
        for df, i, s in ((left, left_id, left_set), (right, right_id, right_set))
    ]
    rows = [s.select("id", F.explode("items").alias("item")) for s in sides]
    frequency = rows[0].unionByName(rows[1]).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    prefixes = []
    for side, items in zip(sides, rows):
        ordered = items.join(frequency, "item").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("by"))
        size = F.size("by")
        kept = size - F.ceil(F.lit(threshold) * size).cast("int") + 1
        prefixes.append(ordered.select("id", F.explode(F.slice(F.col("by"), F.lit(1), kept)).alias("e")).select("id", F.col("e.item").alias("item")))
    pairs = (
        prefixes[0].select(F.col("id").alias(left_id), "item")
        .join(prefixes[1].select(F.col("id").alias(right_id), "item"), "item")
        .select(left_id, right_id).distinct()
    )
    found = (
        pairs.join(sides[0].select(F.col("id").alias(left_id), F.col("items").alias("_l")), left_id)
        .join(sides[1].select(F.col("id").alias(right_id), F.col("items").alias("_r")), right_id)
        .select(left_id, right_id, jaccard(F.col("_l"), F.col("_r")).alias("score"))
        .filter(F.col("score") >= threshold)
    )
    if both_empty >= threshold:
        none = [s.filter(F.size("items") == 0).select(F.col("id").alias(n)) for s, n in zip(sides, (left_id, right_id))]
        found = found.unionByName(none[0].join(none[1], F.lit(True)).withColumn("score", F.lit(both_empty)))
    return found


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column, dim: int | None = None) -> Column:
    """A vector, or its first ``dim`` numbers, at length 1; a zero vector stays as it is."""
    v = (F.slice(v, 1, dim) if dim else v).cast("array<double>")
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def cosine(a: Column, b: Column, dim: int | None = None) -> Column:
    return dot(unit(a, dim), unit(b, dim))


def symmetric_min(forward: Column, reverse: Column) -> Column:
    """Mutual entailment."""
    return F.least(forward, reverse)


def symmetric_max(forward: Column, reverse: Column) -> Column:
    return F.greatest(forward, reverse)


def asymmetry(forward: Column, reverse: Column) -> Column:
    return forward - reverse


def normalised_distance(distance: Column, reference: Column) -> Column:
    return distance / reference


def inverse_distance(normalised: Column) -> Column:
    """1 at distance 0, 0 from the reference distance on."""
    return F.greatest(F.lit(0.0), 1 - F.least(normalised, F.lit(1.0)))
