"""Text-pair scorers and text encoders: the places where a neural model can be plugged in.

The defaults are deterministic substitutes that need no model: token containment for entailment, hashed trigram vectors for
sentence embeddings. Their scores aren't those of any neural model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellate.functions.similarity import unit
from tessellate.functions.text import acronym_tokens, grams

#: A scorer turns (premise, hypothesis) columns into one of scores in [0, 1]; an encoder a text column into array<double>.
#: Models go behind iterator pandas UDFs, which load them once a worker.
PairScorer = Callable[[Column, Column], Column]
TextEncoder = Callable[[Column], Column]


def token_containment(premise: Column, hypothesis: Column) -> Column:
    """The share of the premise's tokens that the hypothesis has; 0 where it has none."""
    a, b = F.array_distinct(acronym_tokens(premise)), F.array_distinct(acronym_tokens(hypothesis))
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def hashed_trigrams(dim: int = 128) -> TextEncoder:
    """An encoder of texts as unit vectors of hashed trigram counts."""

    def encode(text: Column) -> Column:
        cells = F.transform(grams(text), lambda g: F.pmod(F.xxhash64(g), F.lit(dim)))
        counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(cells, lambda c: c == i)).cast("double"))
        return unit(counts)

    return encode


def score_pairs(pairs: DataFrame, scorer: PairScorer, premise: str = "desc_smaller", hypothesis: str = "desc_larger") -> DataFrame:
    """Adds fwd and rev scores. Equal pairs of texts are scored once, in whichever row they are."""
    texts = pairs.select(premise, hypothesis).distinct()
    scored = texts.withColumns({"fwd": scorer(F.col(premise), F.col(hypothesis)), "rev": scorer(F.col(hypothesis), F.col(premise))})
    return pairs.join(scored, [premise, hypothesis])


def encode_texts(rows: DataFrame, encoder: TextEncoder, text: str = "description", vector: str = "vector") -> DataFrame:
    """Adds a vector to each row; equal texts are encoded once."""
    return rows.join(rows.select(text).distinct().withColumn(vector, encoder(F.col(text))), text)
