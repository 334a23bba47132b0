import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellate.functions import similarity as S
from tessellate.functions import text as T


def one(spark, column, **values):
    names = list(values) or ["x"]
    row = spark.createDataFrame([tuple(values.values()) or ("",)], names)
    return row.select(column.alias("r")).first().r


@pytest.mark.parametrize("f, name, want", [
    (T.phrase, "BrakeRotor", "brake rotor"), (T.phrase, "ECUModule", "ecu module"), (T.case_tokens, "ECUModule", ["ecumodule"]),
    (T.acronym_tokens, "ECUModule", ["ecu", "module"]), (T.long_token_set, "A_bX", []), (T.sanitize, " Smart Home - V2! ", "Smart_Home_V2"),
    (T.sanitize, "--", "unknown"), (T.camel_words, "TrueAirspeed", "true airspeed"), (T.grams, "ab", ["a", "b"]), (T.grams, "abcd", ["abc", "bcd"]),
    (T.grams, "", []), (T.spaced_tokens, "A_bX cd", ["a_b", "x", "cd"]), (T.word_tokens, "RodLinksABC", ["rod", "links", "abc"]),
])
def test_text_vectors(spark, f, name, want):
    assert one(spark, f("n"), n=name) == want


def test_verbs_keep_repeats_and_fall_back(spark):
    verb = T.verb_phrase("n", F.array(F.lit("Engine"), F.lit("Transmission")))
    assert one(spark, verb, n="EngineToTransmissionCoupling") == "to coupling"
    assert one(spark, verb, n="EngineTransmission") == "engine transmission"
    assert one(spark, T.verb_phrase("n", F.array(F.lit("X"))), n="ToXTo") == "to to"


def test_gram_jaccard_of_empty_texts(spark):
    assert one(spark, S.gram_jaccard(F.col("a"), F.col("b")), a="", b="") == 1.0
    assert one(spark, S.gram_jaccard(F.col("a"), F.col("b")), a="", b="abc") == 0.0


def test_sequence_ratio_keeps_orientation(spark):
    rnd = random.Random(1)
    pairs = [("".join(rnd.choices("abAB ", k=rnd.randint(0, 12))), "".join(rnd.choices("abAB ", k=rnd.randint(0, 12)))) for _ in range(200)]
    got = spark.createDataFrame(pairs, ["a", "b"]).select("a", "b", S.sequence_ratio("a", "b").alias("r")).collect()
    assert all(r.r == SequenceMatcher(None, r.a.lower(), r.b.lower()).ratio() for r in got)


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
def test_set_join_is_the_filtered_cross_product(spark, threshold):
    rnd = random.Random(7)
    sets = [(i, rnd.sample("abcdefghij", rnd.randint(0, 6))) for i in range(60)]
    df = spark.createDataFrame(sets, "id int, s array<string>")
    got = S.set_similarity_join(df.select(F.col("id").alias("a"), "s"), df.select(F.col("id").alias("b"), "s"), "a", "b", "s", "s", threshold, both_empty=1.0).collect()
    want = {(i, j) for i, x in sets for j, y in sets if (1.0 if not x and not y else len({*x} & {*y}) / len({*x} | {*y})) >= threshold}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_vectors(spark):
    a, b = np.arange(8.0), np.ones(8)
    got = one(spark, S.cosine(F.col("a"), F.col("b")), a=a.tolist(), b=b.tolist())
    assert got == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert one(spark, S.unit(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, S.cosine(F.col("a"), F.col("b"), 2), a=[3.0, 4.0, 9.0], b=[3.0, 4.0, -9.0]) == pytest.approx(1)
