import random

from pyspark.sql import functions as F

from tessellate.functions.similarity import cosine
from tessellate.operators import assign


def greedy(pairs):
    used_a, used_b, out = set(), set(), []
    for s, a, b in sorted(pairs, reverse=True):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append((a, b))
    return sorted(out)


def test_rounds_equal_greedy_and_finish_chains(spark):
    rnd = random.Random(3)
    groups = {g: list({(rnd.randint(0, 4) / 4, f"a{rnd.randint(0, 6)}", f"b{rnd.randint(0, 6)}") for _ in range(25)}) for g in range(6)}
    groups = {g: [(s, a, b) for (a, b), s in {(a, b): s for s, a, b in rows}.items()] for g, rows in groups.items()}
    groups[99] = [(i / 40, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(1, 40)]
    df = spark.createDataFrame([(g, s, a, b) for g, rows in groups.items() for s, a, b in rows], ["g", "score", "a", "b"])
    for most in (2, 20):
        got = assign.greedy_one_to_one(df, ["g"], "a", "b", assign.by_score("score", "a", "b"), most_rounds=most).collect()
        for g, rows in groups.items():
            assert sorted((r.a, r.b) for r in got if r.g == g) == greedy(rows), g


def test_no_pairs(spark):
    df = spark.createDataFrame([], "g int, score double, a string, b string")
    assert assign.greedy_one_to_one(df, ["g"], "a", "b", assign.by_score("score", "a", "b")).count() == 0


def test_losers_of_top_one_are_not_tried_again(spark):
    df = spark.createDataFrame([("q1", "t1", 0.9), ("q2", "t1", 0.8), ("q2", "t2", 0.7)], ["q", "t", "score"])
    got = assign.top_one_then_unique(df, [], "q", "t", [F.col("score").desc(), F.col("q"), F.col("t")]).collect()
    assert [(r.q, r.t) for r in got] == [("q1", "t1")]


def test_sequential_assignment_goes_by_the_sources_order(spark):
    df = spark.createDataFrame([(0, "x", 1, "t", 0.5), (0, "y", 0, "t", 0.4), (0, "x", 1, "u", 0.3)], ["g", "a", "pos", "b", "s"])
    got = assign.assign_in_order(df, ["g"], "a", "b", "pos", [F.col("s").desc(), F.col("b")]).collect()
    assert {(r.a, r.b) for r in got} == {("y", "t"), ("x", "u")}


def test_best_by_cosine_equals_a_slow_version(spark, monkeypatch):
    rnd = random.Random(5)
    for name, most in (("QUERIES", 3), ("TARGETS", 4), ("PACKS", 2)):
        monkeypatch.setattr(assign, name, most)
    nan, odd = float("nan"), [None, [], [0.0] * 3, [0.2, None, 0.1], [1.0, 2.0], [3.0, float("inf"), 1.0]]
    vectors = [[rnd.uniform(-1, 1) for _ in range(3)] for _ in range(20)]
    for extra in ([], [[nan, 1.0, 0.0]]):
        t = [(i, v) for i, v in enumerate(rnd.sample(vectors, 9) * 3 + odd[:5] + [[-0.3, 0.1, -0.2], [-0.6, 0.2, -0.4]] + extra)]
        q = [(i + 100, v) for i, v in enumerate(vectors + odd + [[1.0] * 4, [nan] * 3, [0.3, -0.1, 0.2]])]
        queries, targets = (spark.createDataFrame(x, f"{n} long, v array<double>") for x, n in ((q, "q"), (t, "t")))
        pairs = queries.join(targets.withColumnRenamed("v", "w"), F.lit(True)).select("q", "t", F.round(cosine(F.col("v"), F.col("w")), 6).alias("s"))
        want = assign.top_k(pairs, ["q"], [F.col("s").desc(), F.col("t")]).collect()
        got = assign.best_by_cosine(queries, targets, "q", "t", "v").toDF("q", "t", "s").collect()
        assert {r.q: (r.t, str(r.s)) for r in got} == {r.q: (r.t, str(r.s)) for r in want} and len(got) == len(q)
        assert all(len(r.v or []) != 3 or r.s is not None or None in r.v for r in queries.join(spark.createDataFrame(got), "q").collect())


def test_pairs_of_vectors_are_not_rows(spark, tmp_path):
    from tessellate.plans import registry

    spark.createDataFrame([(i, [float(i % 7), 1.0], 0) for i in range(300)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    plan = registry.QUERIES["top1_then_unique"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "t_units" in plan.split("Join Inner")[0] and "cosine" not in plan and "zip_with" not in plan
