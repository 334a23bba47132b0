"""The engine's registered queries over the relational tables, and the SQL that each is held against.

Each query is an operator on whole tables. Where SQL is too slow on them there is none, and a test holds the query against a slow
version. Names of parts (``p_name``) stand for labels of entities: those with an even first
character are one side, the others the other side.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellate.functions.similarity import (
    asymmetry, camel_gram_jaccard, combined_score, cosine, dot, gram_jaccard, inverse_distance, jaccard, lexical_similarity, set_similarity_join,
)
from tessellate.functions.text import (
    about, acronym_tokens, camel_words, case_tokens, grams, local_name, long_token_set, phrase, sanitize, spaced_tokens, verb_phrase,
)
from tessellate.operators import assign, confirm, describe, distribution, evaluate, graph
from tessellate.operators.cascade import dominant_stage, stage_counts, subsumption_groups
from tessellate.operators.scorers import token_containment
from tessellate.operators.structural import lin_similarity
from tessellate.plans.lineage import cut, parts
from tessellate.sources.messages import parse_cardinality

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def _labels(spark, sf_dir) -> DataFrame:
    """(name, side, tokens, grams) of the distinct part names."""
    names = _t(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    side = F.when(F.ascii("name") % 2 == 0, "a").otherwise("b")
    return names.select("name", side.alias("side"), F.array_distinct(case_tokens("name")).alias("tokens"), grams("name").alias("grams"))


def _sides(spark, sf_dir, column: str = "grams") -> tuple[DataFrame, DataFrame]:
    labels = _labels(spark, sf_dir)
    return tuple(labels.filter(F.col("side") == s).select(F.col("name").alias(f"name_{s}"), F.col(column).alias(f"set_{s}")) for s in "ab")


def _scored(spark, sf_dir, threshold: float = 0.2) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return set_similarity_join(a, b, "name_a", "name_b", "set_a", "set_b", threshold)


NAMES = "names AS (SELECT DISTINCT p_name AS name, CASE WHEN ascii(p_name) % 2 = 0 THEN 'a' ELSE 'b' END AS side FROM part)"
GRAMS = (
    "g AS (SELECT name, side, list_distinct([substr(lower(name), i, 3) for i in range(1, greatest(length(name) - 2, 1) + 1)]) AS s FROM names)"
)
SCORED = f"""{NAMES}, {GRAMS},
    scored AS (SELECT a.name AS name_a, b.name AS name_b,
                      len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(a.s || b.s)) AS score
               FROM g a, g b WHERE a.side = 'a' AND b.side = 'b'),
    p AS (SELECT * FROM scored WHERE score >= 0.2)"""
TARGETS = f"""{SCORED},
    fwd AS (SELECT name_a, name_b FROM scored WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY name_a ORDER BY score DESC, name_b) = 1),
    back AS (SELECT name_b, name_a FROM scored WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY name_b ORDER BY score DESC, name_a) = 1),
    st AS (SELECT 'a' AS side, names.name AS element,
                  CASE WHEN fwd.name_b IS NULL THEN 'missing' WHEN back.name_a = names.name THEN 'matched' ELSE 'ambiguous' END AS status,
                  fwd.name_b AS matched_to
           FROM names LEFT JOIN fwd ON fwd.name_a = names.name LEFT JOIN back ON back.name_b = fwd.name_b WHERE side = 'a'
           UNION ALL
           SELECT 'b', names.name, CASE WHEN back.name_a IS NULL THEN 'missing' WHEN fwd.name_b = names.name THEN 'matched' ELSE 'ambiguous' END, back.name_a
           FROM names LEFT JOIN back ON back.name_b = names.name LEFT JOIN fwd ON fwd.name_a = back.name_a WHERE side = 'b')"""

# ---------------------------------------------------------------- text


@query(r"""
    WITH n AS (SELECT DISTINCT p_name || '_' || p_brand || ' ' || p_type AS name FROM part
               UNION SELECT s_name FROM supplier UNION SELECT 'My' || n_name || 'XMLParser' FROM nation),
    s AS (SELECT name, regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g') AS c,
                 regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g') AS a FROM n)
    SELECT name, array_to_string([lower(x) for x in regexp_split_to_array(c, '[^A-Za-z0-9]+') if x <> ''], '|') AS case_tokens,
           array_to_string([lower(x) for x in regexp_split_to_array(a, '[^A-Za-z0-9]+') if x <> ''], '|') AS acronym_tokens,
           array_to_string(list_sort(list_distinct([lower(x) for x in regexp_split_to_array(a, '[^A-Za-z0-9]+') if length(x) > 1])), '|') AS long_tokens,
           array_to_string([lower(x) for x in regexp_split_to_array(a, '\s+') if x <> ''], '|') AS spaced_tokens
    FROM s""")
def tokenize_names(spark, sf_dir):
    p, s, n = (_t(spark, sf_dir, x) for x in ("part", "supplier", "nation"))
    names = p.select(F.concat("p_name", F.lit("_"), "p_brand", F.lit(" "), "p_type").alias("name")).union(s.select("s_name")).union(
        n.select(F.concat(F.lit("My"), "n_name", F.lit("XMLParser")))).distinct()
    join = lambda c: F.array_join(c, "|")
    return names.select(
        "name", join(case_tokens("name")).alias("case_tokens"), join(acronym_tokens("name")).alias("acronym_tokens"),
        join(F.array_sort(long_token_set("name"))).alias("long_tokens"), join(spaced_tokens("name")).alias("spaced_tokens"),
    )


@query(r"""
    SELECT s_suppkey, regexp_replace(trim(regexp_replace(regexp_replace(trim(s_name), '[^A-Za-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_'), '^$', 'unknown') AS safe,
           regexp_replace(s_name, '[^A-Za-z0-9_]', '_', 'g') AS plain,
           trim(regexp_replace(regexp_replace(s_name, '[^A-Za-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_') || '_' || n_name || '_sup' AS local
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def safe_local_names(spark, sf_dir):
    s, n = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", sanitize("s_name").alias("safe"), sanitize("s_name", collapse=False).alias("plain"), local_name("s_name", "n_name", F.lit("sup")).alias("local"))


@query(r"""
    WITH n AS (SELECT DISTINCT upper(p_name[1]) || p_name[2:] || p_type || 'Unit' AS name FROM part)
    SELECT name, trim(lower(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'))) AS phrase,
           regexp_replace(lower(trim(regexp_replace(name, '([A-Z][a-z]+)', ' \1', 'g'))), '\s+', ' ', 'g') AS camel,
           'This is about ' || name || '.' AS sentence
    FROM n""")
def camel_phrase(spark, sf_dir):
    first = F.upper(F.left("p_name", F.lit(1)))
    names = _t(spark, sf_dir, "part").select(F.concat(first, F.expr("substring(p_name, 2)"), "p_type", F.lit("Unit")).alias("name")).distinct()
    return names.select("name", phrase("name").alias("phrase"), camel_words("name").alias("camel"), about("name", "This is about {}.").alias("sentence"))


@query("""
    WITH n AS (SELECT DISTINCT p_brand, p_type, p_name FROM part),
    t AS (SELECT p_name, p_type, string_split(p_name, ' ') AS w FROM n)
    SELECT DISTINCT p_name, p_type, CASE WHEN len([x for x in w if x <> 'widget']) > 0 THEN array_to_string([x for x in w if x <> 'widget'], ' ') ELSE p_name END AS verb FROM t""")
def verb_phrases(spark, sf_dir):
    names = _t(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    return names.select("p_name", "p_type", verb_phrase("p_name", F.array(F.lit("Widget"))).alias("verb"))


@query(r"""
    WITH c AS (SELECT DISTINCT p_size, CASE p_size % 4 WHEN 0 THEN p_size || '..*' WHEN 1 THEN '0..' || p_size WHEN 2 THEN p_size::VARCHAR ELSE 'x..' || p_size END AS t FROM part),
    s AS (SELECT p_size, t, split_part(t, '..', 1) AS l, CASE WHEN contains(t, '..') THEN split_part(t, '..', 2) ELSE t END AS u FROM c)
    SELECT p_size, t AS cardinality, CASE WHEN regexp_full_match(l, '[0-9]+') THEN l::INT ELSE 0 END AS lower_bound, CASE WHEN u = '*' THEN -1 ELSE u::INT END AS upper_bound FROM s""")
def cardinality_parse(spark, sf_dir):
    size = F.col("p_size").cast("string")
    kind = F.col("p_size") % 4
    text = F.when(kind == 0, F.concat(size, F.lit("..*"))).when(kind == 1, F.concat(F.lit("0.."), size)).when(kind == 2, size).otherwise(F.concat(F.lit("x.."), size))
    rows = _t(spark, sf_dir, "part").select("p_size", text.alias("cardinality")).distinct()
    lower, upper = parse_cardinality(F.col("cardinality"))
    return rows.select("p_size", "cardinality", lower.alias("lower_bound"), upper.alias("upper_bound"))


# ---------------------------------------------------------------- similarity and assignment


@query(f"WITH {SCORED} SELECT name_a, name_b, round(score, 6) AS score FROM p")
def trigram_pairs(spark, sf_dir):
    return _scored(spark, sf_dir).select("name_a", "name_b", F.round("score", 6).alias("score"))


@query(f"""
    WITH {NAMES}, w AS (SELECT name, side, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS c FROM names),
    h AS (SELECT name, side, list_distinct([substr(c, i, 3) for i in range(1, greatest(length(c) - 2, 1) + 1)]) AS s FROM w)
    SELECT a.name AS name_a, b.name AS name_b, round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(a.s || b.s)), 6) AS plain,
           round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(a.s || b.s)), 6) AS camel
    FROM h a, h b WHERE a.side = 'a' AND b.side = 'b'""")
def all_pairs_scored(spark, sf_dir):
    labels = _labels(spark, sf_dir)
    a, b = (labels.filter(F.col("side") == s).select(F.col("name").alias(f"name_{s}")) for s in "ab")
    pairs = a.join(b, F.lit(True))  # every pair of two bounded vocabularies is the result that is asked for
    return pairs.select("name_a", "name_b", F.round(gram_jaccard(F.col("name_a"), F.col("name_b")), 6).alias("plain"), F.round(camel_gram_jaccard(F.col("name_a"), F.col("name_b")), 6).alias("camel"))


@query(f"""
    WITH RECURSIVE {SCORED},
    o AS (SELECT *, row_number() OVER (ORDER BY score DESC, name_a DESC, name_b DESC) AS i FROM p),
    r AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS ua, []::VARCHAR[] AS ub, false AS taken
          UNION ALL
          SELECT o.i, CASE WHEN list_contains(ua, name_a) OR list_contains(ub, name_b) THEN ua ELSE list_append(ua, name_a) END,
                 CASE WHEN list_contains(ua, name_a) OR list_contains(ub, name_b) THEN ub ELSE list_append(ub, name_b) END,
                 NOT (list_contains(ua, name_a) OR list_contains(ub, name_b))
          FROM r JOIN o ON o.i = r.i + 1)
    SELECT name_a, name_b, round(score, 6) AS score FROM r JOIN o USING (i) WHERE taken""")
def trigram_greedy(spark, sf_dir):
    found = assign.greedy_one_to_one(_scored(spark, sf_dir), [], "name_a", "name_b", assign.by_score("score", "name_a", "name_b"))
    return found.select("name_a", "name_b", F.round("score", 6).alias("score"))


@query(f"""
    WITH RECURSIVE {SCORED},
    o AS (SELECT name_a, name_b, row_number() OVER (ORDER BY name_a, name_b) AS i FROM p),
    r AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS ua, []::VARCHAR[] AS ub, false AS taken
          UNION ALL
          SELECT o.i, CASE WHEN list_contains(ua, name_a) OR list_contains(ub, name_b) THEN ua ELSE list_append(ua, name_a) END,
                 CASE WHEN list_contains(ua, name_a) OR list_contains(ub, name_b) THEN ub ELSE list_append(ub, name_b) END,
                 NOT (list_contains(ua, name_a) OR list_contains(ub, name_b))
          FROM r JOIN o ON o.i = r.i + 1)
    SELECT name_a, name_b FROM r JOIN o USING (i) WHERE taken""")
def links_one_to_one(spark, sf_dir):
    return assign.links_one_to_one(_scored(spark, sf_dir).select("name_a", "name_b"), [], "name_a", "name_b")


@query(f"""
    WITH {NAMES}, g AS (SELECT name, side, list_distinct(string_split(lower(name), ' ')) AS s FROM names)
    SELECT a.name AS name_a, b.name AS name_b, round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(a.s || b.s)), 6) AS score
    FROM g a, g b WHERE a.side = 'a' AND b.side = 'b' AND len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(a.s || b.s)) >= 0.3""")
def token_jaccard_pairs(spark, sf_dir):
    a, b = _sides(spark, sf_dir, "tokens")
    return set_similarity_join(a, b, "name_a", "name_b", "set_a", "set_b", 0.3).withColumn("score", F.round("score", 6))


@query("""
    WITH s AS (SELECT l_suppkey AS k, list(DISTINCT p_name) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT a.k AS supp_a, b.k AS supp_b, round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(a.s || b.s)), 6) AS score
    FROM s a JOIN s b ON a.k < b.k WHERE len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(a.s || b.s)) >= 0.3""")
def signature_jaccard(spark, sf_dir):
    """Equal sets are compared once, and their suppliers paired afterwards."""
    line, part = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part")
    items = line.select("l_suppkey", "l_partkey").join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_name").distinct()
    sets = cut(items.groupBy("l_suppkey").agg(F.array_sort(F.collect_set("p_name")).alias("s")))  # read five times below
    kinds = sets.groupBy("s").agg(F.min("l_suppkey").alias("kind"), F.count(F.lit(1)).alias("n"))
    a, b = (kinds.select(F.col("kind").alias(f"kind_{x}"), F.col("s").alias(f"s_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    scored = cut(set_similarity_join(a, b, "kind_a", "kind_b", "s_a", "s_b", 0.3))
    pairs = scored.join(a, "kind_a").join(b, "kind_b").agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0] or 0
    # Most suppliers can have one set, so they are paired by blocks of a thousand, which are dealt before they become rows.
    block = F.pmod(F.hash("l_suppkey"), F.ceil(F.col("n") / 1000)).alias("block")
    blocks = sets.join(kinds, "s").groupBy("kind", block).agg(F.collect_list("l_suppkey").alias("supp"))
    of_a, of_b = (blocks.select(*[F.col(c).alias(f"{c}_{x}") for c in blocks.columns]) for x in "ab")
    met = scored.join(of_a, "kind_a").join(of_b, "kind_b").repartition(parts(spark, pairs), "kind_a", "block_a", "kind_b", "block_b")
    rows = met.select("score", "supp_b", F.explode("supp_a").alias("supp_a")).select("score", "supp_a", F.explode("supp_b").alias("supp_b"))
    return rows.filter("supp_a < supp_b").select("supp_a", "supp_b", F.round("score", 6).alias("score"))


def _part_features(spark, sf_dir) -> DataFrame:
    """(name, side, types, words): what each part name comes with."""
    part = _t(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(
        F.collect_set("p_type").alias("types"), F.collect_set(F.concat(F.lit("b"), F.col("p_size") % 7)).alias("words"), F.collect_set(F.when(F.col("p_size") > 45, F.col("p_brand"))).alias("partners"))
    return part.withColumns({"side": F.when(F.ascii("name") % 2 == 0, "a").otherwise("b"), "tokens": F.array_distinct(case_tokens("name"))})


@query(f"""
    WITH {NAMES}, f AS (SELECT p_name AS name, list(DISTINCT p_type) AS types, list(DISTINCT 'b' || (p_size % 7)) AS words,
            coalesce(list(DISTINCT p_brand) FILTER (p_size > 45), []) AS partners, list_distinct(string_split(lower(p_name), ' ')) AS tokens FROM part GROUP BY p_name),
    g AS (SELECT * FROM names JOIN f USING (name)),
    s AS (SELECT a.name AS name_a, b.name AS name_b,
        len(list_intersect(a.tokens, b.tokens))::DOUBLE / len(list_distinct(a.tokens || b.tokens)) AS lex,
        len(list_intersect(a.types, b.types))::DOUBLE / len(list_distinct(a.types || b.types)) AS typ,
        greatest(len(list_intersect(a.words, b.words))::DOUBLE / len(list_distinct(a.words || b.words)),
                 CASE WHEN len(a.partners || b.partners) = 0 THEN 0 ELSE len(list_intersect(a.partners, b.partners))::DOUBLE / len(list_distinct(a.partners || b.partners)) END) AS asc_
        FROM g a, g b WHERE a.side = 'a' AND b.side = 'b')
    SELECT name_a, name_b, round(0.5 * lex + 0.25 * typ + 0.25 * asc_, 6) AS score FROM s WHERE round(0.5 * lex + 0.25 * typ + 0.25 * asc_, 6) >= 0.5""")
def combined_scores(spark, sf_dir):
    pairs = _feature_pairs(_part_features(spark, sf_dir), ("tokens", "types", "words", "partners"), 0.499)
    score = F.round(combined_score(_sim("tokens"), _sim("types"), F.greatest(_sim("words"), _sim("partners"))), 6)
    return pairs.select("name_a", "name_b", score.alias("score")).filter("score >= 0.5")


def _sim(c: str):
    return jaccard(F.col(f"{c}_a"), F.col(f"{c}_b"))


def _feature_pairs(features: DataFrame, sets: tuple[str, ...], least: float) -> DataFrame:
    """Names of side a beside those of side b that reach ``least`` in one of ``sets`` at least, with the columns of both.

    A weighted mean of similarities is no larger than the largest of them, so a pair that reaches none of these has no such mean either.
    """
    a, b = (features.filter(F.col("side") == s).select(*[F.col(c).alias(f"{c}_{s}") for c in features.columns if c != "side"]) for s in "ab")
    met = [set_similarity_join(a, b, "name_a", "name_b", f"{c}_a", f"{c}_b", least).select("name_a", "name_b") for c in sets]
    pairs = functools.reduce(DataFrame.unionByName, met).distinct()
    return pairs.join(a, "name_a").join(b, "name_b")


@query()
def lexical_match(spark, sf_dir):
    """Two names match by at most twice the letters they share, so the sequence ratio is taken only where that could do."""
    letters = F.split(F.lower("name"), "")
    counted = F.flatten(F.transform(F.array_distinct(letters), lambda c: F.transform(F.sequence(F.lit(1), F.size(F.filter(letters, lambda x: x == c))), lambda i: F.concat(c, i))))
    features = _part_features(spark, sf_dir).withColumn("letters", counted)
    least = 0.28 / 2  # the Jaccard of letters that a ratio of 0.28 needs is 0.28 / (2 - 0.28)
    pairs = _feature_pairs(features, ("tokens", "letters", "types", "words", "partners"), least)
    rest = combined_score(F.lit(0.0), _sim("types"), F.greatest(_sim("words"), _sim("partners")))
    dice = 2 * F.size(F.array_intersect("letters_a", "letters_b")) / (F.size("letters_a") + F.size("letters_b"))
    bounded = pairs.filter(combined_score(F.greatest(dice, _sim("tokens")), F.lit(0.0), F.lit(0.0)) + rest >= 0.28 - 1e-9)
    score = combined_score(lexical_similarity(F.col("name_a"), F.col("name_b")), _sim("types"), F.greatest(_sim("words"), _sim("partners")))
    pairs = bounded.select("name_a", "name_b", score.alias("score")).filter("score >= 0.28")
    return assign.greedy_one_to_one(pairs, [], "name_a", "name_b", assign.by_score("score", "name_a", "name_b")).withColumn("relation", F.lit("="))


@query(f"WITH {TARGETS} SELECT fwd.name_a, fwd.name_b, round(score, 6) AS score FROM fwd JOIN p USING (name_a, name_b)")
def best_target_per_source(spark, sf_dir):
    best = assign.best_target(_scored(spark, sf_dir, 0.45), ["name_a"], [F.col("score").desc(), F.col("name_b")])
    return best.select("name_a", "name_b", F.round("score", 6).alias("score"))


@query("""
    WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT * FROM embeddings WHERE vec_id % 100 <> 0),
    s AS (SELECT q.vec_id AS query, c.vec_id AS target, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])
            / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])), 6) AS score FROM q, c),
    t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, target) = 1)
    SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, query) = 1""")
def top1_then_unique(spark, sf_dir):
    """The queries are the rows whose id is divisible by 100, the targets all others."""
    e, asked = _t(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0
    q, c = (e.filter(x).select(F.col("vec_id").alias(n), "embedding") for x, n in ((asked, "query"), (~asked, "target")))
    first = assign.best_by_cosine(q, c, "query", "target", "embedding")
    return assign.top_k(first, ["target"], [F.col("score").desc(), F.col("query")])


# ---------------------------------------------------------------- confirmation and coverage


def _status(spark, sf_dir) -> DataFrame:
    p = _scored(spark, sf_dir, 0.45)
    fwd = assign.best_target(p, ["name_a"], [F.col("score").desc(), F.col("name_b")]).select(F.lit(0).alias("pair"), F.col("name_a").alias("source"), F.col("name_b").alias("target"))
    back = assign.best_target(p, ["name_b"], [F.col("score").desc(), F.col("name_a")]).select(F.lit(0).alias("pair"), F.col("name_b").alias("source"), F.col("name_a").alias("target"))
    names = _labels(spark, sf_dir).select(F.lit(0).alias("pair"), "side", F.col("name").alias("element"))
    parts = [confirm.confirm(names.filter(F.col("side") == s), f, b, ["pair"]) for s, f, b in (("a", fwd, back), ("b", back, fwd))]
    return parts[0].unionByName(parts[1]).withColumn("kind", F.lit("entity"))


@query(f"WITH {TARGETS} SELECT side, element, status, matched_to FROM st")
def confirm_status(spark, sf_dir):
    return _status(spark, sf_dir).select("side", "element", "status", "matched_to")


@query(f"WITH {TARGETS} SELECT side, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'missing') AS missing FROM st GROUP BY side")
def status_summary(spark, sf_dir):
    return confirm.status_counts(_status(spark, sf_dir), keys=["pair"]).drop("pair")


@query(f"WITH {TARGETS} SELECT side, round(100.0::DOUBLE * count(*) FILTER (status = 'matched') / count(*), 1) AS coverage FROM st GROUP BY side")
def coverage_pct(spark, sf_dir):
    c = confirm.status_counts(_status(spark, sf_dir), keys=["pair"])
    return c.select("side", confirm.coverage(F.col("matched"), F.col("matched") + F.col("ambiguous") + F.col("missing")).alias("coverage"))


@query(f"WITH {TARGETS} SELECT side, element FROM st WHERE status <> 'matched'")
def residual_after_stage(spark, sf_dir):
    s = _status(spark, sf_dir)
    return s.select("side", "element").join(s.filter("status = 'matched'").select("side", "element"), ["side", "element"], "left_anti")


@query(f"""
    WITH {TARGETS}, n AS (SELECT count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b,
            count(*) FILTER (side = 'a' AND status = 'matched') AS ma, count(*) FILTER (side = 'b' AND status = 'matched') AS mb FROM st)
    SELECT side, CASE WHEN a <= b THEN round(100.0::DOUBLE * ma / a, 1) ELSE round(100.0::DOUBLE * mb / b, 1) END AS coverage_pct, element AS entity
    FROM st, n WHERE status = 'missing' AND side = CASE WHEN a <= b THEN 'a' ELSE 'b' END""")
def unmapped_listing(spark, sf_dir):
    s = _status(spark, sf_dir).withColumns({"entity": F.col("element"), "name": F.col("element")})
    return confirm.unmapped(s, ["pair"]).select("side", "coverage_pct", "entity")


@query("""
    WITH c AS (SELECT p_brand, count(DISTINCT p_name) AS n FROM part GROUP BY 1)
    SELECT x.p_brand AS brand_a, y.p_brand AS brand_b, CASE WHEN x.n <= y.n THEN x.p_brand ELSE y.p_brand END AS smaller, least(x.n, y.n) AS total
    FROM c x JOIN c y ON x.p_brand < y.p_brand""")
def smaller_side(spark, sf_dir):
    c = _t(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_distinct("p_name").alias("n"))
    a, b = (c.select(F.col("p_brand").alias(f"brand_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    pairs = a.join(b, F.col("brand_a") < F.col("brand_b"))
    sides = [pairs.select("brand_a", "brand_b", F.lit(s).alias("side"), F.lit(0).alias("matched"), F.lit(0).alias("ambiguous"), F.col(f"n_{s}").alias("missing")) for s in "ab"]
    out = confirm.smaller_side(sides[0].unionByName(sides[1]), ["brand_a", "brand_b"])
    return out.select("brand_a", "brand_b", F.when(F.col("small") == "a", F.col("brand_a")).otherwise(F.col("brand_b")).alias("smaller"), "total")


# ---------------------------------------------------------------- graphs


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Suppliers and parts, linked by line items; suppliers have even nodes, parts odd ones."""
    line = _t(spark, sf_dir, "lineitem")
    pairs = line.select(F.lit(0).alias("g"), (F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    edges = graph.mirrored(pairs, ["g"], line.count())
    return edges.select("g", F.col("src").alias("node")).distinct(), edges


EDGES = """pr AS (SELECT DISTINCT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem),
    e AS (SELECT src, dst FROM pr UNION SELECT dst, src FROM pr),
    d AS (SELECT src AS node, count(*) AS degree FROM e GROUP BY 1),
    ic AS (SELECT node, degree, 1 - ln(degree + 1.0::DOUBLE) / ln(max(degree) OVER () + 2.0::DOUBLE) AS ic FROM d)"""


@query(f"WITH {EDGES} SELECT node, degree, round(ic, 6) AS ic FROM ic")
def graph_degree_ic(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.information_content(nodes, edges, ["g"]).select("node", F.col("degree").cast("long").alias("degree"), F.round("ic", 6).alias("ic"))


ANCHORS = "an AS (SELECT p_partkey * 2 + 1 AS near FROM part WHERE p_size = 1)"


@query(f"""
    WITH {EDGES}, {ANCHORS},
    h AS (SELECT src AS node, dst AS near, 1 AS dist FROM e UNION ALL SELECT x.src, y.dst, 2 FROM e x JOIN e y ON x.dst = y.src WHERE x.src <> y.dst)
    SELECT node, near, min(dist) AS dist FROM h JOIN an USING (near) WHERE node <> near GROUP BY ALL""")
def two_hop_anchors(spark, sf_dir):
    """Parts of size 1 are the query's set of anchors. The neighbourhood is symmetric, so it is grown from the anchors, of which there are fewer."""
    _, edges = _graph(spark, sf_dir)
    start = _t(spark, sf_dir, "part").filter("p_size = 1").select(F.lit(0).alias("g"), (F.col("p_partkey") * 2 + 1).alias("node")).distinct()
    rows = max(graph.two_step_walks(start, edges, ["g"]), 2 * _t(spark, sf_dir, "lineitem").count())
    return graph.within_hops(start, edges, ["g"], rows=rows).select(F.col("near").alias("node"), F.col("node").alias("near"), "dist")


@query(f"""
    WITH {EDGES}, {ANCHORS},
    c AS (SELECT x.src AS u_a, an.near AS anchor, y.dst AS u_b FROM an JOIN e x ON x.dst = an.near JOIN e y ON y.src = an.near WHERE x.src < y.dst)
    SELECT u_a, u_b, anchor, round(2 * i.ic / (a.ic + b.ic) / 2, 6) AS score
    FROM c JOIN ic i ON i.node = anchor JOIN ic a ON a.node = u_a JOIN ic b ON b.node = u_b WHERE a.ic + b.ic > 0""")
def lin_candidates(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    ic = graph.information_content(nodes, edges, ["g"])
    anchors = _t(spark, sf_dir, "part").filter("p_size = 1").select((F.col("p_partkey") * 2 + 1).alias("anchor"))
    known = ic.select("node", "ic")
    # Information is joined to the anchors' edges, which are fewer than their pairs.
    near = anchors.distinct().join(edges, F.col("anchor") == F.col("src")).select("anchor", F.col("dst").alias("node")).join(known, "node")
    u_a, u_b = (near.select("anchor", F.col("node").alias(f"u_{x}"), F.col("ic").alias(f"ic_{x}")) for x in "ab")
    own = anchors.join(known, F.col("anchor") == F.col("node")).select("anchor", F.col("ic").alias("ic_i"))
    rows = u_a.join(own, "anchor").join(u_b, "anchor").filter("u_a < u_b AND ic_a + ic_b > 0")
    score = lin_similarity(F.col("ic_i"), F.col("ic_i"), F.col("ic_a"), F.col("ic_b")) / 2
    return rows.select("u_a", "u_b", "anchor", F.round(score, 6).alias("score"))


def _containment(spark, sf_dir) -> DataFrame:
    """(g, entity, parent, pos): regions contain nations, nations customers, customers orders."""
    r, n, c, o = (_t(spark, sf_dir, x) for x in ("region", "nation", "customer", "orders"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x))
    parts = [
        n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(key("n", "n_nationkey").alias("entity"), key("r", "r_regionkey").alias("parent"), F.col("r_regionkey").cast("long").alias("pos")),
        c.select(key("c", "c_custkey").alias("entity"), key("n", "c_nationkey").alias("parent"), F.col("c_nationkey").cast("long").alias("pos")),
        o.select(key("o", "o_orderkey").alias("entity"), key("c", "o_custkey").alias("parent"), F.col("o_custkey").cast("long").alias("pos")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("g", F.lit(0))


@query("""
    SELECT 'n' || n_nationkey AS entity, 'r' || n_regionkey AS parent FROM nation UNION ALL
    SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders""")
def containment_parents(spark, sf_dir):
    return _containment(spark, sf_dir).select("entity", "parent")


@query("""
    SELECT 'c' || c_custkey AS entity, 'n' || c_nationkey AS ancestors FROM customer UNION ALL
    SELECT 'o' || o_orderkey, 'c' || o_custkey || '|n' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey""")
def ancestors2(spark, sf_dir):
    found = graph.ancestors(_containment(spark, sf_dir), ["g"])
    return found.select("entity", F.array_join("ancestors", "|").alias("ancestors"))


@query()
def component_labels(spark, sf_dir):
    """Recursive SQL is too slow for this, so a test holds it against union-find."""
    nodes, edges = _graph(spark, sf_dir)
    return graph.components(nodes, edges, ["g"]).select("node", "component")


# ---------------------------------------------------------------- assertions and layers


@query("""
    SELECT 'class' AS kind, 'type' AS predicate, 'event_' || event_id AS subject, event_type AS object FROM events UNION ALL
    SELECT 'object', 'byUser', 'event_' || event_id, 'user_' || user_id FROM events UNION ALL
    SELECT 'data', 'k', 'event_' || event_id, json_extract_string(props, '$.k') FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def props_to_assertions(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k string")["k"])
    subject, none = F.concat(F.lit("event_"), F.col("event_id")), F.lit(None).cast("string")
    row = lambda kind, predicate, object_: F.struct(F.lit(kind).alias("kind"), F.lit(predicate).alias("predicate"), subject.alias("subject"), F.coalesce(object_, none).alias("object"))
    rows = e.select(F.inline(F.array(row("class", "type", F.col("event_type")), row("object", "byUser", F.concat(F.lit("user_"), F.col("user_id"))), row("data", "k", F.col("k")))))
    return rows.filter("object IS NOT NULL")


@query("""
    SELECT c_mktsegment AS conceptual, o_orderpriority AS logical, l_returnflag AS platform, count(*) AS links, sum(CASE WHEN l_shipdate > o_orderdate THEN 1 ELSE 0 END)::BIGINT AS later
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def class_link_join(spark, sf_dir):
    line, o, c = (_t(spark, sf_dir, x) for x in ("lineitem", "orders", "customer"))
    rows = line.select("l_orderkey", "l_returnflag", "l_shipdate").join(o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("conceptual"), F.col("o_orderpriority").alias("logical"), F.col("l_returnflag").alias("platform")).agg(
        F.count(F.lit(1)).alias("links"), F.count_if(F.col("l_shipdate") > F.col("o_orderdate")).alias("later"))


@query("""
    WITH a AS (SELECT DISTINCT p_type, p_brand, p_name, p_size % 5 AS t FROM part),
    o AS (SELECT p_type, p_brand, p_name, 'T' || t AS t, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_name, t) AS i FROM a),
    f AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand, t ORDER BY i) = 1 AS first FROM o),
    x AS (SELECT p_type, p_brand, string_agg(p_name || CASE WHEN first THEN ' (' || lower(t) || ')' ELSE '' END, ', ' ORDER BY i) AS d FROM f WHERE i <= 12 GROUP BY ALL)
    SELECT p_type || p_brand AS entity, 'A ' || trim(lower(regexp_replace(regexp_replace(p_type || p_brand, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')))
           || ' entity with attributes: ' || d || '.' AS description FROM x""")
def entity_description(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select("p_type", "p_brand", "p_name", (F.col("p_size") % 5).alias("t")).distinct()
    item = F.struct(F.col("p_name").alias("name"), F.concat(F.lit("T"), F.col("t")).alias("type"), F.lit(False).alias("ref"))
    grouped = rows.groupBy(F.concat("p_type", "p_brand").alias("entity")).agg(F.array_sort(F.collect_list(item)).alias("attributes"))
    return grouped.select("entity", describe.base_text(F.col("entity"), F.col("attributes")).alias("description"))


# ---------------------------------------------------------------- vectors and distributions

CENTROIDS = """x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
    m AS (SELECT label, i, avg(v) AS mean, var_pop(v) AS var, count(*) AS n FROM x GROUP BY ALL)"""
DISTANCES = f"""{CENTROIDS}, dm AS (SELECT a.label AS label_a, b.label AS label_b, sqrt(sum((a.mean - b.mean) ** 2 / ((a.var + b.var) / 2))) AS d
    FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY ALL)"""


def _moments(spark, sf_dir) -> DataFrame:
    x = _t(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return x.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.var_pop(F.col("v").cast("double")).alias("var"))


def _diagonal(spark, sf_dir) -> DataFrame:
    m = _moments(spark, sf_dir)
    a, b = (m.select(F.col("label").alias(f"label_{s}"), "i", F.col("mean").alias(f"m_{s}"), F.col("var").alias(f"v_{s}")) for s in "ab")
    gap = (F.col("m_a") - F.col("m_b")) ** 2 / ((F.col("v_a") + F.col("v_b")) / 2)
    return a.join(b, "i").filter("label_a < label_b").groupBy("label_a", "label_b").agg(F.sqrt(F.sum(gap)).alias("d"))


@query(f"WITH {CENTROIDS} SELECT label, i, round(mean, 6) AS mean, round(var, 6) AS var FROM m")
def label_centroids(spark, sf_dir):
    return _moments(spark, sf_dir).select("label", F.col("i").cast("long").alias("i"), F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@query(f"WITH {DISTANCES} SELECT label_a, label_b, round(d, 6) AS mahalanobis FROM dm")
def diag_mahalanobis(spark, sf_dir):
    return _diagonal(spark, sf_dir).select("label_a", "label_b", F.round("d", 6).alias("mahalanobis"))


@query(f"WITH {DISTANCES} SELECT label_a % 2 AS grp, count(*) AS n, round(min(d), 6) AS min, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(max(d), 6) AS max FROM dm GROUP BY 1")
def distance_summary(spark, sf_dir):
    s = distribution.summary(_diagonal(spark, sf_dir).withColumn("grp", F.col("label_a") % 2), "d", ["grp"])
    return s.select("grp", "n", *[F.round(c, 6).alias(c) for c in ("min", "mean", "median", "max")])


@query(f"WITH {DISTANCES} SELECT round(coalesce(median(d), 1.0), 6) AS reference FROM dm WHERE label_a % 2 <> label_b % 2")
def reference_median(spark, sf_dir):
    rows = _diagonal(spark, sf_dir).select(
        F.when(F.col("label_a") % 2 != F.col("label_b") % 2, "cross_domain").otherwise("within_domain").alias("comparison_type"), F.col("d").alias("mahalanobis_distance"))
    return distribution.reference_distance(rows).select(F.round("reference", 6).alias("reference"))


@query(f"""
    WITH {DISTANCES}, r AS (SELECT median(d) AS ref FROM dm), c AS (SELECT label, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1)
    SELECT label_a, label_b, round(d / ref, 6) AS norm, round(greatest(0, 1 - least(d / ref, 1)), 6) AS inverse,
           round(1 - (greatest(0, 1 - least(d / ref, 1)) + least(x.n, y.n) / greatest(x.n, y.n)) / 2, 6) AS composite_dist
    FROM dm, r, c x, c y WHERE x.label = label_a AND y.label = label_b""")
def composite_distance(spark, sf_dir):
    d = _diagonal(spark, sf_dir)
    sizes = _t(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rows = d.crossJoin(F.broadcast(d.agg(F.median("d").alias("ref"))))
    for s in "ab":
        rows = rows.join(sizes.select(F.col("label").alias(f"label_{s}"), F.col("n").alias(f"n_{s}")), f"label_{s}")
    norm = F.col("d") / F.col("ref")
    near = (inverse_distance(norm) + F.least("n_a", "n_b") / F.greatest("n_a", "n_b")) / 2
    return rows.select("label_a", "label_b", F.round(norm, 6).alias("norm"), F.round(inverse_distance(norm), 6).alias("inverse"), F.round(1 - near, 6).alias("composite_dist"))


@query("""
    WITH e AS (SELECT vec_id, label, embedding[1:16]::DOUBLE[] AS v FROM embeddings),
    c AS (SELECT label, list(s ORDER BY i) AS c FROM (SELECT label, i, sum(x) AS s FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) WHERE i <= 16 GROUP BY label)
    SELECT vec_id, e.label, round(list_dot_product(v, c) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(c, c)), 6) AS cosine, round(list_dot_product(v, v), 6) AS square FROM e JOIN c ON e.label = c.label""")
def matryoshka_cosine(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    centre = distribution.vector_sum(e.select("label", F.col("embedding").cast("array<double>").alias("vector")), ["label"])
    head = F.slice("embedding", 1, 16)
    return e.join(F.broadcast(centre), "label").select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("vector"), 16), 6).alias("cosine"), F.round(dot(head, head), 6).alias("square"))


@query()
def gaussian_distances(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("label", F.slice("embedding", 1, 16).alias("vector"))
    clouds = distribution.fit_clouds(e, ["label"])
    a, b = (clouds.select(F.col("label").alias(f"label_{s}")) for s in "ab")
    return distribution.cloud_distances(a.join(b, F.col("label_a") < F.col("label_b")), clouds, ["label_a"], ["label_b"], ["label"])


@query("""
    WITH c AS (SELECT label, list(s ORDER BY i) AS c FROM (SELECT label, i, sum(x) AS s FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label),
    s AS (SELECT vec_id, e.label, list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(c, c)) AS cos FROM embeddings e JOIN c ON c.label = e.label)
    SELECT vec_id, label, round((cos - min(cos) OVER w) / (max(cos) OVER w - min(cos) OVER w), 5) AS generality FROM s WINDOW w AS (PARTITION BY label)""")
def generality(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    centre = distribution.vector_sum(e.select("label", F.col("embedding").cast("array<double>").alias("vector")), ["label"]).withColumnRenamed("vector", "centre")
    found = distribution.generality(e.join(F.broadcast(centre), "label"), F.col("centre"), ["label"], "embedding")
    return found.select("vec_id", "label", F.round("generality", 5).alias("generality"))


@query("""
    WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y FROM embeddings),
    g AS (SELECT *, 2 * floor((x + 1) / 2) AS gx, 2 * floor((y + 1) / 2) AS gy FROM e)
    SELECT vec_id, label FROM g WHERE abs(gx) <= 6 AND abs(gy) <= 6
    QUALIFY row_number() OVER (PARTITION BY label, gx, gy ORDER BY (x - gx) ** 2 + (y - gy) ** 2, vec_id) = 1""")
def grid_sample(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 20
    return distribution.grid_sample(e.select("vec_id", "label", at(0).alias("x"), at(1).alias("y")), "x", "y", ["label"], "vec_id").select("vec_id", "label")


# ---------------------------------------------------------------- stages and evaluation

CONTAINED = f"""{NAMES}, tk AS (SELECT name, side, list_distinct(string_split(name, ' ') || CASE WHEN side = 'b' THEN ['unit'] ELSE [] END) AS s FROM names),
    f AS (SELECT a.name AS member, b.name AS abstract, len(list_intersect(a.s, b.s))::DOUBLE / len(a.s) AS fwd, len(list_intersect(a.s, b.s))::DOUBLE / len(b.s) AS rev
          FROM tk a, tk b WHERE a.side = 'a' AND b.side = 'b'),
    sub AS (SELECT *, fwd - rev AS gap FROM f WHERE fwd >= 0.5 AND fwd - rev >= 0.15)"""


def _subsumed(spark, sf_dir) -> DataFrame:
    """(g, direction, abstract, member, member_pos, fwd, asymmetry) by containment of tokens."""
    text = F.when(F.col("side") == "b", F.concat("name", F.lit(" unit"))).otherwise(F.col("name"))
    labels = _labels(spark, sf_dir).select("name", "side", text.alias("text"))
    a, b = (labels.filter(F.col("side") == s).select(F.col("name").alias(n), F.col("text").alias(f"t_{n}")) for s, n in (("a", "member"), ("b", "abstract")))
    fwd, rev = token_containment(F.col("t_member"), F.col("t_abstract")), token_containment(F.col("t_abstract"), F.col("t_member"))
    rows = a.join(b, F.lit(True)).select(F.lit(0).alias("g"), F.lit("large_abstracts_small").alias("direction"), "abstract", "member", F.lit(0).alias("member_pos"), fwd.alias("fwd"), asymmetry(fwd, rev).alias("asymmetry"))
    return rows.filter("fwd >= 0.5 AND asymmetry >= 0.15")


@query(f"""
    WITH {CONTAINED} SELECT abstract AS abstract_entity, string_agg(member, '|' ORDER BY fwd DESC, member) AS members, count(*)::INT AS group_size, count(*) > 1 AS is_group, round(avg(fwd), 6) AS mean_fwd FROM sub GROUP BY 1""")
def subsumption(spark, sf_dir):
    g = subsumption_groups(_subsumed(spark, sf_dir), ["g"])
    return g.select("abstract_entity", F.array_join("subsumed_entities", "|").alias("members"), "group_size", "is_group", F.round("mean_fwd", 6).alias("mean_fwd"))


STAGED = f"""{TARGETS}, tk AS (SELECT name, side, list_distinct(string_split(name, ' ') || CASE WHEN side = 'b' THEN ['unit'] ELSE [] END) AS s FROM names),
    ed AS (SELECT element AS smaller, matched_to AS larger, 'lexical' AS stage FROM st WHERE side = 'a' AND status = 'matched' UNION ALL
           SELECT a.name, b.name, 'subsumption' FROM tk a, tk b WHERE a.side = 'a' AND b.side = 'b'
            AND len(list_intersect(a.s, b.s))::DOUBLE / len(a.s) >= 0.5 AND len(list_intersect(a.s, b.s))::DOUBLE / len(a.s) - len(list_intersect(a.s, b.s))::DOUBLE / len(b.s) >= 0.15)"""


def _stage_edges(spark, sf_dir) -> DataFrame:
    lexical = _status(spark, sf_dir).filter("side = 'a' AND status = 'matched'").select(F.lit(0).alias("g"), F.col("element").alias("smaller"), F.col("matched_to").alias("larger"), F.lit("lexical").alias("stage"))
    return lexical.unionByName(_subsumed(spark, sf_dir).select("g", F.col("member").alias("smaller"), F.col("abstract").alias("larger"), F.lit("subsumption").alias("stage")))


@query(f"WITH {STAGED} SELECT stage, count(*) AS n FROM ed GROUP BY stage")
def matches_per_stage(spark, sf_dir):
    return stage_counts(_stage_edges(spark, sf_dir), ["g"]).select("stage", "n")


@query(f"WITH {STAGED} SELECT smaller, min(stage) AS stage FROM ed GROUP BY smaller")
def dominant_stages(spark, sf_dir):
    return dominant_stage(_stage_edges(spark, sf_dir), ["g"]).select("smaller", "stage")


@query("""
    WITH r AS (SELECT quality, n_chars >= 1000 AS p FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT count(*) FILTER (p AND quality = 1)::DOUBLE AS tp, count(*) FILTER (p)::DOUBLE AS pr, count(*) FILTER (quality = 1)::DOUBLE AS ac FROM r)
    SELECT round_even(tp / pr, 3) AS precision, round_even(tp / ac, 3) AS recall, round_even(2 * (tp / pr) * (tp / ac) / (tp / pr + tp / ac), 3) AS f1 FROM c""")
def precision_recall_f1(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    said, right = F.col("n_chars") >= 1000, F.col("quality") == 1
    c = rows.agg(F.count_if(said & right).alias("tp"), F.count_if(said).alias("pr"), F.count_if(right).alias("ac"))
    return c.select(*evaluate.scores(F.col("tp"), F.col("pr"), F.col("ac")))


@query(f"WITH {SCORED} SELECT CASE WHEN score >= 0.5 THEN 'accept' ELSE 'review' END AS band, count(*) AS n FROM p GROUP BY 1")
def link_bands(spark, sf_dir):
    labels = _labels(spark, sf_dir).select(F.col("name").alias("id"), F.col("name").alias("label"), "side")
    rows = evaluate.link_bands(*[labels.filter(F.col("side") == s) for s in "ab"])
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def flagship(spark, sf_dir):
    return lexical_match(spark, sf_dir)
