"""Models as Gaussian clouds of their entities' vectors, the distances between clouds, and composite distances of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessellate.functions.similarity import cosine, inverse_distance, unit
from tessellate.operators.confirm import STATUSES
from tessellate.operators.describe import describe_distribution, terms
from tessellate.operators.lexical import PAIR
from tessellate.operators.scorers import TextEncoder, encode_texts, hashed_trigrams
from tessellate.plans.lineage import cut
from tessellate.sources.models import KEY, ModelTables

DIM, RIDGE = 128, 1e-4
CLOUD = "n long, mean array<double>, cov array<array<double>>"


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """The Ledoit-Wolf (2004) estimate: the sample covariance drawn towards a multiple of the identity."""
    x = x - x.mean(axis=0)
    return _shrunk(len(x), x.T @ x, float(((x * x).sum(axis=1) ** 2).sum()))


def _shrunk(n: int, outer: np.ndarray, fourth: float) -> np.ndarray:
    """The same from sums over centred vectors: of their outer products, and of the fourth powers of their lengths."""
    d = len(outer)
    if n < 2:
        return np.eye(d) * RIDGE
    sample = outer / n
    centre = np.trace(sample) / d
    spread = ((sample - centre * np.eye(d)) ** 2).sum() / d
    # The mean squared distance of the outer products from the sample covariance, without building any of them.
    noise = (fourth / n - (sample**2).sum()) / (n * d)
    share = 0.0 if spread == 0 else min(max(noise, 0.0), spread) / spread
    return (1 - share) * sample + share * centre * np.eye(d)


def fit_clouds(vectors: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """(keys, n, mean, cov) of each group's vectors.

    Two passes: the means, and then sums over centred vectors, made within each slice of rows. So a group of any size comes
    to one task as a row of sums for each slice, and not as its vectors.
    """
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.select(*keys).schema)

    rows = cut(vectors.select(*keys, F.col(vector).cast("array<double>").alias("_v")))  # read twice
    at = rows.select(*keys, F.posexplode("_v").alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_x"))
    means = at.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda e: e["_x"]).alias("mean"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for key, own in batch.groupby(keys, sort=False, dropna=False):
                x = np.stack(own["_v"].to_numpy()) - np.asarray(own["mean"].iloc[0])
                made.append([*key, len(own), own["mean"].iloc[0], (x.T @ x).ravel(), float(((x * x).sum(axis=1) ** 2).sum())])
            yield pd.DataFrame(made, columns=[*keys, "n", "mean", "outer", "fourth"])

    def whole(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        mean, n = parts["mean"].iloc[0], int(parts["n"].sum())
        outer = np.sum(np.stack(parts["outer"].to_numpy()), axis=0).reshape(len(mean), -1)
        return pd.DataFrame([[*key, n, list(mean), _shrunk(n, outer, float(parts["fourth"].sum())).tolist()]], columns=[*keys, "n", "mean", "cov"])

    sums = rows.join(means, keys).mapInPandas(partial, f"{types}, n long, mean array<double>, outer array<double>, fourth double")
    return sums.groupBy(*keys).applyInPandas(whole, f"{types}, {CLOUD}")


def _inverse(s: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(s)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(s)


def gaussian_distances(m1: np.ndarray, s1: np.ndarray, m2: np.ndarray, s2: np.ndarray) -> tuple[float, float, float]:
    """(Mahalanobis distance under the pooled covariance, Bhattacharyya distance, Bhattacharyya coefficient)."""
    pooled, diff = (s1 + s2) / 2, m1 - m2
    square = max(float(diff @ _inverse(pooled) @ diff), 0.0)
    logs = [np.linalg.slogdet(s)[1] for s in (pooled, s1, s2)]
    far = max(square / 8 + 0.5 * (logs[0] - 0.5 * (logs[1] + logs[2])), 0.0)
    return float(np.sqrt(square)), float(far), float(np.exp(-far))


@F.pandas_udf(StructType([StructField(x, DoubleType()) for x in ("mahalanobis", "bhattacharyya", "bc")]))
def _distances(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for m1, s1, m2, s2 in batches:
        rows = [gaussian_distances(np.asarray(a), np.stack(b), np.asarray(c), np.stack(d)) for a, b, c, d in zip(m1, s1, m2, s2)]
        yield pd.DataFrame(rows, columns=["mahalanobis", "bhattacharyya", "bc"])


def cloud_distances(pairs: DataFrame, clouds: DataFrame, a: list[str], b: list[str], keys: list[str]) -> DataFrame:
    """``pairs`` with n_a, n_b and the distances of the clouds that its columns ``a`` and ``b`` name (as ``keys`` of ``clouds``)."""
    for side, own in (("a", a), ("b", b)):
        named = clouds.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], *[F.col(c).alias(f"{c}_{side}") for c in ("n", "mean", "cov")])
        pairs = pairs.join(named, own)
    out = pairs.withColumn("_d", _distances("mean_a", "cov_a", "mean_b", "cov_b"))
    return out.select(*[c for c in out.columns if c not in ("mean_a", "cov_a", "mean_b", "cov_b", "_d")], F.bround("_d.mahalanobis", 4).alias("mahalanobis_distance"),
                      F.bround("_d.bhattacharyya", 6).alias("bhattacharyya_distance"), F.bround("_d.bc", 6).alias("bhattacharyya_coefficient"))


def characterize(tables: ModelTables, encoder: TextEncoder | None = None, dim: int = DIM, anchors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(clouds, distances) of all models: each two of a domain (within_domain) and of two domains (cross_domain)."""
    vectors = encode_texts(describe_distribution(tables, anchors), encoder or hashed_trigrams(dim))
    clouds = cut(fit_clouds(vectors.withColumn("vector", unit(F.col("vector"), dim)), KEY))
    names = clouds.select(*KEY)
    a, b = (names.select(F.col("domain").alias(f"domain_{s}"), F.col("model").alias(f"model_{s}")) for s in "ab")
    both = a.join(b, (F.col("domain_a") < F.col("domain_b")) | (F.col("domain_a") == F.col("domain_b")) & (F.col("model_a") < F.col("model_b")))
    kind = F.when(F.col("domain_a") == F.col("domain_b"), "within_domain").otherwise("cross_domain")
    found = cloud_distances(both.withColumn("comparison_type", kind), clouds, ["domain_a", "model_a"], ["domain_b", "model_b"], KEY)
    return clouds, found.withColumnsRenamed({"n_a": "n_entities_a", "n_b": "n_entities_b"}).withColumn("embedding_dim", F.lit(dim))


def summary(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """min, mean, median and max; null without rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.max(value).alias("max"))


def reference_distance(distances: DataFrame) -> DataFrame:
    """One row: the median of all cross-domain Mahalanobis distances, 1 without any."""
    return distances.filter("comparison_type = 'cross_domain'").agg(F.coalesce(F.median("mahalanobis_distance"), F.lit(1.0)).alias("reference"))


def composite(status: DataFrame, structural: DataFrame, distances: DataFrame) -> DataFrame:
    """A row a pair: lexical and structural coverage of the smaller side, normalised Mahalanobis, overlap, and their mean as similarity.

    Without a distance the composite is null. Lexical matches are those of side a; Lin similarities are capped at 1.
    """
    ent = status.filter("kind = 'entity'")
    sizes = ent.groupBy(*PAIR).agg(
        F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b"),
        F.count_if((F.col("side") == "a") & (F.col("status") == STATUSES[0])).alias("aml_matched"),
    )
    new = structural.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("s2_new"), F.avg(F.least("lin_sim", F.lit(1.0))).alias("s2_avg_lin"))
    # A distance is the same from either side, so pairs meet by their unordered names.
    low, high = F.least("model_a", "model_b"), F.greatest("model_a", "model_b")
    far = distances.filter("comparison_type = 'within_domain'").select(
        F.col("domain_a").alias("domain"), low.alias("_lo"), high.alias("_hi"), F.col("mahalanobis_distance").alias("mahalanobis"), F.col("bhattacharyya_coefficient").alias("bc"))
    rows = sizes.join(new, PAIR, "left").withColumns({"_lo": low, "_hi": high}).join(far, ["domain", "_lo", "_hi"], "left")
    rows = rows.crossJoin(F.broadcast(reference_distance(distances)))
    n_min = F.least("n_a", "n_b")
    share = lambda n: F.when(n_min > 0, n / n_min).otherwise(0.0)
    new_n, norm = F.coalesce("s2_new", F.lit(0)), F.col("mahalanobis") / F.col("reference")
    sim = (share(F.col("aml_matched")) + share(new_n) + inverse_distance(norm) + F.col("bc")) / 4
    sim = F.when(F.col("mahalanobis").isNotNull(), sim)
    return rows.select(
        *PAIR, "n_a", "n_b", n_min.alias("n_min"), "aml_matched", F.bround(share(F.col("aml_matched")), 4).alias("aml_cov"), new_n.alias("s2_new"),
        F.bround(share(new_n), 4).alias("s2_cov"), F.bround("s2_avg_lin", 4).alias("s2_avg_lin"), F.bround("mahalanobis", 4).alias("mahalanobis"),
        F.bround(norm, 4).alias("mah_norm"), F.bround("bc", 6).alias("bc"), F.bround(sim, 4).alias("composite_sim"), F.bround(1 - sim, 4).alias("composite_dist"),
    )


def composite_by_domain(rows: DataFrame) -> DataFrame:
    return rows.groupBy("domain").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("composite_dist").alias("mean_dist"), F.min("composite_dist").alias("min_dist"),
        F.max("composite_dist").alias("max_dist"), F.avg("aml_cov").alias("mean_aml_cov"), F.avg("bc").alias("mean_bc"),
    )


def hypernym_anchors(names: DataFrame, senses: DataFrame, hypernyms: DataFrame, roots: DataFrame, most_depth: int = 20) -> DataFrame:
    """(domain, model, entity, anchors): the root concepts above the first sense of each token of a name, in order.

    senses (token, synset), hypernyms (synset, above) and roots (synset, label) come from the caller's lexicon.
    """
    from tessellate.functions.text import acronym_tokens

    tokens = names.select(*KEY, "entity", F.posexplode(acronym_tokens("entity")).alias("pos", "token")).join(senses, "token")
    seen = cut(tokens.select(F.col("synset").alias("start"), F.col("synset").alias("at")).distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, most_depth + 1):
        up = front.join(hypernyms.select(F.col("synset").alias("at"), "above"), "at").select("start", F.col("above").alias("at")).distinct()
        front = cut(up.join(seen.select("start", "at"), ["start", "at"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    found = seen.join(roots.select(F.col("synset").alias("at"), "label"), "at").select(F.col("start").alias("synset"), "depth", "label")
    rows = tokens.join(found, "synset").groupBy(*KEY, "entity", "label").agg(F.min(F.struct("pos", "depth")).alias("p"))
    return rows.groupBy(*KEY, "entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "label"))), lambda x: x["label"]).alias("anchors"))


def vector_sum(rows: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """The sum of each group's vectors."""
    cells = rows.select(*keys, F.posexplode(vector).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"))
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias(vector))


def term_vectors(tables: ModelTables, encoder: TextEncoder | None = None, mode: str = "root") -> DataFrame:
    """Terms with the vector of their first token (``root``) or the sum of all (``sum``); tokens are encoded once each."""
    rows = terms(tables).withColumn("_id", F.xxhash64(*KEY, "kind", "term")).dropDuplicates(["_id"])
    tokens = rows.select("_id", F.posexplode("tokens").alias("pos", "token"))
    tokens = tokens.filter("pos = 0") if mode == "root" else tokens
    encoded = encode_texts(tokens.withColumnRenamed("token", "description"), encoder or hashed_trigrams())
    return rows.join(vector_sum(encoded, ["_id"]), "_id", "left").drop("_id")


def generality(rows: DataFrame, centroid: Column, keys: list[str], vector: str = "vector") -> DataFrame:
    """Adds the min-max of the cosine to a centroid within each group; 1 where all are equal."""
    w = Window.partitionBy(*keys)
    cos = rows.withColumn("_c", cosine(F.col(vector), centroid))
    low, high = F.min("_c").over(w), F.max("_c").over(w)
    return cos.withColumn("generality", F.when(high > low, (F.col("_c") - low) / (high - low)).otherwise(1.0)).drop("_c")


def principal_axes(rows: DataFrame, k: int = 2, vector: str = "vector", out: str = "coords") -> DataFrame:
    """Adds the first k principal coordinates (their signs are arbitrary)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = rows.filter(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(vector))
    fitted = PCA(k=k, inputCol="_v", outputCol="_p").fit(ready)
    return fitted.transform(ready).withColumn(out, vector_to_array("_p")).drop("_v", "_p")


def grid_sample(rows: DataFrame, x: str, y: str, keys: list[str], order: str, cell: int = 2, reach: int = 6) -> DataFrame:
    """The point nearest to the centre of each square cell of a grid from -reach to reach; the first of equals."""
    gx, gy = (cell * F.floor((F.col(c) + cell / 2) / cell) for c in (x, y))
    cells = rows.withColumns({"_gx": gx, "_gy": gy}).filter(F.abs("_gx").between(0, reach) & F.abs("_gy").between(0, reach))
    far = (F.col(x) - F.col("_gx")) ** 2 + (F.col(y) - F.col("_gy")) ** 2
    first = Window.partitionBy(*keys, "_gx", "_gy").orderBy(far, order)
    return cells.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_gx", "_gy")
