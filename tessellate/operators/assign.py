"""Choosing among scored pairs: best targets, one-to-one assignments and top-k.

Every choice follows a total order, so results don't depend on how rows are partitioned.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellate.plans.lineage import cut

#: Rows of a pack of queries and of targets, and packs of queries in a part: what a task holds at a time.
QUERIES, TARGETS, PACKS = 1024, 2048, 16


def by_score(score: str, left: str, right: str) -> list[Column]:
    """Score, then names, all descending: the order of reversed tuples (score, left, right)."""
    return [F.col(score).desc(), F.col(left).desc(), F.col(right).desc()]


def top_k(pairs: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return pairs.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def best_target(pairs: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The best row of each source."""
    return top_k(pairs, keys, order, 1)


def best_by_cosine(queries: DataFrame, targets: DataFrame, query: str, target: str, vector: str) -> DataFrame:
    """(query, target, score) of each query's target of the largest cosine, to six places; of equals the smallest, of ids in whole numbers.

    Vectors are packed, and each pack of queries meets each pack of targets in one product of matrices, so that a pair is a
    multiplication and not a row. Vectors of zeros score 0; null ones, and pairs of different lengths, null, which is last.
    """
    spark = targets.sparkSession
    asked, offered = queries.count(), targets.count()
    dealt = targets.repartition(max(spark.sparkContext.defaultParallelism, -(-offered // (8 * TARGETS))), target)
    left = _packs(dealt, target, vector, TARGETS).toDF("t_ids", "t_sizes", "t_units")
    right = cut(_packs(queries.repartition(max(1, -(-asked // (PACKS * QUERIES))), query), query, vector, QUERIES).toDF("q_ids", "q_sizes", "q_units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = [np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in enumerate(("i8", "i4", "f8") * 2)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(row[3:], row[:3])], ["query", "target", "score"])

    met = left.join(right, F.lit(True)).mapInArrow(run, "query long, target long, score double")
    best = met.groupBy("query").agg(F.max(F.struct("score", (-F.col("target")).alias("t"))).alias("m"))
    return best.select(F.col("query").alias(query), (-F.col("m.t")).alias(target), F.col("m.score").alias("score"))


def _packs(rows: DataFrame, key: str, vector: str, most: int) -> DataFrame:
    """Packs of at most ``most`` rows: their ids, the lengths of their vectors (-1 for null), and those at length 1, end to end."""
    v = F.col(vector).cast("array<double>")
    rows = rows.select(F.col(key).cast("long"), F.when(~F.exists(v, lambda x: x.isNull()), v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                ids, vectors = batch.slice(start, most).columns
                sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype("i4")
                flat, at = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8"), np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
                with np.errstate(all="ignore"):
                    norm = np.sqrt(np.bincount(at, flat * flat, len(sizes)))
                    flat = flat / np.where(norm == 0, 1.0, norm)[at]
                packed = (ids.to_numpy().astype("i8"), sizes, flat)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], ["ids", "sizes", "units"])

    return rows.mapInArrow(run, "ids binary, sizes binary, units binary")


def _best(queries: list[np.ndarray], targets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The ids of a pack's queries, of their best targets in another pack, and the scores; a score that isn't a number is the largest."""
    (ids, sizes, units), (t_ids, t_sizes, t_units) = queries, targets
    best, score, known = np.full(len(ids), t_ids.min()), np.zeros(len(ids)), np.zeros(len(ids), bool)
    for size in np.intersect1d(sizes[sizes >= 0], t_sizes):
        own = np.flatnonzero(sizes == size)
        q, t = (u[np.repeat(s, np.maximum(s, 0)) == size].reshape(np.count_nonzero(s == size), size) for u, s in ((units, sizes), (t_units, t_sizes)))
        near = t_ids[t_sizes == size]
        order = np.argsort(near, kind="stable")
        near, t = near[order], t[order]
        bad_q, bad_t = np.isnan(q).any(axis=1), np.isnan(t).any(axis=1)
        known[own] = True
        if bad_t.any():
            best[own], score[own] = near[bad_t][0], np.nan
            best[own[bad_q]] = near[0]
            continue
        best[own[bad_q]], score[own[bad_q]] = near[0], np.nan
        own, cosines = own[~bad_q], q[~bad_q] @ t.T
        most = _six_places(cosines.max(axis=1, initial=-np.inf))
        # Targets go by id: the first that rounds to the largest is it. Rounding moves by half of the last place at most.
        first = np.argmax(cosines >= (most - 0.5000001)[:, None] / 1e6, axis=1)
        for i in np.flatnonzero(_six_places(cosines[np.arange(len(own)), first]) != most):
            first[i] = np.argmax(_six_places(cosines[i]) == most[i])
        best[own], score[own] = near[first], most / 1e6
    return ids, best, pa.array(score, mask=~known)


def _six_places(x: np.ndarray) -> np.ndarray:
    """Millionths, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5), x) + 0.0


def greedy_one_to_one(
    pairs: DataFrame, keys: list[str], left: str, right: str, order: list[Column], most_rounds: int = 20
) -> DataFrame:
    """Greedy assignment in ``order`` within each group of ``keys``: a pair is taken unless one of its ends is.

    Runs as rounds of mutual best: a pair that is first for both its ends is taken by greedy too, whatever comes before it.
    Each round is cut, and takes one pair at least. A chain of ever better pairs takes as many rounds as it is long; what is left
    of groups after ``most_rounds`` is finished group by group in order, and without ``keys`` the rounds go on.
    """
    left_w = Window.partitionBy(*keys, left).orderBy(*order)
    right_w = Window.partitionBy(*keys, right).orderBy(*order)
    rest, taken, rounds = cut(pairs), [], 0
    while True:
        if keys and rounds == most_rounds:
            taken.append(_in_order(rest, keys, left, right, order))
            break
        rounds += 1
        ranked = rest.withColumns({"_l": F.row_number().over(left_w), "_r": F.row_number().over(right_w)})
        best = cut(ranked.filter("_l = 1 AND _r = 1").drop("_l", "_r"))
        if best.isEmpty():
            break
        taken = [*taken, best] if len(taken) < 16 else [cut(functools.reduce(DataFrame.unionByName, taken)), best]
        ends = [best.select(*keys, end) for end in (left, right)]
        rest = cut(rest.join(ends[0], [*keys, left], "left_anti").join(ends[1], [*keys, right], "left_anti").select(*pairs.columns))
    return functools.reduce(DataFrame.unionByName, taken) if taken else rest


def _in_order(pairs: DataFrame, keys: list[str], left: str, right: str, order: list[Column]) -> DataFrame:
    ranked = pairs.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        used_l, used_r, kept = set(), set(), []
        for row in group.sort_values("_at").itertuples(index=True):
            a, b = getattr(row, left), getattr(row, right)
            if a not in used_l and b not in used_r:
                used_l.add(a)
                used_r.add(b)
                kept.append(row.Index)
        return group.loc[kept].drop(columns="_at")

    return ranked.groupBy(*keys).applyInPandas(run, pairs.schema)


def top_one_then_unique(pairs: DataFrame, keys: list[str], left: str, right: str, order: list[Column]) -> DataFrame:
    """Each source's best target; of sources with one target the first in ``order``. Losers aren't tried again."""
    return top_k(top_k(pairs, [*keys, left], order), [*keys, right], order)


def links_one_to_one(links: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Links without scores, one-to-one, taken in the order of their ids."""
    return greedy_one_to_one(links, keys, left, right, [F.col(left).asc(), F.col(right).asc()])


def assign_in_order(candidates: DataFrame, keys: list[str], left: str, right: str, left_pos: str, order: list[Column]) -> DataFrame:
    """Sources in the order of ``left_pos``, each taking the first of its targets in ``order`` that no other took.

    This is sequential by its nature, so a group (a pair of models) is one Python call.
    """
    ranked = candidates.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, left).orderBy(*order)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        used, kept = set(), []
        for _, own in group.sort_values([left_pos, left, "_at"]).groupby([left_pos, left], sort=True):
            free = own[~own[right].isin(used)]
            if len(free):
                kept.append(free.index[0])
                used.add(free[right].iloc[0])
        return group.loc[kept].drop(columns="_at")

    return ranked.groupBy(*keys).applyInPandas(run, candidates.schema)
