"""The structural matcher: entities near matched ones are matched by information content, then by association words.

Where a choice is sequential it goes by the order of definition, then by name, so results are the same in each run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellate.functions.similarity import jaccard
from tessellate.functions.text import long_token_set
from tessellate.operators.assign import assign_in_order, top_k
from tessellate.operators.graph import association_vocabulary, information_content, topology, within_hops
from tessellate.operators.lexical import PAIR
from tessellate.plans.lineage import cut
from tessellate.sources.models import KEY, ModelTables

THRESHOLD, ROOT_PENALTY, SET_OVERLAP, HOPS = 0.5, 0.20, 0.5, 2


def _side(df: DataFrame, side: str, *names: str) -> DataFrame:
    """A model table's columns with the side's suffix, keyed for pairs."""
    return df.select("domain", F.col("model").alias(f"model_{side}"), *[F.col(n).alias(f"{n}_{side}") for n in names])


def union_anchors(stages: list[DataFrame]) -> DataFrame:
    """(pair, a, b) of several stages' matches, one b for each a: that of the last stage that has one."""
    out = None
    for i, stage in enumerate(stages):
        rows = stage.select(*PAIR, "a", "b", F.lit(i).alias("_stage"))
        out = rows if out is None else out.unionByName(rows)
    return top_k(out, [*PAIR, "a"], [F.col("_stage").desc(), F.col("b").desc()]).drop("_stage")


def root_anchors(pairs: DataFrame, nodes: DataFrame, ic: DataFrame, anchors: DataFrame) -> DataFrame:
    """(pair, a, b): synthetic anchors among entities that aren't matched.

    Entities that share a token with the domain's name, paired from a Jaccard of 0.5; in pairs of models without such, the entity of
    most edges with the most similar name, from 0.5 on.
    """
    ent = nodes.filter("node_type = 'entity'").join(ic, [*KEY, "node"]).select(*KEY, "node", "pos", "degree", long_token_set("node").alias("t"))
    used_b = anchors.select(*PAIR, F.col("b").alias("node_b")).distinct()
    both = pairs.select(*PAIR).join(_side(ent, "a", "node", "pos", "degree", "t"), ["domain", "model_a"])
    other = _side(ent, "b", "node", "pos", "t")
    domain = F.array_join(F.array(F.col("domain")), "")
    of_domain = lambda t: F.size(F.array_intersect(t, long_token_set(domain))) > 0
    sim = jaccard(F.col("t_a"), F.col("t_b"))
    near = (
        both.filter(of_domain(F.col("t_a"))).join(other.filter(of_domain(F.col("t_b"))), ["domain", "model_b"])
        .withColumn("sim", sim).filter(F.col("sim") >= SET_OVERLAP).join(used_b, [*PAIR, "node_b"], "left_anti")
    )
    order = [F.col("sim").desc(), F.col("pos_b"), F.col("node_b")]
    named = top_k(near, [*PAIR, "node_a"], order)
    hub = top_k(both, PAIR, [F.col("degree_a").desc(), F.col("pos_a"), F.col("node_a")]).join(named.select(*PAIR).distinct(), PAIR, "left_anti")
    hubs = hub.join(other, ["domain", "model_b"]).withColumn("sim", sim).filter(F.col("sim") >= SET_OVERLAP).join(used_b, [*PAIR, "node_b"], "left_anti")
    hubs = top_k(hubs, PAIR, order)
    columns = [*PAIR, "node_a", "node_b", "pos_a"]
    free = named.select(*columns).unionByName(hubs.select(*columns)).join(
        anchors.select(*PAIR, F.col("a").alias("node_a")), [*PAIR, "node_a"], "left_anti"
    )
    return top_k(free, [*PAIR, "node_b"], [F.col("pos_a"), F.col("node_a")]).select(*PAIR, F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def association_anchors(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(pair, a, b) of associations: the mapped participants of the one overlap those of the other by half or more."""
    ent = nodes.filter("node_type = 'entity'").select(*KEY, F.col("node").alias("dst"))
    assoc = nodes.filter("node_type = 'association'").select(*KEY, F.col("node").alias("src"), "pos")
    parts = edges.join(assoc, [*KEY, "src"]).join(ent, [*KEY, "dst"])
    own = parts.select("domain", F.col("model").alias("model_a"), F.col("src").alias("assoc_a"), F.col("pos").alias("pos_a"), F.col("dst").alias("a"))
    mapped = pairs.select(*PAIR).join(own, ["domain", "model_a"]).join(anchors, [*PAIR, "a"])
    mapped = mapped.groupBy(*PAIR, "assoc_a", "pos_a").agg(F.collect_set("b").alias("mapped"))
    other = parts.groupBy(*KEY, F.col("src").alias("assoc"), "pos").agg(F.collect_set("dst").alias("parts"))
    near = mapped.join(_side(other, "b", "assoc", "pos", "parts"), ["domain", "model_b"]).withColumn("sim", jaccard(F.col("mapped"), F.col("parts_b")))
    near = near.filter(F.col("sim") >= SET_OVERLAP).select(*PAIR, "assoc_a", "assoc_b", "pos_a", "pos_b", "sim")
    found = assign_in_order(near, PAIR, "assoc_a", "assoc_b", "pos_a", [F.col("sim").desc(), F.col("pos_b"), F.col("assoc_b")])
    return found.select(*PAIR, F.col("assoc_a").alias("a"), F.col("assoc_b").alias("b"))


def anchors_within(anchors: DataFrame, domains: DataFrame) -> DataFrame:
    """The anchors of the domains under study (rows with ``domain``)."""
    return anchors.join(domains.select("domain").distinct(), "domain", "left_semi")


def lin_similarity(anchor_a: Column, anchor_b: Column, node_a: Column, node_b: Column) -> Column:
    """Twice the mean information of the anchors over the sum of the nodes'; not capped, 0 where that sum isn't over 0."""
    total = node_a + node_b
    return F.when(total > 0, (anchor_a + anchor_b) / total).otherwise(0.0)


def match_structural(tables: ModelTables, pairs: DataFrame, anchors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """New matches (pair, smaller_entity, larger_entity, struct_score, lin_sim, lin_sim_raw, lca_is_root_anchor, anchor, method).

    ``anchors`` (pair, a, b) are what earlier stages matched, in the orientation of the pair.
    """
    nodes, edges = topology(tables)
    nodes, edges = cut(nodes), cut(edges)
    ic = cut(information_content(nodes, edges))
    anchors = cut(anchors.select(*PAIR, "a", "b"))
    roots = cut(root_anchors(pairs, nodes, ic, anchors))
    known = anchors.unionByName(roots)
    known = cut(known.unionByName(association_anchors(pairs, nodes, edges, known)))
    marked = known.join(roots.select(*PAIR, "a", F.lit(True).alias("is_root")), [*PAIR, "a"], "left").select(
        *PAIR, "a", "b", F.coalesce("is_root", F.lit(False)).alias("is_root")
    )
    ent = tables.entity.select(*KEY, "entity", "entity_pos")
    free_a = pairs.select(*PAIR).join(_side(ent, "a", "entity", "entity_pos"), ["domain", "model_a"]).join(
        known.select(*PAIR, F.col("a").alias("entity_a")), [*PAIR, "entity_a"], "left_anti")
    free_b = pairs.select(*PAIR).join(_side(ent, "b", "entity", "entity_pos"), ["domain", "model_b"]).join(
        known.select(*PAIR, F.col("b").alias("entity_b")), [*PAIR, "entity_b"], "left_anti")

    near = _side(within_hops(nodes.select(*KEY, "node"), edges, hops=HOPS), "a", "node", "near", "dist")
    info = ic.join(nodes.select(*KEY, "node", "pos"), [*KEY, "node"])
    ic_a, ic_b = (_side(info, s, "node", "ic", "pos") for s in "ab")
    step = _side(edges, "b", "src", "dst")
    rows = (
        free_a.join(near.withColumnRenamed("node_a", "entity_a"), ["domain", "model_a", "entity_a"])
        .join(marked.select(*PAIR, F.col("a").alias("near_a"), F.col("b").alias("src_b"), "is_root"), [*PAIR, "near_a"])
        .join(step, ["domain", "model_b", "src_b"])
        .join(free_b.withColumnRenamed("entity_b", "dst_b"), [*PAIR, "dst_b"])
        .join(ic_a.select("domain", "model_a", F.col("node_a").alias("entity_a"), F.col("ic_a").alias("_ua")), ["domain", "model_a", "entity_a"])
        .join(ic_a.select("domain", "model_a", F.col("node_a").alias("near_a"), F.col("ic_a").alias("_na"), F.col("pos_a").alias("_np")), ["domain", "model_a", "near_a"])
        .join(ic_b.select("domain", "model_b", F.col("node_b").alias("dst_b"), F.col("ic_b").alias("_ub")), ["domain", "model_b", "dst_b"])
        .join(ic_b.select("domain", "model_b", F.col("node_b").alias("src_b"), F.col("ic_b").alias("_nb")), ["domain", "model_b", "src_b"])
    )
    raw = lin_similarity(F.col("_na"), F.col("_nb"), F.col("_ua"), F.col("_ub"))
    lin = raw * F.when(F.col("is_root"), ROOT_PENALTY).otherwise(1.0)
    score = lin / (F.col("dist_a") + 1)
    columns = [*PAIR, "smaller_entity", "larger_entity", "struct_score", "lin_sim", "lin_sim_raw", "lca_is_root_anchor", "anchor", "method"]
    lins = rows.filter(score >= threshold).select(
        *PAIR, F.col("entity_a").alias("smaller_entity"), F.col("dst_b").alias("larger_entity"), F.bround(score, 4).alias("struct_score"),
        F.bround(lin, 4).alias("lin_sim"), F.bround(raw, 4).alias("lin_sim_raw"), F.col("is_root").alias("lca_is_root_anchor"),
        F.col("near_a").alias("anchor"), F.lit("lin_ic").alias("method"), "entity_pos_a", "entity_pos_b", "dist_a", "_np",
    )
    order = [F.col("struct_score").desc(), F.col("dist_a"), F.col("_np"), F.col("anchor"), F.col("entity_pos_b"), F.col("larger_entity")]
    first = cut(assign_in_order(lins, PAIR, "smaller_entity", "larger_entity", "entity_pos_a", order).select(*columns))

    words = association_vocabulary(tables)
    left = free_a.join(first.select(*PAIR, F.col("smaller_entity").alias("entity_a")), [*PAIR, "entity_a"], "left_anti").join(_side(words, "a", "entity", "vocabulary"), ["domain", "model_a", "entity_a"])
    right = free_b.join(first.select(*PAIR, F.col("larger_entity").alias("entity_b")), [*PAIR, "entity_b"], "left_anti").join(_side(words, "b", "entity", "vocabulary"), ["domain", "model_b", "entity_b"])
    sim = jaccard(F.col("vocabulary_a"), F.col("vocabulary_b"))
    rest = left.join(right, PAIR).withColumn("sim", sim).filter(F.col("sim") >= max(0.8 * threshold, 0.25)).select(*PAIR, "entity_a", "entity_b", "entity_pos_a", "entity_pos_b", "sim")
    second = assign_in_order(rest, PAIR, "entity_a", "entity_b", "entity_pos_a", [F.col("sim").desc(), F.col("entity_pos_b"), F.col("entity_b")])
    null = F.lit(None)
    second = second.select(
        *PAIR, F.col("entity_a").alias("smaller_entity"), F.col("entity_b").alias("larger_entity"), F.bround("sim", 4).alias("struct_score"),
        F.lit(0.0).alias("lin_sim"), null.cast("double").alias("lin_sim_raw"), null.cast("boolean").alias("lca_is_root_anchor"),
        F.lit("assoc_vocab").alias("anchor"), F.lit("assoc_vocab").alias("method"),
    )
    return first.unionByName(second)


def discover_lin(tables: ModelTables, pairs: DataFrame, anchors: DataFrame, k: int = 20) -> DataFrame:
    """(pair, u_a, u_b, score, lin_sim, anchor): what lies unmatched within two steps of both ends of an anchor, the k best of each pair."""
    nodes, edges = topology(tables, keep_empty=True)
    ic = information_content(nodes, edges)
    near = within_hops(nodes.select(*KEY, "node"), edges, hops=HOPS)
    out = anchors.select(*PAIR, "a", "b")
    for s, end in (("a", "a"), ("b", "b")):
        used = anchors.select(*PAIR, F.col(end).alias(f"u_{s}")).distinct()
        own = near.select("domain", F.col("model").alias(f"model_{s}"), F.col("node").alias(end), F.col("near").alias(f"u_{s}"), F.col("dist").alias(f"d_{s}"))
        out = out.join(own, ["domain", f"model_{s}", end]).join(used, [*PAIR, f"u_{s}"], "left_anti")
        for node, name in ((end, f"_n{s}"), (f"u_{s}", f"_u{s}")):
            out = out.join(ic.select("domain", F.col("model").alias(f"model_{s}"), F.col("node").alias(node), F.col("ic").alias(name)), ["domain", f"model_{s}", node])
    lin = lin_similarity(F.col("_na"), F.col("_nb"), F.col("_ua"), F.col("_ub"))
    scored = out.select(*PAIR, "u_a", "u_b", (lin / (F.col("d_a") + F.col("d_b"))).alias("score"), lin.alias("lin_sim"), F.col("a").alias("anchor"))
    best = top_k(scored, [*PAIR, "u_a", "u_b"], [F.col("score").desc(), F.col("anchor")])
    return top_k(best, PAIR, [F.col("score").desc(), F.col("u_a"), F.col("u_b")], k)
