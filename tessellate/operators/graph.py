"""Graphs of models as node and edge tables: topology, degrees, neighbourhoods, components, levels and roots.

Edges are stored in both directions. Loops over the graph cut their lineage in each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellate.functions.text import long_token_set, word_tokens
from tessellate.plans.lineage import cut, parts
from tessellate.sources.models import KEY, ModelTables

#: Words that say containment after an entity's name in an association's.
CONTAINMENT_VERBS = (
    "contains", "has", "includes", "aggregates", "owns", "holds", "comprises", "composed", "packaged", "assembles",
    "supports", "mounts", "houses", "carries", "manages", "controls", "provides", "groups", "in", "on", "part",
    "member", "inside", "within", "consists",
)


def mirrored(edges: DataFrame, keys: list[str] = KEY, rows: int | None = None) -> DataFrame:
    """Undirected edges (keys, src, dst) in both directions, once each; ``rows`` is the number of ``edges``, where they are many."""
    kept = F.col("src").isNull() | (F.col("src") <= F.col("dst"))
    ends = [F.when(kept, F.col(x)).otherwise(F.col(y)).alias(n) for x, y, n in (("src", "dst", "_a"), ("dst", "src", "_b"))]
    once = edges.select(*keys, *ends)
    if rows is not None:
        once = once.repartition(parts(edges.sparkSession, rows), "_a", "_b")  # without the keys, since a constant one would make groups be dealt again
    there, back = (F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in (("_a", "_b"), ("_b", "_a")))
    both = F.when(F.col("_a").eqNullSafe(F.col("_b")), F.array(there)).otherwise(F.array(there, back))
    return once.distinct().select(*keys, F.inline(both))


def topology(tables: ModelTables, keep_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): entities, associations as nodes of their own, and containment by attribute types.

    An association without a name is left out, as is one without a known participant unless ``keep_empty``.
    """
    known = tables.participant.filter("known AND assoc <> ''")
    entity = tables.entity.select(*KEY, F.col("entity").alias("node"), F.lit("entity").alias("node_type"), F.col("entity_pos").alias("pos"))
    assoc = tables.association.filter("assoc <> ''") if keep_empty else tables.association.join(known.select(*KEY, "assoc_pos").distinct(), [*KEY, "assoc_pos"], "left_semi")
    assoc = assoc.select(*KEY, F.col("assoc").alias("node"), F.lit("association").alias("node_type"), F.col("assoc_pos").alias("pos"))
    # A node that is both takes the type it got last, which is association.
    nodes = entity.unionByName(assoc).groupBy(*KEY, "node").agg(F.min("node_type").alias("node_type"), F.min("pos").alias("pos"))
    inside = tables.attribute.filter("owner_kind = 'entity' AND is_entity_ref").select(*KEY, F.col("owner").alias("src"), F.col("type").alias("dst"))
    part = known.select(*KEY, F.col("entity").alias("src"), F.col("assoc").alias("dst"))
    return nodes, mirrored(inside.unionByName(part))


def degrees(nodes: DataFrame, edges: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """(keys, node, degree): a loop counts twice, nodes without edges have 0."""
    own = edges.groupBy(*keys, F.col("src").alias("node")).agg(F.sum(F.when(F.col("src") == F.col("dst"), 2).otherwise(1)).alias("degree"))
    return nodes.select(*keys, "node").join(own, [*keys, "node"], "left").select(*keys, "node", F.coalesce("degree", F.lit(0)).alias("degree"))


def information_content(nodes: DataFrame, edges: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """(keys, node, degree, ic): 1 - ln(degree + 1) / ln(largest degree + 2); 1 in a graph of one node."""
    deg = degrees(nodes, edges, keys)
    top = deg.groupBy(*keys).agg(F.max("degree").alias("_top"), F.count(F.lit(1)).alias("_n"))
    ic = F.when(F.col("_n") <= 1, 1.0).otherwise(1 - F.log(F.col("degree") + 1.0) / F.log(F.col("_top") + 2.0))
    return deg.join(top, keys).select(*keys, "node", "degree", ic.alias("ic"))


def within_hops(start: DataFrame, edges: DataFrame, keys: list[str] = KEY, hops: int = 2, rows: int | None = None) -> DataFrame:
    """(keys, node, near, dist) of what lies 1 to ``hops`` steps from each start node (keys, node), at its least distance.

    ``rows`` is the number of walks, or of edges if that is larger, where they are many: steps are dealt by it, and by nodes alone,
    since a constant key would make joins and groups be dealt again.
    """
    deal = lambda df, *by: df if rows is None else df.repartition(parts(df.sparkSession, rows), *by)
    step = deal(edges.select(*keys, F.col("src").alias("_at"), F.col("dst").alias("near")), "_at")
    level = start.select(*keys, "node", F.col("node").alias("_at")).distinct()
    out = None
    for d in range(1, hops + 1):
        reached = deal(level, "_at").join(step, [*keys, "_at"]).select(*keys, "node", "near")
        reached = reached.distinct() if d < hops else reached  # the last step's are met below
        found = reached.withColumn("dist", F.lit(d))
        out = found if out is None else out.unionByName(found)
        level = reached.select(*keys, "node", F.col("near").alias("_at"))
    return deal(out.filter("near <> node"), "node", "near").groupBy(*keys, "node", "near").agg(F.min("dist").alias("dist"))


def two_step_walks(start: DataFrame, edges: DataFrame, keys: list[str] = KEY) -> int:
    """How many walks of one or two steps begin at the start nodes (keys, node, once each); ``edges`` holds both directions."""
    begun = start.select(*keys, F.col("node").alias("dst"), F.lit(1).alias("_begun"))
    around = edges.join(begun, [*keys, "dst"], "left").groupBy(*keys, "src").agg(F.count(F.lit(1)).alias("n"), F.count("_begun").alias("begun"))
    return around.agg(F.sum(F.col("begun") * (F.col("n") + 1))).first()[0] or 0


def parents(tables: ModelTables) -> DataFrame:
    """(domain, model, entity, parent, pos): direct containers in the order of their definition, once each."""
    inside = tables.attribute.filter("owner_kind = 'entity' AND is_entity_ref")
    return inside.groupBy(*KEY, F.col("type").alias("entity"), F.col("owner").alias("parent")).agg(F.min("owner_pos").alias("pos"))


def ancestors(parent: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """(keys, entity, ancestors): containers up to two levels, nearest first; those that nothing contains are left out."""
    contained = parent.select(*keys, F.col("entity").alias("parent")).distinct()
    inner = parent.join(contained, [*keys, "parent"], "left_semi")
    first = inner.select(*keys, "entity", F.col("parent").alias("a"), F.lit(1).alias("level"), F.col("pos").alias("p1"), F.lit(-1).alias("p2"))
    up = inner.select(*keys, F.col("entity").alias("a"), F.col("parent").alias("a2"), F.col("pos").alias("p2"))
    second = first.drop("p2").join(up, [*keys, "a"]).select(*keys, "entity", F.col("a2").alias("a"), F.lit(2).alias("level"), "p1", "p2")
    each = first.unionByName(second).groupBy(*keys, "entity", "a").agg(F.min(F.struct("level", "p1", "p2")).alias("at"))
    return each.groupBy(*keys, "entity").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "a"))), lambda x: x["a"]).alias("ancestors")
    )


def components(nodes: DataFrame, edges: DataFrame, keys: list[str] = KEY, most_rounds: int = 100) -> DataFrame:
    """(keys, node, component): the smallest node that each one reaches, by labels that spread and then jump.

    ``edges`` holds both directions. A round takes the least label around each node, and then that label's own label, so
    that rounds grow with the logarithm of a path's length.
    """
    labels = cut(nodes.select(*keys, "node", F.col("node").alias("component")))
    pairs = cut(edges.select(*keys, "src", "dst"))
    pairs = pairs.repartition(parts(pairs.sparkSession, pairs.count()), *keys, "dst")
    for _ in range(most_rounds):
        near = (
            pairs.join(labels.select(*keys, F.col("node").alias("dst"), "component"), [*keys, "dst"])
            .groupBy(*keys, F.col("src").alias("node")).agg(F.min("component").alias("_near"))
        )
        spread = labels.join(near, [*keys, "node"], "left").withColumn("_low", F.least("component", F.coalesce("_near", "component")))
        jump = spread.select(*keys, F.col("node").alias("_low"), F.col("_low").alias("_far"))
        new = cut(spread.join(jump, [*keys, "_low"], "left").select(*keys, "node", "component", F.least("_low", F.coalesce("_far", "_low")).alias("_new")))
        moved = new.filter("component <> _new").limit(1).count()
        labels = new.select(*keys, "node", F.col("_new").alias("component"))
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def levels(nodes: DataFrame, edges: DataFrame, roots: DataFrame, keys: list[str] = KEY, most_rounds: int = 1000) -> DataFrame:
    """(keys, node, level): steps from the nearest root (keys, node); null where no root reaches. Fails beyond ``most_rounds`` levels."""
    seen = cut(roots.select(*keys, "node").distinct().withColumn("level", F.lit(0)))
    front = seen
    step = edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("_to"))
    for d in range(1, most_rounds):
        new = front.join(step, [*keys, "node"]).select(*keys, F.col("_to").alias("node")).distinct()
        front = cut(new.join(seen, [*keys, "node"], "left_anti").withColumn("level", F.lit(d)))
        if front.isEmpty():
            return nodes.select(*keys, "node").join(seen, [*keys, "node"], "left")
        seen = cut(seen.unionByName(front)) if d % 16 == 0 else seen.unionByName(front)
    raise RuntimeError(f"more than {most_rounds} levels")


def visual_edges(tables: ModelTables) -> DataFrame:
    """(domain, model, src, dst, kind, label): one row an undirected edge, src the smaller name; containment overrides association."""
    part = tables.participant.filter("known").select(*KEY, "assoc_pos", "assoc", "part_pos", "entity")
    a, b = (part.select(*KEY, "assoc_pos", "assoc", F.col("part_pos").alias(f"p{s}"), F.col("entity").alias(s)) for s in ("x", "y"))
    assoc = a.join(b, [*KEY, "assoc_pos", "assoc"]).filter("px < py").select(
        *KEY, F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), F.lit("association").alias("kind"), F.col("assoc").alias("label"),
        F.col("assoc_pos").alias("pos"), F.lit(0).alias("rank"),
    )
    inside = tables.attribute.filter("owner_kind = 'entity' AND is_entity_ref").select(
        *KEY, F.least("owner", "type").alias("src"), F.greatest("owner", "type").alias("dst"), F.lit("containment").alias("kind"),
        F.lit(None).cast("string").alias("label"), F.col("owner_pos").alias("pos"), F.lit(1).alias("rank"),
    )
    last = Window.partitionBy(*KEY, "src", "dst").orderBy(F.col("rank").desc(), F.col("pos").desc())
    rows = assoc.unionByName(inside)
    label = rows.filter("rank = 0").groupBy(*KEY, "src", "dst").agg(F.max_by("label", "pos").alias("label"))
    kinds = rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select(*KEY, "src", "dst", "kind")
    return kinds.join(label, [*KEY, "src", "dst"], "left")


def find_roots(tables: ModelTables, edges: DataFrame) -> DataFrame:
    """(domain, model, node, strategy, pos): the roots of each model by the first strategy that gives any, best first.

    1 containment: entities that no attribute has as its type, if those are under half of all. 2 verbs: entities whose
    name and a containment verb begin an association's name, and that no such entity contains. 3 participants: entities that
    never come after the first in an association. 4 degree: the entity of most edges. Equals go by name.
    """
    nodes = tables.entity.select(*KEY, F.col("entity").alias("node"))
    deg = degrees(nodes, mirrored(edges))
    count = nodes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_all"))
    child = tables.attribute.filter("owner_kind = 'entity' AND is_entity_ref").select(*KEY, F.col("type").alias("node")).distinct()
    free = nodes.join(child, [*KEY, "node"], "left_anti")
    few = free.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_free")).join(count, KEY).filter("_free < 0.5 * _all").select(*KEY)
    first = free.join(few, KEY, "left_semi").select(*KEY, "node", F.lit(1).alias("strategy"), F.lit(0).alias("out"))

    words = tables.association.filter("assoc <> ''").select(*KEY, "assoc_pos", word_tokens("assoc").alias("w"))
    starts = nodes.select(*KEY, "node", word_tokens("node").alias("e"), F.length("node").alias("size"))
    begins = words.join(starts, KEY).filter(F.slice(F.col("w"), F.lit(1), F.size("e")) == F.col("e"))
    longest = Window.partitionBy(*KEY, "assoc_pos").orderBy(F.col("size").desc(), "node")
    owner = begins.withColumn("_n", F.row_number().over(longest)).filter("_n = 1").filter(
        F.coalesce(F.get("w", F.size("e")), F.lit("")).isin(*CONTAINMENT_VERBS)
    )
    owned = owner.join(tables.participant.filter("known").select(*KEY, "assoc_pos", "entity"), [*KEY, "assoc_pos"]).filter("entity <> node")
    owned = owned.select(*KEY, "node", "entity").distinct()
    out = owned.groupBy(*KEY, "node").agg(F.count(F.lit(1)).alias("out"))
    second = out.join(owned.select(*KEY, F.col("entity").alias("node")).distinct(), [*KEY, "node"], "left_anti").select(*KEY, "node", F.lit(2).alias("strategy"), "out")

    by_place = Window.partitionBy(*KEY, "assoc_pos").orderBy("part_pos")
    later = tables.participant.filter("known").withColumn("_n", F.row_number().over(by_place)).filter("_n > 1").select(*KEY, F.col("entity").alias("node")).distinct()
    third = nodes.join(later, [*KEY, "node"], "left_anti").select(*KEY, "node", F.lit(3).alias("strategy"), F.lit(0).alias("out"))
    top = Window.partitionBy(*KEY).orderBy(F.col("degree").desc(), "node")
    fourth = deg.withColumn("_n", F.row_number().over(top)).filter("_n = 1").select(*KEY, "node", F.lit(4).alias("strategy"), F.lit(0).alias("out"))

    every = first.unionByName(second).unionByName(third).unionByName(fourth)
    best = every.groupBy(*KEY).agg(F.min("strategy").alias("strategy"))
    order = Window.partitionBy(*KEY).orderBy(F.col("out").desc(), F.col("degree").desc(), "node")
    return every.join(best, [*KEY, "strategy"]).join(deg, [*KEY, "node"]).select(*KEY, "node", "strategy", (F.row_number().over(order) - 1).alias("pos"))


def internal_graph(tables: ModelTables) -> DataFrame:
    """``visual_edges`` and, as kind ``inferred``, an edge from the best root to each node outside its component."""
    edges = visual_edges(tables)
    nodes = tables.entity.select(*KEY, F.col("entity").alias("node"))
    comp = components(nodes, mirrored(edges))
    root = find_roots(tables, edges).filter("pos = 0").select(*KEY, F.col("node").alias("root"))
    of_root = root.join(comp.withColumnRenamed("node", "root"), [*KEY, "root"]).select(*KEY, "root", F.col("component").alias("_main"))
    apart = comp.join(of_root, KEY).filter("component <> _main").select(
        *KEY, F.least("root", "node").alias("src"), F.greatest("root", "node").alias("dst"), F.lit("inferred").alias("kind"), F.lit(None).cast("string").alias("label")
    )
    return edges.unionByName(apart)


def association_vocabulary(tables: ModelTables) -> DataFrame:
    """(domain, model, entity, vocabulary): token sets of the names of an entity's associations and their other participants."""
    part = tables.participant.select(*KEY, "assoc_pos", "assoc", "entity")
    other = part.select(*KEY, "assoc_pos", F.col("entity").alias("other")).distinct()
    names = part.select(*KEY, "entity", F.explode(long_token_set("assoc")).alias("t"))
    mates = part.join(other, [*KEY, "assoc_pos"]).filter("entity <> other").select(*KEY, "entity", F.explode(long_token_set("other")).alias("t"))
    return names.unionByName(mates).groupBy(*KEY, "entity").agg(F.collect_set("t").alias("vocabulary"))
