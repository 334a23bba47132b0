"""Layered layout of a model's graph as coordinates: a band for each component, a height for each level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellate.operators.graph import components, degrees, find_roots, levels, mirrored, visual_edges
from tessellate.sources.models import KEY, ModelTables


def hierarchical_layout(tables: ModelTables, x_lo: float, x_hi: float, y_lo: float = 0.03, y_hi: float = 0.97) -> DataFrame:
    """(domain, model, node, component, level, x, y).

    Components come by size, the largest first, equals by name; each has a band as wide as its share of the nodes. A component
    without a root takes its node of most edges. Nodes of one level are spread over the band by name, and levels over the height
    by the deepest level of the model.
    """
    nodes = tables.entity.select(*KEY, F.col("entity").alias("node"))
    visual = visual_edges(tables)
    edges = mirrored(visual)
    comp = components(nodes, edges)
    roots = find_roots(tables, visual).select(*KEY, "node")
    top = Window.partitionBy(*KEY, "component").orderBy(F.col("degree").desc(), "node")
    bare = comp.join(comp.join(roots, [*KEY, "node"]).select(*KEY, "component").distinct(), [*KEY, "component"], "left_anti")
    extra = bare.join(degrees(nodes, edges), [*KEY, "node"]).withColumn("_n", F.row_number().over(top)).filter("_n = 1").select(*KEY, "node")
    level = levels(nodes, edges, roots.unionByName(extra)).join(comp, [*KEY, "node"])
    last = F.max("level").over(Window.partitionBy(*KEY, "component"))
    level = level.withColumn("level", F.coalesce("level", last + 1))
    sizes = comp.groupBy(*KEY, "component").agg(F.count(F.lit(1)).alias("size"))
    by = Window.partitionBy(*KEY).orderBy(F.col("size").desc(), "component").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("size").over(Window.partitionBy(*KEY))
    bands = sizes.select(*KEY, "component", (F.coalesce(F.sum("size").over(by), F.lit(0)) / whole).alias("_from"), (F.col("size") / whole).alias("_share"))
    row = Window.partitionBy(*KEY, "component", "level")
    deepest = F.greatest(F.max("level").over(Window.partitionBy(*KEY)), F.lit(1))
    place = (F.row_number().over(row.orderBy("node")) - 0.5) / F.count(F.lit(1)).over(row)
    return level.join(bands, [*KEY, "component"]).select(
        *KEY, "node", "component", "level",
        (x_lo + (x_hi - x_lo) * (F.col("_from") + F.col("_share") * place)).alias("x"), (y_hi - F.col("level") / deepest * (y_hi - y_lo)).alias("y"),
    )


def curve_points(x0: Column, y0: Column, x1: Column, y1: Column, bend: float = 0.15, n: int = 20) -> Column:
    """n + 1 points of a quadratic Bezier curve whose middle is moved up by ``bend``."""
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2 + bend

    def point(i: Column) -> Column:
        t = i / F.lit(float(n))
        return F.struct(*[((1 - t) * (1 - t) * a + 2 * (1 - t) * t * m + t * t * b).alias(c) for c, a, m, b in (("x", x0, mx, x1), ("y", y0, my, y1))])

    return F.transform(F.sequence(F.lit(0), F.lit(n)), point)


def matched_only(nodes: DataFrame, edges: DataFrame, keys: list[str], node: str) -> DataFrame:
    """The nodes that an edge between models touches."""
    return nodes.join(edges.select(*keys, node).distinct(), [*keys, node], "left_semi")
