import os

import duckdb
import pytest

from tessellate.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", registry.QUERIES)
def test_query_equals_sql(spark, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.ORACLE:  # held against a slow version below
        assert len(got) and name in ("lexical_match", "gaussian_distances", "component_labels")
        return
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    want = con.execute(registry.ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def _rows(table, columns):
    return duckdb.sql(f"SELECT DISTINCT {columns} FROM '{DATA}/{table}.parquet'").fetchall()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_components_of_all_line_items(spark):
    links = [(a * 2, b * 2 + 1) for a, b in _rows("lineitem", "l_suppkey, l_partkey")]
    parent = {x: x for link in links for x in link}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    got = registry.QUERIES["component_labels"](spark, DATA).collect()
    assert {r.node: r.component for r in got} == {x: top(x) for x in parent} and len(got) == len(parent)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_signatures_of_all_line_items(spark):
    name, sets = dict(_rows("part", "p_partkey, p_name")), {}
    for supplier, part in _rows("lineitem", "l_suppkey, l_partkey"):
        sets.setdefault(supplier, set()).add(name[part])
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b}
    got = registry.QUERIES["signature_jaccard"](spark, DATA).collect()
    assert {(r.supp_a, r.supp_b): r.score for r in got} == {k: v for k, v in want.items() if v >= 0.3} and len(got) > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_graphs_of_all_line_items(spark):
    near = {}
    for a, b in _rows("lineitem", "l_suppkey, l_partkey"):
        near.setdefault(a * 2, set()).add(b * 2 + 1)
        near.setdefault(b * 2 + 1, set()).add(a * 2)
    got = registry.QUERIES["graph_degree_ic"](spark, DATA).collect()
    assert {r.node: r.degree for r in got} == {x: len(v) for x, v in near.items()}
    anchors = {p * 2 + 1 for p, size in _rows("part", "p_partkey, p_size") if size == 1} & near.keys()
    want = {(x, a, 1) for a in anchors for x in near[a]} | {(y, a, 2) for a in anchors for x in near[a] for y in near[x] if y != a}
    got = registry.QUERIES["two_hop_anchors"](spark, DATA).collect()
    assert {(r.node, r.near, r.dist) for r in got} == want and len(got) == len(want) > 0
    got = registry.QUERIES["lin_candidates"](spark, DATA).collect()
    assert {(r.u_a, r.u_b, r.anchor) for r in got} == {(x, y, a) for a in anchors for x in near[a] for y in near[a] if x < y}


def test_camel_phrase_keeps_long_names(spark, tmp_path):
    spark.createDataFrame([("a" * 1500, "T")], "p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    assert registry.QUERIES["camel_phrase"](spark, str(tmp_path)).first().name == "A" + "a" * 1499 + "TUnit"


def _features():
    out = {}
    for name, kind, size, brand in duckdb.sql(f"SELECT p_name, p_type, p_size, p_brand FROM '{DATA}/part.parquet'").fetchall():
        types, words, partners = out.setdefault(name, (set(), set(), set()))
        types.add(kind)
        words.add(size % 7)
        if size > 45:
            partners.add(brand)
    return out


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_lexical_match_equals_a_slow_version(spark):
    from difflib import SequenceMatcher

    features, scored = _features(), []
    for a in features:
        for b in features:
            if ord(a[0]) % 2 == 0 and ord(b[0]) % 2:
                lexical = max(_jaccard(set(a.lower().split()), set(b.lower().split())), SequenceMatcher(None, a.lower(), b.lower()).ratio())
                (ta, wa, pa), (tb, wb, pb) = features[a], features[b]
                score = 0.5 * lexical + 0.25 * _jaccard(ta, tb) + 0.25 * max(_jaccard(wa, wb), _jaccard(pa, pb))
                if score >= 0.28:
                    scored.append((score, a, b))
    used, want = set(), {}
    for score, a, b in sorted(scored, reverse=True):
        if not used & {(0, a), (1, b)}:
            used |= {(0, a), (1, b)}
            want[a, b] = score
    got = {(r.name_a, r.name_b): r.score for r in registry.QUERIES["lexical_match"](spark, DATA).collect()}
    assert got == pytest.approx(want, abs=1e-9) and got


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_gaussian_distances_equal_a_slow_version(spark):
    import numpy as np

    from tessellate.operators import distribution

    by = {}
    for label, v in duckdb.sql(f"SELECT label, embedding FROM '{DATA}/embeddings.parquet'").fetchall():
        by.setdefault(label, []).append(v[:16])
    clouds = {}
    for label, rows in by.items():
        x = np.array(rows, float)
        m, (n, d) = x.mean(axis=0), x.shape
        c = (x - m).T @ (x - m) / n if n > 1 else None
        if n < 2:
            clouds[label] = m, np.eye(d) * distribution.RIDGE
            continue
        mu = np.trace(c) / d * np.eye(d)
        far, noise = ((c - mu) ** 2).sum(), sum(((np.outer(v - m, v - m) - c) ** 2).sum() for v in x) / n**2
        share = min(noise, far) / far
        clouds[label] = m, (1 - share) * c + share * mu
    got = {(r.label_a, r.label_b): r for r in registry.QUERIES["gaussian_distances"](spark, DATA).collect()}
    assert got.keys() == {(a, b) for a in clouds for b in clouds if a < b} and got
    for (a, b), r in got.items():
        want = distribution.gaussian_distances(*clouds[a], *clouds[b])
        assert (r.mahalanobis_distance, r.bhattacharyya_distance, r.bhattacharyya_coefficient) == pytest.approx(want, abs=2e-4)
        assert (r.n_a, r.n_b) == (len(by[a]), len(by[b]))


def test_levels_fail_rather_than_stop(spark):
    from tessellate.operators import graph

    edges = spark.createDataFrame([(0, i, i + 1) for i in range(20)], "g int, src int, dst int")
    nodes, root = (spark.createDataFrame([(0, i) for i in r], "g int, node int") for r in (range(22), [0]))
    assert {r.node: r.level for r in graph.levels(nodes, edges, root, ["g"]).collect()} == {i: i for i in range(21)} | {21: None}
    with pytest.raises(RuntimeError, match="levels"):
        graph.levels(nodes, edges, root, ["g"], most_rounds=5)


def test_graphs_of_odd_edges(spark):
    from tessellate.operators import graph

    rows = [(0, 1, 2), (0, 2, 1), (0, 3, 3), (0, 3, 3), (0, None, 4), (0, 4, None), (0, None, None), (1, 2, 1), (0, 2, 5), (0, 5, 6)]
    edges = spark.createDataFrame(rows, "g int, src int, dst int")
    want = {r for g, a, b in rows for r in ((g, a, b), (g, b, a))}
    for n in (None, len(rows)):
        got = [tuple(r) for r in graph.mirrored(edges, ["g"], n).collect()]
        assert set(got) == want and len(got) == len(want)
    both = graph.mirrored(edges, ["g"]).filter("src IS NOT NULL AND dst IS NOT NULL")
    start = spark.createDataFrame([(0, 1), (0, 3), (0, 9)], "g int, node int")
    walks = [(a, b, b) for g, a, b in want if g == 0 and a in (1, 3) and b] + [
        (a, b, d) for g, a, b in want for h, c, d in want if g == h == 0 and a in (1, 3) and b and b == c and d]
    assert graph.two_step_walks(start, both, ["g"]) == len(walks)
    for n in (None, len(walks)):
        got = {(r.node, r.near): r.dist for r in graph.within_hops(start, both, ["g"], rows=n).collect()}
        assert got == {(1, 2): 1, (1, 5): 2}


def _dealt(df):
    """The partitions that rows are dealt to by their number."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return [int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\), REPARTITION_BY_NUM", plan)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["graph_degree_ic", "two_hop_anchors", "lin_candidates", "signature_jaccard"])
def test_partitions_of_graphs_grow_with_the_rows(spark, name, monkeypatch):
    from tessellate.plans import lineage

    monkeypatch.setattr(lineage, "ROWS_A_TASK", 100)
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    df = registry.QUERIES[name](spark, DATA)
    least = df.count() if name == "signature_jaccard" else lines  # pairs are what grows there
    dealt = _dealt(df)
    assert dealt and min(dealt) >= -(-least // 100)


def test_components_deal_edges_by_their_number(spark, monkeypatch):
    from tessellate.operators import graph
    from tessellate.plans import lineage

    monkeypatch.setattr(lineage, "ROWS_A_TASK", 3)
    asked, given = [], graph.parts
    monkeypatch.setattr(graph, "parts", lambda s, n: asked.append(given(s, n)) or asked[-1])
    nodes = spark.createDataFrame([(0, i) for i in range(30)], "g int, node int")
    edges = graph.mirrored(spark.createDataFrame([(0, i, i + 1) for i in range(28)], "g int, src int, dst int"), ["g"])
    got = {r.node: r.component for r in graph.components(nodes, edges, ["g"]).collect()}
    assert got == {i: 0 for i in range(29)} | {29: 29} and asked == [19]
