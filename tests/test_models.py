import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellate.operators import cascade, confirm, describe, distribution, graph, layout, lexical, structural
from tessellate.sources import models, sinks
from tessellate.sources.alignments import read_alignment_cells, read_links
from tessellate.sources.messages import parse_cardinality, parse_messages, to_assertions

A = {
    "modelName": "Car Model - V1", "observables": ["Distance", "Kind"],
    "entities": [
        {"entityName": "Car", "entityAttributes": [{"name": "engine", "type": "Engine"}, {"name": "carKind", "type": "Kind"}]},
        {"entityName": "Engine", "entityAttributes": [{"name": "block", "type": "EngineBlock"}, {"name": "boreWidth", "type": "Distance"}]},
        {"entityName": "", "name": "EngineBlock", "entityAttributes": [], "attributes": [{"name": "len", "type": "Distance"}, {"name": "wid", "type": "Distance"}]},
        {"entityName": "Wheel", "entityAttributes": [{"name": "old", "type": "Kind"}]},
        {"entityName": "Wheel", "entityAttributes": [{"name": "radius", "type": "Distance"}, {"name": "odd", "type": "Undeclared"}]},
    ],
    "associations": [
        {"associationName": "CarHasWheel", "associationParticipants": ["Car", "Wheel", "Ghost"], "associationAttributes": [{"name": "n", "type": "Kind"}]},
        {"associationName": "WheelToWheel", "associationParticipants": ["Wheel", "Wheel"]},
        {"associationName": "", "associationParticipants": ["Car", "Engine"]},
    ],
}
B = {
    "modelName": "Auto Parts", "topicDomain": "x",
    "entities": [
        {"name": "Car", "attributes": [{"name": "motor", "type": "Motor"}]}, {"name": "Motor", "attributes": [{"name": "bore", "type": "Distance"}]},
        {"name": "WheelUnit", "attributes": [{"name": "radius", "type": "Distance"}]}, {"name": "Lamp", "attributes": []},
    ],
    "associations": [{"name": "CarHasWheelUnit", "participants": ["Car", "WheelUnit"], "attributes": []}],
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("models") / "Car"
    folder.mkdir()
    (folder / "car_model_v1.json").write_text(json.dumps(A))
    (folder / "parts_model_variation_1.json").write_text(json.dumps(B))
    (folder / "broken.json").write_text("{ not json")
    return models.read_models(spark, str(folder.parent)).cached()


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]


def test_flattening(tables):
    a = tables.where("model like 'Car%'")
    assert rows(a.entity, "entity_pos", "entity") == [(0, "Car"), (1, "Engine"), (2, "EngineBlock"), (3, "Wheel")]
    assert rows(a.attribute.filter("owner = 'Wheel'"), "attr_pos", "attr") == [(0, "radius"), (1, "odd")]
    assert rows(a.attribute.filter("is_entity_ref"), "owner", "type") == [("Car", "Engine"), ("Engine", "EngineBlock")]
    assert rows(a.participant.filter("assoc = 'CarHasWheel'"), "part_pos", "entity", "known") == [(0, "Car", True), (1, "Wheel", True), (2, "Ghost", False)]
    assert rows(a.observable, "observable", "declared") == [("Distance", True), ("Kind", True), ("Undeclared", False)]
    assert rows(tables.model, "domain", "safe_name", "type_ab", "versioned") == [("Car", "Auto_Parts", "B", False), ("Car", "Car_Model_V1", "A", True)]


def test_features_follow_declared_types(tables):
    f = {(r.model[:3], r.entity): r for r in lexical.entity_features(tables).collect()}
    assert f["Car", "Wheel"].types == ["Distance"] and sorted(f["Car", "Wheel"].partners) == ["car", "ghost"]
    assert f["Aut", "Car"].types == ["Motor"]  # a model that declares none counts every type
    assert sorted(f["Car", "Wheel"].words) == ["car", "has", "to", "wheel"]


def test_lexical_match_and_confirmation(spark, tables):
    pairs = models.model_pairs(tables, "crosstype")
    cells = {(r.entity_a, r.entity_b): r.score for r in lexical.match_lexical(tables, pairs).collect()}
    assert cells[("Car", "Car")] >= 0.5 and ("Wheel", "WheelUnit") in cells
    status = confirm.crosstype_status(tables, pairs)
    got = {(r.side, r.entity): r.status for r in status.collect()}
    assert got["a", "Car"] == "matched" and got["b", "Car"] == "matched" and got["b", "Lamp"] == "missing"
    coded = {(r.side, r.entity): r.status for r in confirm.crosstype_status(tables, pairs, "as_coded").collect()}
    assert coded["a", "Car"] == "matched" and coded["a", "Wheel"] == "ambiguous"
    report = confirm.pair_reports(status).first()
    assert len(report.side_a.elements) == 4 and report.side_b.summary.missing >= 1
    assert confirm.unmapped(status.withColumn("kind", F.lit("entity"))).count() >= 1


def test_cascade_accounts_for_every_entity(tables):
    status = confirm.crosstype_status(tables, models.model_pairs(tables, "crosstype")).persist()
    found = cascade.run_cascade(tables, status, config=cascade.Config(all_models=True))
    ran = found.summary.select(*cascade.SIDES, F.explode(F.array(*[F.lit(x) for x in cascade.STAGES[:-1]])).alias("stage"))
    last = cascade.latest_residual(found.residual, ran)
    summary = found.summary.first()
    covered = sum(summary[s] for s in cascade.STAGES[:-1])
    ambiguous = status.filter("side = 'a' AND status = 'ambiguous'").count()
    assert covered + last.count() + ambiguous == summary.total
    assert cascade.stage_edges(found).count() >= found.matches.count()


def test_descriptions(tables):
    get = lambda f, e: {r.entity: r.description for r in f(tables.where("model like 'Car%'")).collect()}[e]
    assert get(describe.describe_plain, "EngineBlock") == "A engine block (part of: engine) entity with attributes: len (distance), wid."
    assert get(describe.describe_children, "Engine") == "A engine entity containing: engine block [len, wid]; with attributes: bore width (distance)."
    assert get(describe.describe_associations, "Car").endswith("Relations: has ghost entity measuring distance, undeclared via kind; car engine.") or "Relations:" in get(describe.describe_associations, "Car")
    assert get(describe.describe_name_first, "Wheel").startswith("Wheel. measures distance, undeclared.")
    assert get(describe.describe_distribution, "Car").startswith("search_document: Car: car. Measures: Kind. Relations: car has wheel (Wheel, Ghost)")


def test_self_association_has_no_partner(tables):
    index = describe.association_index(tables.where("model like 'Car%'")).filter("entity = 'Wheel' AND assoc_pos = 1").collect()
    assert len(index) == 2 and all(r.partner_types == [] for r in index)


def test_graph(tables):
    nodes, edges = graph.topology(tables.where("model like 'Car%'"))
    ic = {r.node: r for r in graph.information_content(nodes, edges).collect()}
    assert ic["Car"].degree == 2 and ic["WheelToWheel"].degree == 1
    top = max(r.degree for r in ic.values())
    assert ic["Car"].ic == pytest.approx(1 - math.log(3) / math.log(top + 2))
    near = {(r.node, r.near): r.dist for r in graph.within_hops(nodes.select("domain", "model", "node"), edges).collect()}
    assert near["Car", "EngineBlock"] == 2 and near["Car", "CarHasWheel"] == 1
    comp = {r.component for r in graph.components(nodes, edges).collect()}
    assert len(comp) == 1
    above = {r.entity: r.ancestors for r in graph.ancestors(graph.parents(tables)).filter("model like 'Car%'").collect()}
    assert above == {"EngineBlock": ["Engine"]}


def test_structural_and_layout(tables):
    pairs = models.model_pairs(tables, "crosstype")
    anchors = pairs.select("*", F.lit("Car").alias("a"), F.lit("Car").alias("b"))
    found = structural.match_structural(tables, pairs, anchors).collect()
    assert len({r.smaller_entity for r in found}) == len(found) == len({r.larger_entity for r in found})
    assert structural.discover_lin(tables, pairs, anchors).count() <= 20
    place = layout.hierarchical_layout(tables, 0.0, 1.0).collect()
    assert len(place) == 8 and all(0 <= r.x <= 1 and 0.03 <= r.y <= 0.97 for r in place)
    assert graph.internal_graph(tables).filter("kind = 'inferred' AND src = 'Lamp' OR kind = 'inferred' AND dst = 'Lamp'").count() == 1


def test_gaussians():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(30, 4)), rng.normal(size=(20, 4)) + 1
    sx, sy = distribution.shrunk_covariance(x), distribution.shrunk_covariance(y)
    assert distribution.gaussian_distances(x.mean(0), sx, x.mean(0), sx) == (0.0, 0.0, 1.0)
    a, b = distribution.gaussian_distances(x.mean(0), sx, y.mean(0), sy), distribution.gaussian_distances(y.mean(0), sy, x.mean(0), sx)
    assert a == pytest.approx(b) and a[0] > 0
    assert np.array_equal(distribution.shrunk_covariance(x[:1]), np.eye(4) * 1e-4)
    centred = x - x.mean(0)
    outer = np.mean([((np.outer(r, r) - centred.T @ centred / 30) ** 2).sum() for r in centred]) / 30 / 4
    sample = centred.T @ centred / 30
    d2 = ((sample - np.trace(sample) / 4 * np.eye(4)) ** 2).sum() / 4
    share = min(outer, d2) / d2
    assert np.allclose(sx, (1 - share) * sample + share * np.trace(sample) / 4 * np.eye(4))


def test_characterize_and_composite(tables):
    clouds, far = distribution.characterize(tables, dim=16)
    assert clouds.count() == 2 and far.count() == 1
    pairs = models.model_pairs(tables, "crosstype")
    status = confirm.crosstype_status(tables, pairs)
    none = pairs.select("*", F.lit("x").alias("smaller_entity"), F.lit(1.5).alias("lin_sim")).limit(0)
    row = distribution.composite(status, none, far).first()
    assert row.s2_new == 0 and 0 <= row.composite_sim <= 1 and row.composite_dist == pytest.approx(1 - row.composite_sim, abs=2e-4)


MESSAGE = {"uddl_layered_message": {
    "message_id": "m 1", "message_name": "M",
    "conceptual": {"basis_entities": [{"id": "b", "name": "B"}], "observables": [{"id": "o1", "name": "Speed"}],
                   "entities": [{"id": "e1", "name": "E1", "specializes": "b", "compositions": [{"id": "c1", "role_name": "r", "observable_ref": "o1", "cardinality": "0..*"}, {"id": "c2", "entity_ref": "e2"}]}, {"id": "e2", "name": "E2"}]},
    "logical": {"entity_realizations": [{"id": "l1", "realizes": "e1"}], "measurements": [{"id": "m1", "name": "Meas", "realizes": "o1", "unit": "Knots", "numeric_value": 4.5}]},
    "platform": {"entity_realizations": [{"id": "p1", "realizes": "l1"}], "platform_compositions": [{"id": "f1", "role_name": "spd", "data_type": "Double", "realizes": "m1", "value": "7"}]},
}}


def test_message_assertions(spark):
    text = spark.createDataFrame([(json.dumps(MESSAGE),)], ["value"])
    every = {tuple(r)[1:5] for r in to_assertions(parse_messages(text)).collect()}
    assert ("object", "compositionTarget", "c2_ccomp", "e2_centity") in every
    assert ("object", "specializes", "e1_centity", "b_basis") in every and ("object", "hasPlatformComposition", "p1_pentity", "f1_pcomp") in every
    assert ("data", "upperBound", "card_c1", "-1") in every and ("class", "type", "dtype_Double", "PlatformPrimitive") in every
    assert ("data", "hasFieldValue", "f1_pcomp", "7") in every and ("object", "hasConceptualModel", "m_1_dm", "m_1_dm_cdm") in every
    coded = {tuple(r)[1:5] for r in to_assertions(parse_messages(text), "as_coded").collect()}
    assert every - coded == {("object", "compositionTarget", "c2_ccomp", "e2_centity")}
    lines = [r.value for r in sinks.ntriples(to_assertions(parse_messages(text))).collect()]
    assert len(lines) == len(every) and all(x.endswith(" .") for x in lines)


def test_cardinalities(spark):
    lower, upper = parse_cardinality(F.col("t"))
    got = {r.t: (r.l, r.u) for r in spark.createDataFrame([("1..1",), ("0..*",), ("3",), ("x..2",), ("bad",)], ["t"]).select("t", lower.alias("l"), upper.alias("u")).collect()}
    assert got == {"1..1": (1, 1), "0..*": (0, -1), "3": (3, 3), "x..2": (0, 2), "bad": (None, None)}


def test_alignment_documents_are_read_back(spark, tmp_path):
    cells = spark.createDataFrame([("d", "http://x/a&b", "http://x/c", 0.5, "="), ("d", "http://x/e", "http://x/f", 0.75, "=")], ["k", "source", "target", "score", "relation"])
    folder = tmp_path / "Car"
    folder.mkdir()
    (folder / "A_vs_B.rdf").write_text(sinks.alignment_documents(cells, ["k"]).first().value)
    (folder / "C_vs_D.rdf").write_text('<?xml version="1.0"?><rdf:RDF xmlns:rdf="r"></rdf:RDF>')
    got = rows(read_alignment_cells(spark, str(tmp_path)), "domain", "stem", "source", "target", "score")
    assert got == [("Car", "A_vs_B", "http://x/a&b", "http://x/c", 0.5), ("Car", "A_vs_B", "http://x/e", "http://x/f", 0.75)]


def test_links(spark, tmp_path):
    (tmp_path / "l.nt").write_text("# note\n\n<http://a#x> <http://p#s> <http://b#y> .\n<http://a#x> <http://p#s> <http://b#y> .\n<only> <two> .\n")
    assert rows(read_links(spark, str(tmp_path / "l.nt")), "src_id", "tgt_id") == [("x", "y")]
    assert read_links(spark, str(tmp_path / "l.nt"), keep_repeats=True).count() == 2


def test_new_files_are_aligned_once(spark, tmp_path):
    from tessellate.streaming.ingest import watch_models

    folder = tmp_path / "in" / "Car"
    folder.mkdir(parents=True)
    (folder / "car_model_v1.json").write_text(json.dumps(A))
    (folder / "parts_model_variation_1.json").write_text(json.dumps(B))
    for _ in range(2):
        watch_models(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/pairs")).count() == 1


def test_message_comparison(spark, tmp_path):
    from tessellate.plans.message_pipeline import compare_messages
    from tessellate.sources.metamodel import class_parents, with_superproperties

    other = json.loads(json.dumps(MESSAGE).replace('"Speed"', '"AirSpeed"').replace('"o1"', '"o9"'))
    for name, m in (("a", MESSAGE), ("b", other)):
        (tmp_path / f"{name}.json").write_text(json.dumps(m))
    (tmp_path / "truth.json").write_text(json.dumps([{"src_name": "Speed", "tgt_name": "AirSpeed"}, {"src_name": "Speed", "tgt_name": "Nothing"}]))
    got = compare_messages(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"), str(tmp_path / "truth.json"))
    assert {(r.method, r.precision, r.recall, r.f1) for r in got.scores.collect()} == {(m, 1.0, 1.0, 1.0) for m in ("trigram", "camel_trigram", "links")}
    assert got.missed.count() == 0
    wider = with_superproperties(got.assertions.drop("side")).filter("predicate = 'realizes'")
    assert wider.count() == 8
    assert class_parents(spark).filter("class = 'ConceptualEntity'").count() == 2
