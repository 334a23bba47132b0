"""What is written reads back as it was; forms of versions, domains, counts."""

import json

from pyspark.sql import functions as F

from tessellate.operators import confirm, structural
from tessellate.sources import alignments, metamodel, models, sinks


def test_turtle_reads_back(spark, tmp_path):
    said = [
        ("class", "e1", "type", "LogicalMeasurement"), ("data", "e1", "hasName", 'a "b" \\ c .\n< x\t;'), ("data", "e1", "hasName", "second"),
        ("object", "e1", "measurementUnit", "u1"), ("class", "u1", "type", "LogicalUnit"), ("data", "u1", "symbol", "\\n"), ("data", "u1", "note", ""),
    ]
    df = spark.createDataFrame([("m 1", *x) for x in said], "message string, kind string, subject string, predicate string, object string")
    sinks.write_turtle(df, str(tmp_path / "t"))
    got = alignments.read_turtle(spark, str(tmp_path / "t")).collect()
    assert sorted((r.kind, r.subject, r.predicate, r.object) for r in got) == sorted(said)


def test_metamodel_triples(spark, tmp_path):
    classes, properties = metamodel.class_parents(spark), metamodel.property_parents(spark)
    sinks.write_lines(sinks.metamodel_triples(classes, properties), str(tmp_path / "m"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert len(lines) == len(set(lines)) and all(x.startswith("<") and x.endswith(" .") for x in lines)
    count = lambda part: sum(part in x for x in lines)
    assert count("#Class>") == classes.select("class").distinct().count() and count("subClassOf") == classes.filter("parent IS NOT NULL").count()
    assert count("#ObjectProperty>") == properties.count() and count("subPropertyOf") == properties.filter("parent IS NOT NULL").count()
    assert count("schema#domain") == sum(len(r.domain.split("|")) for r in properties.collect())


def test_reports_read_back(spark, tmp_path):
    rows = [("d", "x", "y", s, "entity", f"e{i}", f"e{i}", st, to) for s in "ab" for i, (st, to) in enumerate([("matched", "z"), ("missing", None), ("ambiguous", "w")])]
    status = spark.createDataFrame(rows, "domain string, model_a string, model_b string, side string, kind string, entity string, name string, status string, matched_to string")
    reports = confirm.pair_reports(status)
    sinks.write_partitioned_json(reports, str(tmp_path / "r"))
    back = confirm.statuses_of_reports(sinks.read_partitioned_json(spark, str(tmp_path / "r"), reports.schema))
    assert sorted(map(str, (r.asDict() for r in back.select(status.columns).collect()))) == sorted(map(str, (r.asDict() for r in status.collect())))


def test_versions_domains_and_counts(spark, tmp_path):
    content = lambda n: json.dumps({"modelName": n, "entities": [{"entityName": "E"}]})
    names = {"Cars/a_model_v2.json": "A", "Cars/b_v3_x.json": "B", "Cars/c_v4.json": "C", "Boats/d_variation_1.json": "D"}
    for name, model in names.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content(model))
    (tmp_path / "Cars/bad.json").write_text("{nonsense")
    scanned = models.scan_models(spark, str(tmp_path))
    assert models.batch_counts(scanned).first().asDict() == {"converted": 4, "failed": 1}
    tables = models.flatten_models(scanned)
    flags = {r.model: (r.versioned, r.versioned_short, r.original) for r in tables.model.collect()}
    assert flags == {"A": (True, True, True), "B": (False, True, True), "C": (False, False, True), "D": (False, False, False)}
    assert {r.model for r in tables.of_domain("cARS").model.collect()} == {"A", "B", "C"}
    anchors = spark.createDataFrame([("Cars", "x"), ("Boats", "y")], "domain string, entity string")
    assert [r.entity for r in structural.anchors_within(anchors, tables.model.filter(F.col("model") == "D")).collect()] == ["y"]
