"""The pipeline's stages against brute force over whole small tables, and the registered queries."""

import os

import pytest

from tests.llm.test_operators import lowered, reach, slow_print

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_data
def test_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    start = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    # Whatever has letters of a known language stays.
    assert {r.doc_id for r in start} - {r.doc_id for r in held["language_id"]} <= {r.doc_id for r in start if not any(c.isalpha() for c in r.text or "")}
    groups = {}
    for r in held["language_id"]:
        groups[lowered(r.text)] = max(groups.get(lowered(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in held["exact_dedup"]) == sorted(groups.values())
    prints = {r.doc_id: slow_print(r.text) for r in held["exact_dedup"]}
    label = reach(prints, [(i, j) for i, p in prints.items() for j, q in prints.items() if i < j and (p ^ q).bit_count() <= 4])
    assert sorted(r.doc_id for r in held["simhash_dedup"]) == sorted(set(label.values()))
    mixed = {r.doc_id: r.text for r in held["mixing"]}
    assert mixed.items() <= {r.doc_id: r.text for r in held["simhash_dedup"]}.items() and len(mixed) > 0.5 * len(held["simhash_dedup"])
    assert {r.doc_id for r in held["packing"]} == set(mixed)
    whole = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in held["packing"])


@needs_data
@pytest.mark.parametrize("name", ["op1_mixing", "op2_exact_dedup", "op4_quality_rules", "op7_warc"])
def test_queries_equal_sql(spark, name):
    import duckdb

    from tessellate.llm import registry

    got = registry.QUERIES[name](spark, DATA).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(registry.ORACLE[name]).df()
    columns = sorted(want.columns)
    if "refers_to" in columns:
        got, want = (x.assign(refers_to=x["refers_to"].astype("Int64")) for x in (got, want))
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert sorted(got.columns) == columns and a.equals(b)


@needs_data
def test_held_out_accuracy(spark):
    from tessellate.llm import registry

    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = [r for r in registry.QUERIES["op8_language_id"](spark, DATA).collect() if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in rows) >= 0.95 * len(rows) > 0
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [r for r in registry.QUERIES["op6_quality_classifier"](spark, DATA).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.8 * len(rows) > 0


def test_registry_names_every_operator():
    from tessellate.llm import registry

    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)}
