"""Registered queries: their columns, SQL where there is some, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from packetloom.llm.registry import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op2": "doc_id held_out lang_pred score", "op3": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op4": "doc_id fingerprint component_id", "op5": "doc_id n_words n_base first_word last_word base_labels labels score", "op6": "doc_id n_words n_removed kept_sha256",
    "op7": "doc_id held_out score predicted", "op8": "doc_id size source_size target taken", "op9": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op10": "page_id url text n_chars",
}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("op")))
def test_rows_and_columns(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns)
    of = "pages" if name.startswith("op10") else "documents"
    assert df.count() == spark.read.parquet(f"{sf}/{of}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    a, b = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLE_SQL[name]).df()
    cols = sorted(b.columns)
    assert sorted(map(str, a[cols].values.tolist())) == sorted(map(str, b[cols].values.tolist()))


def test_all_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))


def test_pipeline_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        n = docs.count()
        if i < 4:
            assert docs.columns == columns and 0 < n <= before, name
            before = n
    assert set(columns) < set(docs.columns)


def test_pipeline_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert got.groupBy("doc_id").count().filter("count > 3").count() == 0
