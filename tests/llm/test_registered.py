"""Registered queries against SQL, and the pipeline, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from forgelens.llm import line_dedup, near_dedup, sentence_pieces, soft_mixing
from forgelens.llm.common import written
from forgelens.llm.queries import QUERIES, STATEMENTS

NATIVE = ("op4_soft_mixing", "op5_license_scan", "op8_line_dedup")


@pytest.fixture(scope="module")
def oracle(sf_dir):
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    yield connection
    connection.close()


def comparable(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", list(STATEMENTS))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    df = entry_module.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    relation = oracle.sql(entry_module.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(column) for column in columns]
    expected = [tuple(comparable(row[i]) for i in order) for row in relation.fetchall()]
    got = [tuple(comparable(value) for value in row) for row in df.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_operator_is_registered():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(entry_module.queries()) >= {"pipeline", *QUERIES}


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"test-{name}")
        kept[name] = {row.doc_id for row in docs.select("doc_id").collect()}
        assert kept[name] <= {row.doc_id for row in before.select("doc_id").collect()}
        if name != "sentence_pieces":
            assert docs.columns == columns
        if name == "line_dedup":
            assert docs.count() == before.count() and line_dedup.keep_bitmaps(docs).count() == 0
        if name == "minhash_dedup":
            assert near_dedup.near_duplicates(docs).where("NOT kept").count() == 0
        if name == "soft_mixing":
            rows = soft_mixing.mix(before, soft_mixing.read_labels(spark, sf_dir)).where("kept").collect()
            assert {row.doc_id for row in rows} == kept[name]
        if name == "sentence_pieces":
            assert docs.where("NOT round_trip").count() == 0
            texts = {row.doc_id: row.text for row in before.collect()}
            decoded = sentence_pieces.decode(docs.select("doc_id", "ids")).collect()
            assert {row.doc_id: row.text for row in decoded} == texts
    assert len(kept["language_id"]) >= 0.97 * 200
