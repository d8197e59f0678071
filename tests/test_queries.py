"""Every registered query against its SQL counterpart, and the shape of the plans."""

import math
import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_module  # noqa: E402
from forgelens.plans.oracle.statements import STATEMENTS  # noqa: E402
from forgelens.plans.queries import QUERIES, build  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()
PYTHON_STAGES = {
    "extracted_workflows", "parse_errors", "ai_tools_known", "adoption_counts_known", "actions_categorized", "ai_actions_known", "action_descriptions", "ai_action_discovery", "config_files",
    "config_trends", "config_counters", "build_backends", "trend_counters",
}


@pytest.fixture(scope="module")
def oracle(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    yield connection
    connection.close()


def comparable(value):
    return None if value is None else round(value, 9) if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    df = entry_module.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "EvalPython" not in plan
    assert ("MapInPandas" in plan) == (name in PYTHON_STAGES)
    columns = sorted(df.columns)
    got = [tuple(comparable(value) for value in row) for row in df.select(*columns).collect()]
    relation = oracle.sql(entry_module.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(column) for column in columns]
    expected = [tuple(comparable(row[i]) for i in order) for row in relation.fetchall()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_registries_agree():
    assert set(STATEMENTS) == set(QUERIES)


def test_entry(spark, sf_dir):
    assert entry_module.entry(spark).count() == 22


def plan_of(spark, sf_dir, name):
    return build(name, spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["fingerprint_examples", "pattern_top_repos", "pattern_examples", "surprising_actions", "insight_flags"]
)
def test_first_k_per_group_is_cut_before_the_shuffle(spark, sf_dir, name):
    assert "WindowGroupLimit" in plan_of(spark, sf_dir, name)


@pytest.mark.parametrize("name", ["popular_actions", "fingerprints", "security_top", "language_stats"])
def test_top_k_needs_no_full_sort(spark, sf_dir, name):
    assert "TakeOrderedAndProject" in plan_of(spark, sf_dir, name)


def test_unused_columns_are_not_read(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "permissions_usage")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", build("permissions_usage", spark, sf_dir)._jdf.queryExecution().toString())
    assert any("l_orderkey" in schema and "l_partkey" not in schema for schema in schemas), plan


@pytest.mark.parametrize("name, own", [("pattern_chaos_engineering", "toxiproxy"), ("flaky_examples", "flaky")])
def test_a_pattern_query_evaluates_only_its_own_rule(spark, sf_dir, name, own):
    plan = plan_of(spark, sf_dir, name)
    assert own in plan and "callgrind" not in plan


@pytest.mark.parametrize("name", ["pattern_adoption", "repo_patterns", "security_scores", "repo_maturity"])
def test_no_text_is_shuffled(spark, sf_dir, name):
    execution = build(name, spark, sf_dir)._jdf.queryExecution()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    sections = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", execution.explainString(mode))
    assert len(sections) >= 2
    for columns in sections:
        assert not re.search(r"_text|_raw|_folded|run_commands|actions|source_file", columns), columns
