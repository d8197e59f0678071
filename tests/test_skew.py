"""Results stay whole when one key holds a third of all rows."""

import duckdb
import pytest

from forgelens.plans.oracle.statements import STATEMENTS
from forgelens.plans.queries import build
from tests.test_queries import TABLES, comparable

# a hot order among the lines, a hot customer among the orders, many repos with equally many stars
CHANGED = {
    "lineitem": "* REPLACE (CASE WHEN (l_partkey + l_suppkey) % 3 = 0 THEN 9 ELSE l_orderkey END AS l_orderkey)",
    "orders": "* REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey)",
    "customer": "* REPLACE (CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal)",
    "documents": "* REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'one [a/b](https://github.com/a/b)' ELSE text END AS text)",
}


@pytest.fixture(scope="module")
def skewed(sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    connection = duckdb.connect()
    for name in TABLES:
        columns = CHANGED.get(name, "*")
        connection.execute(f"COPY (SELECT {columns} FROM '{sf_dir}/{name}.parquet') TO '{folder}/{name}.parquet'")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    yield str(folder), connection
    connection.close()


@pytest.mark.parametrize(
    "name",
    [
        "workflow_table", "popular_actions", "fingerprint_examples", "repo_rollup", "pattern_adoption", "pattern_examples",
        "security_scores", "repo_sources", "seed_verdicts", "repo_pair_workflows", "health_check", "file_signals",
    ],
)
def test_hot_keys(spark, skewed, name):
    folder, connection = skewed
    df = build(name, spark, folder)
    columns = sorted(df.columns)
    got = [tuple(comparable(value) for value in row) for row in df.select(*columns).collect()]
    relation = connection.sql(STATEMENTS[name])
    order = [relation.columns.index(column) for column in columns]
    expected = [tuple(comparable(row[i]) for i in order) for row in relation.fetchall()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_lists_collected_for_a_file_are_bounded_by_the_vocabulary(spark, skewed):
    from forgelens.sources import tables

    files = tables.order_files(spark, skewed[0])
    longest = files.selectExpr("max(size(_steps)) AS n").first().n
    assert longest <= tables.JOBS_PER_FILE * len(tables.ACTIONS) * len(tables.COMMANDS)


def test_no_step_is_dropped(spark, skewed):
    folder, connection = skewed
    used = build("actions_normalized", spark, folder).selectExpr("sum(usage_count) AS n").first().n
    lines = "SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"
    assert used == connection.execute(lines).fetchall()[0][0]
