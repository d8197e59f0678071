"""What queries shuffle and read as tables grow, by their plans."""

import datetime
import re

from forgelens.operators import lifetimes, reuse
from forgelens.plans.queries import build


def test_snapshots_of_patterns_build_the_steps_once(spark, sf_dir):
    for name in ("pattern_changed_repos", "trend_counters"):
        plan = build(name, spark, sf_dir)._jdf.queryExecution().toString()
        executed = plan[plan.index("== Physical Plan ==") :]
        scans = [scan for scan in re.findall(r"ReadSchema: struct<([^>]*)>", executed) if "l_quantity" in scan]
        assert len(scans) == 1, name


def test_flags_of_snapshots_travel_as_one_number(spark, sf_dir):
    plan = build("pattern_lifetimes", spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "_has" in plan and "n_fuzz_randomized_testing" not in plan


def test_lifetimes_shuffle_members_by_their_key_alone(spark):
    rows = [(datetime.date(2026, 1, 1), "a", "x")] * 2 + [(datetime.date(2026, 2, 1), "a", "x")]
    whole = lifetimes.lifetimes(spark.createDataFrame(rows, "snapshot date, repo string, slug string"), "repo", "slug")
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(snapshot#\d+, repo", plan)
    assert len(re.findall(r"Exchange hashpartitioning\(repo#", plan)) == 1
    assert [tuple(row) for row in whole.collect()] == [("a", "x", rows[0][0], rows[2][0], None)]


def test_chains_are_shuffled_by_caller_alone(spark):
    chains = reuse.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "caller string, callee string"))
    plan = chains._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(caller#\d+, callee", plan)
    assert {tuple(row) for row in chains.collect()} == {("a", "b", 1), ("b", "c", 1), ("a", "c", 1)}
