"""Chains of reusable workflows against a search from every file."""

import random

from forgelens.operators import reuse


def expected_chains(edges):
    out = {}
    for start in {a for a, _ in edges}:
        front, depth = {start}, 0
        while front:
            depth += 1
            front = {b for a, b in edges if a in front} - {b for a, b in out if a == start}
            out.update({(start, b): depth for b in front})
    return out


def chains_of(spark, edges):
    rows = reuse.closure(spark.createDataFrame(edges, "caller string, callee string")).collect()
    assert len({(row.caller, row.callee) for row in rows}) == len(rows)
    return {(row.caller, row.callee): row.depth for row in rows}


def test_closure_of_random_calls(spark):
    rng = random.Random(4)
    inner = [(f"s{rng.randrange(25)}", f"s{rng.randrange(25)}") for _ in range(30)] + [("s1", "s1"), ("a", "b"), ("b", "c"), ("c", "a")]
    edges = inner + [(f"w{i}", f"s{rng.randrange(25)}") for i in range(60)] + [("w1", "a")]
    assert chains_of(spark, edges + edges[:5]) == expected_chains(edges)
    assert chains_of(spark, []) == {}


def test_targets_and_reach(spark, make_workflows):
    shared, local = "acme/ci/.github/workflows/main.yml", "./.github/workflows/local.yml"
    rows = make_workflows(
        {"repo": "a/x", "workflow_name": "one", "reusable_workflows": [shared + "@v1", shared + "@v2", local]},
        {"repo": "a/y", "workflow_name": "one", "reusable_workflows": [local]},
        {"repo": "acme/ci", "workflow_name": "main", "reusable_workflows": [local]},
        {"repo": "acme/ci", "workflow_name": "local", "reusable_workflows": ["./.github/workflows/main.yml"]},
    )
    found = {row.workflow: row[1:] for row in reuse.reach(reuse.closure(reuse.calls(rows))).collect()}
    assert found == {
        shared: (2, 2, 1, True),
        "acme/ci/.github/workflows/local.yml": (1, 2, 2, True),
        "a/x/.github/workflows/local.yml": (1, 1, 1, False),
        "a/y/.github/workflows/local.yml": (1, 1, 1, False),
    }
