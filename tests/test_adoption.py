import hashlib

from forgelens.operators import adoption, insights, repos


def rows(make_workflows):
    return make_workflows(
        {"repo": "a/x", "workflow_name": "ci", "actions_normalized": ["actions/checkout", "b/tool", "", None], "uses_matrix": True},
        {"repo": "a/x", "workflow_name": "rel", "actions_normalized": ["b/tool", "actions/checkout"], "has_permissions_block": True},
        {"repo": "b/y", "workflow_name": "ci", "actions_normalized": ["actions/checkout"], "has_ai_review": True,
         "ai_review_actions": ["q/claude", "p/claude", "q/claude"]},
        {"repo": "c/z", "workflow_name": "ci", "concurrency_set": True},
    )


def test_totals_and_shares(make_workflows):
    table = rows(make_workflows)
    assert tuple(adoption.totals(table).first()) == (3, 4)
    assert tuple(adoption.matrix_usage(table).first()) == (3, 1, 33.33)
    assert tuple(adoption.permissions_usage(table).first()) == (4, 1, 25.0)
    assert [tuple(row) for row in adoption.popular_actions(table).collect()] == [("actions/checkout", 3), ("b/tool", 2)]


def test_empty_table(make_workflows):
    table = rows(make_workflows).limit(0)
    assert tuple(adoption.totals(table).first()) == (0, 0)
    assert tuple(adoption.matrix_usage(table).first()) == (0, 0, 0.0)
    assert tuple(adoption.permissions_usage(table).first()) == (0, 0, 0.0)
    assert adoption.popular_actions(table).collect() == []
    assert adoption.fingerprints(table).collect() == []
    assert [tuple(row)[1:] for row in repos.practice_adoption(repos.workflow_detail(table)).collect()] == [(0, 0.0)] * 6


def test_fingerprints_are_multisets(make_workflows):
    table = rows(make_workflows)
    found = {row.actions: row for row in adoption.fingerprints(table).collect()}
    assert found["actions/checkout,b/tool"].usage_count == 2
    digest = hashlib.md5(b"actions/checkout,b/tool").hexdigest()
    assert found["actions/checkout,b/tool"].fingerprint == digest
    examples = [tuple(row) for row in adoption.fingerprint_examples(table).collect() if row.fingerprint == digest]
    assert examples == [(digest, "a/x", 1)]


def test_ai_adoption_keeps_first_seen_order(make_workflows):
    got = [(row.position, row.action) for row in adoption.ai_adoption(rows(make_workflows)).orderBy("position").collect()]
    assert got == [(1, "q/claude"), (2, "p/claude")]


def test_categories(spark):
    names = ["actions/cache/restore", "actions/cache-other", "github/codeql-action/init", "x/y", "actions/stale"]
    counted = spark.createDataFrame([(name, 1) for name in names], "action string, usage_count long")
    got = {row.action: row.category for row in adoption.actions_categorized(counted).collect()}
    assert got == {
        "actions/cache/restore": "Cache/Performance", "actions/cache-other": "Cache/Performance",
        "github/codeql-action/init": "Security", "x/y": "Other", "actions/stale": "Automation",
    }


def test_rollup_and_maturity(make_workflows):
    detail = repos.workflow_detail(rows(make_workflows))
    rollup = {row.repo: row for row in repos.repo_rollup(detail).collect()}
    assert (rollup["a/x"].workflow_count, rollup["a/x"].action_count) == (2, 2)
    assert (rollup["c/z"].workflow_count, rollup["c/z"].action_count) == (1, 0)
    maturity = {row.repo: row for row in repos.repo_maturity(detail).collect()}
    assert (maturity["a/x"].maturity_score, maturity["a/x"].maturity_pct) == (2, 33)
    assert maturity["c/z"].missing_en == [
        "Matrix testing", "Explicit permissions", "Security scanning", "AI code review", "CI caching",
    ]
    assert {(row.repo, row.action) for row in repos.notable_actions(detail).collect()} == {("a/x", "b/tool")}


def test_insight_rules(make_workflows):
    from pyspark.sql import functions as F

    got = {row.rule_key: row.value for row in insights.insight_flags(rows(make_workflows), F.lit("all")).collect()}
    assert got == {"permissions_low": 25.0, "ai_review": 33.3, "surprising_actions": 1.0}
    assert [row.rule_key for row in insights.recommendation_flags(rows(make_workflows), F.lit("all")).collect()] == ["try_ai_review"]


def test_discovery_and_missing_descriptions(spark, make_workflows):
    candidates = spark.createDataFrame([("s/starred", 3), ("s/dim", 2)], "full_name string, stars long")
    texts = spark.createDataFrame(
        [
            ("d/one", "GPT based review of your code"), ("d/two", "review your\npull request with AI"),
            ("d/three", "code review, automatic"), ("d/four", "lint"),
        ],
        "action string, description string",
    )
    got = {row.action for row in adoption.ai_action_discovery(candidates, texts).collect()}
    assert got == {"s/starred", "anthropics/claude-code-action", "coderabbitai/ai-pr-reviewer", "d/one", "d/two", "d/three"}
    known = spark.createDataFrame([("b/tool",)], "action string")
    missing = adoption.missing_descriptions(rows(make_workflows), known)
    assert {row.action for row in missing.where("action != ''").collect()} == {"actions/checkout"}
