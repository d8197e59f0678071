import random
import re

from pyspark.sql import functions as F

from forgelens import rules
from forgelens.operators import patterns, repos


def flags_of(workflows):
    return patterns.workflow_flags(repos.workflow_detail(workflows))


def slugs(workflows):
    rows = patterns.repo_patterns(patterns.repo_facts(flags_of(workflows))).collect()
    return {row.repo: row.slugs for row in rows}


def test_workflow_level_slugs(make_workflows):
    found = slugs(
        make_workflows(
            {
                "workflow_name": "release-nightly",
                "actions_normalized": ["acme/own", "Step-Security/harden-runner", "aquasecurity/trivy-action", "", "nick-fields/retry"],
                "uses_matrix": True,
                "matrix_keys": ["python"],
                "matrix_values": ["3.12", "v3.13", "3.14", "arm64"],
                "has_permissions_block": True,
                "uses_reusable_workflows": True,
                "run_commands": ["cosign sign", "pkg.pr.new", "pytest --Benchmark", "toxiproxy", "check-AI-coauthors"],
                "step_names": ["Codex security audit", "fuzz it", "downstream"],
            }
        )
    )
    assert found["acme/app"] == sorted(set(patterns.WORKFLOW_SLUGS))


def test_plain_workflow_has_no_pattern(make_workflows):
    assert slugs(make_workflows({"actions_normalized": ["actions/checkout"]}))["acme/app"] == []


def test_release_train(make_workflows):
    release = [{"workflow_name": f"release-{i}"} for i in range(3)]
    assert "multi-stage-release" in slugs(make_workflows(*release))["acme/app"]
    assert "multi-stage-release" not in slugs(make_workflows(*release[:2]))["acme/app"]
    two = [*release[:2], {"workflow_name": "ci", "triggers": ["Workflow_Dispatch"]}]
    assert "multi-stage-release" in slugs(make_workflows(*two))["acme/app"]


def test_build_systems_and_samples(make_workflows):
    rows = [{"workflow_name": f"w{i}", "run_commands": [command]} for i, command in enumerate(["make", "cargo b", "npm i"])]
    assert "multiple-build-systems" in slugs(make_workflows(*rows))["acme/app"]
    rows = [{"workflow_name": f"docs{i}" if i < 3 else f"w{i}"} for i in range(10)]
    assert "per-sample-ci" in slugs(make_workflows(*rows))["acme/app"]
    assert "per-sample-ci" not in slugs(make_workflows(*rows[:9]))["acme/app"]


def test_version_values_match_as_a_whole(make_workflows):
    values = ["3.11", "3.12", "3.13\n", "3.1.2.3"]
    row = {"matrix_values": values, "uses_matrix": True}
    assert "cross-version-compat" not in slugs(make_workflows(row))["acme/app"]
    row = {"matrix_values": ["3.11", "v3", "20"], "uses_matrix": True}
    assert "cross-version-compat" in slugs(make_workflows(row))["acme/app"]


def test_rollup_keeps_unused_patterns_and_examples_are_ordered(make_workflows):
    rows = [
        {"repo": f"o{i}/r", "workflow_name": f"wf{j}", "has_permissions_block": True, "concurrency_set": i == 3}
        for i in range(4)
        for j in range(3)
    ]
    detail = repos.workflow_detail(make_workflows(*rows))
    facts = patterns.repo_facts(patterns.workflow_flags(detail))
    rollup = {row.slug: row for row in patterns.pattern_adoption(facts).collect()}
    assert len(rollup) == 22 and rollup["harden-runner"].repo_count == 0
    hit = rollup["least-privilege-permissions"]
    assert (hit.repo_count, hit.workflow_count, hit.adoption_pct) == (4, 12, 100.0)
    examples = patterns.pattern_examples(detail).where(F.col("slug") == "least-privilege-permissions").orderBy("position")
    assert [(row.repo, row.workflow_name) for row in examples.collect()] == [
        ("o3/r", "wf0"), ("o3/r", "wf1"), ("o3/r", "wf2"), ("o0/r", "wf0"), ("o0/r", "wf1"),
    ]


def test_train_example_lists_first_five_names(make_workflows):
    rows = [{"workflow_name": f"deploy{i}"} for i in range(7)]
    examples = patterns.pattern_examples(repos.workflow_detail(make_workflows(*rows)))
    train = examples.where(F.col("slug") == "multi-stage-release").collect()
    assert [(row.position, row.repo, row.detail) for row in train] == [
        (1, "acme/app", "deploy0,deploy1,deploy2,deploy3,deploy4")
    ]


def test_empty_table_gives_zero_rows_for_all_patterns(make_workflows):
    empty = flags_of(make_workflows({}).limit(0))
    rows = patterns.pattern_adoption(patterns.repo_facts(empty)).collect()
    assert len(rows) == 22 and all(row.repo_count == 0 and row.adoption_pct == 0.0 for row in rows)


# --- the same rules restated one row at a time ------------------------------------
def expected_slugs(row):
    def says(terms, body):
        return re.search("|".join(t.replace(".", r"\.").replace("~", "[-_ ]?") for t in terms), body, re.I)

    actions = [a for a in row["actions_normalized"] if a]
    notable = [a for a in actions if a not in rules.COMMON_ACTIONS and a[0] != "."]
    fields = [row["workflow_name"]] + [
        " ".join(values)
        for values in (
            row["triggers"], row["job_names"], actions, notable, row["runs_on"], row["matrix_keys"],
            row["matrix_values"], row["step_names"], row["run_commands"], row["reusable_workflows"],
        )
    ]
    body = "\n".join(fields)
    ai = row["has_ai_review"] or says(rules.AI_TOOLS_TEXT, body)
    platforms = row["matrix_keys"] + row["matrix_values"] + row["runs_on"]
    checks = {
        "ai-code-review": ai,
        "ai-security-review": ai and says(rules.AI_SECURITY_TOPIC, body),
        "ai-contribution-audit": says(rules.AI_AUDIT, body),
        "dogfooding": any(a.lower().startswith(row["repo"].split("/")[0].lower() + "/") for a in actions),
        "security-scanning": row["has_security_scan"] or says(rules.SCANNERS, body),
        "container-signing": says(rules.SUPPLY_CHAIN, body),
        "harden-runner": any(rules.HARDENED_RUNNER in a.lower() for a in actions),
        "least-privilege-permissions": row["has_permissions_block"],
        "hardware-matrix": row["uses_matrix"] and any(t in p.lower() for t in rules.HARDWARE for p in platforms),
        "chaos-engineering": says(rules.CHAOS, body),
        "fuzz-randomized-testing": says(rules.FUZZ, body),
        "flaky-test-retry": says(rules.RETRY, body),
        "performance-tracking": says(rules.PERFORMANCE, body),
        "python-future-testing": any("3.14" in v or "free-threaded" in v.lower() for v in row["matrix_values"])
        or ("3.14" in body and "python" in body.lower()),
        "multi-channel-release": says(rules.RELEASE, body) and says(rules.CHANNEL, body),
        "pr-package-preview": says(rules.PREVIEW_PACKAGE, body),
        "reusable-workflows": row["uses_reusable_workflows"],
        "ecosystem-ci": says(rules.ECOSYSTEM, body),
        "cross-version-compat": len(
            {v for v in row["matrix_values"] if re.fullmatch(rules.VERSION_VALUE, v)}
        ) >= 3,
    }
    return {slug for slug, hit in checks.items() if hit}


def test_flags_equal_the_row_by_row_rules(make_workflows):
    rng = random.Random(7)
    words = [
        "fault", "Default", "ai review", "AI_REVIEW", "pr", "package", "release", "NEXT", "python", "3.14", "docs",
        "network", "partition", "gh", "workflow", "run", "SBOM", "attest", "perf", "router", "ai", "contribution", "pod kill",
        "org/tool", "Org/Tool", "actions/checkout", "./local", "step-security/harden-runner", "gpu", "H20", "v1.2", "3.11",
        "3.12", "audit", "tutorial", "property based", "randomiSed",
    ]
    lists = ("triggers", "job_names", "actions_normalized", "runs_on", "matrix_keys", "matrix_values", "step_names",
             "run_commands", "reusable_workflows")
    rows = []
    for i in range(300):
        row = {"repo": f"{rng.choice(['org', 'Org', 'acme'])}/r{i}", "workflow_name": rng.choice(words)}
        for name in lists:
            row[name] = [rng.choice(words + [""]) for _ in range(rng.choice([0, 0, 1, 2, 4]))]
        for name in ("uses_matrix", "has_permissions_block", "has_ai_review", "has_security_scan", "uses_reusable_workflows"):
            row[name] = rng.random() < 0.2
        rows.append(row)
    got = flags_of(make_workflows(*rows)).select("repo", *map(patterns.flag, patterns.WORKFLOW_SLUGS)).collect()
    by_repo = {row["repo"]: expected_slugs(row) for row in rows}
    for row in got:
        assert {s for s in patterns.WORKFLOW_SLUGS if row[patterns.flag(s)]} == by_repo[row.repo], row.repo
