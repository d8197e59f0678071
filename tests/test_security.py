from pyspark.sql import functions as F

from forgelens.operators import repos, security


def scores_of(workflows):
    return security.security_scores(repos.workflow_detail(workflows))


def test_strong_repo_scores_high(make_workflows):
    row = scores_of(
        make_workflows(
            {
                "actions_normalized": [
                    "step-security/harden-runner", "aquasecurity/trivy-action", "github/codeql-action",
                    "gitleaks/gitleaks-action", "ossf/scorecard-action", "securego/gosec", "snyk/actions",
                    "sigstore/cosign-installer", "actions/create-github-app-token",
                ],
                "run_commands": ["syft .", "echo SBOM", "echo sbom"],
                "has_permissions_block": True,
            }
        )
    ).first()
    assert row.permissions == 25.0 and row.security_scan == 25.0 and row.supply_chain == 20.0
    assert row.secret_handling == 15.0 and row.harden_runner == 15.0 and row.score == 100.0


def test_matched_words_count_by_case(make_workflows):
    detail = repos.workflow_detail(make_workflows({"run_commands": ["echo SBOM sbom SBOM"]}))
    tools = {row.tool for row in security.security_tools(detail).collect()}
    assert tools == {"SBOM", "sbom"}


def test_personal_token_halves_secret_handling(make_workflows):
    app = {"actions_normalized": ["actions/create-github-app-token"]}
    cases = {"": 15.0, "use PAT here": 7.5, "path": 15.0, "GH_token": 7.5, "my_pat": 15.0}
    for command, expected in cases.items():
        assert scores_of(make_workflows({**app, "run_commands": [command]})).first().secret_handling == expected
    assert scores_of(make_workflows({"run_commands": ["PAT"]})).first().secret_handling == 0.0


def test_permission_share_rounds_half_to_even(make_workflows):
    rows = [{"workflow_name": f"w{i}", "has_permissions_block": i == 0} for i in range(8)]
    assert scores_of(make_workflows(*rows)).first().permissions == 3.12


def test_repeated_tools_of_one_repo_count_once_and_caps_hold(make_workflows):
    rows = [
        {"workflow_name": f"w{i}", "actions_normalized": [f"o/trivy-{j}" for j in range(8)]} for i in range(20)
    ]
    row = scores_of(make_workflows(*rows)).first()
    assert (row.workflow_count, row.scanners, row.security_scan) == (20, 8, 25.0)


def frame(spark, values):
    return spark.createDataFrame([(f"r{i:03}", value) for i, value in enumerate(values)], "repo string, score double")


def test_upper_median_and_bins(spark):
    for values in ([5.0], [1.0, 2.0], [1.0, 2.0, 3.0], [4.0, 1.0, 3.0, 2.0], [7.5] * 6 + [1.0] * 6):
        expected = sorted(values)[len(values) // 2]
        assert security.upper_median(frame(spark, values)).first()[0] == expected
    counts = [row.repo_count for row in security.histogram(frame(spark, [-5.0, 0.0, 9.99, 10.0, 100.0, 250.0, None])).orderBy("bin").collect()]
    assert counts == [3, 1, 0, 0, 0, 0, 0, 0, 0, 2]


def test_lists_and_average(spark):
    scores = frame(spark, [float(i % 4) for i in range(15)])
    top = [row.repo for row in security.top(scores).collect()]
    bottom = [row.repo for row in security.bottom(scores).collect()]
    ordered = [row.repo for row in scores.orderBy(F.desc("score"), "repo").collect()]
    assert top == ordered[:10] and bottom == list(reversed(ordered[-10:]))
    assert security.average(scores).first()[0] == 1.4
    assert security.average(scores.limit(0)).first()[0] == 0.0


def test_recommendations_in_order(make_workflows):
    rows = security.recommendations(scores_of(make_workflows({}))).orderBy("position").collect()
    assert [row.position for row in rows] == [0, 1, 2, 3, 4]
    assert rows[0].advice == "permissions"
