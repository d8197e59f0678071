"""Quality, snapshots, changes, lineage, profiles, serving and the incremental stream."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from forgelens.operators import changes, lineage, patterns, profiles, quality, repos, security, serving
from forgelens.sources import snapshots
from forgelens.streaming import incremental


def test_quality(make_workflows):
    table = make_workflows({}, {}, {"repo": "b/y"})
    row = quality.quality_summary(table).first()
    assert (row.status, row.row_count, row.repo_count, row.duplicate_count) == ("warn", 3, 2, 1)
    row = quality.quality_summary(table.drop("has_security_scan")).first()
    assert (row.status, row.missing_columns) == ("fail", "has_security_scan")
    assert row.issues == "missing_columns: has_security_scan; duplicate_rows: 1"
    row = quality.quality_summary(table.limit(0)).first()
    assert (row.status, row.row_count, row.repo_count, row.issues) == ("pass", 0, 0, "")
    rates = {row.column_name: row.null_rate for row in quality.null_rates(table).collect()}
    assert rates["permissions"] == 100.0 and rates["repo"] == 0.0 and len(rates) == 23


def test_validation_gate(make_workflows):
    good = make_workflows({}, {"repo": "b/y"})
    assert quality.validate(good).count() == 2
    with pytest.raises(quality.ContractViolation, match="duplicate_rows: 1"):
        quality.validate(good.unionByName(make_workflows({})))
    broken = good.drop("triggers").withColumn("job_names", F.lit(None).cast("array<string>"))
    with pytest.raises(quality.ContractViolation) as caught:
        quality.validate(broken.withColumn("workflow_path", F.lit(None).cast("string")))
    assert caught.value.issues == ["missing_columns: triggers", "no_values: job_names"]


def test_snapshots_by_date(spark, make_workflows, tmp_path):
    path = str(tmp_path / "cicd")
    assert snapshots.read_snapshots(spark, path).count() == 0
    days = [datetime.date(2026, 1, day) for day in (1, 8, 15)]
    snapshots.write_snapshot(make_workflows(*[{"crawl_date": day} for day in days]), path)
    snapshots.write_snapshot(make_workflows({"crawl_date": days[1], "repo": "new/one"}, {"crawl_date": days[1]}), path)
    table = snapshots.read_as_view(spark, path, "cicd_test")
    assert {(row.crawl_date, row.n) for row in table.groupBy("crawl_date").agg(F.count("*").alias("n")).collect()} == {
        (days[0], 1), (days[1], 2), (days[2], 1),
    }
    assert spark.sql("SELECT count(*) FROM cicd_test WHERE crawl_date = DATE '2026-01-08'").first()[0] == 2
    previous = changes.previous_snapshot(table, F.lit(days[2]))
    assert {row.repo for row in previous.collect()} == {"acme/app", "new/one"}
    assert changes.previous_snapshot(table, F.lit(days[0])).count() == 0
    plan = table.where(F.col("crawl_date") == F.lit(days[0]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(crawl_date" in plan


def test_older_snapshots_get_typed_defaults(spark):
    old = spark.createDataFrame([("a/x", "ci", ["actions/checkout"], True)], "repo string, workflow_name string, actions_normalized array<string>, uses_matrix boolean")
    row = snapshots.conform(old).first()
    assert (row.workflow_path, row.source_file, row.matrix_values, row.has_ai_review, row.permissions) == ("ci", "ci", [], False, None)
    assert patterns.repo_facts(patterns.workflow_flags(repos.workflow_detail(snapshots.conform(old)))).first().workflow_count == 1


def test_result_tables_keep_all_runs(spark, tmp_path):
    for day, n in (("2026-01-01", 1), ("2026-01-08", 2)):
        snapshots.write_results({"totals": spark.range(n)}, day, str(tmp_path))
    assert snapshots.read_result(spark, str(tmp_path), "totals").groupBy("crawl_date").count().count() == 2


def test_changes(make_workflows, spark):
    previous = make_workflows({"workflow_name": "a"}, {"workflow_name": "b"}, {"repo": "o/gone", "workflow_name": "a"})
    current = make_workflows({"workflow_name": "b"}, {"workflow_name": "c", "uses_matrix": True}, {"repo": "o/new", "workflow_name": "a"})
    assert {tuple(row) for row in changes.workflow_changes(previous, current).collect()} == {
        ("acme/app", "a", "removed"), ("o/gone", "a", "removed"), ("acme/app", "c", "added"), ("o/new", "a", "added"),
    }
    assert changes.workflow_changes(previous, previous).count() == 0
    diffs = {row.metric: (row.prev_value, row.curr_value, row.delta) for row in changes.two_snapshot_diffs(previous, current).collect()}
    assert diffs == {"matrix_usage_percentage": (0.0, 50.0, 50.0)}
    first = {row.metric: row.prev_value for row in changes.two_snapshot_diffs(previous.limit(0), current).collect()}
    assert first["total_workflows"] == 0.0
    shared = changes.on_shared_repos(previous, current)
    assert [df.select("repo").distinct().count() for df in shared] == [1, 1]
    rows = [("previous", "a", "x"), ("previous", "a", "y"), ("previous", "b", "x"), ("current", "a", "y"), ("current", "a", "z"), ("current", "b", "x")]
    moved = changes.pattern_changes(spark.createDataFrame(rows, "snapshot string, repo string, slug string"))
    assert [tuple(row) for row in changes.changed_repos(moved).collect()] == [("a", ["z"], ["x"])]


def test_metric_series(make_workflows):
    days = [datetime.date(2026, 1, day) for day in (1, 8, 15)]
    table = make_workflows(
        {"crawl_date": days[0]}, {"crawl_date": days[1]}, {"crawl_date": days[2]}, {"crawl_date": days[2], "repo": "b/y", "uses_matrix": True}
    )
    got = {(row.snapshot, row.metric, row.delta) for row in changes.metric_diffs(table, F.col("crawl_date")).collect()}
    assert got == {(days[2], "matrix_usage_percentage", 50.0), (days[2], "total_repos", 1.0), (days[2], "total_workflows", 1.0)}


def test_lineage(make_workflows):
    detail = repos.workflow_detail(make_workflows({"source_file": ""}, {"workflow_name": "x", "source_file": "raw/x.yml"}))
    assert {row.source_file for row in lineage.workflow_sources(detail).collect()} == {".github/workflows/ci.yml", "raw/x.yml"}
    assert lineage.repo_sources(detail).count() == 2


def test_profiles(spark, make_workflows, tmp_path):
    detail = repos.workflow_detail(make_workflows({"has_permissions_block": True}, {"repo": "b/y"}))
    facts = patterns.repo_facts(patterns.workflow_flags(detail))
    metadata = spark.createDataFrame(
        [("acme/app", " some\n text ", 0, 12, 3, "Go", "MIT", ["cli"], "2026")],
        "full_name string, description string, stars long, stargazers_count long, forks long, language string, license string,"
        " topics array<string>, pushed_at string",
    )
    rows = profiles.repo_profiles(facts, security.security_scores(detail), metadata)
    got = {row.repo: row for row in rows.collect()}
    app = got["acme/app"]
    assert (app.summary, app.stars, app.forks, app.patterns) == ("some text", 12, 3, ["least-privilege-permissions"])
    assert (app.security_score, app.maturity_pct, app.workflow_count) == (25.0, 17, 1)
    assert (got["b/y"].description, got["b/y"].stars, got["b/y"].topics) == ("", None, [])
    snapshots.write_profiles(profiles.profile_documents(rows), str(tmp_path / "profiles"), by_owner=True)
    lines = [json.loads(line) for path in (tmp_path / "profiles").glob("owner=acme/*.json") for line in path.read_text().splitlines()]
    assert lines[0]["cicd"] == {"workflow_count": 1, "patterns": ["least-privilege-permissions"], "security_score": 25.0, "maturity_pct": 17}


def test_serving(spark, make_workflows):
    table = make_workflows({"workflow_name": "a"}, {"workflow_name": "b"}, {"repo": "b/y", "workflow_name": "b", "uses_matrix": True})
    detail = repos.workflow_detail(table)
    pairs = spark.createDataFrame([("acme/app", "b/y"), ("acme/app", "no/where")], "left_repo string, right_repo string")
    assert [tuple(row) for row in serving.pair_workflows(pairs, table).collect()] == [("acme/app", "b/y", "a", "left")]
    matrix = serving.pair_practices(pairs, repos.practices(detail)).where("practice = 'has_matrix'").collect()
    assert [(row.left_has, row.right_has) for row in matrix] == [(False, True)]
    facts = patterns.repo_facts(patterns.workflow_flags(detail))
    scores = security.security_scores(detail)
    listed = serving.repo_list(facts, scores.where("repo = 'b/y'"), sort="security_score")
    assert [(row.repo, row.security_score) for row in listed.orderBy("position").collect()] == [("b/y", 0.0), ("acme/app", None)]
    assert [row.repo for row in serving.repo_list(facts, scores, "ACME").collect()] == ["acme/app"]
    with pytest.raises(ValueError):
        serving.repo_list(facts, scores, sort="x")
    advice = serving.repo_advice(detail, scores).where("repo = 'acme/app'").orderBy("position").collect()
    assert len(advice) == 8 and advice[0].advice == "Add Matrix testing." and advice[6].advice == "permissions"


def test_health_counts_all_files(spark):
    rows = [("r", False, i < 1, False, ["a/trivy"] if i < 40 else []) for i in range(80)] + [("s", True, True, True, [])]
    scan = spark.createDataFrame(rows, "repo string, has_matrix boolean, has_permissions boolean, has_ai_review boolean, security_tools array<string>")
    got = {row.repo: row for row in serving.health_check(scan).collect()}
    assert (got["r"].workflow_count, got["r"].permissions_coverage_pct, got["r"].security_tools) == (80, 1, 1)
    assert (got["r"].advice, got["s"].advice) == ("permissions,matrix", "scanner")


def put(folder, path, body):
    target = folder / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(body)


def current(spark, tables):
    return {(row.repo, row.workflow_name): row.triggers for row in incremental.workflows(spark, tables).collect()}


def test_incremental_runs(spark, tmp_path):
    raw, tables = tmp_path / "raw", str(tmp_path / "tables")
    put(raw, "a/x/ci.yml", "on: push\n")
    put(raw, "a/x/bad.yml", "- list\n")
    put(raw, "b/y/ci.yml", "on: push\n")
    assert incremental.run(spark, str(raw), tables) == 0
    assert current(spark, tables) == {("a/x", "ci"): ["push"], ("b/y", "ci"): ["push"]}
    assert spark.read.parquet(f"{tables}/errors").count() == 1
    put(raw, "c/z/ci.yaml", "on: [schedule]\n")
    put(raw, "b/y/ci.yml", "on: pull_request\n")  # in place
    assert incremental.run(spark, str(raw), tables) == 1
    changed = {("a/x", "ci"): ["push"], ("b/y", "ci"): ["pull_request"], ("c/z", "ci"): ["schedule"]}
    assert current(spark, tables) == changed
    assert spark.read.parquet(f"{tables}/workflows").where("run = 1").count() == 2  # the others are not parsed again
    put(raw, "a/x/ci.yml", "- no longer a workflow\n")
    assert incremental.run(spark, str(raw), tables) == 2
    del changed["a/x", "ci"]
    assert current(spark, tables) == changed
    assert incremental.run(spark, str(raw), tables, number=2) == 2  # a repeated run replaces its own output
    assert current(spark, tables) == changed
    assert spark.read.parquet(f"{tables}/state").where("run = 2").count() == 4


def test_two_versions_in_one_run(spark, tmp_path):
    tables = str(tmp_path / "tables")
    columns = "repo string, file_name string, source_file string, content string"
    rows = [("a/x", "ci.yml", "1", "on: push\n"), ("a/x", "ci.yml", "2", "on: later\n"), ("d/w", "ci.yml", "f", "on: x\n")]
    for order in (rows, rows[::-1]):
        incremental.process(spark.createDataFrame(order, columns), 0, tables)
        assert current(spark, tables) == {("a/x", "ci"): ["later"], ("d/w", "ci"): ["x"]}


def test_incremental_stream_of_added_files(spark, tmp_path):
    raw, tables, checkpoint = tmp_path / "raw", str(tmp_path / "tables"), str(tmp_path / "checkpoint")
    put(raw, "a/x/ci.yml", "on: push\n")
    incremental.start(spark, str(raw), tables, checkpoint).awaitTermination()
    put(raw, "c/z/ci.yaml", "on: [schedule]\n")
    incremental.start(spark, str(raw), tables, checkpoint).awaitTermination()
    assert current(spark, tables) == {("a/x", "ci"): ["push"], ("c/z", "ci"): ["schedule"]}


def test_sinks(spark, tmp_path, make_workflows):
    rows = make_workflows({"workflow_name": "ci"}, {"workflow_name": "release"})
    for _ in range(2):  # the second write replaces the first
        snapshots.write_latest(rows, str(tmp_path / "latest"))
    assert spark.read.parquet(str(tmp_path / "latest")).count() == 2
    signals = spark.createDataFrame([("a/x", "dockerfile", "Dockerfile")], "repo string, signal string, path string")
    snapshots.write_observations({"signals": signals}, str(tmp_path / "observed"))
    assert spark.read.json(str(tmp_path / "observed/signals")).first().path == "Dockerfile"
    repos = spark.createDataFrame([("a/x", 2)], "repo string, workflow_count int")
    patterns = spark.createDataFrame([("dogfooding", 1)], "slug string, repo_count int")
    snapshots.write_export(repos, patterns, str(tmp_path / "export"))
    assert spark.read.parquet(str(tmp_path / "export/repos")).first().workflow_count == 2
    assert spark.read.parquet(str(tmp_path / "export/patterns")).first().slug == "dogfooding"
