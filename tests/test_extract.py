import datetime

import pytest
from pyspark.sql import functions as F

from forgelens.functions import parsers
from forgelens.functions.parsers import parse_workflow
from forgelens.operators import extract
from forgelens.sources import corpus, tables



def day():
    return F.lit("2026-01-01").cast("date")


def files(spark, *texts, name="flow.yml"):
    rows = [("acme/app", f"{i}-{name}", f"raw/acme/app/{i}-{name}", body) for i, body in enumerate(texts)]
    return spark.createDataFrame(rows, "repo string, file_name string, source_file string, content string")


def only_row(spark, body, known=None):
    return extract.workflows_from(extract.parse(files(spark, body)), day(), known).first()


def test_triggers_and_permissions(spark):
    row = only_row(spark, "name: A\non: [push, pull_request]\npermissions:\n  contents: read\n  actions: none\njobs: {}\n")
    assert row.triggers == ["push", "pull_request"]
    assert row.has_permissions_block
    assert row.permissions == '{"actions": "none", "contents": "read"}'
    assert row.crawl_date == datetime.date(2026, 1, 1)
    assert (row.workflow_name, row.workflow_path) == ("0-flow", ".github/workflows/0-flow.yml")


@pytest.mark.parametrize(
    "text, triggers",
    [
        ("on: push\n", ["push"]),
        ("on: true\n", []),
        ("on:\n  schedule:\n    - cron: x\n  push:\n", ["schedule", "push"]),
        ("'on': [push, 3]\n", ["push", "3"]),
        ("name: nothing\n", []),
        ("on: 5\n", []),
    ],
)
def test_trigger_forms(text, triggers):
    assert parse_workflow(text)["triggers"] == triggers


def test_null_permissions_still_set_the_flag():
    row = parse_workflow("permissions:\nconcurrency:\n")
    assert row["has_permissions_block"] and row.get("permissions") is None and row["concurrency_set"]
    assert parse_workflow("permissions: read-all\n")["permissions"] == "read-all"


def test_matrix_keys_have_only_the_nearest_parent():
    row = parse_workflow(
        "jobs:\n  t:\n    strategy:\n      matrix:\n        os: [linux, mac]\n        py: ['3.12', 3.10]\n"
        "        include:\n          - os: win\n            extra: {deep: {leaf: 1}}\n"
    )
    assert row["uses_matrix"]
    assert row["matrix_keys"] == ["deep.leaf", "extra.deep", "include", "include.extra", "include.os", "os", "py"]
    assert row["matrix_values"] == ["1", "3.1", "3.12", "linux", "mac", "win"]


def test_matrix_expression_counts_as_matrix_without_keys():
    row = parse_workflow("jobs:\n  t:\n    strategy:\n      matrix: ${{ fromJSON(x) }}\n")
    assert row["uses_matrix"] and row["matrix_keys"] == [] and row["matrix_values"] == []


def test_actions_keep_order_repeats_and_versions(spark):
    row = only_row(
        spark,
        "jobs:\n  b:\n    steps:\n      - uses: a/x@v1\n      - just text\n      - uses: a/x@deadbeef\n"
        "  a:\n    steps:\n      - uses: ./.github/actions/foo\n      - run: make\n        name: Build\n"
        "  c: not a mapping\n  d:\n    uses: o/r/.github/workflows/w.yml@main\n",
    )
    assert row.job_names == ["b", "a", "c", "d"]
    assert row.actions_used == ["a/x@v1", "a/x@deadbeef", "./.github/actions/foo"]
    assert row.actions_normalized == ["a/x", "a/x", "./.github/actions/foo"]
    assert row.step_names == ["Build"] and row.run_commands == ["make"]
    assert row.reusable_workflows == ["o/r/.github/workflows/w.yml@main"] and row.uses_reusable_workflows


def test_runner_labels_of_all_jobs():
    row = parse_workflow("jobs:\n  a: {runs-on: ubuntu}\n  b: {runs-on: [self-hosted, 2]}\n  c: {runs-on: ubuntu}\n")
    assert row["runs_on"] == ["ubuntu", "self-hosted", "2", "ubuntu"]


def test_scanner_and_ai_detection(spark):
    body = (
        "jobs:\n  s:\n    steps:\n      - uses: github/CodeQL-action/analyze@v3\n"
        "      - uses: anthropics/claude-code-action@v1\n"
    )
    row = only_row(spark, body)
    assert row.has_security_scan and row.has_ai_review
    assert row.ai_review_actions == ["anthropics/claude-code-action"]
    # a known set replaces the name pattern, an empty one does not
    assert only_row(spark, body, ["other/reviewer"]).ai_review_actions == []
    assert only_row(spark, body, []).ai_review_actions == ["anthropics/claude-code-action"]
    assert only_row(spark, body, ["github/CodeQL-action/analyze"]).ai_review_actions == ["github/CodeQL-action/analyze"]


def test_many_jobs():
    text = "jobs:\n" + "".join(f"  job{i:02}:\n    runs-on: x\n" for i in range(20))
    assert parse_workflow(text)["job_names"] == [f"job{i:02}" for i in range(20)]


def test_minimal_file_gives_defaults(spark):
    row = only_row(spark, "name: Minimal\n")
    assert row.job_names == [] and not row.uses_matrix and row.permissions is None


def test_unusable_files_go_to_the_error_table(spark):
    parsed = extract.parse(
        files(spark, 'run: "open\n', "", "- a\n", "jobs: [a]\n", "jobs:\n  a:\n    steps: 5\n", "name: fine\n", None)
    )
    errors = {row.file_name: row.reason for row in extract.parse_errors(parsed).collect()}
    assert len(errors) == 6
    assert errors["1-flow.yml"] == errors["2-flow.yml"] == errors["6-flow.yml"] == "top-level is not a mapping"
    assert errors["3-flow.yml"] == "jobs is not a mapping"
    assert errors["4-flow.yml"].startswith("TypeError")
    assert extract.workflows_from(parsed, day()).count() == 1


def test_keys_that_are_not_text_are_kept_as_text():
    row = parse_workflow("on:\n  1: x\njobs:\n  2:\n    steps: []\n")
    assert row["triggers"] == ["1"] and row["job_names"] == ["2"]


def test_corpus_reads_whole_files_of_both_endings(spark, tmp_path):
    for path, body in (
        ("o1/r1/ci.yml", "name: a\non: push\njobs: {}\n"),
        ("o1/r1/two words.yaml", "name: b\n"),
        ("o2/r2/x.txt", "name: c\n"),
        ("o2/r2/bad.yml", "a: [\n"),
    ):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(body)
    raw = corpus.read_corpus(spark, str(tmp_path))
    assert {(row.repo, row.file_name) for row in raw.collect()} == {
        ("o1/r1", "ci.yml"), ("o1/r1", "two words.yaml"), ("o2/r2", "bad.yml"),
    }
    rows = {row.workflow_name: row for row in corpus.extract(spark, str(tmp_path)).collect()}
    assert set(rows) == {"ci", "two words"}
    assert rows["ci"].source_file == str(tmp_path / "o1/r1/ci.yml")
    assert rows["two words"].workflow_path == ".github/workflows/two words.yaml"


def test_extractors_can_be_registered(spark, tmp_path):
    target = tmp_path / "o" / "r" / "notes.md"
    target.parent.mkdir(parents=True)
    target.write_text("# hi")
    extract.register(extract.Extractor("notes", "*.md", lambda raw: raw.select("repo", F.length("content").alias("n"))))
    assert [tuple(row) for row in corpus.extract(spark, str(tmp_path), "notes").collect()] == [("o/r", 4)]


def test_raw_text_scan(spark):
    body = (
        "permissions: {}\njobs:\n  a:\n    strategy:\n      fail-fast: false\n      matrix:\n        x: [1]\n"
        "    steps:\n      - uses: aquasecurity/Trivy-action@v1 # note\n      - uses: a/b@v2\n      - run: ai_review\n"
    )
    row = extract.raw_text_scan(files(spark, body, " permissions: {}\n")).orderBy("file_name").collect()
    assert (row[0].has_matrix, row[0].has_permissions, row[0].has_ai_review) == (True, True, True)
    assert row[0].security_tools == ["aquasecurity/Trivy-action"]
    assert (row[1].has_matrix, row[1].has_permissions, row[1].security_tools) == (False, False, [])


def test_action_descriptions_take_the_first_candidate_with_text(spark):
    rows = [
        ("a/one", 0, "description: first\n"), ("a/one", 1, "description: second\n"),
        ("a/two", 0, "name: x\n"), ("a/two", 1, "description: fallback\n"),
        ("a/three", 0, "description: [broken\n"), ("./local", 0, "description: no\n"), ("plain", 0, "description: no\n"),
    ]
    found = extract.action_descriptions(spark.createDataFrame(rows, "action string, candidate int, content string"))
    assert {tuple(row) for row in found.collect()} == {("a/one", "first"), ("a/two", "fallback"), ("a/three", "")}


def test_pieces_of_yaml_read_as_the_whole_text(monkeypatch):
    flow = (
        "name: ci-{0}\non: [push]\njobs:\n  a:\n    runs-on: x\n    # note\n    steps:\n      - name: s\n        run: |\n          b\n\n"
        "      - uses: c/d@v1\n  on:\n    uses: ./e.yml\n  yes: no\n"
    )
    odd = [
        flow.replace("    runs-on: x", "   runs-on: x"), flow.replace("run: |", 'run: "'), flow.replace("c/d@v1", "&c d") + "z: *c\n",
        flow.replace("jobs:\n", "jobs:\n  a: {b: 1}\n"), flow.replace("\n", "\r\n"), flow + "...\n---\nx: 1\n", flow + "? q\n: r\n",
        "a:\n  # c\n", "a:\n b: 'x\n c: y'\n", "a:\n- b\nc:\n  - d\n", "a: b\n  c: d\n", "", "- a\n- b: 1\n", "a: on\nb: 1.5\n",
    ]

    def outcome(load, text):
        try:
            return repr(load(text))
        except Exception as problem:
            return f"{type(problem).__name__}: {problem}"

    whole = parsers._load_yaml
    pieces = parsers.YamlPieces()
    for text in [flow.format(0), *odd, *odd]:
        assert outcome(pieces.load, text) == outcome(whole, text), text
    calls = []
    monkeypatch.setattr(parsers, "_load_yaml", lambda text: calls.append(text) or whole(text))
    for i in range(1, 50):
        assert pieces.load(flow.format(i)) == whole(flow.format(i))
    assert not calls


def test_files_are_not_parsed_in_a_few_coalesced_partitions(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with larger tables
    try:
        content = tables.raw_files(spark, sf_dir)
        assert content.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
