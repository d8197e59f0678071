import base64
import json

import pytest
from pyspark.sql import functions as F

from forgelens import rules, schemas
from forgelens.operators import signals


@pytest.fixture(scope="module")
def read(spark):
    def one(kind, path, body):
        known = spark.createDataFrame([("r", path, body, kind)], "repo string, path string, content string, kind string")
        return signals.read_configs(known).first()

    return one


def test_json_with_comments(read):
    row = read(
        "tsconfig", "tsconfig.json",
        '{\n// c\n"extends": "./b", /* x\n y */ "compilerOptions": {"strict": true, "paths": {"a": ["b"]}, "jsx": "react",},\n}',
    )
    assert (row["kind"], row["extends"], row["strict"], row["jsx"], row["paths_configured"]) == ("tsconfig", "./b", True, "react", True)
    # comment marks inside strings are cut as well, which breaks the file
    assert read("tsconfig", "t", '{"extends": "http://x"}')["kind"] == "parse_error"
    assert read("tsconfig", "t", '{"compilerOptions": {"strict": "true", "paths": {}}}')["strict"] is None


def test_python_and_rust_projects(read):
    row = read(
        "pyproject", "pyproject.toml",
        '[project]\nname = "p"\nrequires-python = ">=3.12"\n[build-system]\nbuild-backend = "b"\n[tool.ruff]\nx = 1\n[tool.uv]\n',
    )
    assert (row["project_name"], row["requires_python"], row["build_backend"]) == ("p", ">=3.12", "b")
    assert (row["uses_ruff"], row["uses_pytest"], row["uses_uv"]) == (True, False, True)
    row = read("cargo", "Cargo.toml", '[workspace]\nmembers = ["a", "b"]\n[package]\nname = "c"\nedition = "2021"\n')
    assert (row["workspace"], row["package_name"], row["edition"], row["workspace_members"]) == (True, "c", "2021", 2)
    assert read("cargo", "Cargo.toml", "x = [")["kind"] == "parse_error"


def test_monorepo_files(read):
    row = read("pnpm_workspace", "pnpm-workspace.yaml", "packages:\n  - a/*\n  - b\n")
    assert (row["package_patterns"], row["package_pattern_count"]) == (["a/*", "b"], 2)
    assert read("pnpm_workspace", "pnpm-workspace.yaml", "")["package_pattern_count"] == 0
    row = read("turbo", "turbo.json", '{"tasks": {}, "pipeline": {"a": {}, "b": {}}, "remoteCache": {"x": 1}}')
    assert (row["task_count"], row["uses_remote_cache"]) == (2, True)
    row = read("nx", "nx.json", '{"plugins": ["p"], "namedInputs": {"z": 1, "a": 2}}')
    assert (row["plugins"], row["plugin_count"], row["named_inputs"]) == (["p"], 1, ["a", "z"])


@pytest.mark.parametrize(
    "path, body, keys, count",
    [
        (".eslintrc.json", '{"rules": {"a": 1}, "env": {}}', ["env", "rules"], 1),
        ("biome.json", '{"linter": {"rules": {"style": {"a": 1, "b": 2}, "recommended": true}}}', ["linter"], 2),
        ("ruff.toml", "line-length = 1\n[lint]\nselect = []\n", ["line-length", "lint"], 0),
        # an eslint name is read as JSON even when it ends in yaml
        (".eslintrc.yaml", "rules:\n  a: 1\n", [], 0),
        ("other.yaml", "rules: {a: 1, b: 2}\n", ["rules"], 2),
        ("eslint.config.js", "export default []", [], 0),
        ("biome.jsonc", "[1]", [], 0),
    ],
)
def test_linter_files(read, path, body, keys, count):
    row = read("linter", path, body)
    assert (row["kind"], row["top_level_keys"], row["rule_count"]) == ("linter", keys, count)


def listing(spark, *rows):
    full = [(repo, path, kind, content, entries) for repo, path, kind, content, entries in rows]
    return spark.createDataFrame(full, schemas.REPO_FILE)


def test_config_job_and_trends(spark):
    files = listing(
        spark,
        ("a/x", "tsconfig.json", "file", '{"compilerOptions": {"strict": true}}', None),
        ("a/x", "Cargo.toml", "file", "[workspace]\n", None),
        ("b/y", "pyproject.toml", "file", '[build-system]\nbuild-backend = "hatchling"\n', None),
        ("b/y", "turbo.json", "file", "{oops", None),
        ("b/y", "nx.json", "dir", None, ["a"]),
        ("b/y", "src/tsconfig.json", "file", "{}", None),
    )
    configs = signals.config_files(files)
    assert {(row.repo, row.path, row.kind) for row in configs.collect()} == {
        ("a/x", "tsconfig.json", "tsconfig"), ("a/x", "Cargo.toml", "cargo"), ("b/y", "pyproject.toml", "pyproject"),
        ("b/y", "turbo.json", "parse_error"),
    }
    repos = spark.createDataFrame([("a/x",), ("b/y",), ("c/z",)], "repo string")
    assert {tuple(row) for row in signals.config_trends(configs, repos).collect()} == {
        ("tsconfig", 1, 33.33), ("cargo", 1, 33.33), ("pyproject", 1, 33.33),
    }
    assert tuple(signals.config_counters(configs).first()) == (1, 1, 1)
    assert [tuple(row) for row in signals.build_backends(configs).collect()] == [("hatchling", 1)]


def test_kinds_by_ending(spark):
    paths = ["Packages/CARGO.TOML", "tsconfig.json", "my-tsconfig.json", "pnpm-workspace.yaml", ".ruff.toml", "jnx.json"]
    df = spark.createDataFrame([(path,) for path in paths], "path string").select(signals.config_kind(F.col("path")))
    assert [row[0] for row in df.collect()] == ["cargo", "tsconfig", "tsconfig", "pnpm_workspace", "linter", "nx"]


def test_first_candidate_path_wins_and_zero_signals_stay(spark):
    files = listing(
        spark,
        ("a/x", "docs/CODEOWNERS", "file", "", None),
        ("a/x", ".github/CODEOWNERS", "file", "", None),
        ("b/y", "SECURITY.md", "file", "", None),
    )
    assert {tuple(row) for row in signals.file_signals(files).collect()} == {
        ("a/x", "codeowners", ".github/CODEOWNERS"), ("b/y", "security_policy", "SECURITY.md"),
    }
    repos = spark.createDataFrame([("a/x",), ("b/y",), ("c/z",)], "repo string")
    adoption = {row.signal: (row.repo_count, row.adoption_pct) for row in signals.file_signal_adoption(files, repos).collect()}
    assert adoption["codeowners"] == (1, 33.33) and adoption["pre_commit"] == (0, 0.0) and len(adoption) == 7


def test_structure_hits(spark):
    files = listing(
        spark,
        ("a/x", "adr", "dir", None, [f"{i}.md" for i in range(7)]),
        ("a/x", "rfcs", "file", "x", None),
        ("a/x", "flake.nix", "file", "abc", None),
        ("a/x", "cliff.toml", "file", "", None),
        ("b/y", ".goreleaser.yml", "file", "12", None),
    )
    hits = {row.path: row for row in signals.structure_signals(files).collect()}
    assert set(hits) == {"adr", "flake.nix", "cliff.toml", ".goreleaser.yml"}
    assert (hits["adr"].entry_count, hits["adr"].sample_entries) == (7, ["0.md", "1.md", "2.md", "3.md", "4.md"])
    assert (hits["flake.nix"].tool, hits["flake.nix"].size) == ("nix", 3)
    assert (hits["cliff.toml"].tool, hits["cliff.toml"].size) == ("git-cliff", None)
    assert hits[".goreleaser.yml"].tool == "goreleaser"
    repos = spark.createDataFrame([("a/x",), ("b/y",)], "repo string")
    adoption = {row.signal: row.repo_count for row in signals.structure_adoption(files, repos).collect()}
    assert adoption == {"release_strategy": 2, "dev_environment": 1, "decision_records": 1}


def test_base64_bodies(spark):
    body = base64.encodebytes("é\n".encode() * 60).decode()
    rows = [(1, body, "base64"), (2, "x", "utf-8"), (3, None, "base64"), (4, "x", None)]
    got = signals.decode_contents(spark.createDataFrame(rows, "i int, content string, encoding string")).orderBy("i").collect()
    assert got[0].content == "é\n" * 60 and got[0].error is None
    assert [row.error for row in got[1:]] == ["unsupported encoding: utf-8", "missing content", "unsupported encoding: none"]


def test_changed_files(spark):
    schema = "repo string, path string, sha string"
    state = spark.createDataFrame([("r", "a", "1"), ("r", "b", "1"), ("r", "gone", "9")], schema)
    listed = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3")], schema)
    changes = signals.file_changes(listed, state)
    assert {row.path: row.outcome for row in changes.collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    assert {tuple(row)[1:] for row in signals.updated_state(listed, state).collect()} == {
        ("a", "1"), ("b", "2"), ("c", "3"), ("gone", "9"),
    }


def test_rule_tables_are_consistent():
    assert len(rules.PATTERNS) == 22 and len({slug for slug, *_ in rules.PATTERNS}) == 22
    assert len(rules.CONFIG_PATHS) == 15 and len(rules.STRUCTURE_SIGNALS) == 21
    assert len(rules.ACTION_CATEGORIES) == 36
    assert json.dumps(rules.PRACTICES)
