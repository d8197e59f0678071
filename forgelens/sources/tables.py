"""Workflow-shaped inputs derived from star-schema tables.

An order is a workflow file, its customer a repository, its lines the steps, in the order of their codes and with
repeats.  A line becomes a small integer code (job, action, command).  Lines are counted by (order, code) first, which
combines map-side; the list that is collected for an order then holds (code, number) pairs, bounded by the vocabulary.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelens import rules
from forgelens.functions import text
from forgelens.operators.extract import derive

# --- fixed vocabularies of the derived inputs ---------------------------------
KINDS = ("ci", "test", "lint", "tutorial", "release", "nightly-release", "codeql", "build")
ACTIONS = (
    "actions/checkout@v4", "actions/setup-python@v5", "actions/setup-node@v4", "actions/cache@v4",
    "actions/upload-artifact@v4", "docker/login-action@v3", "codecov/codecov-action@v4",
    "aquasecurity/trivy-action@master", "github/codeql-action/analyze@v3", "gitleaks/gitleaks-action@v2",
    "ossf/scorecard-action@v2", "sigstore/cosign-installer@v3", "anchore/sbom-action@v0",
    "step-security/harden-runner@v2", "actions/create-github-app-token@v1", "anthropics/claude-code-action@v1",
    "coderabbitai/ai-pr-reviewer@v1", "nick-fields/retry@v3", "pkg-pr-new/publish@v1", "Swatinem/rust-cache@v2",
    "astral-sh/setup-uv@v5", "./.github/actions/local", "org3/internal-action@v1",
    "peter-evans/create-pull-request@v6", "aws-actions/configure-aws-credentials@v4",
    "softprops/action-gh-release@v2", "actions/dependency-review-action@v4", "securego/gosec@v2",
    "actions/github-script@v7", "actions/cache/restore@v4", "docker/build-push-action@v6",
    "org7/shared-action@abc123",
)
COMMON_ACTION_COUNT = 7
COMMANDS = (
    "pytest", "npm test", "go vet", "echo done", "make all", "cargo test", "bazel build //...", "pnpm install",
    "syft dir:. -o SBOM", "cosign sign img", "echo GH_TOKEN", "npm publish --tag beta",
    "python -m pytest --benchmark", "run fuzz target", "toxiproxy start", "rerun flaky",
    "gh workflow run promote.yml", "check-ai-coauthors", "security audit", "nix build", "poetry install",
    "publish pr package", "downstream check", "cookbook run",
)
COMMON_COMMAND_COUNT = 4
MATRIX_VALUES = ("3.11", "3.12", "3.13", "3.14", "ubuntu-latest", "arm64", "cuda-12", "20")
TRIGGERS = ("push", "pull_request", "workflow_dispatch")
RUNNERS = ("ubuntu-latest", "macos-latest")
MONTHS = 6
JOBS_PER_FILE = 8
SHARED_WORKFLOW = "./.github/workflows/shared.yml"
PERMISSIONS_JSON = '{"contents": "read"}'
OWNERS = 20
LINKED_REPOS = 150

TOPIC_LISTS = (
    ("awesome", "list"), ("machine-learning", "nlp"), ("docker", "devops"), ("database",), ("security", "hacking"),
    ("react", "frontend"), ("api",), ("android",), ("cli",), ("tutorial",), (), ("books", "python", "web", "data", "etl"),
)
DESCRIPTIONS = (
    "A curated list of things", "Deep learning toolkit", "A collection of resources for builders", "Plain library",
    "Coding interview cookbook", "Algorithm notes", "", "Language model runtime  with   odd spacing", "List of tools",
)
LICENSES = ("MIT", "Apache-2.0", "BSD-3-Clause")

FILE_PATHS = tuple(
    dict.fromkeys(
        [path for _, path in rules.FILE_SIGNALS]
        + list(rules.CONFIG_PATHS)
        + [path for _, path, _ in rules.STRUCTURE_SIGNALS]
        + ["README.md", "src", "Makefile"]
    )
)
DIRECTORY_PATHS = tuple(
    [path for _, path, kind in rules.STRUCTURE_SIGNALS if kind == "dir"]
    + [".github/ISSUE_TEMPLATE", ".github/PULL_REQUEST_TEMPLATE", "src"]
)
DIRECTORY_ENTRIES = ("0001-first.md", "0002-second.md", "0003-third.md", "a.md", "b.md", "c.md", "d.md")
# path, four file bodies chosen by a row number
CONFIG_BODIES = (
    (
        "tsconfig.json",
        (
            '{\n  // strict build\n  "compilerOptions": {"strict": true, "module": "esnext", "target": "es2022",},\n}',
            '{"extends": "./base", "compilerOptions": {"strict": false, "moduleResolution": "bundler",'
            ' "paths": {"a": ["b"]}}}',
            '{"compilerOptions": {"jsx": "react-jsx"}} /* tail */',
            '{"compilerOptions": {"baseUrl": "http://x"}}',
        ),
    ),
    (
        "pyproject.toml",
        (
            '[project]\nname = "a"\nrequires-python = ">=3.11"\n[build-system]\nbuild-backend = "hatchling.build"\n'
            "[tool.ruff]\nline-length = 100\n",
            '[project]\nname = "b"\n[build-system]\nbuild-backend = "setuptools.build_meta"\n'
            "[tool.pytest.ini_options]\nx = 1\n[tool.uv]\ndev = true\n",
            "[tool.other]\nx = 1\n",
            "not = [valid",
        ),
    ),
    (
        "Cargo.toml",
        (
            '[workspace]\nmembers = ["a", "b", "c"]\n',
            '[package]\nname = "crate"\nedition = "2021"\n',
            '[workspace]\nresolver = "2"\n[package]\nname = "root"\nedition = "2024"\n',
            "[package\n",
        ),
    ),
    (
        "turbo.json",
        (
            '{"tasks": {"build": {}, "test": {}}}',
            '{"pipeline": {"build": {}}, "remoteCache": {"enabled": true}}',
            "{}",
            "{oops",
        ),
    ),
    (
        "nx.json",
        (
            '{"plugins": ["@nx/js", "@nx/react"], "namedInputs": {"prod": [], "default": []}}',
            '{"plugins": []}',
            '{"namedInputs": {"z": [], "a": []}, }',
            "nope",
        ),
    ),
    (
        "pnpm-workspace.yaml",
        ("packages:\n  - 'a/*'\n  - 'b/*'\n", "packages: []\n", "", "packages: [a\n"),
    ),
)
LINTER_BODIES = (
    '{"rules": {"a": 1, "b": 2}, "extends": ["x"]}',
    '{"linter": {"rules": {"style": {"x": 1, "y": 2}, "perf": {"z": 1}, "recommended": true}}}',
    "line-length = 100\n",
    "{broken",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(words, index: Column) -> Column:
    """Element of a constant list by zero-based position."""
    return F.element_at(text.strings(words), index.cast("int") + 1)


def _bits(code: Column, shift: int) -> Column:
    return F.shiftright(code, shift).bitwiseAND(F.lit(31))


def repo_name(customer_key: Column) -> Column:
    return F.concat(
        F.lit("org"), (customer_key % OWNERS).cast("string"), F.lit("/cust"), customer_key.cast("string")
    )


def _step_code() -> Column:
    rare_actions = len(ACTIONS) - COMMON_ACTION_COUNT
    rare_commands = len(COMMANDS) - COMMON_COMMAND_COUNT
    action = F.when(F.col("l_partkey") % 5 < 4, F.col("l_partkey") % COMMON_ACTION_COUNT).otherwise(
        COMMON_ACTION_COUNT + (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % rare_actions
    )
    command = F.when(F.col("l_quantity") < 46, F.col("l_partkey") % COMMON_COMMAND_COUNT).otherwise(
        COMMON_COMMAND_COUNT + (F.col("l_suppkey") + F.col("l_linenumber")) % rare_commands
    )
    job = F.col("l_linenumber") % JOBS_PER_FILE
    return (job * 1024 + action * 32 + command).cast("int")


def _bit_of(words: tuple[str, ...], index: Column) -> Column:
    """Bit of a word: its place among the sorted words, so that set bits come out in sorted order."""
    ranked = sorted(words)
    return F.element_at(F.expr(f"array({', '.join(str(1 << ranked.index(word)) for word in words)})"), index + 1)


def _words_of(bits: str, words: tuple[str, ...]) -> Column:
    """Sorted words whose bits are set."""
    cases = [f"CASE WHEN {bits} & {1 << i} > 0 THEN {text.quoted(word)} END" for i, word in enumerate(sorted(words))]
    return F.expr(f"array_compact(array({', '.join(cases)}))")


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order that has lines: step codes in order, repeats kept, and the small value sets of its lines.

    Value sets are bit masks while they are aggregated and shuffled: fixed-size buffers, hash aggregation.
    """
    lines = table(spark, sf_dir, "lineitem")
    value = ((F.col("l_linenumber") + F.col("l_partkey")) % len(MATRIX_VALUES)).cast("int")
    trigger = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    runner = F.when(F.col("l_linestatus") == "O", 0).otherwise(1)
    coded = lines.groupBy(F.col("l_orderkey").alias("o_orderkey"), _step_code().alias("_code")).agg(
        F.count("*").cast("int").alias("_n"),
        F.bit_or(_bit_of(TRIGGERS, trigger)).alias("_triggers"),
        F.bit_or(_bit_of(RUNNERS, runner)).alias("_runners"),
        F.bit_or(F.when(F.col("l_quantity") >= 36, _bit_of(MATRIX_VALUES, value)).otherwise(0)).alias("_values"),
        F.bool_or(F.col("l_tax") >= 0.08).alias("_reuses"),
    )
    steps = coded.groupBy("o_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("_code", "_n"))).alias("_steps"),
        F.bit_or("_triggers").alias("_triggers"),
        F.bit_or("_runners").alias("_runners"),
        F.bit_or("_values").alias("_values"),
        F.bool_or("_reuses").alias("uses_reusable_workflows"),
    )
    steps = steps.withColumn(
        "steps", F.flatten(F.transform("_steps", lambda step: F.array_repeat(step["_code"], step["_n"])))
    )
    # a stated number of partitions is not coalesced: a few shuffled bytes become much text, and the partitions that the
    # planner would leave, one or two more than there are cores, take twice as long as one a core
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = table(spark, sf_dir, "orders").repartition(partitions, "o_orderkey")
    files = orders.join(steps, "o_orderkey", "inner")
    return files.withColumns(
        {
            "triggers": _words_of("_triggers", TRIGGERS),
            "runs_on": _words_of("_runners", RUNNERS),
            "matrix_values": _words_of("_values", MATRIX_VALUES),
            "uses_matrix": F.col("_values") > 0,
        }
    )


def _file_columns() -> dict[str, Column]:
    key = F.col("o_orderkey")
    return {
        "repo": repo_name(F.col("o_custkey")),
        "workflow_name": F.concat(_pick(KINDS, key % len(KINDS)), F.lit("-"), key.cast("string")),
        "crawl_date": F.col("o_orderdate").cast("date"),
    }


def workflows(spark: SparkSession, sf_dir: str, keep: Column | None = None) -> DataFrame:
    """Workflow table derived from orders and lines; ``keep`` is an optional filter over orders (a snapshot)."""
    files = order_files(spark, sf_dir)
    if keep is not None:
        files = files.where(keep)
    named = _file_columns()
    job = F.transform("steps", lambda code: F.shiftright(code, 10).cast("string"))
    shared = F.col("uses_reusable_workflows")
    base = files.select(
        *[column.alias(name) for name, column in named.items()],
        "triggers",
        F.concat(
            F.array_distinct(F.transform(job, lambda number: F.concat(F.lit("job"), number))),
            F.when(shared, F.array(F.lit("shared"))).otherwise(text.strings(())),
        ).alias("job_names"),
        "uses_matrix",
        F.when(F.col("uses_matrix"), F.array(F.lit("version"))).otherwise(text.strings(())).alias("matrix_keys"),
        "matrix_values",
        F.when(shared, F.array(F.lit(SHARED_WORKFLOW))).otherwise(text.strings(())).alias("reusable_workflows"),
        F.transform("steps", lambda code: _pick(ACTIONS, _bits(code, 5))).alias("actions_used"),
        (F.col("o_orderstatus") == "F").alias("has_permissions_block"),
        F.when(F.col("o_orderstatus") == "F", PERMISSIONS_JSON).alias("permissions"),
        "runs_on",
        F.col("o_orderpriority").startswith("1").alias("concurrency_set"),
        F.transform(job, lambda number: F.concat(F.lit("step"), number)).alias("step_names"),
        F.transform("steps", lambda code: _pick(COMMANDS, _bits(code, 0))).alias("run_commands"),
    )
    located = base.withColumns(
        {
            "workflow_path": F.concat(F.lit(".github/workflows/"), "workflow_name", F.lit(".yml")),
            "source_file": F.concat(F.lit("data/raw/"), "repo", F.lit("/"), "workflow_name", F.lit(".yml")),
        }
    )
    return derive(located)


def snapshot_orders(which: str) -> Column:
    """Filter over orders for two overlapping snapshots of the corpus: urgent orders are files that only the
    current one has, low-priority orders files that are gone since the previous one."""
    absent = {"previous": "1-URGENT", "current": "5-LOW"}[which]
    return F.col("o_orderpriority") != absent


def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snapshot, repo, workflow_name) of the previous and the current snapshot; the lines only tell which orders are files."""
    filled = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    files = table(spark, sf_dir, "orders").join(filled, "o_orderkey", "left_semi")
    named = _file_columns()
    taken = F.array_compact(F.array(*[F.when(snapshot_orders(which), F.lit(which)) for which in ("previous", "current")]))
    return files.select(F.explode(taken).alias("snapshot"), named["repo"].alias("repo"), named["workflow_name"].alias("workflow_name"))


def snapshot_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snapshot, repo, workflow_name) of six monthly snapshots: a file is in those that the suppliers of its lines name."""
    lines = table(spark, sf_dir, "lineitem")
    bit = F.call_function("shiftleft", F.lit(1), (F.col("l_suppkey") % MONTHS).cast("int"))
    months = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bit_or(bit).alias("_months"))
    named = _file_columns()
    files = table(spark, sf_dir, "orders").join(months, "o_orderkey").select(
        named["repo"].alias("repo"), named["workflow_name"].alias("workflow_name"), "_months"
    )
    cases = [f"CASE WHEN _months & {1 << i} > 0 THEN DATE '2026-{i + 1:02d}-01' END" for i in range(MONTHS)]
    return files.select(F.explode(F.expr(f"array_compact(array({', '.join(cases)}))")).alias("snapshot"), "repo", "workflow_name")


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same workflows rendered as YAML text, a few of them broken on purpose (repo, file_name, source_file,
    content)."""
    files = order_files(spark, sf_dir)
    named = _file_columns()

    def quoted(word: Column) -> Column:
        return F.concat(F.lit('"'), word, F.lit('"'))

    def flow(array: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(array, quoted), ", "), F.lit("]"))

    def step(code: Column) -> Column:
        return F.concat(
            F.lit("      - name: step"),
            F.shiftright(code, 10).cast("string"),
            F.lit("\n        uses: "),
            _pick(ACTIONS, _bits(code, 5)),
            F.lit("\n        run: "),
            quoted(_pick(COMMANDS, _bits(code, 0))),
        )

    jobs = F.array_distinct(F.transform("steps", lambda code: F.shiftright(code, 10)))

    def job(number: Column) -> Column:
        own = F.filter("steps", lambda code: F.shiftright(code, 10) == number)
        first = number == F.element_at(jobs, 1)
        return F.concat(
            F.lit("  job"),
            number.cast("string"),
            F.lit(":\n"),
            F.when(first, F.concat(F.lit("    runs-on: "), flow(F.col("runs_on")), F.lit("\n"))).otherwise(""),
            F.when(
                first & F.col("uses_matrix"),
                F.concat(
                    F.lit("    strategy:\n      matrix:\n        version: "), flow(F.col("matrix_values")), F.lit("\n")
                ),
            ).otherwise(""),
            F.lit("    steps:\n"),
            F.array_join(F.transform(own, step), "\n"),
        )

    key = F.col("o_orderkey")
    body = F.concat(
        F.lit("name: "),
        named["workflow_name"],
        F.lit("\non: "),
        flow(F.col("triggers")),
        F.lit("\n"),
        F.when(F.col("o_orderstatus") == "F", "permissions:\n  contents: read\n").otherwise(""),
        F.when(F.col("o_orderpriority").startswith("1"), "concurrency: ci\n").otherwise(""),
        F.lit("jobs:\n"),
        F.array_join(F.transform(jobs, job), "\n"),
        F.when(F.col("uses_reusable_workflows"), f"\n  shared:\n    uses: {SHARED_WORKFLOW}\n").otherwise("\n"),
    )
    content = (
        F.when(key % 97 == 5, 'name: "never closed\non: push\n')
        .when(key % 97 == 6, "- just\n- a list\n")
        .when(key % 97 == 7, "")
        .otherwise(body)
    )
    name = F.concat(named["workflow_name"], F.lit(".yml"))
    return files.select(
        named["repo"].alias("repo"),
        name.alias("file_name"),
        F.concat(F.lit("data/raw/"), named["repo"], F.lit("/"), name).alias("source_file"),
        content.alias("content"),
    )


def repo_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository metadata derived from customers; one nation stands for "no language"."""
    customer = table(spark, sf_dir, "customer")
    # 25 rows whatever the scale of the other tables: the nation table is part of the fixed schema
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("_nation")
    )
    key = F.col("c_custkey")
    topics = F.element_at(
        F.array(*[text.strings(words) for words in TOPIC_LISTS]),
        (key % len(TOPIC_LISTS)).cast("int") + 1,
    )
    return customer.join(nation, "c_nationkey", "left").select(
        repo_name(key).alias("full_name"),
        _pick(DESCRIPTIONS, key % len(DESCRIPTIONS)).alias("description"),
        F.when(F.col("c_nationkey") != 3, F.col("_nation")).alias("language"),
        F.greatest(F.floor("c_acctbal"), F.lit(0)).cast("bigint").alias("stars"),
        (key % 50).alias("forks"),
        topics.alias("topics"),
        _pick(LICENSES, key % len(LICENSES)).alias("license"),
        F.lit("2026-01-01T00:00:00Z").alias("pushed_at"),
        (key % 17 == 0).alias("archived"),
        F.when(key % 101 == 7, "HTTP 404").alias("error"),
    )


def counted_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository metadata with the number of workflow files; both sides have one row per customer."""
    per_order = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    filled = table(spark, sf_dir, "orders").join(per_order, "o_orderkey", "left_semi")
    counts = filled.groupBy(repo_name(F.col("o_custkey")).alias("full_name")).agg(
        F.count("*").alias("workflow_count")
    )
    counted = repo_metadata(spark, sf_dir).join(counts, "full_name", "left")
    return counted.withColumn("workflow_count", F.coalesce("workflow_count", F.lit(0)))


def api_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository objects as an API returns them: other field names, nested license, absent values."""
    known = repo_metadata(spark, sf_dir)
    wide = F.repeat(F.concat("description", F.lit(" ")), 20)
    return known.select(
        "full_name",
        F.when(F.col("forks") % 7 != 0, wide).alias("description"),
        "language",
        F.col("stars").alias("stargazers_count"),
        F.col("forks").alias("forks_count"),
        F.lit(None).cast("bigint").alias("open_issues_count"),
        F.when(F.size("topics") > 0, F.col("topics")).alias("topics"),
        F.when(F.col("license") != "MIT", F.struct(F.col("license").alias("spdx_id"))).alias("license"),
        F.lit(None).cast("string").alias("created_at"),
        F.lit(None).cast("string").alias("updated_at"),
        "pushed_at",
        F.when(F.col("archived"), True).alias("archived"),
        F.lit(None).cast("string").alias("default_branch"),
    )


def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with Markdown repository links appended, many of them to the same repository."""
    documents = table(spark, sf_dir, "documents")
    name = repo_name(F.col("doc_id") % LINKED_REPOS)
    link = F.concat(F.lit("["), name, F.lit("](https://github.com/"), name, F.lit(")"))
    plain = F.lit("[docs/here](https://example.com/docs/here) ")
    shared = F.lit(" [Core/engine.js](https://github.com/Core/engine.js)")
    return documents.select("doc_id", F.concat("text", F.lit("\n| "), plain, link, shared, F.lit(" |")).alias("text"))


def _config_body(path: Column, pick: Column) -> Column:
    body = None
    for name, bodies in CONFIG_BODIES:
        chosen = _pick(bodies, pick)
        body = F.when(path == name, chosen) if body is None else body.when(path == name, chosen)
    return body.when(path.isin(list(rules.CONFIG_PATHS)), _pick(LINTER_BODIES, pick)).otherwise(
        F.concat(F.lit("body of "), path)
    )


def _path_variants(spark: SparkSession, sf_dir: str, keep: Column | None = None) -> DataFrame:
    """Which variant of which path each customer's repository has."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        ((F.col("l_partkey") + F.col("l_suppkey")) % len(FILE_PATHS)).alias("path_no"),
        (F.col("l_partkey") % 4).alias("variant"),
    )
    per_order = lines.groupBy("o_orderkey", "path_no").agg(F.min("variant").alias("variant"))
    orders = table(spark, sf_dir, "orders")
    if keep is not None:
        orders = orders.where(keep)
    owned = per_order.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    return owned.groupBy("o_custkey", "path_no").agg(F.min("variant").alias("variant"))


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File listing per repository, one row per (repo, path), derived from orders and lines."""
    path = _pick(FILE_PATHS, F.col("path_no"))
    is_dir = path.isin(list(DIRECTORY_PATHS))
    entry_count = (F.col("variant") * 2 + 1).cast("int")
    return _path_variants(spark, sf_dir).select(
        repo_name(F.col("o_custkey")).alias("repo"),
        path.alias("path"),
        F.when(is_dir, "dir").otherwise("file").alias("type"),
        F.when(~is_dir, _config_body(path, F.col("variant"))).alias("content"),
        F.when(is_dir, F.slice(text.strings(DIRECTORY_ENTRIES), 1, entry_count)).alias("entries"),
    )


def hashed_listing(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Listing of one snapshot with a content hash per file."""
    path = _pick(FILE_PATHS, F.col("path_no"))
    return _path_variants(spark, sf_dir, snapshot_orders(which)).select(
        repo_name(F.col("o_custkey")).alias("repo"),
        path.alias("path"),
        F.md5(F.concat(path, F.col("variant").cast("string"))).alias("sha"),
    )


def repo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of repositories of one owner: each customer with the next one of the same owner."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        repo_name(key).alias("left_repo"), repo_name(key + OWNERS).alias("right_repo")
    )


def action_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definition files of actions: one action per part, the first parts those of the workflows; one or two candidate files
    each."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    action = F.concat(F.col("p_type"), F.lit("/"), F.regexp_replace("p_name", " ", "-"), F.lit("-"), key.cast("string"))
    used = _pick(tuple(name.split("@")[0] for name in ACTIONS), key - 1)
    name = F.when(key % 11 == 0, F.concat(F.lit("./"), "p_type")).when(key <= len(ACTIONS), used).otherwise(action)
    phrase = (
        F.when(key % 5 == 0, "GPT powered pull request helper")
        .when(key % 5 == 1, "Automated code review")
        .when(key % 5 == 2, "Cache things")
        .when(key % 5 == 3, "")
        .otherwise("Review with care, no robots")
    )
    quoted = F.concat(F.lit('name: x\ndescription: "'), phrase, F.lit(' of '), "p_brand", F.lit('"\n'))
    first = F.when(key % 5 == 3, "name: x\n").when(key % 13 == 0, "description: [broken\n").otherwise(quoted)
    second = F.concat(F.lit("description: fallback for "), "p_brand", F.lit("\n"))
    candidates = F.array(
        F.struct(F.lit(0).alias("candidate"), first.alias("content")),
        F.struct(F.lit(1).alias("candidate"), F.when(key % 2 == 0, second).alias("content")),
    )
    return part.select(name.alias("action"), F.inline(candidates)).where(F.col("content").isNotNull())


def reuse_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of shared workflows: lines call the one of their supplier, those call others, some in cycles."""
    shared = lambda key, ref="@v1": F.concat(F.lit("shared/s"), key.cast("string"), F.lit(f"/.github/workflows/main.yml{ref}"))
    path = ".github/workflows/main.yml"
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(
        F.concat(F.lit("orders/o"), F.col("l_orderkey").cast("string")).alias("repo"),
        F.lit(path).alias("workflow_path"),
        F.array(shared(F.col("l_suppkey"))).alias("reusable_workflows"),
    )
    key = F.col("s_suppkey")
    others = F.array(
        F.when(key >= 3, shared(F.floor(key / 3), "@v2")),
        F.when(key % 4 == 0, F.lit("./.github/workflows/local.yml")),
        F.when(key % 5 == 0, shared(key + 1)),
        F.when(key % 7 == 1, shared(key * 3)),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("shared/s"), key.cast("string")).alias("repo"), F.lit(path).alias("workflow_path"),
        others.alias("reusable_workflows"),
    )
    return lines.unionByName(suppliers)


def file_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of files that change in place: an event of a user is a look at one of that user's files."""
    name = F.concat("event_type", F.lit(".yml"))
    repo = F.concat(F.lit("org/user"), (F.col("user_id") % 200).cast("string"))
    content = F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("v"), F.floor(F.coalesce("value", F.lit(0.0)) / 4).cast("string")))
    return table(spark, sf_dir, "events").select(
        repo.alias("repo"), name.alias("file_name"), F.concat(repo, F.lit("/"), name).alias("source_file"),
        content.alias("content"), F.col("ts").cast("timestamp").alias("seen_at"), (F.col("event_id") % 3).alias("part"),
    )
