"""SQL counterpart of each registered query that SQL can express."""

from forgelens import rules
from forgelens.functions.text import WHITESPACE
from forgelens.plans.oracle.base import REPO, WORKFLOW_SLUGS, col, has, pct, query, quote, words
from forgelens.sources import tables as t

_SPACE = WHITESPACE
_J = "array_to_string({0}, '|') AS {0}"


def _lists(*names: str) -> str:
    return ", ".join(_J.format(name) for name in names)


_WORKFLOW_COLUMNS = (
    "repo, workflow_name, workflow_path, source_file, uses_matrix, uses_reusable_workflows, has_permissions_block,"
    " permissions, concurrency_set, has_ai_review, has_security_scan, "
    + _lists(
        "triggers", "job_names", "matrix_keys", "matrix_values", "reusable_workflows", "actions_used",
        "actions_normalized", "runs_on", "ai_review_actions", "step_names", "run_commands",
    )
)


def _usage(column: str, name: str, extra: str = "") -> str:
    return f"""
        SELECT {name}, count(*) AS usage_count, count(DISTINCT repo) AS repo_count{extra}
        FROM (SELECT repo, unnest({column}) AS {name} FROM wf) WHERE {name} <> '' GROUP BY {name}"""


_EXACT = " ".join(f"WHEN action = '{name}' THEN '{category}'" for category, name in rules.ACTION_CATEGORIES)
_PREFIX = " ".join(
    f"WHEN starts_with(action, '{name}') THEN '{category}'" for category, name in rules.ACTION_CATEGORIES
)
CATEGORY = f"CASE {_EXACT} {_PREFIX} ELSE 'Other' END"
ACTION_URL = (
    "CASE WHEN contains(action, '/') THEN concat('https://github.com/', split_part(action, '/', 1), '/',"
    " split_part(action, '/', 2)) ELSE '' END"
)
_POPULAR = """
    SELECT action, count(*) AS usage_count FROM counts WHERE action <> '' GROUP BY action
    ORDER BY usage_count DESC, action LIMIT {0}"""
_FINGERPRINTS = """
    SELECT md5(actions) AS fingerprint, actions, count(*) AS usage_count
    FROM (SELECT array_to_string(list_sort(actions_normalized), ',') AS actions FROM wf
          WHERE len(actions_normalized) > 0)
    GROUP BY actions ORDER BY usage_count DESC, fingerprint LIMIT 10"""


def _metrics(group: str, source: str) -> str:
    return f"""
        SELECT grp, count(*) AS total_repos, sum(workflows)::BIGINT AS total_workflows,
               count(*) FILTER (WHERE m) AS matrix_repos, count(*) FILTER (WHERE ai) AS ai_repos,
               count(*) FILTER (WHERE scan) AS scan_repos,
               {pct('count(*) FILTER (WHERE m)', 'count(*)')} AS matrix_pct,
               {pct('sum(permitted)', 'sum(workflows)')} AS permissions_pct
        FROM (SELECT {group} AS grp, repo, count(*) AS workflows,
                     count(*) FILTER (WHERE has_permissions_block) AS permitted, bool_or(uses_matrix) AS m,
                     bool_or(has_ai_review) AS ai, bool_or(has_security_scan) AS scan
              FROM {source} GROUP BY ALL)
        GROUP BY grp"""


def _top_actions(group: str, limit: int) -> str:
    return f"""
        SELECT * FROM (
            SELECT grp, action, usage_count,
                   row_number() OVER (PARTITION BY grp ORDER BY usage_count DESC, action) AS position
            FROM (SELECT {group} AS grp, action, count(*) AS usage_count FROM counts GROUP BY ALL))
        WHERE position <= {limit}"""


_OWNER = "split_part(repo, '/', 1)"
_UNOFFICIAL = "NOT starts_with(action, 'actions/') AND NOT starts_with(action, 'docker/')"


def _insights(group: str) -> str:
    rules_sql = [
        ("matrix_high", "matrix_pct", "matrix_pct >= 70"),
        ("matrix_moderate", "matrix_pct", "matrix_pct >= 40 AND matrix_pct < 70"),
        ("permissions_low", "permissions_pct", "permissions_pct < 50"),
        ("permissions_good", "permissions_pct", "permissions_pct >= 50"),
        ("ai_review", pct("ai_repos", "total_repos", 1), "ai_repos > 0"),
        ("surprising_actions", "s::DOUBLE", "s > 0"),
        ("security_scan", pct("scan_repos", "total_repos", 1), "scan_repos > 0"),
    ]
    return (
        f"SELECT * FROM (WITH m AS ({_metrics(group, 'wf')}), s AS (SELECT grp, count(*) AS s FROM"
        f" ({_top_actions(group, 10)}) WHERE {_UNOFFICIAL} GROUP BY grp), ms AS (SELECT * FROM m LEFT JOIN s USING (grp)) "
        + " UNION ALL ".join(
            f"SELECT grp, '{key}' AS rule_key, {value} AS value FROM ms WHERE {condition}"
            for key, value, condition in rules_sql
        )
        + ")"
    )


_RECOMMENDATIONS = (
    f"SELECT * FROM (WITH m AS ({_metrics(_OWNER, 'wf')}), c AS (SELECT grp, sum(usage_count) AS c FROM"
    f" ({_top_actions(_OWNER, 50)}) WHERE contains(lower(action), 'cache') GROUP BY grp),"
    " mc AS (SELECT * FROM m LEFT JOIN c USING (grp)) "
    + " UNION ALL ".join(
        f"SELECT grp, '{priority}' AS priority, '{key}' AS rule_key, {value}::DOUBLE AS value FROM mc WHERE {condition}"
        for priority, key, value, condition in (
            ("high", "add_matrix", "matrix_pct", "matrix_pct >= 50"),
            ("high", "set_permissions", "permissions_pct", "permissions_pct >= 30"),
            ("medium", "use_cache", "c", "c IS NOT NULL"),
            ("medium", "try_ai_review", "ai_repos", "ai_repos > 0"),
        )
    )
    + ")"
)

_PRACTICES = [(flag, en, zh) for flag, en, zh in rules.PRACTICES]


def _missing(label: int) -> str:
    cases = ", ".join(f"CASE WHEN NOT {p[0]} THEN {quote(p[label])} END" for p in _PRACTICES)
    return f"list_filter([{cases}], lambda v: v IS NOT NULL)"


def _long(source: str, rows, select: str) -> str:
    return " UNION ALL ".join(select.format(*row) + f" FROM {source}" for row in rows)


_ADVICE_CONDITIONS = ("permitted < workflow_count", "scanners = 0", "supply_tools = 0", "NOT app_token", "NOT hardened")
_ADVICE = (
    "list_filter(["
    + ", ".join(
        f"CASE WHEN {condition} THEN {quote(line)} END"
        for condition, line in zip(_ADVICE_CONDITIONS, rules.SECURITY_ADVICE)
    )
    + "], lambda v: v IS NOT NULL)"
)


def _positions(source: str, list_sql: str, name: str) -> str:
    return f"""
        SELECT repo, i - 1 AS position, items[i] AS {name}
        FROM (SELECT repo, items, unnest(range(1, len(items) + 1)) AS i
              FROM (SELECT repo, {list_sql} AS items FROM {source}))"""


_EXAMPLES = """
    SELECT slug, position, repo, workflow_name, workflow_path, source_file, '' AS detail FROM (
        SELECT *, row_number() OVER (PARTITION BY slug ORDER BY maturity_score DESC, repo, workflow_name, workflow_path)
                  AS position
        FROM ({0}) JOIN (SELECT repo, maturity_score FROM facts) USING (repo))
    WHERE position <= 5
    UNION ALL
    SELECT slug, position, repo, '', '', '', detail FROM (
        SELECT slug, repo, row_number() OVER (PARTITION BY slug ORDER BY pr.maturity_score DESC, repo) AS position,
               CASE slug WHEN 'multi-stage-release' THEN names
                         WHEN 'multiple-build-systems' THEN array_to_string(build_systems, ',')
                         ELSE samples::VARCHAR END AS detail
        FROM pr JOIN facts USING (repo)
        LEFT JOIN (SELECT repo, array_to_string(list(workflow_name ORDER BY workflow_name, workflow_path)[1:5], ',')
                          AS names
                   FROM flags WHERE is_release GROUP BY repo) USING (repo)
        WHERE slug IN ('multi-stage-release', 'multiple-build-systems', 'per-sample-ci'))
    WHERE position <= 5""".format(
    " UNION ALL ".join(
        f"SELECT '{slug}' AS slug, repo, workflow_name, workflow_path, source_file FROM flags WHERE {col(slug)}"
        for slug in WORKFLOW_SLUGS
    )
)

_REPO_PATTERN_DETAIL = {
    "multi-stage-release": "concat(releases, '/', dispatches)",
    "multiple-build-systems": "array_to_string(build_systems, ',')",
    "per-sample-ci": "concat(workflow_count, '/', samples)",
}


def _pattern(slug: str) -> str:
    if slug in WORKFLOW_SLUGS:
        return f"SELECT repo, workflow_name FROM flags WHERE {col(slug)}"
    return f"SELECT repo, {_REPO_PATTERN_DETAIL[slug]} AS detail FROM facts WHERE {col(slug)}"


_SLUGS = ", ".join(f"CASE WHEN {col(slug)} THEN '{slug}' END" for slug in sorted(s for s, *_ in rules.PATTERNS))
_SLUG_LIST = f"list_filter([{_SLUGS}], lambda v: v IS NOT NULL)"
_CATEGORIES = {}
for _slug, _, _category, _ in rules.PATTERNS:
    _CATEGORIES.setdefault(_category, []).append(col(_slug))

_RECRAWLED = "(SELECT * FROM wf UNION ALL SELECT * FROM wf WHERE o_orderstatus = 'P')"
_COPIES = f"SELECT repo, workflow_name, workflow_path, count(*) AS copies FROM {_RECRAWLED} GROUP BY ALL"


def _quality(missing: str) -> str:
    prefix = f"missing_columns: {missing}; " if missing else ""
    return f"""
        SELECT sum(copies)::BIGINT AS row_count, count(DISTINCT repo) AS repo_count,
               sum(copies - 1)::BIGINT AS duplicate_count, '{missing}' AS missing_columns,
               {"'fail'" if missing else "CASE WHEN sum(copies - 1) > 0 THEN 'warn' ELSE 'pass' END"} AS status,
               concat('{prefix}', 'duplicate_rows: ', sum(copies - 1)::BIGINT) AS issues
        FROM ({_COPIES})"""


_ALL_COLUMNS = (
    "actions_normalized", "actions_used", "ai_review_actions", "concurrency_set", "crawl_date", "has_ai_review",
    "has_permissions_block", "has_security_scan", "job_names", "matrix_keys", "matrix_values", "permissions", "repo",
    "reusable_workflows", "run_commands", "runs_on", "source_file", "step_names", "triggers", "uses_matrix",
    "uses_reusable_workflows", "workflow_name", "workflow_path",
)
_METRIC_COLUMNS = (
    ("matrix_usage_percentage", "matrix_pct"), ("permissions_usage_percentage", "permissions_pct"),
    ("ai_review_count", "ai_repos"), ("total_repos", "total_repos"), ("total_workflows", "total_workflows"),
)


def _two_diffs(previous: str, current: str) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{name}' AS metric, p.{c}::DOUBLE AS prev_value, q.{c}::DOUBLE AS curr_value"
        f" FROM ({_metrics('1', previous)}) p, ({_metrics('1', current)}) q"
        for name, c in _METRIC_COLUMNS
    )
    return f"SELECT *, round_even(curr_value - prev_value, 6) AS delta FROM ({long}) WHERE prev_value <> curr_value"


_SHARED = "(SELECT repo FROM wf_prev INTERSECT SELECT repo FROM wf_curr)"
_PATTERN_CHANGES = """
    SELECT repo, slug, CASE min(snapshot) WHEN 'current' THEN 'added' ELSE 'removed' END AS change
    FROM pr_snap GROUP BY repo, slug HAVING count(*) = 1"""


_CHANGED_REPOS = f"""
    SELECT repo, coalesce(string_agg(slug, '|' ORDER BY slug) FILTER (WHERE change = 'added'), '') AS added_patterns,
           coalesce(string_agg(slug, '|' ORDER BY slug) FILTER (WHERE change = 'removed'), '') AS removed_patterns
    FROM ({_PATTERN_CHANGES}) GROUP BY repo"""


def _changed(this: str, other: str) -> str:
    return f"SELECT DISTINCT repo, workflow_name FROM {this} EXCEPT SELECT repo, workflow_name FROM {other}"


def _summary(text: str) -> str:
    line = f"trim(regexp_replace({text}, '{_SPACE}+', ' ', 'g'), ' ')"
    return (
        f"CASE WHEN length({line}) <= 240 THEN {line}"
        f" ELSE concat(rtrim(substring({line}, 1, 237), ' '), '...') END"
    )


# raw files: orders whose text is broken on purpose give no YAML
_BROKEN = "o_orderkey % 97 IN (5, 6, 7)"
_RAW_SCAN = f"""
    SELECT repo, concat(workflow_name, '.yml') AS file_name, uses_matrix AND NOT {_BROKEN} AS has_matrix,
           has_permissions_block AND NOT {_BROKEN} AS has_permissions,
           NOT {_BROKEN} AND len([a for a in list_concat(actions_used, run_commands) if {has('a', rules.RAW_AI)}]) > 0
               AS has_ai_review,
           CASE WHEN {_BROKEN} THEN []::VARCHAR[]
                ELSE [a for a in actions_normalized if {has('a', rules.RAW_SCANNERS)}] END AS security_tools
    FROM wf"""

_FLOW = """concat('[', array_to_string(['"' || v || '"' for v in {0}], ', '), ']')"""
_STEP = f"""concat('      - name: step', c // 1024, chr(10), '        uses: ', {words(t.ACTIONS)}[(c // 32) % 32 + 1], chr(10),
                '        run: "', {words(t.COMMANDS)}[c % 32 + 1], '"')"""
_JOB = f"""concat('  job', j, ':', chr(10),
    CASE WHEN j = jobs[1] THEN concat('    runs-on: ', {_FLOW.format('runs_on')}, chr(10)) ELSE '' END,
    CASE WHEN j = jobs[1] AND len(matrix_values) > 0
         THEN concat('    strategy:', chr(10), '      matrix:', chr(10), '        version: ',
                     {_FLOW.format('matrix_values')}, chr(10)) ELSE '' END,
    '    steps:', chr(10), array_to_string([{_STEP} for c in steps if c // 1024 = j], chr(10)))"""
_RAW_TEXT = f"""
    SELECT repo, workflow_name, CASE o_orderkey % 97
        WHEN 5 THEN concat('name: "never closed', chr(10), 'on: push', chr(10))
        WHEN 6 THEN concat('- just', chr(10), '- a list', chr(10)) WHEN 7 THEN ''
        ELSE concat('name: ', workflow_name, chr(10), 'on: ', {_FLOW.format('triggers')}, chr(10),
            CASE WHEN o_orderstatus = 'F' THEN concat('permissions:', chr(10), '  contents: read', chr(10)) ELSE '' END,
            CASE WHEN starts_with(o_orderpriority, '1') THEN concat('concurrency: ci', chr(10)) ELSE '' END,
            'jobs:', chr(10), array_to_string([{_JOB} for j in jobs], chr(10)), chr(10),
            CASE WHEN reuses THEN concat('  shared:', chr(10), '    uses: {t.SHARED_WORKFLOW}', chr(10)) ELSE '' END)
        END AS content
    FROM (SELECT *, list_sort(list_distinct([c // 1024 for c in steps])) AS jobs FROM files)"""

# actions and their definition files, from parts
_DESCRIPTIONS = """
    SELECT action, CASE WHEN b5 = 3 OR k13 THEN CASE WHEN p_partkey % 2 = 0 THEN concat('fallback for ', p_brand) ELSE '' END
                        ELSE concat(phrase, ' of ', p_brand) END AS description
    FROM (SELECT p_partkey, p_brand, CASE WHEN p_partkey <= {ACTIONS}
                      THEN split_part([{NAMES}][p_partkey], '@', 1)
                      ELSE concat(p_type, '/', replace(p_name, ' ', '-'), '-', p_partkey) END AS action,
                 p_partkey % 5 AS b5, p_partkey % 13 = 0 AS k13,
                 ['GPT powered pull request helper', 'Automated code review', 'Cache things', '',
                  'Review with care, no robots'][p_partkey % 5 + 1] AS phrase
          FROM part WHERE p_partkey % 11 <> 0) WHERE NOT starts_with(action, '.')""".replace(
    "{ACTIONS}", str(len(t.ACTIONS))
).replace("[{NAMES}]", words(t.ACTIONS))
_DISCOVERED = f"""
    SELECT full_name AS action FROM meta WHERE stars >= 3
    UNION SELECT unnest({words(rules.WELL_KNOWN_AI_ACTIONS)})
    UNION SELECT action FROM ({_DESCRIPTIONS}) WHERE regexp_matches(description, {quote(rules.AI_DESCRIPTION)}, 'i')"""

# what each configuration file of the derived listing has to give, by path and variant
_CONFIG_EXPECTED = """
    SELECT * FROM (VALUES
        ('tsconfig', 0, 'strict=true;module=esnext;target=es2022;paths=false'),
        ('tsconfig', 1, 'extends=./base;strict=false;resolution=bundler;paths=true'),
        ('tsconfig', 2, 'jsx=react-jsx;paths=false'),
        ('tsconfig', 3, 'parse_error'),
        ('pyproject', 0, 'name=a;python=>=3.11;backend=hatchling.build;ruff=true;pytest=false;uv=false'),
        ('pyproject', 1, 'name=b;backend=setuptools.build_meta;ruff=false;pytest=true;uv=true'),
        ('pyproject', 2, 'ruff=false;pytest=false;uv=false'),
        ('pyproject', 3, 'parse_error'),
        ('cargo', 0, 'workspace=true;members=3'),
        ('cargo', 1, 'workspace=false;package=crate;edition=2021;members=0'),
        ('cargo', 2, 'workspace=true;package=root;edition=2024;members=0'),
        ('cargo', 3, 'parse_error'),
        ('turbo', 0, 'tasks=2;cache=false'),
        ('turbo', 1, 'tasks=1;cache=true'),
        ('turbo', 2, 'tasks=0;cache=false'),
        ('turbo', 3, 'parse_error'),
        ('nx', 0, 'plugins=@nx/js,@nx/react;count=2;inputs=default,prod'),
        ('nx', 1, 'plugins=;count=0;inputs='),
        ('nx', 2, 'plugins=;count=0;inputs=a,z'),
        ('nx', 3, 'parse_error'),
        ('pnpm_workspace', 0, 'workspace=true;globs=a/*,b/*;count=2'),
        ('pnpm_workspace', 1, 'workspace=true;globs=;count=0'),
        ('pnpm_workspace', 2, 'workspace=true;globs=;count=0'),
        ('pnpm_workspace', 3, 'parse_error'),
        ('json', 0, 'keys=extends,rules;rules=2'),
        ('json', 1, 'keys=linter;rules=3'),
        ('json', 2, 'keys=;rules=0'),
        ('json', 3, 'keys=;rules=0'),
        ('toml', 0, 'parse_error'),
        ('toml', 1, 'parse_error'),
        ('toml', 2, 'keys=line-length;rules=0'),
        ('toml', 3, 'parse_error')) AS v(form, variant, content)"""
_CONFIGS = f"""
    SELECT repo, path, CASE WHEN content = 'parse_error' THEN 'parse_error' ELSE kind END AS kind, content
    FROM (SELECT *, CASE WHEN kind <> 'linter' THEN kind WHEN ends_with(path, '.toml') THEN 'toml' ELSE 'json' END
                    AS form FROM kinds)
    JOIN ({_CONFIG_EXPECTED}) USING (form, variant)"""


def _signals(hits: str, names) -> str:
    total = "(SELECT count(*) FROM customer)"
    return f"""
        SELECT signal, count(DISTINCT repo) AS repo_count, {pct('count(DISTINCT repo)', total)} AS adoption_pct
        FROM (SELECT unnest({words(list(dict.fromkeys(names)))}) AS signal) LEFT JOIN ({hits}) USING (signal)
        GROUP BY signal"""


_FILE_HITS = "SELECT repo, signal, arg_min(path, ordinal) AS path FROM listing JOIN signal_def USING (path) GROUP BY ALL"
_BODY = f"""CASE WHEN list_contains({words(t.DIRECTORY_PATHS)}, path) THEN NULL ELSE concat('body of ', path) END"""
_STRUCTURE_HITS = f"""
    SELECT repo, signal, path, type, CASE WHEN type = 'dir' THEN least(variant * 2 + 1, 7) END AS entry_count,
           CASE WHEN type = 'dir'
                THEN array_to_string({words(t.DIRECTORY_ENTRIES)}[1:least(variant * 2 + 1, 5)], '|') END AS sample_entries,
           CASE WHEN type = 'dir' THEN NULL WHEN contains(path, 'release-please') THEN 'release-please'
                WHEN contains(path, 'goreleaser') THEN 'goreleaser' WHEN path = 'cliff.toml' THEN 'git-cliff'
                WHEN contains(path, 'devcontainer') THEN 'devcontainer' WHEN path = 'flake.nix' THEN 'nix'
                WHEN contains(path, 'compose') THEN 'docker-compose' END AS tool,
           CASE WHEN type = 'file' THEN length({_BODY}) END AS size
    FROM listing JOIN structure_def USING (path, type)"""

_REPO_LIST = f"""
    SELECT f.repo, f.workflow_count, maturity_pct, len({_SLUG_LIST}) AS pattern_count, has_matrix, has_permissions,
           has_ai_review, has_security_scan, has_cache, score AS security_score
    FROM facts f LEFT JOIN (SELECT repo, score FROM scores) USING (repo)"""


def _listed(key: str, condition: str) -> str:
    return f"""
        SELECT *, row_number() OVER (ORDER BY coalesce({key}, -1) DESC, repo) AS position
        FROM ({_REPO_LIST}) WHERE {condition}"""


_PAIRS = f"""
    SELECT {REPO.format('c_custkey')} AS left_repo, {REPO.format('(c_custkey + 20)')} AS right_repo FROM customer"""
_GROUPED_SEEDS = f"""SELECT split_part(name, '/', 1) AS list_name, name
    FROM (SELECT {REPO.format('c_custkey')} AS name FROM customer)"""
_PARTS = ", ".join(f"sum(('0x' || substring(h, {8 * i + 1}, 8))::BIGINT)" for i in range(8))


def _lifetimes(members: str, *keys: str) -> str:
    """Gaps and islands over all snapshots."""
    names = ", ".join(keys)
    return f"""
        SELECT {names}, min(snapshot)::VARCHAR AS first_seen, max(snapshot)::VARCHAR AS last_seen,
               CASE WHEN NOT bool_or(later IS NULL) THEN max(later)::VARCHAR END AS gone_at
        FROM (SELECT m.*, later, n - row_number() OVER (PARTITION BY {names} ORDER BY n) AS run
              FROM (SELECT DISTINCT snapshot, {names} FROM {members}) m
              JOIN (SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS n, lead(snapshot) OVER (ORDER BY snapshot) AS later
                    FROM (SELECT DISTINCT snapshot FROM {members})) USING (snapshot))
        GROUP BY {names}, run"""


_MAIN = "'/.github/workflows/main.yml'"
_CALLS = f"""
    SELECT DISTINCT concat('orders/o', l_orderkey, {_MAIN}) AS caller, concat('shared/s', l_suppkey, {_MAIN}) AS callee
    FROM lineitem WHERE l_linenumber <= 2
    UNION SELECT concat('shared/s', s_suppkey, {_MAIN}), concat('shared/s', s_suppkey // 3, {_MAIN}) FROM supplier WHERE s_suppkey >= 3
    UNION SELECT concat('shared/s', s_suppkey, {_MAIN}), concat('shared/s', s_suppkey, '/.github/workflows/local.yml')
          FROM supplier WHERE s_suppkey % 4 = 0
    UNION SELECT concat('shared/s', s_suppkey, {_MAIN}), concat('shared/s', s_suppkey + 1, {_MAIN}) FROM supplier WHERE s_suppkey % 5 = 0
    UNION SELECT concat('shared/s', s_suppkey, {_MAIN}), concat('shared/s', s_suppkey * 3, {_MAIN}) FROM supplier WHERE s_suppkey % 7 = 1"""
# chains of at most 40 calls: depth must be bounded for UNION to end in cycles; shortest ones are far below
_CHAINS = f"""
    WITH RECURSIVE calls AS ({_CALLS}), walk AS (
      SELECT caller, callee, 1 AS depth FROM calls
      UNION
      SELECT w.caller, c.callee, w.depth + 1 FROM walk w JOIN calls c ON c.caller = w.callee WHERE w.depth < 40
    ) SELECT caller, callee, min(depth)::BIGINT AS depth FROM walk GROUP BY ALL"""

_STATEMENTS: dict[str, str] = {
    # sources and extraction
    "workflow_table": f"SELECT {_WORKFLOW_COLUMNS}, crawl_date::VARCHAR AS crawl_date FROM wf",
    "extracted_workflows": f"SELECT {_WORKFLOW_COLUMNS}, '2026-01-01' AS crawl_date FROM wf WHERE NOT {_BROKEN}",
    "parse_errors": f"""
        SELECT repo, concat(workflow_name, '.yml') AS file_name, source_file,
               CASE WHEN o_orderkey % 97 = 5 THEN 'ScannerError' ELSE 'top-level is not a mapping' END AS reason
        FROM wf WHERE {_BROKEN}""",
    "raw_text_scan": f"SELECT * REPLACE (array_to_string(security_tools, '|') AS security_tools) FROM ({_RAW_SCAN})",
    "triggers_usage": _usage("triggers", "trigger"),
    "runner_usage": _usage("runs_on", "runner"),
    "job_usage": _usage("job_names", "job"),
    "matrix_value_usage": _usage("matrix_values", "value"),
    "reusable_usage": _usage("reusable_workflows", "workflow"),
    "actions_normalized": _usage("actions_used", "used", ", split_part(used, '@', 1) AS action"),
    "ai_actions_regex": f"SELECT repo, workflow_name, {_lists('ai_review_actions')} FROM wf WHERE has_ai_review",
    "ai_actions_known": f"""
        SELECT action, repo, workflow_name
        FROM (SELECT repo, workflow_name, unnest(actions_normalized) AS action FROM wf)
        WHERE action IN ({_DISCOVERED})""",
    "ai_tools_known": f"""
        SELECT action, count(DISTINCT repo) AS repo_count
        FROM (SELECT repo, unnest(actions_normalized) AS action FROM wf)
        WHERE action IN ({_DISCOVERED}) GROUP BY action""",
    "adoption_counts_known": f"""
        SELECT count(DISTINCT repo) AS total_repos,
               (SELECT count(DISTINCT repo) FROM (SELECT repo, unnest(actions_normalized) AS action FROM wf)
                WHERE action IN ({_DISCOVERED})) AS ai_review_repos,
               count(DISTINCT repo) FILTER (WHERE has_security_scan) AS security_scan_repos FROM wf""",
    "security_scan_flag": "SELECT repo, workflow_name FROM wf WHERE has_security_scan",
    "action_descriptions": _DESCRIPTIONS,
    # adoption
    "totals": "SELECT count(DISTINCT repo) AS total_repos, count(*) AS total_workflows FROM wf",
    "adoption_counts": """
        SELECT count(DISTINCT repo) AS total_repos, count(DISTINCT repo) FILTER (WHERE has_ai_review) AS ai_review_repos,
               count(DISTINCT repo) FILTER (WHERE has_security_scan) AS security_scan_repos FROM wf""",
    "matrix_usage": f"""
        SELECT count(DISTINCT repo) AS total_repos, count(DISTINCT CASE WHEN uses_matrix THEN repo END) AS matrix_repos,
               {pct('count(DISTINCT CASE WHEN uses_matrix THEN repo END)', 'count(DISTINCT repo)')} AS percentage
        FROM wf""",
    "permissions_usage": f"""
        SELECT count(*) AS total_workflows, count(*) FILTER (WHERE has_permissions_block) AS with_permissions,
               {pct('count(*) FILTER (WHERE has_permissions_block)', 'count(*)')} AS percentage FROM wf""",
    "popular_actions": _POPULAR.format(50),
    "actions_categorized": f"""
        SELECT action, usage_count, {CATEGORY} AS category, {ACTION_URL} AS url, coalesce(description, '') AS description
        FROM ({_POPULAR.format(50)}) LEFT JOIN ({_DESCRIPTIONS}) USING (action)""",
    "category_usage": f"""
        SELECT {CATEGORY} AS category, sum(n)::BIGINT AS usage_count, count(*) AS action_count
        FROM (SELECT action, count(*) AS n FROM counts GROUP BY action) GROUP BY 1""",
    "ai_adoption": """
        SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY first_name, first_pos, action) AS position, action,
               concat('https://github.com/', repo) AS url
        FROM (SELECT repo, action, min(workflow_name) AS first_name,
                     min(struct_pack(w := workflow_name, p := pos)).p AS first_pos
              FROM (SELECT repo, workflow_name, unnest(ai_review_actions) AS action,
                           generate_subscripts(ai_review_actions, 1) AS pos FROM wf WHERE has_ai_review)
              GROUP BY repo, action)""",
    "ai_tool_breakdown": """
        SELECT action, count(DISTINCT repo) AS repo_count, any_value(tool_name) AS tool_name, any_value(model) AS model,
               any_value(approach) AS approach, any_value(prompt_style) AS prompt_style,
               concat('https://github.com/', action) AS url
        FROM (SELECT repo, unnest(ai_review_actions) AS action FROM wf)
        LEFT JOIN (VALUES """
    + ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in rules.AI_REVIEW_TOOLS)
    + """) AS d(action, tool_name, model, approach, prompt_style) USING (action) GROUP BY action""",
    "ai_repos_distinct": "SELECT DISTINCT repo FROM wf WHERE has_ai_review",
    "fingerprints": _FINGERPRINTS,
    "fingerprint_examples": f"""
        SELECT fingerprint, repo, position FROM (
            SELECT fingerprint, repo, row_number() OVER (PARTITION BY fingerprint ORDER BY repo) AS position
            FROM (SELECT DISTINCT md5(array_to_string(list_sort(actions_normalized), ',')) AS fingerprint, repo FROM wf)
            WHERE fingerprint IN (SELECT fingerprint FROM ({_FINGERPRINTS})))
        WHERE position <= 3""",
    "security_scan_adoption": "SELECT DISTINCT repo FROM wf WHERE has_security_scan",
    "distinct_actions": "SELECT DISTINCT action FROM counts",
    "actions_missing_desc": f"""
        SELECT DISTINCT action FROM counts WHERE NOT starts_with(action, '.') AND {CATEGORY} <> 'CI/Build'""",
    "ai_action_discovery": _DISCOVERED,
    "action_share": f"""
        SELECT action, {CATEGORY} AS category, usage_count,
               usage_count::DOUBLE / max(usage_count) OVER () AS share_of_largest
        FROM ({_POPULAR.format(15)})""",
    "insight_flags": _insights(_OWNER),
    "insight_flags_overall": _insights("'all'"),
    "recommendation_flags": _RECOMMENDATIONS,
    "surprising_actions": f"""
        SELECT grp, position, action, usage_count FROM ({_top_actions(_OWNER, 10)}) WHERE {_UNOFFICIAL}""",
    # repo summaries
    "workflow_detail": f"""
        SELECT repo, workflow_name, workflow_path, source_file, job_count, {_lists('jobs', 'actions', 'notable_actions')}
        FROM detail""",
    "notable_actions": "SELECT DISTINCT repo, unnest(notable_actions) AS action FROM detail",
    "repo_rollup": """
        SELECT repo, workflow_count, coalesce(n, 0) AS action_count, has_matrix, has_permissions, has_security_scan,
               has_ai_review, has_cache, has_concurrency, has_reusable_workflows
        FROM facts LEFT JOIN (SELECT repo, count(DISTINCT action) AS n FROM counts GROUP BY repo) USING (repo)""",
    "repo_maturity": f"""
        SELECT repo, maturity_score, maturity_pct, array_to_string({_missing(1)}, '|') AS missing_en,
               array_to_string({_missing(2)}, '|') AS missing_zh FROM facts""",
    "missing_practices": _positions("facts", _missing(1), "practice"),
    "repo_ranking": """
        SELECT repo, workflow_count, maturity_score, maturity_pct,
               row_number() OVER (ORDER BY maturity_score DESC, repo) AS position FROM facts""",
    "maturity_histogram": "SELECT maturity_score, count(*) AS repo_count FROM facts GROUP BY maturity_score",
    "practice_adoption": _long(
        "facts",
        [(flag, quote(en), pct(f"count(*) FILTER (WHERE {flag})", "count(*)")) for flag, en, _ in _PRACTICES],
        "SELECT {1} AS practice, count(*) FILTER (WHERE {0}) AS repo_count, {2} AS adoption_pct",
    ),
    "practice_matrix": _long(
        "facts", [(flag, quote(en)) for flag, en, _ in _PRACTICES], "SELECT repo, {1} AS practice, {0} AS adopted"
    ),
    # patterns
    **{"pattern_" + slug.replace("-", "_"): _pattern(slug) for slug, *_ in rules.PATTERNS},
    "pattern_hits": " UNION ALL ".join(
        f"SELECT '{slug}' AS slug, repo, workflow_name, workflow_path, source_file FROM flags WHERE {col(slug)}"
        for slug in WORKFLOW_SLUGS
    ),
    "pattern_adoption": "SELECT * FROM adoption",
    "pattern_categories": """
        SELECT category, category_repo_count,
               row_number() OVER (PARTITION BY category ORDER BY repo_count DESC, name) AS position, slug, repo_count
        FROM adoption JOIN ("""
    + _long(
        "facts",
        [(quote(name), " OR ".join(flags)) for name, flags in _CATEGORIES.items()],
        "SELECT {0} AS category, count(*) FILTER (WHERE {1}) AS category_repo_count",
    )
    + ") USING (category)",
    "pattern_totals": """
        SELECT count(*) AS total_patterns, count(*) FILTER (WHERE repo_count > 0) AS detected_patterns FROM adoption""",
    "pattern_by_tier": """
        SELECT tier, category, count(*) AS patterns, count(*) FILTER (WHERE repo_count > 0) AS detected,
               sum(workflow_count)::BIGINT AS workflow_count FROM adoption GROUP BY ALL""",
    "pattern_examples": _EXAMPLES,
    "pattern_top_repos": """
        SELECT slug, position, repo
        FROM (SELECT slug, repo, row_number() OVER (PARTITION BY slug ORDER BY repo) AS position FROM pr)
        WHERE position <= 3""",
    "repo_patterns": f"""
        SELECT repo, array_to_string({_SLUG_LIST}, '|') AS slugs, len({_SLUG_LIST}) AS pattern_count FROM facts""",
    # security
    "sec_permissions": "SELECT repo, permitted, workflow_count, permissions FROM scores",
    "sec_scanners": "SELECT repo, scanners, security_scan FROM scores",
    "sec_supply_chain": "SELECT repo, supply_tools, supply_chain FROM scores",
    "sec_secrets": "SELECT repo, app_token, personal_token, secret_handling FROM scores",
    "sec_hardening": "SELECT repo, hardened, harden_runner FROM scores",
    "security_scores": """
        SELECT repo, permissions, security_scan, supply_chain, secret_handling, harden_runner, score FROM scores""",
    "security_recommendations": _positions("scores", _ADVICE, "advice"),
    "security_average": """
        SELECT round_even(sum(score::DECIMAL(18, 2))::DOUBLE / count(*), 2) AS average_score FROM scores""",
    "security_top": "SELECT repo, score FROM scores ORDER BY score DESC, repo LIMIT 10",
    "security_bottom": "SELECT repo, score FROM scores ORDER BY score, repo DESC LIMIT 10",
    "security_histogram": """
        SELECT b AS bin, count(repo) AS repo_count FROM range(10) r(b)
        LEFT JOIN (SELECT repo, least(greatest(floor(score / 10), 0), 9)::BIGINT AS b FROM scores) USING (b)
        GROUP BY b""",
    "security_median": """
        SELECT score AS median_score FROM scores ORDER BY score LIMIT 1 OFFSET (SELECT count(*) // 2 FROM scores)""",
    "security_tools": "SELECT repo, kind, tool FROM tools",
    "security_tool_usage": "SELECT kind, tool, count(*) AS repo_count FROM tools GROUP BY kind, tool",
    # quality
    "duplicate_count": f"SELECT sum(copies - 1)::BIGINT AS duplicate_count FROM ({_COPIES})",
    "duplicate_rows": f"SELECT * FROM ({_COPIES}) WHERE copies > 1",
    "null_rates": _long(
        "wf",
        [(name, pct(f"count(*) FILTER (WHERE {name} IS NULL)", "count(*)")) for name in _ALL_COLUMNS],
        "SELECT '{0}' AS column_name, {1} AS null_rate",
    ),
    "quality_summary": _quality(""),
    "quality_missing_column": _quality("has_security_scan, triggers"),
    "all_null_columns": "SELECT 'triggers' AS column_name FROM wf GROUP BY ALL HAVING count(*) > 0",
    # changes
    "metric_diffs": f"""
        SELECT grp AS snapshot, metric, prev_value, curr_value, round_even(curr_value - prev_value, 6) AS delta
        FROM (SELECT grp, metric, value AS curr_value,
                     lag(value) OVER (PARTITION BY metric ORDER BY grp) AS prev_value
              FROM ({_long(
                  f"({_metrics("strftime(crawl_date, '%Y-%m')", 'wf')})",
                  _METRIC_COLUMNS,
                  "SELECT grp, '{0}' AS metric, {1}::DOUBLE AS value",
              )}))
        WHERE prev_value <> curr_value""",
    "metric_diffs_two": _two_diffs("wf_prev", "wf_curr"),
    "workflows_added": _changed("wf_curr", "wf_prev"),
    "workflows_removed": _changed("wf_prev", "wf_curr"),
    "workflow_lifetimes": _lifetimes("wf_month", "repo", "workflow_name"),
    "workflow_lifetimes_merged": _lifetimes("wf_month", "repo", "workflow_name"),
    "workflow_changes_between": """
        SELECT repo, workflow_name, CASE max(snapshot) WHEN DATE '2026-05-01' THEN 'added' ELSE 'removed' END AS change
        FROM (SELECT DISTINCT * FROM wf_month WHERE snapshot IN (DATE '2026-02-01', DATE '2026-05-01'))
        GROUP BY repo, workflow_name HAVING count(*) = 1""",
    "pattern_lifetimes": _lifetimes("pr_month", "repo", "slug"),
    "distinct_unions": "SELECT metric, count(DISTINCT repo) AS repos FROM practice_month GROUP BY metric",
    "distinct_cumulative": """
        SELECT d.snapshot::VARCHAR AS snapshot, d.metric, count(DISTINCT p.repo) AS repos
        FROM (SELECT DISTINCT snapshot, metric FROM practice_month) d
        JOIN practice_month p ON p.metric = d.metric AND p.snapshot <= d.snapshot GROUP BY ALL""",
    "distinct_shared": """
        SELECT p.snapshot::VARCHAR AS snapshot, p.metric, count(*) AS repos
        FROM practice_month p
        JOIN (SELECT snapshot, repo FROM practice_month WHERE metric = 'repos') b
          ON b.repo = p.repo AND b.snapshot = p.snapshot - INTERVAL 1 MONTH GROUP BY ALL""",
    "pattern_changes": _PATTERN_CHANGES,
    "pattern_changed_repos": _CHANGED_REPOS,
    "pattern_changed_listed": f"SELECT * FROM ({_CHANGED_REPOS}) ORDER BY repo LIMIT 20",
    "trend_on_intersection": _two_diffs(
        f"(SELECT * FROM wf_prev WHERE repo IN {_SHARED})", f"(SELECT * FROM wf_curr WHERE repo IN {_SHARED})"
    ),
    "previous_snapshot": """
        SELECT repo, workflow_name, m::VARCHAR AS crawl_date
        FROM (SELECT *, date_trunc('month', crawl_date)::DATE AS m FROM wf)
        WHERE m = (SELECT max(date_trunc('month', crawl_date)::DATE) FROM wf
                   WHERE date_trunc('month', crawl_date) < DATE '1998-01-01')""",
    # lineage and profiles
    "workflow_sources": "SELECT repo, workflow_name, workflow_path, source_file FROM detail",
    "repo_sources": "SELECT DISTINCT repo, source_file FROM detail",
    "pattern_sources": f"SELECT slug, position, repo, workflow_name, workflow_path, source_file FROM ({_EXAMPLES})",
    "repo_profiles": f"""
        SELECT f.repo, concat('https://github.com/', f.repo) AS url, m.description, {_summary('m.description')} AS summary,
               nullif(stars, 0) AS stars, nullif(forks, 0) AS forks, language, license,
               array_to_string(topics, '|') AS topics, pushed_at, f.workflow_count,
               array_to_string({_SLUG_LIST}, '|') AS patterns, score AS security_score, maturity_pct
        FROM facts f LEFT JOIN meta m ON m.full_name = f.repo
        LEFT JOIN (SELECT repo, score FROM scores) USING (repo)""",
    "short_summary": f"SELECT doc_id, {_summary('text')} AS summary FROM documents",
    "export_repos": """
        SELECT f.repo, f.workflow_count, maturity_pct, coalesce(score, 0.0::DOUBLE) AS security_score
        FROM facts f LEFT JOIN (SELECT repo, score FROM scores) USING (repo)""",
    "export_patterns": "SELECT slug, name, category, repo_count, adoption_pct FROM adoption",
    # seeds
    "link_extract": f"""
        SELECT split_part(name, '/', 1) AS owner, split_part(name, '/', 2) AS repo, min(doc_id) AS first_document,
               arg_min(place, doc_id)::BIGINT AS first_place
        FROM (SELECT doc_id, {REPO.format(f'(doc_id % {t.LINKED_REPOS})')} AS name, 0 AS place FROM documents
              UNION ALL SELECT doc_id, 'Core/engine.js', 1 FROM documents)
        GROUP BY name""",
    "seed_metadata": """
        SELECT full_name,
               CASE WHEN forks % 7 <> 0 THEN substring(repeat(concat(description, ' '), 20), 1, 200) ELSE '' END
                   AS description,
               coalesce(language, '') AS language, stars, forks, 0::BIGINT AS open_issues,
               array_to_string(topics, '|') AS topics, CASE WHEN license <> 'MIT' THEN license ELSE '' END AS license,
               '' AS created_at, '' AS updated_at, pushed_at, archived, 'main' AS default_branch
        FROM meta""",
    "skip_reason": "SELECT full_name, skip AS reason FROM reasons",
    "workflow_gate": "SELECT full_name, gate AS reason FROM reasons",
    "seed_accepted": "SELECT full_name, stars, workflow_count FROM reasons WHERE reason IS NULL",
    "skip_log": """
        SELECT 'search' AS source, reason, count(*) AS repos FROM reasons WHERE reason IS NOT NULL GROUP BY reason""",
    "seed_fill": """
        SELECT full_name, 'research' AS source FROM research
        UNION ALL
        SELECT full_name, 'search' FROM (
            SELECT full_name, row_number() OVER (ORDER BY stars DESC, full_name) AS n FROM reasons
            WHERE reason IS NULL AND full_name NOT IN (SELECT full_name FROM research))
        WHERE n <= 200 - (SELECT count(*) FROM research)""",
    "seed_merge": """
        SELECT full_name, 'research' AS source, NULL::VARCHAR AS reason FROM research
        UNION ALL
        SELECT e.full_name, 'manual', CASE WHEN r.full_name IS NULL THEN 'not found on GitHub' ELSE r.reason END
        FROM (SELECT DISTINCT concat('org', s_suppkey % 20, CASE WHEN s_suppkey % 6 = 5 THEN '/lost' ELSE '/cust' END,
                                     s_suppkey) AS full_name
              FROM supplier WHERE s_suppkey % 9 <> 4) e
        LEFT JOIN reasons r USING (full_name)
        WHERE e.full_name NOT IN (SELECT full_name FROM research)""",
    "seed_fingerprint": f"""
        SELECT list_name, count(*) AS names, substring(sha256(string_agg(name, chr(10) ORDER BY name)), 1, 16) AS fingerprint,
               substring(sha256(concat_ws(',', count(*), {_PARTS})), 1, 16) AS additive
        FROM (SELECT DISTINCT list_name, name, sha256(name) AS h FROM ({_GROUPED_SEEDS})) GROUP BY list_name""",
    "seed_compare": """
        SELECT coalesce(p.repo, c.repo) AS full_name,
               CASE WHEN c.repo IS NULL THEN 'previous_only' WHEN p.repo IS NULL THEN 'current_only'
                    ELSE 'intersection' END AS side
        FROM (SELECT DISTINCT repo FROM wf_prev) p FULL JOIN (SELECT DISTINCT repo FROM wf_curr) c ON p.repo = c.repo""",
    "repo_category": "SELECT full_name, category FROM cats",
    "category_stats": """
        SELECT category, count(*) AS repos, count(*) FILTER (WHERE workflow_count >= 2) AS with_workflows,
               count(*) FILTER (WHERE workflow_count = 0) AS without_workflows,
               (sum(stars) // count(*))::BIGINT AS average_stars
        FROM cats GROUP BY category""",
    "language_stats": """
        SELECT coalesce(language, '(none)') AS language, count(*) AS repos FROM meta GROUP BY 1
        ORDER BY repos DESC, 1 LIMIT 15""",
    "seed_verdicts": """
        SELECT category, full_name, stars, array_to_string(topics[1:4], '|') AS topics, verdict,
               row_number() OVER (PARTITION BY category ORDER BY stars DESC, full_name) AS position
        FROM verdicts""",
    "seed_summary": """
        SELECT count(*) AS total, count(*) FILTER (WHERE workflow_count >= 2) AS workflows_2_or_more,
               count(*) FILTER (WHERE workflow_count = 1) AS workflows_1,
               count(*) FILTER (WHERE workflow_count = 0 AND error IS NULL) AS workflows_0,
               count(*) FILTER (WHERE language IS NULL AND error IS NULL) AS no_language,
               count(*) FILTER (WHERE archived) AS archived, count(error) AS errors,
               count(*) FILTER (WHERE verdict = 'OK') AS ok, count(*) FILTER (WHERE verdict <> 'OK') AS skip
        FROM verdicts""",
    # repository signals
    "file_signals": _FILE_HITS,
    "file_signal_adoption": _signals(_FILE_HITS, (signal for signal, _ in rules.FILE_SIGNALS)),
    "config_kind": "SELECT repo, path, kind FROM kinds",
    "config_files": f"SELECT repo, path, kind, content FROM ({_CONFIGS})",
    "config_trends": f"""
        SELECT kind, count(DISTINCT repo) AS repo_count,
               {pct('count(DISTINCT repo)', '(SELECT count(*) FROM customer)')} AS adoption_pct
        FROM ({_CONFIGS}) WHERE kind <> 'parse_error' GROUP BY kind""",
    "config_counters": f"""
        SELECT count(*) FILTER (WHERE kind = 'tsconfig' AND contains(content, 'strict=true')) AS tsconfig_strict,
               count(*) FILTER (WHERE kind = 'cargo' AND contains(content, 'workspace=true')) AS cargo_workspaces,
               count(*) FILTER (WHERE kind = 'parse_error') AS parse_errors
        FROM ({_CONFIGS})""",
    "build_backends": f"""
        SELECT regexp_extract(content, 'backend=([^;]+)', 1) AS build_backend, count(*) AS files
        FROM ({_CONFIGS}) WHERE kind = 'pyproject' AND contains(content, 'backend=') GROUP BY 1""",
    "structure_signals": _STRUCTURE_HITS,
    "structure_adoption": _signals(_STRUCTURE_HITS, (signal for signal, _, _ in rules.STRUCTURE_SIGNALS)),
    "yaml_files": """
        SELECT repo, path FROM listing WHERE type = 'file' AND (ends_with(path, '.yml') OR ends_with(path, '.yaml'))""",
    "decoded_contents": """
        SELECT conv_id, turn,
               CASE WHEN turn % 5 <> 4 AND turn % 3 <> 2 THEN text END AS content,
               CASE WHEN turn % 5 = 4 THEN 'missing content'
                    WHEN turn % 3 = 2 THEN 'unsupported encoding: utf-8' END AS error
        FROM conversations""",
    "incremental_changes": "SELECT * FROM changes",
    "incremental_counts": "SELECT outcome, count(*) AS files FROM changes GROUP BY outcome",
    "incremental_state": """
        SELECT repo, path, coalesce(c.sha, p.sha) AS sha FROM hash_curr c FULL JOIN hash_prev p USING (repo, path)""",
    # serving
    "repo_list": _listed("security_score", "TRUE"),
    "repo_list_search": _listed("maturity_pct", "contains(lower(repo), 'org7/')"),
    "dashboard_patterns": """
        SELECT slug, category, repo_count, adoption_pct FROM adoption ORDER BY repo_count DESC, category, name LIMIT 8""",
    "dashboard_actions": f"SELECT action, {CATEGORY} AS category, usage_count FROM ({_POPULAR.format(15)})",
    "dashboard_security": "SELECT repo, score FROM scores ORDER BY score DESC, repo LIMIT 8",
    "repo_pair_diff": f"SELECT * FROM (WITH p AS ({_PAIRS}) "
    + _long(
        "p JOIN facts l ON l.repo = left_repo JOIN facts r ON r.repo = right_repo",
        [(flag,) for flag, _, _ in _PRACTICES],
        "SELECT left_repo, right_repo, '{0}' AS practice, l.{0} AS left_has, r.{0} AS right_has",
    )
    + ")",
    "repo_pair_workflows": f"""
        SELECT * FROM (
            WITH p AS (SELECT * FROM ({_PAIRS}) WHERE left_repo IN (SELECT repo FROM wf)
                       AND right_repo IN (SELECT repo FROM wf)),
            l AS (SELECT left_repo, right_repo, workflow_name FROM p JOIN wf ON repo = left_repo),
            r AS (SELECT left_repo, right_repo, workflow_name FROM p JOIN wf ON repo = right_repo)
            SELECT *, 'left' AS side FROM (FROM l EXCEPT FROM r)
            UNION ALL SELECT *, 'right' FROM (FROM r EXCEPT FROM l))""",
    "repo_search": "SELECT DISTINCT repo AS name FROM wf WHERE contains(lower(repo), 'org7/cust1')",
    "action_search": """
        SELECT DISTINCT name FROM (SELECT unnest(actions_used) AS name FROM wf) WHERE contains(lower(name), 'setup-')""",
    "streamed_versions": """
        SELECT repo, file_name, sha FROM (
          SELECT repo, file_name, max(struct_pack(ts := ts, sha := sha)).sha AS sha
          FROM (SELECT concat('org/user', user_id % 200) AS repo, concat(event_type, '.yml') AS file_name, ts,
                       CASE WHEN event_id % 11 = 0 THEN ''
                            ELSE sha256(concat('v', floor(coalesce(value, 0) / 4)::BIGINT)) END AS sha FROM events)
          WHERE ts IS NOT NULL GROUP BY ALL) WHERE sha <> ''""",
    "reusable_chains": f"FROM ({_CHAINS})",
    "reusable_reach": f"""
        SELECT callee AS workflow, count(*) FILTER (WHERE caller <> callee AND depth = 1) AS direct_callers,
               count(*) FILTER (WHERE caller <> callee) AS callers,
               coalesce(max(depth) FILTER (WHERE caller <> callee), 0) AS longest_chain, bool_or(caller = callee) AS in_cycle
        FROM ({_CHAINS}) GROUP BY callee""",
    "repo_advice": f"""
        SELECT repo, position, advice FROM ({_positions(
            "facts JOIN (SELECT repo AS r, permitted, scanners, supply_tools, app_token, hardened FROM scores) ON r = repo",
            f"list_concat([concat('Add ', m, '.') for m in {_missing(1)}], {_ADVICE})[1:8]",
            "advice",
        )})""",
    "flaky_signal": "SELECT slug, repo_count FROM adoption WHERE slug = 'flaky-test-retry'",
    "patterns_in_category": """
        SELECT slug, name, repo_count, adoption_pct FROM adoption WHERE category = 'Testing Strategy'""",
    "flaky_examples": f"SELECT * FROM ({_EXAMPLES}) WHERE slug = 'flaky-test-retry'",
    "health_check": f"""
        SELECT repo, workflow_count, floor(permitted::DOUBLE / workflow_count * 100 + 0.5)::BIGINT
                   AS permissions_coverage_pct, security_tools, has_matrix, has_ai_review,
               security_tools > 0 AS has_security_scan,
               concat_ws(',', CASE WHEN permitted < workflow_count THEN 'permissions' END,
                         CASE WHEN security_tools = 0 THEN 'scanner' END, CASE WHEN NOT has_matrix THEN 'matrix' END)
                   AS advice
        FROM (SELECT repo, count(*) AS workflow_count, count(*) FILTER (WHERE has_permissions) AS permitted,
                     len(list_distinct(flatten(list(security_tools)))) AS security_tools,
                     bool_or(has_matrix) AS has_matrix, bool_or(has_ai_review) AS has_ai_review
              FROM ({_RAW_SCAN}) GROUP BY repo)""",
    "workflow_raw_sources": f"SELECT repo, workflow_name, md5(content) AS content_md5 FROM ({_RAW_TEXT})",
    "trend_counters": f"""
        SELECT 'added_workflows' AS counter, count(*) AS value FROM ({_changed('wf_curr', 'wf_prev')})
        UNION ALL SELECT 'removed_workflows', count(*) FROM ({_changed('wf_prev', 'wf_curr')})
        UNION ALL SELECT 'changed_repos', count(DISTINCT repo) FROM ({_PATTERN_CHANGES})
        UNION ALL SELECT 'tsconfig_strict', count(*) FROM ({_CONFIGS})
                  WHERE kind = 'tsconfig' AND contains(content, 'strict=true')
        UNION ALL SELECT 'cargo_workspaces', count(*) FROM ({_CONFIGS})
                  WHERE kind = 'cargo' AND contains(content, 'workspace=true')
        UNION ALL SELECT 'release_strategy_repos', count(DISTINCT repo) FROM ({_STRUCTURE_HITS})
                  WHERE signal = 'release_strategy'""",
}

STATEMENTS: dict[str, str] = {name: query(body) for name, body in _STATEMENTS.items()}
