"""Common table expressions of the SQL counterparts.

Written for DuckDB over the same tables and independent of the Spark operators: only the fixed vocabularies are
shared.  ``query`` prepends the expressions that a statement needs.
"""

import re

from forgelens import rules
from forgelens.functions.text import pattern_of
from forgelens.sources import tables as t


def words(items) -> str:
    """List literal."""
    return "[" + ", ".join(quote(item) for item in items) + "]" if items else "[]::VARCHAR[]"


def quote(item: str) -> str:
    return "'" + item.replace("'", "''") + "'"


def has(text: str, terms) -> str:
    return f"regexp_matches({text}, {quote(pattern_of(terms))}, 'i')"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return f"coalesce(round_even(({part})::DOUBLE / nullif({whole}, 0) * 100, {digits}), 0.0)"


REPO = "concat('org', {0} % 20, '/cust', {0})"
MATRIX_TERMS = pattern_of(rules.HARDWARE)

FLAGS = {
    "ai-code-review": f"has_ai_review OR {has('txt', rules.AI_TOOLS_TEXT)}",
    "ai-security-review": f"(has_ai_review OR {has('txt', rules.AI_TOOLS_TEXT)})"
    f" AND {has('txt', rules.AI_SECURITY_TOPIC)}",
    "ai-contribution-audit": has("txt", rules.AI_AUDIT),
    "dogfooding": "len([a for a in actions if starts_with(lower(a), lower(split_part(repo, '/', 1)) || '/')]) > 0",
    "security-scanning": f"has_security_scan OR {has('txt', rules.SCANNERS)}",
    "container-signing": has("txt", rules.SUPPLY_CHAIN),
    "harden-runner": "len([a for a in actions if contains(lower(a), 'step-security/harden-runner')]) > 0",
    "least-privilege-permissions": "has_permissions",
    "hardware-matrix": "uses_matrix AND len([v for v in list_concat(list_concat(matrix_keys, matrix_values), runs_on)"
    f" if regexp_matches(lower(v), '{MATRIX_TERMS}')]) > 0",
    "chaos-engineering": has("txt", rules.CHAOS),
    "fuzz-randomized-testing": has("txt", rules.FUZZ),
    "flaky-test-retry": has("txt", rules.RETRY),
    "performance-tracking": has("txt", rules.PERFORMANCE),
    "python-future-testing": "len([v for v in matrix_values if contains(lower(v), '3.14') OR"
    " contains(lower(v), 'free-threaded')]) > 0 OR (contains(lower(txt), '3.14') AND contains(lower(txt), 'python'))",
    "multi-channel-release": f"{has('txt', rules.RELEASE)} AND {has('txt', rules.CHANNEL)}",
    "pr-package-preview": has("txt", rules.PREVIEW_PACKAGE),
    "reusable-workflows": "uses_reusable_workflows",
    "ecosystem-ci": has("txt", rules.ECOSYSTEM),
    "cross-version-compat": "len(list_distinct([v for v in matrix_values if"
    f" regexp_full_match(v, '{rules.VERSION_VALUE}')])) >= 3",
}
WORKFLOW_SLUGS = list(FLAGS)
REPO_SLUGS = {
    "multi-stage-release": "releases >= 3 OR (releases >= 2 AND dispatches > 0)",
    "multiple-build-systems": "len(build_systems) >= 3",
    "per-sample-ci": "workflow_count >= 10 AND samples >= 3",
}


def col(slug: str) -> str:
    return "f_" + slug.replace("-", "_")


_RELEASE, _SAMPLE = has("txt", rules.RELEASE), has("txt", rules.SAMPLE)
_DISPATCH = (
    f"len(list_intersect([lower(e) for e in triggers], {words(rules.DISPATCH_TRIGGERS)})) > 0 OR "
    + " OR ".join(f"contains(lower(txt), '{phrase}')" for phrase in rules.DISPATCH_TEXT)
)
_PRACTICE_SUM = " + ".join(f"{flag}::BIGINT" for flag, _, _ in rules.PRACTICES)
_SUPPLY = quote(pattern_of(rules.SUPPLY_CHAIN))


def _rows(items) -> str:
    return ", ".join("(" + ", ".join(quote(i) if isinstance(i, str) else str(i) for i in row) + ")" for row in items)


def workflow_ctes(suffix: str = "", keep: str = "TRUE") -> dict[str, str]:
    """Workflow, detail, flag and repo tables of the orders that satisfy ``keep``."""
    s = suffix
    return {
        f"files{s}": f"""
            SELECT o.*, {REPO.format('o_custkey')} AS repo,
                   concat({words(t.KINDS)}[o_orderkey % 8 + 1], '-', o_orderkey) AS workflow_name,
                   o_orderdate::DATE AS crawl_date, l.*
            FROM orders o JOIN (
                SELECT l_orderkey,
                       list(code ORDER BY code) AS steps,
                       list(DISTINCT trig ORDER BY trig) AS triggers,
                       list(DISTINCT runner ORDER BY runner) AS runs_on,
                       coalesce(list(DISTINCT mval ORDER BY mval) FILTER (WHERE mval IS NOT NULL), []) AS matrix_values,
                       bool_or(l_tax >= 0.08) AS reuses
                FROM (
                    SELECT l_orderkey, l_tax,
                           (l_linenumber % 8) * 1024
                           + (CASE WHEN l_partkey % 5 < 4 THEN l_partkey % 7
                                   ELSE 7 + (l_suppkey * 7 + l_linenumber) % 25 END) * 32
                           + (CASE WHEN l_quantity < 46 THEN l_partkey % 4
                                   ELSE 4 + (l_suppkey + l_linenumber) % 20 END) AS code,
                           CASE l_returnflag WHEN 'A' THEN 'push' WHEN 'N' THEN 'pull_request'
                                ELSE 'workflow_dispatch' END AS trig,
                           CASE l_linestatus WHEN 'O' THEN 'ubuntu-latest' ELSE 'macos-latest' END AS runner,
                           CASE WHEN l_quantity >= 36
                                THEN {words(t.MATRIX_VALUES)}[(l_linenumber + l_partkey) % 8 + 1] END AS mval
                    FROM lineitem)
                GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
            WHERE {keep}""",
        f"wf0{s}": f"""
            SELECT o_orderkey, o_orderstatus, o_orderpriority, repo, workflow_name, crawl_date, triggers, runs_on, matrix_values,
                   concat('.github/workflows/', workflow_name, '.yml') AS workflow_path,
                   concat('data/raw/', repo, '/', workflow_name, '.yml') AS source_file,
                   len(matrix_values) > 0 AS uses_matrix,
                   CASE WHEN len(matrix_values) > 0 THEN ['version'] ELSE []::VARCHAR[] END AS matrix_keys,
                   list_concat([concat('job', j) for j in
                                list_sort(list_distinct([c // 1024 for c in steps]))],
                               CASE WHEN reuses THEN ['shared'] ELSE []::VARCHAR[] END) AS job_names,
                   reuses AS uses_reusable_workflows,
                   CASE WHEN reuses THEN ['{t.SHARED_WORKFLOW}'] ELSE []::VARCHAR[] END AS reusable_workflows,
                   [{words(t.ACTIONS)}[(c // 32) % 32 + 1] for c in steps] AS actions_used,
                   o_orderstatus = 'F' AS has_permissions_block,
                   CASE WHEN o_orderstatus = 'F' THEN '{t.PERMISSIONS_JSON}' END AS permissions,
                   starts_with(o_orderpriority, '1') AS concurrency_set,
                   [concat('step', c // 1024) for c in steps] AS step_names,
                   [{words(t.COMMANDS)}[c % 32 + 1] for c in steps] AS run_commands
            FROM files{s}""",
        f"wf1{s}": f"""
            SELECT *, [split_part(a, '@', 1) for a in actions_used] AS actions_normalized,
                   len([a for a in actions_used if {has('a', rules.SCANNER_ACTIONS)}]) > 0 AS has_security_scan
            FROM wf0{s}""",
        f"wf{s}": f"""
            SELECT *, [a for a in actions_normalized if {has('a', rules.AI_ACTIONS_FALLBACK)}] AS ai_review_actions,
                   len([a for a in actions_normalized if {has('a', rules.AI_ACTIONS_FALLBACK)}]) > 0 AS has_ai_review
            FROM wf1{s}""",
        f"detail{s}": f"""
            SELECT repo, workflow_name, workflow_path, source_file, crawl_date, triggers, runs_on, matrix_keys, o_orderpriority,
                   matrix_values, step_names, run_commands, reusable_workflows, uses_matrix, uses_reusable_workflows,
                   job_names AS jobs, len(job_names) AS job_count, actions_normalized AS actions,
                   [a for a in actions_normalized if NOT list_contains({words(rules.COMMON_ACTIONS)}, a)
                    AND NOT starts_with(a, '.')] AS notable_actions,
                   has_permissions_block AS has_permissions, concurrency_set AS has_concurrency, has_ai_review,
                   has_security_scan
            FROM wf{s}""",
        f"texts{s}": f"""
            SELECT *, concat(workflow_name, chr(10), array_to_string(triggers, ' '), chr(10),
                             array_to_string(jobs, ' '), chr(10), array_to_string(actions, ' '), chr(10),
                             array_to_string(notable_actions, ' '), chr(10), array_to_string(runs_on, ' '), chr(10),
                             array_to_string(matrix_keys, ' '), chr(10), array_to_string(matrix_values, ' '), chr(10),
                             array_to_string(step_names, ' '), chr(10), array_to_string(run_commands, ' '), chr(10),
                             array_to_string(reusable_workflows, ' ')) AS txt,
                   concat(workflow_name, ' ', array_to_string(actions, ' '), ' ',
                          array_to_string(run_commands, ' '), ' ', array_to_string(step_names, ' ')) AS sectxt
            FROM detail{s}""",
        f"flags{s}": "SELECT *, "
        + ", ".join(f"({condition}) AS {col(slug)}" for slug, condition in FLAGS.items())
        + f", ({_RELEASE}) AS is_release, ({_DISPATCH}) AS is_dispatch, ({_SAMPLE}) AS is_sample FROM texts{s}",
    }


def fact_ctes(flags: str = "flags", s: str = "", by: str = "repo") -> dict[str, str]:
    """Repo tables over flagged workflows."""
    return {
        f"facts0{s}": f"SELECT {by}, count(*) AS workflow_count, bool_or(uses_matrix) AS has_matrix,"
        " bool_or(has_permissions) AS has_permissions, bool_or(has_security_scan) AS has_security_scan,"
        " bool_or(has_ai_review) AS has_ai_review,"
        " bool_or(len([a for a in actions if contains(lower(a), 'cache')]) > 0) AS has_cache,"
        " bool_or(has_concurrency) AS has_concurrency, bool_or(uses_reusable_workflows) AS has_reusable_workflows,"
        " count(*) FILTER (WHERE is_release) AS releases, count(*) FILTER (WHERE is_dispatch) AS dispatches,"
        " count(*) FILTER (WHERE is_sample) AS samples, "
        + ", ".join(f"count(*) FILTER (WHERE {col(slug)}) AS n{col(slug)}" for slug in FLAGS)
        + ", list_filter(["
        + ", ".join(
            f"CASE WHEN bool_or(regexp_matches(txt, '\\b{term}\\b', 'i')) THEN '{term}' END"
            for term in sorted(rules.BUILD_SYSTEMS)
        )
        + f"], lambda b: b IS NOT NULL) AS build_systems FROM {flags} GROUP BY {by}",
        f"facts{s}": f"SELECT *, {_PRACTICE_SUM} AS maturity_score,"
        f" round_even(({_PRACTICE_SUM})::DOUBLE / 6 * 100, 0)::BIGINT AS maturity_pct, "
        + ", ".join(f"n{col(slug)} > 0 AS {col(slug)}" for slug in FLAGS)
        + ", "
        + ", ".join(f"({condition}) AS {col(slug)}" for slug, condition in REPO_SLUGS.items())
        + ", "
        + ", ".join(f"0 AS n{col(slug)}" for slug in REPO_SLUGS)
        + f" FROM facts0{s}",
        f"pr{s}": " UNION ALL ".join(
            f"SELECT {by}, maturity_score, '{slug}' AS slug, n{col(slug)} AS hits FROM facts{s} WHERE {col(slug)}"
            for slug, *_ in rules.PATTERNS
        ),
    }


CTES: dict[str, str] = {
    **workflow_ctes(),
    **fact_ctes(),
    **workflow_ctes("_prev", "o_orderpriority <> '1-URGENT'"),
    **workflow_ctes("_curr", "o_orderpriority <> '5-LOW'"),
    # both snapshots over one chain: every file is flagged once
    "flags_snap": """
        SELECT f.*, snapshot FROM flags f
        JOIN (VALUES ('previous', '1-URGENT'), ('current', '5-LOW')) v(snapshot, absent) ON o_orderpriority <> absent""",
    **fact_ctes("flags_snap", "_snap", "snapshot, repo"),
    # six monthly snapshots
    "member_months": f"""
        SELECT DISTINCT l_orderkey AS month_key, make_date(2026, 1 + l_suppkey % {t.MONTHS}, 1) AS snapshot FROM lineitem""",
    "flags_month": """
        SELECT f.*, snapshot FROM flags f
        JOIN member_months ON month_key = split_part(workflow_name, '-', -1)::BIGINT""",
    **fact_ctes("flags_month", "_month", "snapshot, repo"),
    "wf_month": """
        SELECT repo, workflow_name, snapshot FROM wf
        JOIN member_months ON month_key = split_part(workflow_name, '-', -1)::BIGINT""",
    "practice_month": """
        SELECT DISTINCT snapshot, repo, metric FROM (
            SELECT snapshot, repo, unnest(['repos', CASE WHEN uses_matrix THEN 'uses_matrix' END,
                                           CASE WHEN has_permissions_block THEN 'has_permissions_block' END,
                                           CASE WHEN has_security_scan THEN 'has_security_scan' END,
                                           CASE WHEN has_ai_review THEN 'has_ai_review' END]) AS metric
            FROM wf JOIN member_months ON month_key = split_part(workflow_name, '-', -1)::BIGINT) WHERE metric IS NOT NULL""",
    "pdef": f"SELECT * FROM (VALUES {_rows(rules.PATTERNS)}) AS v(slug, name, category, tier)",
    "adoption": f"""
        SELECT pdef.slug, name, category, tier::BIGINT AS tier, coalesce(repos, 0) AS repo_count,
               coalesce(hits, 0)::BIGINT AS workflow_count,
               {pct('coalesce(repos, 0)', '(SELECT count(*) FROM facts)')} AS adoption_pct
        FROM pdef LEFT JOIN (SELECT slug, count(*) AS repos, sum(hits) AS hits FROM pr GROUP BY slug) USING (slug)""",
    # distinct tools per repo, told apart by case
    "tools": f"""
        SELECT DISTINCT repo, kind, tool FROM (
            SELECT repo, 'scanner' AS kind, a AS tool FROM (SELECT repo, unnest(actions) AS a FROM texts)
            WHERE {has('a', rules.SCANNERS)}
            UNION ALL
            SELECT repo, 'supply_chain', a FROM (SELECT repo, unnest(actions) AS a FROM texts)
            WHERE {has('a', rules.SUPPLY_CHAIN)}
            UNION ALL
            SELECT repo, 'supply_chain', unnest(regexp_extract_all(sectxt, {_SUPPLY}, 0, 'i')) FROM texts)""",
    "secfacts": f"""
        SELECT t.*, coalesce(scanners, 0) AS scanners, coalesce(supply, 0) AS supply_tools FROM (
            SELECT repo, count(*) AS workflow_count, count(*) FILTER (WHERE has_permissions) AS permitted,
                   bool_or({has('sectxt', rules.APP_TOKEN)}) AS app_token,
                   bool_or(regexp_matches(sectxt, '\\bPAT\\b|personal access token|GH_TOKEN|GITHUB_TOKEN', 'i'))
                       AS personal_token,
                   bool_or(len([a for a in actions if contains(lower(a), 'step-security/harden-runner')]) > 0)
                       AS hardened
            FROM texts GROUP BY repo) t
        LEFT JOIN (SELECT repo, count(*) FILTER (WHERE kind = 'scanner') AS scanners,
                          count(*) FILTER (WHERE kind = 'supply_chain') AS supply
                   FROM tools GROUP BY repo) USING (repo)""",
    "dims": """
        SELECT *, round_even(permitted::DOUBLE / workflow_count * 25, 2) AS permissions,
               round_even(least(scanners, 6)::DOUBLE / 6 * 25, 2) AS security_scan,
               round_even(least(supply_tools, 3)::DOUBLE / 3 * 20, 2) AS supply_chain,
               CASE WHEN app_token AND NOT personal_token THEN 15.0::DOUBLE WHEN app_token THEN 7.5::DOUBLE
                    ELSE 0.0::DOUBLE END AS secret_handling,
               CASE WHEN hardened THEN 15.0::DOUBLE ELSE 0.0::DOUBLE END AS harden_runner
        FROM secfacts""",
    "scores": """
        SELECT *, round_even(permissions + security_scan + supply_chain + secret_handling + harden_runner, 2) AS score
        FROM dims""",
    "counts": "SELECT unnest(actions_normalized) AS action, repo FROM wf",
    # repository metadata from customers
    "meta": f"""
        SELECT {REPO.format('c_custkey')} AS full_name, c_custkey,
               {words(t.DESCRIPTIONS)}[c_custkey % {len(t.DESCRIPTIONS)} + 1] AS description,
               CASE WHEN c_nationkey <> 3 THEN n_name END AS language,
               greatest(floor(c_acctbal), 0)::BIGINT AS stars, c_custkey % 50 AS forks,
               [{', '.join(words(topics) for topics in t.TOPIC_LISTS)}][c_custkey % {len(t.TOPIC_LISTS)} + 1] AS topics,
               {words(t.LICENSES)}[c_custkey % {len(t.LICENSES)} + 1] AS license,
               '2026-01-01T00:00:00Z' AS pushed_at, c_custkey % 17 = 0 AS archived,
               CASE WHEN c_custkey % 101 = 7 THEN 'HTTP 404' END AS error,
               coalesce(w.n, 0) AS workflow_count
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders
                   WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY o_custkey) w
               ON o_custkey = c_custkey""",
    "reasons": f"""
        SELECT *, coalesce(skip, gate) AS reason FROM (
            SELECT *, CASE
                WHEN list_contains({words(rules.SKIP_REPOS)}, full_name) THEN 'in skip list'
                WHEN archived THEN 'archived'
                WHEN coalesce(language, '') = '' THEN 'no programming language'
                WHEN len(list_intersect(topics, {words(rules.SKIP_TOPICS)})) > 0
                     AND (contains(lower(full_name), 'awesome')
                          OR regexp_matches(lower(description), 'curated list|collection of|list of'))
                THEN concat('skip keywords in topics: ',
                            array_to_string(list_sort(list_intersect(topics, {words(rules.SKIP_TOPICS)})), ', '))
                {' '.join(f"WHEN contains(lower(description), '{p}') THEN 'skip keyword in description: ''{p}'''"
                          for p in rules.SKIP_DESCRIPTION)}
                END AS skip,
                CASE WHEN workflow_count = 0 THEN 'no .github/workflows/'
                     WHEN workflow_count < 2
                     THEN concat('only ', workflow_count, ' workflow file (minimum 2)') END AS gate
            FROM meta)""",
    "cats": "SELECT *, CASE WHEN error IS NOT NULL THEN 'Error' "
    + " ".join(
        f"WHEN len(list_intersect(topics, {words(topics)})) > 0 THEN '{name}'"
        for name, topics in rules.TOPIC_CATEGORIES
    )
    + " "
    + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(description), '{p}')" for p in phrases) + f" THEN '{name}'"
        for name, phrases in rules.DESCRIPTION_CATEGORIES
    )
    + " ELSE 'Other' END AS category FROM meta",
    "verdicts": """
        SELECT *, CASE WHEN error IS NOT NULL THEN 'SKIP (error)' WHEN archived THEN 'SKIP (archived)'
                       WHEN coalesce(language, '') = '' THEN 'SKIP (no lang)' WHEN workflow_count = 0 THEN 'SKIP (no CI)'
                       WHEN workflow_count = 1 THEN 'SKIP (1 wf)'
                       WHEN category IN ('Awesome List', 'Education / Docs') THEN 'SKIP (not code)' ELSE 'OK' END
                  AS verdict
        FROM cats""",
    "research": f"""
        SELECT full_name FROM reasons WHERE reason IS NULL
        AND c_custkey IN (SELECT doc_id % {t.LINKED_REPOS} FROM documents)""",
    # file listings
    "variants": f"""
        SELECT o_custkey, o_orderpriority, {words(t.FILE_PATHS)}[(l_partkey + l_suppkey) % {len(t.FILE_PATHS)} + 1] AS path,
               l_partkey % 4 AS variant
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "listing": f"""
        SELECT {REPO.format('o_custkey')} AS repo, path, min(variant) AS variant,
               CASE WHEN list_contains({words(t.DIRECTORY_PATHS)}, path) THEN 'dir' ELSE 'file' END AS type
        FROM variants GROUP BY o_custkey, path""",
    "kinds": f"""
        SELECT repo, path, variant, CASE
            {' '.join(f"WHEN ends_with(lower(path), '{suffix}') THEN '{kind}'" for suffix, kind in rules.CONFIG_KINDS)}
            ELSE 'linter' END AS kind
        FROM listing WHERE list_contains({words(rules.CONFIG_PATHS)}, path) AND type = 'file'""",
    "hash_prev": f"""
        SELECT {REPO.format('o_custkey')} AS repo, path, md5(concat(path, min(variant))) AS sha
        FROM variants WHERE o_orderpriority <> '1-URGENT' GROUP BY o_custkey, path""",
    "hash_curr": f"""
        SELECT {REPO.format('o_custkey')} AS repo, path, md5(concat(path, min(variant))) AS sha
        FROM variants WHERE o_orderpriority <> '5-LOW' GROUP BY o_custkey, path""",
    "changes": """
        SELECT repo, path, c.sha,
               CASE WHEN p.sha IS NULL THEN 'new' WHEN p.sha = c.sha THEN 'unchanged' ELSE 'changed' END AS outcome
        FROM hash_curr c LEFT JOIN hash_prev p USING (repo, path)""",
    "signal_def": "SELECT * FROM (VALUES "
    + _rows((signal, path, i) for i, (signal, path) in enumerate(rules.FILE_SIGNALS))
    + ") AS v(signal, path, ordinal)",
    "structure_def": f"SELECT * FROM (VALUES {_rows(rules.STRUCTURE_SIGNALS)}) AS v(signal, path, type)",
}


def query(body: str) -> str:
    """The statement with the expressions it refers to, in dependency order."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN) (\w+)", sql)):
            if name in CTES and name not in needed:
                visit(CTES[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in needed) + "\n" + body
