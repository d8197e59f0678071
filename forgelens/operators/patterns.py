"""Practice patterns: 19 rules per workflow, 3 per repo.

The workflow text is built once per row and dropped right after the flags, so no text is ever shuffled.  Flags are
counted per repo with map-side combining, which gives every rollup from one table with one row per repo.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgelens import rules
from forgelens.functions import text
from forgelens.functions.literals import rule_table
from forgelens.functions.numeric import percentage
from forgelens.operators import repos
from forgelens.sources.workspace import written

WORKFLOW_SLUGS = tuple(slug for slug, *_ in rules.PATTERNS if slug not in rules.REPO_LEVEL_PATTERNS)
ALL_SLUGS = tuple(slug for slug, *_ in rules.PATTERNS)
EXAMPLES = 5
MANY = 4
_KEYS = ("repo", "workflow_name", "workflow_path", "source_file")


def flag(slug: str) -> str:
    """Column that holds a pattern's boolean."""
    return "is_" + slug.replace("-", "_")


def hits(slug: str) -> str:
    """Column that holds a repo's number of matching workflows."""
    return "n_" + slug.replace("-", "_")


def workflow_flags(detail: DataFrame, slugs: tuple[str, ...] = ALL_SLUGS) -> DataFrame:
    """Detail rows plus one boolean per workflow-level pattern and the helper flags of the repo-level ones.

    ``slugs`` tells which will be used: the pass that finds the marks of all words pays for many rules, not for one.
    """
    searched, marked = [], "_marks" if len(slugs) >= MANY else None

    def says(*terms: str) -> Column:
        searched.extend(terms)
        return text.mentions("_text", terms, "_items", marked)

    uses_ai, releases = F.col("_uses_ai"), F.col("is_release")
    shared = {"_uses_ai": F.col("has_ai_review") | says(*rules.AI_TOOLS_TEXT), "is_release": says(*rules.RELEASE)}
    versions = F.filter("matrix_values", lambda value: value.rlike(rf"(?U)\A(?:{rules.VERSION_VALUE})\z"))
    by_slug = {
        "ai-code-review": uses_ai,
        "ai-security-review": uses_ai & says(*rules.AI_SECURITY_TOPIC),
        "ai-contribution-audit": says(*rules.AI_AUDIT),
        "dogfooding": F.exists("actions", lambda action: F.lower(action).startswith(F.col("_owner_prefix"))),
        "security-scanning": F.col("has_security_scan") | says(*rules.SCANNERS),
        "container-signing": says(*rules.SUPPLY_CHAIN),
        "harden-runner": text.mentions("action_text", (rules.HARDENED_RUNNER,)),
        "least-privilege-permissions": F.col("has_permissions"),
        "hardware-matrix": F.col("uses_matrix") & text.mentions("_platforms", rules.HARDWARE),
        "chaos-engineering": says(*rules.CHAOS),
        "fuzz-randomized-testing": says(*rules.FUZZ),
        "flaky-test-retry": says(*rules.RETRY),
        "performance-tracking": says(*rules.PERFORMANCE),
        "python-future-testing": text.mentions("_matrix_text", (rules.PYTHON_NEXT, rules.PYTHON_FREE_THREADED))
        | (says(rules.PYTHON_NEXT) & says("python")),
        "multi-channel-release": releases & says(*rules.CHANNEL),
        "pr-package-preview": says(*rules.PREVIEW_PACKAGE),
        "reusable-workflows": F.col("uses_reusable_workflows"),
        "ecosystem-ci": says(*rules.ECOSYSTEM),
        "cross-version-compat": F.when(
            F.size("matrix_values") >= rules.MIN_VERSIONS, F.size(F.array_distinct(versions)) >= rules.MIN_VERSIONS
        ).otherwise(False),
    }
    events = F.transform("triggers", F.lower)
    columns = {flag(slug): condition for slug, condition in by_slug.items()}
    columns["is_dispatch"] = F.arrays_overlap(events, text.strings(rules.DISPATCH_TRIGGERS)) | says(
        *rules.DISPATCH_TEXT
    )
    columns["is_sample"] = says(*rules.SAMPLE)
    columns["_builds"] = text.words_found("_items", rules.BUILD_SYSTEMS, marked)
    # the text that may be spanned is built only where the items hold all words of a term
    texts = detail.withColumn("_raw_items", repos.workflow_items()).withColumns(
        {
            "_items": text.folded(F.col("_raw_items")),
            "_platforms": F.expr("lower(array_join(concat(matrix_keys, matrix_values, runs_on), '\\n'))"),
            "_matrix_text": F.expr("lower(array_join(matrix_values, '\\n'))"),
            "_owner_prefix": F.concat(F.lower(text.owner_of(F.col("repo"))), F.lit("/")),
        }
    )
    if marked:
        texts = texts.withColumn(marked, text.marks("_items", text.item_words((*searched, *rules.BUILD_SYSTEMS))))
    spans = text.may_span(searched, "_items", marked)
    texts = texts.withColumn("_raw", F.when(spans, repos.workflow_text()).otherwise(""))
    texts = texts.withColumn("_text", text.folded(F.col("_raw"))).withColumns(shared)
    helpers = ("_raw", "_raw_items", "_text", "_items", "_marks", "_platforms", "_matrix_text", "_owner_prefix", "_uses_ai")
    return texts.withColumns(columns).drop(*helpers)


def workflow_hits(flags: DataFrame, slug: str) -> DataFrame:
    """Workflows that match one workflow-level pattern; the other rules are pruned from the plan."""
    return flags.where(F.col(flag(slug))).select(*_KEYS)


def pattern_hits(flags: DataFrame) -> DataFrame:
    """Long form of all workflow-level hits: one row per workflow and pattern."""
    cells = _compact([(flag(slug), text.quoted(slug)) for slug in WORKFLOW_SLUGS])
    return flags.select(F.explode(cells).alias("slug"), *_KEYS)


def of_snapshots(flags: DataFrame, versions: DataFrame) -> DataFrame:
    """(snapshot, repo, slug) of the patterns that repos have in several snapshots; each file version is flagged once.

    ``versions`` holds (snapshot, repo, workflow_name).  A version's flags travel and are combined as the bits of one number.
    """
    packed = " | ".join(f"if({flag(slug)}, {1 << place}L, 0L)" for place, slug in enumerate(WORKFLOW_SLUGS))
    narrow = flags.select(
        "repo", "workflow_name", F.expr(packed).alias("_has"), "is_release", "is_dispatch", "is_sample", "_builds"
    )
    grouped = narrow.join(versions, ["repo", "workflow_name"]).groupBy("snapshot", "repo").agg(
        F.count("*").alias("workflow_count"), F.bit_or("_has").alias("_has"), *_repo_counts()
    )
    has = {flag(slug): F.expr(f"_has & {1 << place}L > 0") for place, slug in enumerate(WORKFLOW_SLUGS)}
    facts = grouped.withColumns(has).withColumn("build_systems", _systems()).withColumns(_repo_flags())
    return facts.select("snapshot", "repo", F.explode(slugs_of()).alias("slug"))


def _repo_counts() -> list[Column]:
    """What the repo-level patterns rest on, as aggregates."""
    counts = {"release_workflows": "is_release", "dispatch_workflows": "is_dispatch", "sample_workflows": "is_sample"}
    return [F.count_if(name).alias(alias) for alias, name in counts.items()] + [F.bit_or("_builds").alias("_builds")]


def _systems() -> Column:
    systems = [(f"_builds & {1 << i} > 0", text.quoted(term)) for i, term in enumerate(sorted(rules.BUILD_SYSTEMS))]
    return _compact(systems)


def _repo_flags() -> dict[str, Column]:
    """Repo-level patterns by the counts of a repo."""
    releases, dispatches = F.col("release_workflows"), F.col("dispatch_workflows")
    return {
        flag("multi-stage-release"): (releases >= rules.MIN_RELEASE_WORKFLOWS)
        | ((releases >= rules.MIN_RELEASE_WORKFLOWS_WITH_DISPATCH) & (dispatches > 0)),
        flag("multiple-build-systems"): F.size("build_systems") >= rules.MIN_BUILD_SYSTEMS,
        flag("per-sample-ci"): (F.col("workflow_count") >= rules.MIN_REPO_WORKFLOWS_FOR_SAMPLES)
        & (F.col("sample_workflows") >= rules.MIN_SAMPLE_WORKFLOWS),
    }


def repo_facts(flags: DataFrame, *by: str) -> DataFrame:
    """One row per repo (and snapshot): practices, maturity, hits per pattern, and which patterns it has."""
    aggregates = [column.alias(name) for name, column in repos.practice_aggregates().items()]
    aggregates += [F.count_if(flag(slug)).alias(hits(slug)) for slug in WORKFLOW_SLUGS]
    grouped = flags.groupBy(*by, "repo").agg(F.count("*").alias("workflow_count"), *aggregates, *_repo_counts())
    facts = grouped.withColumn("build_systems", _systems()).drop("_builds")
    has = {flag(slug): F.col(hits(slug)) > 0 for slug in WORKFLOW_SLUGS}
    has.update(_repo_flags())
    has.update({hits(slug): F.lit(0).cast("bigint") for slug in rules.REPO_LEVEL_PATTERNS})
    return repos.with_maturity(facts.withColumns(has))


def _compact(cases: list[tuple[str, str]]) -> Column:
    """Array of the values whose condition holds, in order; conditions and values are SQL text."""
    items = [f"CASE WHEN {condition} THEN {value} END" for condition, value in cases]
    return F.expr(f"array_compact(array({', '.join(items)}))")


def slugs_of() -> Column:
    """Sorted slugs of a repo-facts row."""
    return _compact([(flag(slug), text.quoted(slug)) for slug in sorted(ALL_SLUGS)])


def pattern_repos(facts: DataFrame, *by: str, slugs: tuple[str, ...] = ALL_SLUGS) -> DataFrame:
    """Long form: (repo, slug) of the patterns each repo has, with what the repo-level ones rest on."""
    details = {
        "multiple-build-systems": "array_join(build_systems, ',')",
        "per-sample-ci": "cast(sample_workflows AS string)",
    }
    cells = _compact(
        [
            (flag(slug), f"struct({text.quoted(slug)} AS slug, {details.get(slug, text.quoted(''))} AS detail)")
            for slug in slugs
        ]
    )
    return facts.select(*by, "repo", "maturity_score", F.inline(cells))


def repo_patterns(facts: DataFrame) -> DataFrame:
    slugs = slugs_of()
    return facts.select("repo", slugs.alias("slugs"), F.size(slugs).cast("bigint").alias("pattern_count"))


def _rollup(facts: DataFrame) -> DataFrame:
    """One row per pattern from a single aggregate row; patterns without hits stay with zeros."""
    members: dict[str, list[str]] = {}
    for slug, _, category, _ in rules.PATTERNS:
        members.setdefault(category, []).append(flag(slug))
    in_category = {name: f"c{i}" for i, name in enumerate(members)}
    counted = facts.agg(
        F.count("*").alias("total"),
        *[F.count_if(flag(slug)).alias(flag(slug)) for slug in ALL_SLUGS],
        *[F.expr(f"coalesce(sum({hits(slug)}), 0L) AS {hits(slug)}") for slug in ALL_SLUGS],
        *[F.expr(f"count_if({' OR '.join(flags)}) AS {in_category[name]}") for name, flags in members.items()],
    )
    cells = ", ".join(
        f"{text.quoted(slug)}, {text.quoted(name)}, {text.quoted(category)}, {tier}L,"
        f" {flag(slug)}, {hits(slug)}, {in_category[category]}"
        for slug, name, category, tier in rules.PATTERNS
    )
    names = "slug, name, category, tier, repo_count, workflow_count, category_repo_count"
    long = counted.selectExpr("total", f"stack({len(rules.PATTERNS)}, {cells}) AS ({names})")
    return long.withColumn("adoption_pct", percentage(F.col("repo_count"), F.col("total")))


def pattern_adoption(facts: DataFrame) -> DataFrame:
    """Repos, matching workflows and adoption of each pattern."""
    return _rollup(facts).select(
        "slug", "name", "category", "tier", "repo_count", "workflow_count", "adoption_pct"
    )


def pattern_categories(facts: DataFrame) -> DataFrame:
    """Patterns by category with the repos that have any of its patterns, most adopted first."""
    order = Window.partitionBy("category").orderBy(F.desc("repo_count"), "name")
    return _rollup(facts).select(
        "category",
        "category_repo_count",
        F.row_number().over(order).cast("bigint").alias("position"),
        "slug",
        "repo_count",
    )


def pattern_totals(facts: DataFrame) -> DataFrame:
    return pattern_adoption(facts).agg(
        F.count("*").alias("total_patterns"), F.count_if(F.col("repo_count") > 0).alias("detected_patterns")
    )


def pattern_by_tier(facts: DataFrame) -> DataFrame:
    return (
        pattern_adoption(facts)
        .groupBy("tier", "category")
        .agg(
            F.count("*").alias("patterns"),
            F.count_if(F.col("repo_count") > 0).alias("detected"),
            F.sum("workflow_count").alias("workflow_count"),
        )
    )


def top_repos(facts: DataFrame, limit: int, *order: Column, slugs: tuple[str, ...] = ALL_SLUGS) -> DataFrame:
    """First repos of each pattern; the row limit is applied before and after the shuffle."""
    window = Window.partitionBy("slug").orderBy(*order)
    ranked = pattern_repos(facts, slugs=slugs).withColumn("position", F.row_number().over(window).cast("bigint"))
    return ranked.where(F.col("position") <= limit)


def pattern_top_repos(facts: DataFrame, limit: int = 3) -> DataFrame:
    return top_repos(facts, limit, F.col("repo")).select("slug", "position", "repo")


def _written_flags(detail: DataFrame, slugs: tuple[str, ...]) -> DataFrame:
    """Keys, practices and flags of all workflows as a table; rules that ``slugs`` do not rest on are not evaluated."""
    practice = ("uses_matrix", "has_permissions", "has_security_scan", "has_ai_review", "uses_cache", "has_concurrency")
    rests_on = {
        "multi-stage-release": ("is_release", "is_dispatch"), "per-sample-ci": ("is_sample",), "multiple-build-systems": ("_builds",),
    }
    needed = {flag(slug) for slug in slugs} | {name for slug in slugs for name in rests_on.get(slug, ())}
    blank = {"_builds": F.lit(0)}
    own = [flag(slug) for slug in WORKFLOW_SLUGS] + ["is_release", "is_dispatch", "is_sample", "_builds"]
    flags = workflow_flags(detail, slugs).select(
        *_KEYS, *practice, "uses_reusable_workflows", *[name for name in own if name in needed]
    )
    absent = {name: blank.get(name, F.lit(False)) for name in own if name not in needed}
    return written(flags, "flags").withColumns(absent)


def pattern_examples(detail: DataFrame, limit: int = EXAMPLES, slugs: tuple[str, ...] = ALL_SLUGS) -> DataFrame:
    """First examples of each pattern by (maturity desc, repo, workflow); rules of other patterns are not evaluated.

    They lie in the first ``limit`` repos that have the pattern.  The rules run once: their flags are written with the keys
    (a narrow table, no text), the repos are picked from the per-repo counts of that table, and at most ``limit``
    workflows of each picked repo are read from it again.  A release train is one example that lists the names of its
    first release workflows.
    """
    train = "multi-stage-release"
    flags = _written_flags(detail, slugs)
    picked = top_repos(repo_facts(flags), limit, F.desc("maturity_score"), F.col("repo"), slugs=slugs).select(
        "slug", "repo", F.col("position").alias("repo_rank"), "detail"
    )
    cells = _compact(
        [(flag(slug), text.quoted(slug)) for slug in slugs if slug in WORKFLOW_SLUGS]
        + [("is_release", text.quoted(train))] * (train in slugs)
        or [("false", text.quoted(train))]  # repo-level patterns have no workflow rows
    )
    # the picked side has at most ``limit`` rows per pattern
    matches = flags.select(*_KEYS, F.explode(cells).alias("slug")).join(
        F.broadcast(picked.select("slug", "repo")), ["slug", "repo"], "left_semi"
    )
    within_repo = Window.partitionBy("slug", "repo").orderBy("workflow_name", "workflow_path")
    first = matches.withColumn("_n", F.row_number().over(within_repo)).where(F.col("_n") <= limit)
    # from here on a few hundred rows at most
    found = picked.join(F.broadcast(first), ["slug", "repo"], "left")
    by_repo = F.col("slug").isin(list(rules.REPO_LEVEL_PATTERNS))
    listed = F.array_join(F.sort_array(F.collect_list(F.struct("_n", "workflow_name")))["workflow_name"], ",")
    examples = found.groupBy("slug", "repo_rank", "repo", F.when(~by_repo, F.col("_n")).alias("_n1")).agg(
        *[F.min(name).alias(name) for name in (*_KEYS[1:], "detail")], listed.alias("_listed")
    )
    order = Window.partitionBy("slug").orderBy("repo_rank", "_n1")
    placed = examples.withColumn("position", F.row_number().over(order).cast("bigint"))
    detail = F.when(F.col("slug") == train, F.col("_listed")).otherwise(F.col("detail"))
    return placed.where(F.col("position") <= limit).select(
        "slug",
        "position",
        "repo",
        *[F.when(by_repo, F.lit("")).otherwise(F.col(name)).alias(name) for name in _KEYS[1:]],
        detail.alias("detail"),
    )
