"""Registered queries: name to builder over the given tables.

Builders only declare plans.  ``Inputs`` derives the workflow-shaped tables from one scale-factor folder; arrays are
joined to text and positions widened so that results compare across engines.
"""

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelens import rules
from forgelens.functions import text
from forgelens.operators import (
    adoption,
    changes,
    distinct_state,
    extract,
    insights,
    lifetimes,
    lineage,
    name_search,
    patterns,
    profiles,
    quality,
    repos,
    reuse,
    security,
    seeds,
    serving,
    signals,
)
from forgelens.sources import tables
from forgelens.sources.workspace import shared_folder, written
from forgelens.streaming import versions

CRAWLED = "2026-01-01"
LAST_MONTH = f"2026-{tables.MONTHS:02d}-01"
SEPARATOR = "|"


class Inputs:
    """Tables of one folder; every attribute is a lazy plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _of(self, builder, *args) -> DataFrame:
        return builder(self.spark, self.sf_dir, *args)

    @cached_property
    def workflows(self) -> DataFrame:
        return self._of(tables.workflows)

    @cached_property
    def detail(self) -> DataFrame:
        return repos.workflow_detail(self.workflows)

    @cached_property
    def flags(self) -> DataFrame:
        return patterns.workflow_flags(self.detail)

    @cached_property
    def facts(self) -> DataFrame:
        return patterns.repo_facts(self.flags)

    @cached_property
    def scores(self) -> DataFrame:
        return security.security_scores(self.detail)

    @cached_property
    def raw_files(self) -> DataFrame:
        return self._of(tables.raw_files)

    @cached_property
    def parsed(self) -> DataFrame:
        return extract.parse(self.raw_files)

    @cached_property
    def scan(self) -> DataFrame:
        return extract.raw_text_scan(self.raw_files)

    @cached_property
    def metadata(self) -> DataFrame:
        return self._of(tables.counted_metadata)

    @cached_property
    def files(self) -> DataFrame:
        return self._of(tables.repo_files)

    @cached_property
    def configs(self) -> DataFrame:
        return signals.config_files(self.files)

    @cached_property
    def observed(self) -> DataFrame:
        return self._of(tables.repo_metadata).select(F.col("full_name").alias("repo"))

    @cached_property
    def descriptions(self) -> DataFrame:
        return extract.action_descriptions(self._of(tables.action_definitions))

    @cached_property
    def known_ai(self) -> DataFrame:
        """Workflows flagged by the table of discovered AI-review actions instead of by name."""
        return extract.with_known_ai_flags(
            self.workflows, adoption.ai_action_discovery(self.metadata, self.descriptions)
        )

    def snapshot(self, which: str) -> DataFrame:
        return self._of(tables.workflows, tables.snapshot_orders(which))

    def snapshots(self) -> tuple[DataFrame, DataFrame]:
        return self.snapshot("previous"), self.snapshot("current")

    @cached_property
    def pattern_changes(self) -> DataFrame:
        return changes.pattern_changes(patterns.of_snapshots(self.flags, self._of(tables.snapshot_files)))

    @cached_property
    def members(self) -> DataFrame:
        return self._of(tables.snapshot_members)

    @cached_property
    def pattern_members(self) -> DataFrame:
        return patterns.of_snapshots(self.flags, self.members)

    @cached_property
    def distinct_state(self) -> DataFrame:
        """Bitmaps of the repos of every monthly snapshot, by practice; written once, as snapshots would be."""
        flags = ("uses_matrix", "has_permissions_block", "has_security_scan", "has_ai_review")
        cells = ", ".join(f"CASE WHEN {name} THEN '{name}' END" for name in flags)
        dated = self.members.join(self.workflows.select("repo", "workflow_name", *flags), ["repo", "workflow_name"])
        metrics = F.explode(F.expr(f"array_compact(array('repos', {cells}))")).alias("metric")
        rows = written(dated.select("snapshot", metrics, "repo").distinct(), "practices")
        numbers = distinct_state.with_new_repos(self.spark.createDataFrame([], distinct_state.NUMBERS), rows)
        return written(distinct_state.state_of(rows, numbers), "distinct-state")

    @cached_property
    def chains(self) -> DataFrame:
        return reuse.closure(reuse.calls(self._of(tables.reuse_calls)))

    def merged_lifetimes(self) -> DataFrame:
        """Intervals of all snapshots but the last, merged with the last."""
        last = F.lit(LAST_MONTH).cast("date")
        before = lifetimes.lifetimes(self.members.where(F.col("snapshot") < last), "repo", "workflow_name")
        return lifetimes.merged(before, self.members.where(F.col("snapshot") == last), LAST_MONTH, "repo", "workflow_name")

    def seeds(self, which: str) -> DataFrame:
        """Repositories of a snapshot as a seed list."""
        return self.snapshot(which).select(F.col("repo").alias("full_name")).distinct()

    def recrawled(self) -> DataFrame:
        """Workflows with part of them delivered twice."""
        return self.workflows.unionByName(self._of(tables.workflows, F.col("o_orderstatus") == "P"))


def _joined(name: str) -> Column:
    return F.array_join(name, SEPARATOR).alias(name)


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as text, small integers as bigint, dates as text."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind.startswith("array"):
            columns.append(_joined(field.name))
        elif kind in ("int", "smallint", "tinyint"):
            columns.append(F.col(field.name).cast("bigint").alias(field.name))
        elif kind == "date":
            columns.append(F.col(field.name).cast("string").alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


def _seed_lists(x: Inputs) -> DataFrame:
    """Repositories as seed lists, one per owner."""
    names = x._of(tables.repo_metadata).select("full_name")
    return names.withColumn("list_name", text.owner_of(F.col("full_name")))


def _research(x: Inputs) -> DataFrame:
    """Accepted research candidates: repositories linked from documents that pass the checks."""
    links = seeds.repo_links(x._of(tables.linked_documents), "doc_id", "text")
    linked = links.select(F.concat("owner", F.lit("/"), "repo").alias("full_name"))
    return seeds.accepted(x.metadata).select("full_name").join(linked, "full_name", "left_semi")


def _extras(x: Inputs) -> DataFrame:
    """Pinned extras derived from suppliers: known, unknown and malformed entries."""
    key = F.col("s_suppkey")
    owner = F.when(key % 9 == 4, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("org"), (key % tables.OWNERS).cast("string"))
    )
    repo = F.when(key % 6 == 5, F.concat(F.lit("lost"), key.cast("string"))).otherwise(
        F.concat(F.lit("cust"), key.cast("string"))
    )
    return tables.table(x.spark, x.sf_dir, "supplier").select(owner.alias("owner"), repo.alias("repo"))


def _search(x: Inputs, rows: DataFrame, column: str, term: str) -> DataFrame:
    path = f"{shared_folder(x.spark)}/{column}-index-{uuid.uuid4().hex}"
    name_search.write_index(rows, column, path)
    return name_search.search(x.spark, path, term)


def _streamed_versions(x: Inputs) -> DataFrame:
    """Files as the keyed state has them after three batches, which hold observations of all times."""
    root = f"{shared_folder(x.spark)}/versions-{uuid.uuid4().hex}"
    landing = f"{root}/landing"
    x._of(tables.file_observations).write.partitionBy("part").parquet(landing)
    files = len(x.spark.read.schema(versions.OBSERVATION).parquet(landing).inputFiles())
    stream = x.spark.readStream.schema(versions.OBSERVATION).option("maxFilesPerTrigger", -(-files // 3)).parquet(landing)
    versions.start(stream, f"{root}/tables", f"{root}/checkpoint", parse=False).awaitTermination()
    return versions.current(x.spark, f"{root}/tables").select("repo", "file_name", "sha")


def _config_text() -> Column:
    """Fields of a parsed configuration file as one line; absent ones are left out."""
    names = {
        "tsconfig": ("extends", "strict", "module", "target", "resolution:module_resolution", "jsx", "paths:paths_configured"),
        "pyproject": (
            "name:project_name", "python:requires_python", "backend:build_backend", "ruff:uses_ruff",
            "pytest:uses_pytest", "uv:uses_uv",
        ),
        "cargo": ("workspace", "package:package_name", "edition", "members:workspace_members"),
        "pnpm_workspace": ("workspace", "globs:package_patterns", "count:package_pattern_count"),
        "turbo": ("tasks:task_count", "cache:uses_remote_cache"),
        "nx": ("plugins", "count:plugin_count", "inputs:named_inputs"),
        "linter": ("keys:top_level_keys", "rules:rule_count"),
    }
    lists = {"package_patterns", "plugins", "named_inputs", "top_level_keys"}
    cases = []
    for kind, fields in names.items():
        parts = []
        for field in fields:
            label, _, column = field.partition(":")
            column = column or label
            value = f"array_join({column}, ',')" if column in lists else f"cast({column} AS string)"
            parts.append(f"'{label}=' || {value}")
        cases.append(f"WHEN kind = '{kind}' THEN concat_ws(';', {', '.join(parts)})")
    return F.expr(f"CASE {' '.join(cases)} ELSE kind END")


def _described(x: Inputs) -> DataFrame:
    """Actions taken as described already: those of the build category."""
    return adoption.distinct_actions(x.workflows).where(adoption.action_category(F.col("action")) == "CI/Build")


def _diffs_on_shared(x: Inputs) -> DataFrame:
    return changes.two_snapshot_diffs(*changes.on_shared_repos(*x.snapshots()))


def _trend_counters(x: Inputs) -> DataFrame:
    files = x._of(tables.snapshot_files)
    return serving.trend_counters(
        changes.workflow_changes(*[files.where(F.col("snapshot") == which) for which in ("previous", "current")]),
        x.pattern_changes,
        x.configs,
        signals.structure_adoption(x.files, x.observed),
    )


def _examples(x: Inputs) -> DataFrame:
    return patterns.pattern_examples(x.detail)


def _pattern_query(slug: str) -> Callable[[Inputs], DataFrame]:
    if slug not in rules.REPO_LEVEL_PATTERNS:
        return lambda x: patterns.workflow_hits(patterns.workflow_flags(x.detail, (slug,)), slug).select("repo", "workflow_name")
    extra = {
        "multi-stage-release": "concat(release_workflows, '/', dispatch_workflows)",
        "multiple-build-systems": "array_join(build_systems, ',')",
        "per-sample-ci": "concat(workflow_count, '/', sample_workflows)",
    }[slug]
    return lambda x: patterns.repo_facts(patterns.workflow_flags(x.detail, (slug,))).where(patterns.flag(slug)).selectExpr(
        "repo", f"{extra} AS detail"
    )


def _month(column: str) -> Column:
    return F.date_format(column, "yyyy-MM")


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    # sources and extraction
    "workflow_table": lambda x: x.workflows,
    "extracted_workflows": lambda x: extract.workflows_from(x.parsed, F.lit(CRAWLED).cast("date")),
    "parse_errors": lambda x: extract.parse_errors(x.parsed).withColumn(
        "reason", F.substring_index("reason", ":", 1)
    ),
    "raw_text_scan": lambda x: x.scan,
    "triggers_usage": lambda x: adoption.list_usage(x.workflows, "triggers", "trigger"),
    "runner_usage": lambda x: adoption.list_usage(x.workflows, "runs_on", "runner"),
    "job_usage": lambda x: adoption.list_usage(x.workflows, "job_names", "job"),
    "matrix_value_usage": lambda x: adoption.list_usage(x.workflows, "matrix_values", "value"),
    "reusable_usage": lambda x: adoption.list_usage(x.workflows, "reusable_workflows", "workflow"),
    "actions_normalized": lambda x: adoption.list_usage(x.workflows, "actions_used", "used").withColumn(
        "action", text.normalized_action(F.col("used"))
    ),
    "ai_actions_regex": lambda x: x.workflows.where("has_ai_review").select(
        "repo", "workflow_name", "ai_review_actions"
    ),
    "ai_actions_known": lambda x: extract.with_known_ai_actions(
        x.workflows, adoption.ai_action_discovery(x.metadata, x.descriptions)
    ),
    "ai_tools_known": lambda x: adoption.ai_tool_breakdown(x.known_ai).select("action", "repo_count"),
    "adoption_counts_known": lambda x: adoption.adoption_counts(x.known_ai),
    "security_scan_flag": lambda x: x.workflows.where("has_security_scan").select("repo", "workflow_name"),
    "action_descriptions": lambda x: x.descriptions,
    # adoption
    "totals": lambda x: adoption.totals(x.workflows),
    "adoption_counts": lambda x: adoption.adoption_counts(x.workflows),
    "matrix_usage": lambda x: adoption.matrix_usage(x.workflows),
    "permissions_usage": lambda x: adoption.permissions_usage(x.workflows),
    "popular_actions": lambda x: adoption.popular_actions(x.workflows),
    "actions_categorized": lambda x: adoption.actions_categorized(
        adoption.popular_actions(x.workflows), x.descriptions
    ),
    "category_usage": lambda x: adoption.category_usage(x.workflows),
    "ai_adoption": lambda x: adoption.ai_adoption(x.workflows),
    "ai_tool_breakdown": lambda x: adoption.ai_tool_breakdown(x.workflows),
    "ai_repos_distinct": lambda x: adoption.ai_repos(x.workflows),
    "fingerprints": lambda x: adoption.fingerprints(x.workflows),
    "fingerprint_examples": lambda x: adoption.fingerprint_examples(x.workflows),
    "security_scan_adoption": lambda x: adoption.security_scan_repos(x.workflows),
    "distinct_actions": lambda x: adoption.distinct_actions(x.workflows),
    "actions_missing_desc": lambda x: adoption.missing_descriptions(x.workflows, _described(x)),
    "ai_action_discovery": lambda x: adoption.ai_action_discovery(x.metadata, x.descriptions),
    "action_share": lambda x: adoption.action_share(x.workflows),
    "insight_flags": lambda x: insights.insight_flags(x.workflows),
    "insight_flags_overall": lambda x: insights.insight_flags(
        x.workflows, F.when(F.col("repo").isNotNull(), "all")
    ),
    "recommendation_flags": lambda x: insights.recommendation_flags(x.workflows),
    "surprising_actions": lambda x: insights.surprising_actions(x.workflows),
    # repo summaries
    "workflow_detail": lambda x: x.detail.select(
        "repo", "workflow_name", "workflow_path", "source_file", "jobs", "job_count", "actions", "notable_actions"
    ),
    "notable_actions": lambda x: repos.notable_actions(x.detail),
    "repo_rollup": lambda x: repos.repo_rollup(x.detail),
    "repo_maturity": lambda x: repos.repo_maturity(x.detail).select(
        "repo", "maturity_score", "maturity_pct", "missing_en", "missing_zh"
    ),
    "missing_practices": lambda x: repos.missing_practices(x.detail),
    "repo_ranking": lambda x: repos.repo_ranking(x.detail),
    "maturity_histogram": lambda x: repos.maturity_histogram(x.detail),
    "practice_adoption": lambda x: repos.practice_adoption(x.detail),
    "practice_matrix": lambda x: repos.practice_matrix(x.detail),
    # patterns
    **{"pattern_" + slug.replace("-", "_"): _pattern_query(slug) for slug in patterns.ALL_SLUGS},
    "pattern_hits": lambda x: patterns.pattern_hits(x.flags),
    "pattern_adoption": lambda x: patterns.pattern_adoption(x.facts),
    "pattern_categories": lambda x: patterns.pattern_categories(x.facts),
    "pattern_totals": lambda x: patterns.pattern_totals(x.facts),
    "pattern_by_tier": lambda x: patterns.pattern_by_tier(x.facts),
    "pattern_examples": _examples,
    "pattern_top_repos": lambda x: patterns.pattern_top_repos(x.facts),
    "repo_patterns": lambda x: patterns.repo_patterns(x.facts),
    # security
    "sec_permissions": lambda x: x.scores.select("repo", "permitted", "workflow_count", "permissions"),
    "sec_scanners": lambda x: x.scores.select("repo", "scanners", "security_scan"),
    "sec_supply_chain": lambda x: x.scores.select("repo", "supply_tools", "supply_chain"),
    "sec_secrets": lambda x: x.scores.select("repo", "app_token", "personal_token", "secret_handling"),
    "sec_hardening": lambda x: x.scores.select("repo", "hardened", "harden_runner"),
    "security_scores": lambda x: x.scores.select("repo", *security.DIMENSIONS, "score"),
    "security_recommendations": lambda x: security.recommendations(x.scores),
    "security_average": lambda x: security.average(x.scores),
    "security_top": lambda x: security.top(x.scores),
    "security_bottom": lambda x: security.bottom(x.scores),
    "security_histogram": lambda x: security.histogram(x.scores),
    "security_median": lambda x: security.upper_median(x.scores),
    "security_tools": lambda x: security.security_tools(x.detail),
    "security_tool_usage": lambda x: security.tool_usage(x.detail),
    # quality
    "duplicate_count": lambda x: quality.duplicate_count(x.recrawled()),
    "duplicate_rows": lambda x: quality.duplicate_rows(x.recrawled()),
    "null_rates": lambda x: quality.null_rates(x.workflows),
    "quality_summary": lambda x: quality.quality_summary(x.recrawled()),
    "quality_missing_column": lambda x: quality.quality_summary(x.recrawled().drop("has_security_scan", "triggers")),
    "all_null_columns": lambda x: quality.all_null_columns(
        x.workflows.withColumn("triggers", F.when(F.size("triggers") < 0, F.col("triggers")))
    ),
    # changes
    "metric_diffs": lambda x: changes.metric_diffs(x.workflows, _month("crawl_date")),
    "metric_diffs_two": lambda x: changes.two_snapshot_diffs(*x.snapshots()),
    "workflows_added": lambda x: changes.workflows_added(*x.snapshots()),
    "workflows_removed": lambda x: changes.workflows_removed(*x.snapshots()),
    "workflow_lifetimes": lambda x: lifetimes.lifetimes(x.members, "repo", "workflow_name"),
    "workflow_lifetimes_merged": lambda x: x.merged_lifetimes(),
    "workflow_changes_between": lambda x: lifetimes.changes_between(
        lifetimes.lifetimes(x.members, "repo", "workflow_name"), "2026-02-01", "2026-05-01", "repo", "workflow_name"
    ),
    "pattern_lifetimes": lambda x: lifetimes.lifetimes(x.pattern_members, "repo", "slug"),
    "distinct_unions": lambda x: distinct_state.union_counts(x.distinct_state),
    "distinct_cumulative": lambda x: distinct_state.cumulative_counts(x.distinct_state),
    "distinct_shared": lambda x: distinct_state.shared_counts(x.distinct_state),
    "pattern_changes": lambda x: x.pattern_changes,
    "pattern_changed_repos": lambda x: changes.changed_repos(
        x.pattern_changes
    ),
    "pattern_changed_listed": lambda x: changes.changed_repos_listed(
        x.pattern_changes
    ),
    "trend_on_intersection": _diffs_on_shared,
    "previous_snapshot": lambda x: changes.previous_snapshot(
        x.workflows.withColumn("crawl_date", F.trunc("crawl_date", "month")), F.lit("1998-01-01").cast("date")
    ).select("repo", "workflow_name", "crawl_date"),
    # lineage and profiles
    "workflow_sources": lambda x: lineage.workflow_sources(x.detail),
    "repo_sources": lambda x: lineage.repo_sources(x.detail),
    "pattern_sources": lambda x: lineage.pattern_sources(_examples(x)),
    "repo_profiles": lambda x: profiles.repo_profiles(x.facts, x.scores, x.metadata),
    "short_summary": lambda x: tables.table(x.spark, x.sf_dir, "documents").select(
        "doc_id", text.short_summary(F.col("text")).alias("summary")
    ),
    "export_repos": lambda x: serving.repo_table(x.facts, x.scores),
    "export_patterns": lambda x: serving.pattern_table(x.facts),
    # seeds
    "link_extract": lambda x: seeds.repo_links(x._of(tables.linked_documents), "doc_id", "text"),
    "seed_metadata": lambda x: seeds.metadata_projection(x._of(tables.api_metadata)),
    "skip_reason": lambda x: x.metadata.select("full_name", seeds.skip_reason().alias("reason")),
    "workflow_gate": lambda x: x.metadata.select("full_name", seeds.workflow_gate().alias("reason")),
    "seed_accepted": lambda x: seeds.accepted(x.metadata).select("full_name", "stars", "workflow_count"),
    "skip_log": lambda x: seeds.skip_counts(seeds.skip_log(x.metadata, "search")),
    "seed_fill": lambda x: seeds.fill_to_target(_research(x), x.metadata),
    "seed_merge": lambda x: seeds.merge_extras(
        _research(x).withColumn("source", F.lit("research")), _extras(x), x.metadata
    ),
    "seed_fingerprint": lambda x: seeds.seed_fingerprints(_seed_lists(x), "list_name"),
    "seed_compare": lambda x: seeds.seed_compare(x.seeds("previous"), x.seeds("current")),
    "repo_category": lambda x: seeds.categorized(x.metadata).select("full_name", "category"),
    "category_stats": lambda x: seeds.category_stats(x.metadata),
    "language_stats": lambda x: seeds.language_stats(x.metadata),
    "seed_verdicts": lambda x: seeds.seed_verdicts(x.metadata),
    "seed_summary": lambda x: seeds.seed_summary(x.metadata),
    # repository signals
    "file_signals": lambda x: signals.file_signals(x.files),
    "file_signal_adoption": lambda x: signals.file_signal_adoption(x.files, x.observed),
    "config_kind": lambda x: signals.config_candidates(x.files).select("repo", "path", "kind"),
    "config_files": lambda x: x.configs.select("repo", "path", "kind", _config_text().alias("content")),
    "config_trends": lambda x: signals.config_trends(x.configs, x.observed),
    "config_counters": lambda x: signals.config_counters(x.configs),
    "build_backends": lambda x: signals.build_backends(x.configs),
    "structure_signals": lambda x: signals.structure_signals(x.files),
    "structure_adoption": lambda x: signals.structure_adoption(x.files, x.observed),
    "yaml_files": lambda x: signals.workflow_files(x.files).select("repo", "path"),
    "decoded_contents": lambda x: signals.decode_contents(
        tables.table(x.spark, x.sf_dir, "conversations").select(
            "conv_id",
            "turn",
            F.when(F.col("turn") % 5 != 4, F.base64(F.encode("text", "UTF-8"))).alias("content"),
            F.when(F.col("turn") % 3 != 2, "base64").otherwise("utf-8").alias("encoding"),
        )
    ).select("conv_id", "turn", "content", "error"),
    "incremental_changes": lambda x: signals.file_changes(
        x._of(tables.hashed_listing, "current"), x._of(tables.hashed_listing, "previous")
    ),
    "incremental_counts": lambda x: signals.change_counts(
        signals.file_changes(x._of(tables.hashed_listing, "current"), x._of(tables.hashed_listing, "previous"))
    ),
    "incremental_state": lambda x: signals.updated_state(
        x._of(tables.hashed_listing, "current"), x._of(tables.hashed_listing, "previous")
    ),
    "streamed_versions": _streamed_versions,
    "reusable_chains": lambda x: x.chains,
    "reusable_reach": lambda x: reuse.reach(x.chains),
    # serving
    "repo_list": lambda x: serving.repo_list(x.facts, x.scores),
    "repo_list_search": lambda x: serving.repo_list(x.facts, x.scores, " ORG7/ ", "maturity_pct"),
    "repo_search": lambda x: _search(x, x.workflows, "repo", " ORG7/cust1"),
    "action_search": lambda x: _search(x, x.workflows.select(F.explode("actions_used").alias("action")), "action", "Setup-"),
    "dashboard_patterns": lambda x: serving.dashboard_patterns(x.facts),
    "dashboard_actions": lambda x: serving.dashboard_actions(x.workflows),
    "dashboard_security": lambda x: serving.dashboard_security(x.scores),
    "repo_pair_diff": lambda x: serving.pair_practices(x._of(tables.repo_pairs), repos.practices(x.detail)),
    "repo_pair_workflows": lambda x: serving.pair_workflows(x._of(tables.repo_pairs), x.workflows),
    "repo_advice": lambda x: serving.repo_advice(x.detail, x.scores),
    "flaky_signal": lambda x: serving.flaky_signal(x.facts),
    "patterns_in_category": lambda x: serving.patterns_in_category(x.facts, "Testing Strategy"),
    "flaky_examples": lambda x: serving.examples_of(x.detail, "flaky-test-retry"),
    "health_check": lambda x: serving.health_check(x.scan),
    "trend_counters": _trend_counters,
    "workflow_raw_sources": lambda x: serving.raw_sources(x.detail, x.raw_files).select(
        "repo", "workflow_name", F.md5("content").alias("content_md5")
    ),
}


def build(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(QUERIES[name](Inputs(spark, sf_dir)))
