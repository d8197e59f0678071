"""Fixed schemas of the tables that jobs exchange."""

from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())

WORKFLOW = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("workflow_name", T.StringType()),
        T.StructField("workflow_path", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("crawl_date", T.DateType()),
        T.StructField("triggers", _STRINGS),
        T.StructField("job_names", _STRINGS),
        T.StructField("uses_matrix", T.BooleanType()),
        T.StructField("matrix_keys", _STRINGS),
        T.StructField("matrix_values", _STRINGS),
        T.StructField("uses_reusable_workflows", T.BooleanType()),
        T.StructField("reusable_workflows", _STRINGS),
        T.StructField("actions_used", _STRINGS),
        T.StructField("actions_normalized", _STRINGS),
        T.StructField("has_permissions_block", T.BooleanType()),
        T.StructField("permissions", T.StringType()),
        T.StructField("runs_on", _STRINGS),
        T.StructField("concurrency_set", T.BooleanType()),
        T.StructField("ai_review_actions", _STRINGS),
        T.StructField("has_ai_review", T.BooleanType()),
        T.StructField("has_security_scan", T.BooleanType()),
        T.StructField("step_names", _STRINGS),
        T.StructField("run_commands", _STRINGS),
    ]
)

RAW_FILE = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

# what the YAML worker returns; the remaining workflow columns are expressions over these
PARSED = T.StructType(
    RAW_FILE.fields[:3]
    + [
        T.StructField("triggers", _STRINGS),
        T.StructField("job_names", _STRINGS),
        T.StructField("uses_matrix", T.BooleanType()),
        T.StructField("matrix_keys", _STRINGS),
        T.StructField("matrix_values", _STRINGS),
        T.StructField("reusable_workflows", _STRINGS),
        T.StructField("actions_used", _STRINGS),
        T.StructField("has_permissions_block", T.BooleanType()),
        T.StructField("permissions", T.StringType()),
        T.StructField("runs_on", _STRINGS),
        T.StructField("concurrency_set", T.BooleanType()),
        T.StructField("step_names", _STRINGS),
        T.StructField("run_commands", _STRINGS),
        T.StructField("_error", T.StringType()),
    ]
)

SEED = T.StructType(
    [T.StructField("owner", T.StringType()), T.StructField("repo", T.StringType())]
)

METADATA = T.StructType(
    [
        T.StructField("full_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("stars", T.LongType()),
        T.StructField("forks", T.LongType()),
        T.StructField("open_issues", T.LongType()),
        T.StructField("topics", _STRINGS),
        T.StructField("license", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("updated_at", T.StringType()),
        T.StructField("pushed_at", T.StringType()),
        T.StructField("archived", T.BooleanType()),
        T.StructField("default_branch", T.StringType()),
    ]
)

REPO_FILE = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("entries", _STRINGS),
    ]
)

CONFIG = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("extends", T.StringType()),
        T.StructField("strict", T.BooleanType()),
        T.StructField("module", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("module_resolution", T.StringType()),
        T.StructField("jsx", T.StringType()),
        T.StructField("paths_configured", T.BooleanType()),
        T.StructField("project_name", T.StringType()),
        T.StructField("requires_python", T.StringType()),
        T.StructField("build_backend", T.StringType()),
        T.StructField("uses_ruff", T.BooleanType()),
        T.StructField("uses_pytest", T.BooleanType()),
        T.StructField("uses_uv", T.BooleanType()),
        T.StructField("workspace", T.BooleanType()),
        T.StructField("package_name", T.StringType()),
        T.StructField("edition", T.StringType()),
        T.StructField("workspace_members", T.LongType()),
        T.StructField("package_patterns", _STRINGS),
        T.StructField("package_pattern_count", T.LongType()),
        T.StructField("task_count", T.LongType()),
        T.StructField("uses_remote_cache", T.BooleanType()),
        T.StructField("plugins", _STRINGS),
        T.StructField("plugin_count", T.LongType()),
        T.StructField("named_inputs", _STRINGS),
        T.StructField("top_level_keys", _STRINGS),
        T.StructField("rule_count", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)
