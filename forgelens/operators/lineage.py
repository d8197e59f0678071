"""From results back to source files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def workflow_sources(detail: DataFrame) -> DataFrame:
    """Source file of each workflow, its path when no file is known."""
    source = F.coalesce(F.nullif("source_file", F.lit("")), "workflow_path")
    return detail.select("repo", "workflow_name", "workflow_path", source.alias("source_file"))


def repo_sources(detail: DataFrame) -> DataFrame:
    """Distinct source files per repo, one per row: a repo's list has no bound."""
    sources = workflow_sources(detail).select("repo", "source_file")
    return sources.where(F.col("source_file").isNotNull() & (F.col("source_file") != "")).distinct()


def pattern_sources(examples: DataFrame) -> DataFrame:
    """Source files of pattern examples."""
    return examples.where(F.col("repo").isNotNull()).select(
        "slug", "position", "repo", "workflow_name", "workflow_path", "source_file"
    )
