"""Repository profiles: summary, metadata, patterns and score side by side."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelens.functions import text
from forgelens.operators import patterns


def _nonzero(metadata: DataFrame, *names: str) -> Column:
    """First of several number fields that is neither absent nor zero; the last one may be zero."""
    present = [name for name in names if name in metadata.columns]
    columns = [F.nullif(name, F.lit(0)) if name == names[0] else F.col(name) for name in present]
    return F.coalesce(*columns) if columns else F.lit(None).cast("bigint")


def repo_profiles(facts: DataFrame, scores: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row per repo.  All three inputs have one row per repo, so no join key repeats."""
    known = metadata.where(F.contains("full_name", F.lit("/"))).select(
        F.col("full_name").alias("repo"),
        F.coalesce("description", F.lit("")).alias("description"),
        _nonzero(metadata, "stars", "stargazers_count").alias("stars"),
        _nonzero(metadata, "forks", "forks_count").alias("forks"),
        "language",
        "license",
        "topics",
        "pushed_at",
    )
    summary = facts.select(
        "repo", "workflow_count", patterns.slugs_of().alias("patterns"), "maturity_pct"
    )
    joined = summary.join(known, "repo", "left").join(scores.select("repo", "score"), "repo", "left")
    description = F.coalesce("description", F.lit(""))
    return joined.select(
        "repo",
        text.repo_url(F.col("repo")).alias("url"),
        description.alias("description"),
        text.short_summary(description).alias("summary"),
        "stars",
        "forks",
        "language",
        "license",
        F.coalesce("topics", text.strings(())).alias("topics"),
        "pushed_at",
        "workflow_count",
        "patterns",
        F.col("score").alias("security_score"),
        "maturity_pct",
    )


def profile_documents(profiles: DataFrame) -> DataFrame:
    """Nested document per repo for the JSON sink."""
    cicd = F.struct("workflow_count", "patterns", "security_score", "maturity_pct")
    flat = [name for name in profiles.columns if name not in ("workflow_count", "patterns", "security_score", "maturity_pct")]
    return profiles.select(text.owner_of(F.col("repo")).alias("owner"), *flat, cicd.alias("cicd"))
