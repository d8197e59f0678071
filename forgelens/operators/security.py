"""Security posture: five weighted dimensions per repo."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelens import rules
from forgelens.functions import text
from forgelens.functions.numeric import share
from forgelens.operators import repos

# weight and cap of each dimension (fixed values)
PERMISSIONS_WEIGHT = 25
SCANNER_WEIGHT, SCANNER_CAP = 25, 6
SUPPLY_WEIGHT, SUPPLY_CAP = 20, 3
SECRETS_FULL, SECRETS_PARTIAL = 15.0, 7.5
HARDENING = 15.0
LISTED = 10
BINS, BIN_WIDTH = 10, 10
DIMENSIONS = ("permissions", "security_scan", "supply_chain", "secret_handling", "harden_runner")


def tool_rows(detail: DataFrame) -> DataFrame:
    """One row per workflow (kind null) plus one per security tool it names.

    Supply-chain tools are matching actions and the matched words of the text, told apart by case.
    """
    pattern = text.ignore_case(text.pattern_of(rules.SUPPLY_CHAIN))
    says_supply = text.mentions("_folded", rules.SUPPLY_CHAIN)
    words = F.when(says_supply, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(text.strings(()))
    scanners = text.only_matching("actions", rules.SCANNERS, text.mentions("action_text", rules.SCANNERS))
    supply = text.only_matching("actions", rules.SUPPLY_CHAIN, text.mentions("action_text", rules.SUPPLY_CHAIN))
    word = rules.PERSONAL_TOKEN_WORD
    personal = text.mentions("_folded", rules.PERSONAL_TOKEN) | (
        text.mentions("_folded", (word,)) & F.col("_folded").rlike(text.whole_word((word,)))
    )
    texts = detail.withColumn("_text", repos.security_text()).withColumn("_folded", text.folded(F.col("_text")))
    named = texts.select(
        "repo",
        "has_permissions",
        text.mentions("_folded", rules.APP_TOKEN).alias("app_token"),
        personal.alias("personal_token"),
        text.mentions("action_text", (rules.HARDENED_RUNNER,)).alias("hardened"),
        F.array_distinct(scanners).alias("_scanners"),
        F.array_distinct(F.concat(supply, words)).alias("_supply"),
    )
    facts = F.expr(
        "concat(array(struct(cast(NULL AS string) AS kind, cast(NULL AS string) AS tool)),"
        " transform(_scanners, tool -> struct('scanner' AS kind, tool AS tool)),"
        " transform(_supply, tool -> struct('supply_chain' AS kind, tool AS tool)))"
    )
    return named.select("repo", "has_permissions", "app_token", "personal_token", "hardened", F.inline(facts))


def security_facts(detail: DataFrame) -> DataFrame:
    """One row per repo with the counts and flags the score rests on.

    First grouped by (repo, kind, tool), which spreads a large repo and removes repeats, then by repo.
    """
    per_tool = (
        tool_rows(detail)
        .groupBy("repo", "kind", "tool")
        .agg(
            F.count("*").alias("rows"),
            F.count_if("has_permissions").alias("permitted"),
            F.bool_or("app_token").alias("app_token"),
            F.bool_or("personal_token").alias("personal_token"),
            F.bool_or("hardened").alias("hardened"),
        )
    )
    itself = F.col("kind").isNull()
    return per_tool.groupBy("repo").agg(
        F.sum(F.when(itself, F.col("rows"))).alias("workflow_count"),
        F.sum(F.when(itself, F.col("permitted"))).alias("permitted"),
        F.count_if(F.col("kind") == "scanner").alias("scanners"),
        F.count_if(F.col("kind") == "supply_chain").alias("supply_tools"),
        F.bool_or("app_token").alias("app_token"),
        F.bool_or("personal_token").alias("personal_token"),
        F.bool_or("hardened").alias("hardened"),
    )


def security_tools(detail: DataFrame) -> DataFrame:
    """Distinct security tools of each repo, one per row."""
    return tool_rows(detail).where(F.col("kind").isNotNull()).select("repo", "kind", "tool").distinct()


def security_scores(detail: DataFrame) -> DataFrame:
    facts = security_facts(detail)

    def capped(count: str, cap: int, weight: int) -> Column:
        return F.bround(F.least(F.col(count), F.lit(cap)).cast("double") / cap * weight, 2)

    rate = share(F.col("permitted"), F.col("workflow_count"))
    secrets = (
        F.when(F.col("app_token") & ~F.col("personal_token"), SECRETS_FULL)
        .when(F.col("app_token"), SECRETS_PARTIAL)
        .otherwise(0.0)
    )
    scored = facts.withColumns(
        {
            "permissions": F.bround(rate * PERMISSIONS_WEIGHT, 2),
            "security_scan": capped("scanners", SCANNER_CAP, SCANNER_WEIGHT),
            "supply_chain": capped("supply_tools", SUPPLY_CAP, SUPPLY_WEIGHT),
            "secret_handling": secrets,
            "harden_runner": F.when(F.col("hardened"), HARDENING).otherwise(0.0),
        }
    )
    total = F.lit(0.0)
    for dimension in DIMENSIONS:
        total = total + F.col(dimension)
    return scored.withColumn("score", F.bround(total, 2))


def recommendations(scores: DataFrame) -> DataFrame:
    """Advice per repo in report order, one row each."""
    return scores.select("repo", F.posexplode(advice()).alias("position", "advice"))


def advice() -> Column:
    """Advice keys of a score row, as an ordered array."""
    conditions = {
        "permissions": F.col("permitted") < F.col("workflow_count"),
        "scanner": F.col("scanners") == 0,
        "supply_chain": F.col("supply_tools") == 0,
        "app_token": ~F.col("app_token"),
        "harden_runner": ~F.col("hardened"),
    }
    return F.array_compact(F.array(*[F.when(conditions[key], F.lit(key)) for key in rules.SECURITY_ADVICE]))


def average(scores: DataFrame) -> DataFrame:
    """Mean score; summed as exact decimals so that the result does not depend on the order of addition."""
    cents = F.sum(F.col("score").cast("decimal(18,2)")).cast("double")
    return scores.agg(
        F.coalesce(F.bround(F.try_divide(cents, F.count("*")), 2), F.lit(0.0)).alias("average_score")
    )


def top(scores: DataFrame, limit: int = LISTED) -> DataFrame:
    return scores.orderBy(F.desc("score"), "repo").limit(limit).select("repo", "score")


def bottom(scores: DataFrame, limit: int = LISTED) -> DataFrame:
    """Lowest scores, worst first; ties the other way round than in the top list."""
    return scores.orderBy("score", F.desc("repo")).limit(limit).select("repo", "score")


def histogram(scores: DataFrame) -> DataFrame:
    """Ten bins over 0 to 100; values outside go to the end bins and empty bins stay."""
    slot = F.least(F.greatest(F.floor(F.col("score") / BIN_WIDTH), F.lit(0)), F.lit(BINS - 1))
    counts = scores.where(F.col("score").isNotNull()).groupBy(slot.alias("bin")).agg(F.count("*").alias("_n"))
    bins = scores.sparkSession.range(BINS).withColumnRenamed("id", "bin")
    # at most ten rows on either side
    joined = bins.join(F.broadcast(counts), "bin", "left")
    return joined.select("bin", F.coalesce("_n", F.lit(0)).alias("repo_count"))


def upper_median(scores: DataFrame) -> DataFrame:
    """Upper median: the discrete middle counted from the top.  Works on counts per distinct score."""
    return scores.agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY score DESC)").alias("median_score")
    )


def tool_usage(detail: DataFrame) -> DataFrame:
    """Repos per security tool."""
    return security_tools(detail).groupBy("kind", "tool").agg(F.count("*").alias("repo_count"))
