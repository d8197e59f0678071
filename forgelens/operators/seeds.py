"""Curation of the list of repositories to look at."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgelens import rules, schemas
from forgelens.functions import text
from forgelens.functions.numeric import count_true
from forgelens.functions.ranking import numbered
from forgelens.operators.changes import membership

FINGERPRINT_LENGTH = 16
TOP_LANGUAGES = 15
SHOWN_TOPICS = 4
DESCRIPTION_LIMIT = 200


# --- candidates from text -------------------------------------------------------
def repo_links(documents: DataFrame, key: str, body: str) -> DataFrame:
    """Distinct repositories linked from Markdown texts, with the place each was first seen."""
    linked = documents.select(
        F.col(key).alias("document"),
        F.posexplode(F.regexp_extract_all(body, F.lit(rules.REPO_LINK), F.lit(1))).alias("place", "full_name"),
    )
    first = linked.groupBy("full_name").agg(F.min(F.struct("document", "place")).alias("first"))
    return first.select(
        text.owner_of(F.col("full_name")).alias("owner"),
        F.substring_index("full_name", "/", -1).alias("repo"),
        F.col("first.document").alias("first_document"),
        F.col("first.place").cast("bigint").alias("first_place"),
    )


# --- metadata and filters ---------------------------------------------------------
def metadata_projection(raw: DataFrame) -> DataFrame:
    """The 13 metadata fields from an API-shaped table, with defaults; long descriptions are cut."""

    def field(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    return raw.select(
        field("full_name", "").alias("full_name"),
        F.substring(field("description", ""), 1, DESCRIPTION_LIMIT).alias("description"),
        field("language", "").alias("language"),
        field("stargazers_count", 0).cast("bigint").alias("stars"),
        field("forks_count", 0).cast("bigint").alias("forks"),
        field("open_issues_count", 0).cast("bigint").alias("open_issues"),
        F.coalesce("topics", text.strings(())).alias("topics"),
        F.coalesce("license.spdx_id", F.lit("")).alias("license"),
        field("created_at", "").alias("created_at"),
        field("updated_at", "").alias("updated_at"),
        field("pushed_at", "").alias("pushed_at"),
        field("archived", False).alias("archived"),
        field("default_branch", "main").alias("default_branch"),
    ).select(*schemas.METADATA.names)


def _contains_any(column: Column, phrases) -> Column:
    condition = F.lit(False)
    for phrase in phrases:
        condition = condition | F.contains(column, F.lit(phrase))
    return condition


def _no_language() -> Column:
    return F.coalesce(F.col("language"), F.lit("")) == ""


def skip_reason() -> Column:
    """Why a repository is not a candidate, or null; the first reason that applies."""
    name = F.col("full_name")
    description = F.lower(F.coalesce("description", F.lit("")))
    topics = F.transform(F.coalesce("topics", text.strings(())), F.lower)
    listed = F.array_sort(F.array_intersect(topics, text.strings(rules.SKIP_TOPICS)))
    likely_list = F.contains(F.lower(name), F.lit("awesome")) | _contains_any(description, rules.LIST_DESCRIPTION)
    reason = (
        F.when(name.isin(list(rules.SKIP_REPOS)), "in skip list")
        .when(F.coalesce("archived", F.lit(False)), "archived")
        .when(_no_language(), "no programming language")
        .when(
            (F.size(listed) > 0) & likely_list,
            F.concat(F.lit("skip keywords in topics: "), F.array_join(listed, ", ")),
        )
    )
    for phrase in rules.SKIP_DESCRIPTION:
        reason = reason.when(
            F.contains(description, F.lit(phrase)), F.lit(f"skip keyword in description: '{phrase}'")
        )
    return reason


def workflow_gate() -> Column:
    """Why a repository has too few workflow files, or null."""
    count = F.coalesce("workflow_count", F.lit(0))
    return F.when(count == 0, "no .github/workflows/").when(
        count < rules.MIN_WORKFLOW_FILES,
        F.concat(
            F.lit("only "),
            count.cast("string"),
            F.lit(f" workflow file (minimum {rules.MIN_WORKFLOW_FILES})"),
        ),
    )


def with_reason(metadata: DataFrame) -> DataFrame:
    """Add ``reason``: null for accepted repositories."""
    return metadata.withColumn("reason", F.coalesce(skip_reason(), workflow_gate()))


def accepted(metadata: DataFrame) -> DataFrame:
    return with_reason(metadata).where(F.col("reason").isNull()).drop("reason")


def skip_log(metadata: DataFrame, source: str) -> DataFrame:
    rejected = with_reason(metadata).where(F.col("reason").isNotNull())
    return rejected.select(F.col("full_name").alias("repo"), F.lit(source).alias("source"), "reason")


def skip_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("source", "reason").agg(F.count("*").alias("repos"))


def fill_to_target(accepted: DataFrame, candidates: DataFrame, target: int = rules.SEED_TARGET) -> DataFrame:
    """Accepted repositories plus the most starred acceptable candidates until the target is reached.

    Only ``target`` candidates can ever be needed, so a top-k keeps that many and the numbering runs over those.
    """
    usable = candidates.where(~_no_language() & ~F.coalesce("archived", F.lit(False)))
    valid = with_reason(usable).where(F.col("reason").isNull()).select("full_name", "stars")
    fresh = valid.dropDuplicates(["full_name"]).join(accepted.select("full_name"), "full_name", "left_anti")
    best = fresh.orderBy(F.desc("stars"), "full_name").limit(target)
    numbered = best.withColumn(
        "_n", F.row_number().over(Window.partitionBy().orderBy(F.desc("stars"), "full_name"))
    )
    taken = accepted.agg(F.count("*").alias("n")).select("n").scalar()
    filled = numbered.where(F.col("_n") <= F.lit(target) - taken)
    return accepted.select("full_name", F.lit("research").alias("source")).unionByName(
        filled.select("full_name", F.lit("search").alias("source"))
    )


def merge_extras(baseline: DataFrame, extras: DataFrame, metadata: DataFrame) -> DataFrame:
    """Baseline plus pinned extras (owner, repo), never cut by the target; unusable extras carry their reason."""
    named = extras.where(
        (F.coalesce("owner", F.lit("")) != "") & (F.coalesce("repo", F.lit("")) != "")
    ).select(F.concat("owner", F.lit("/"), "repo").alias("full_name"))
    fresh = named.distinct().join(baseline.select("full_name"), "full_name", "left_anti")
    known = with_reason(metadata).select("full_name", "reason", F.lit(True).alias("_known"))
    checked = fresh.join(known, "full_name", "left")
    reason = F.when(F.col("_known").isNull(), "not found on GitHub").otherwise(F.col("reason"))
    return baseline.select("full_name", "source", F.lit(None).cast("string").alias("reason")).unionByName(
        checked.select("full_name", F.lit("manual").alias("source"), reason.alias("reason"))
    )


# --- list identity ------------------------------------------------------------------
def seed_names(seeds: DataFrame) -> DataFrame:
    """Distinct owner/repo names of well-formed entries."""
    formed = seeds.where((F.coalesce("owner", F.lit("")) != "") & (F.coalesce("repo", F.lit("")) != ""))
    return formed.select(F.concat("owner", F.lit("/"), "repo").alias("full_name")).distinct()


def seed_fingerprints(names: DataFrame, group: str) -> DataFrame:
    """Fingerprints of each named list: (group, full_name) in, one row per group out; order and repeats do not matter.

    ``fingerprint`` is the sha256 of the sorted names, one a line, as stored lists carry it: a list is one text in one
    task, which suits curated lists.  ``additive`` identifies lists of any length: the sha256 of every name is cut
    into eight 32-bit numbers, and the number of names and the eight sums, which combine map-side, are hashed.
    """
    distinct = names.select(group, "full_name").distinct().withColumn("_hash", F.sha2("full_name", 256))
    parts = [F.conv(F.substring("_hash", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    summed = distinct.groupBy(group).agg(
        F.count("*").alias("names"),
        F.expr("listagg(full_name, '\\n') WITHIN GROUP (ORDER BY full_name)").alias("_names"),
        *[F.sum(part).cast("string").alias(f"_p{i}") for i, part in enumerate(parts)]
    )
    joined = F.concat_ws(",", F.col("names").cast("string"), *[f"_p{i}" for i in range(8)])
    digest = {"fingerprint": F.col("_names"), "additive": joined}
    return summed.select(
        group, "names", *[F.substring(F.sha2(value, 256), 1, FINGERPRINT_LENGTH).alias(name) for name, value in digest.items()]
    )


def seed_compare(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Side of each name of two lists: both, previous or current."""
    side = (
        F.when(F.col("in_previous") & F.col("in_current"), "intersection")
        .when(F.col("in_previous"), "previous_only")
        .otherwise("current_only")
    )
    return membership(previous, current, "full_name").select("full_name", side.alias("side"))


# --- overview -------------------------------------------------------------------------
def repo_category() -> Column:
    """Category by topics, else by description words; failed lookups first."""
    topics = F.transform(F.coalesce("topics", text.strings(())), F.lower)
    description = F.lower(F.coalesce("description", F.lit("")))
    category = F.when(F.col("error").isNotNull(), "Error")
    for name, words in rules.TOPIC_CATEGORIES:
        category = category.when(F.arrays_overlap(topics, text.strings(words)), name)
    for name, words in rules.DESCRIPTION_CATEGORIES:
        category = category.when(_contains_any(description, words), name)
    return category.otherwise("Other")


def categorized(metadata: DataFrame) -> DataFrame:
    return metadata.withColumn("category", repo_category())


def category_stats(metadata: DataFrame) -> DataFrame:
    grouped = categorized(metadata).groupBy("category")
    count = F.coalesce("workflow_count", F.lit(0))
    return grouped.agg(
        F.count("*").alias("repos"),
        F.count_if(count >= rules.MIN_WORKFLOW_FILES).alias("with_workflows"),
        F.count_if(count == 0).alias("without_workflows"),
        F.sum(F.coalesce("stars", F.lit(0))).alias("_stars"),
    ).select(
        "category", "repos", "with_workflows", "without_workflows", F.expr("_stars div repos AS average_stars")
    )


def language_stats(metadata: DataFrame, limit: int = TOP_LANGUAGES) -> DataFrame:
    language = F.when(_no_language(), "(none)").otherwise(F.col("language"))
    counted = metadata.groupBy(language.alias("language")).agg(F.count("*").alias("repos"))
    return counted.orderBy(F.desc("repos"), "language").limit(limit)


def verdict() -> Column:
    count = F.coalesce("workflow_count", F.lit(0))
    return (
        F.when(F.col("error").isNotNull(), "SKIP (error)")
        .when(F.coalesce("archived", F.lit(False)), "SKIP (archived)")
        .when(_no_language(), "SKIP (no lang)")
        .when(count == 0, "SKIP (no CI)")
        .when(count == 1, "SKIP (1 wf)")
        .when(F.col("category").isin(list(rules.NON_CODE_CATEGORIES)), "SKIP (not code)")
        .otherwise("OK")
    )


def seed_verdicts(metadata: DataFrame) -> DataFrame:
    """Listing per category by stars, with place, first topics and verdict."""
    listed = categorized(metadata).select(
        "category",
        "full_name",
        F.coalesce("stars", F.lit(0)).alias("stars"),
        F.slice(F.coalesce("topics", text.strings(())), 1, SHOWN_TOPICS).alias("topics"),
        verdict().alias("verdict"),
    )
    return numbered(listed, [("stars", True), ("full_name", False)], "position", ("category",))


def seed_summary(metadata: DataFrame) -> DataFrame:
    """Counters of the overview in one pass."""
    count = F.coalesce("workflow_count", F.lit(0))
    sound = F.col("error").isNull()
    return categorized(metadata).agg(
        F.count("*").alias("total"),
        F.count_if(count >= rules.MIN_WORKFLOW_FILES).alias("workflows_2_or_more"),
        F.count_if(count == 1).alias("workflows_1"),
        F.count_if((count == 0) & sound).alias("workflows_0"),
        F.count_if(_no_language() & sound).alias("no_language"),
        count_true(F.col("archived")).alias("archived"),
        F.count_if(~sound).alias("errors"),
        F.count_if(verdict() == "OK").alias("ok"),
        F.count_if(verdict() != "OK").alias("skip"),
    )
