"""Data-quality checks of the workflow table, each in one pass over it."""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from forgelens import rules
from forgelens.functions.numeric import percentage


class ContractViolation(ValueError):
    """The table breaks its contract; ``issues`` says how."""

    def __init__(self, issues: list[str]):
        super().__init__("; ".join(issues))
        self.issues = issues


def missing_columns(df: DataFrame) -> list[str]:
    return sorted(set(rules.EXPECTED_COLUMNS) - set(df.columns))


def _has_key(df: DataFrame) -> bool:
    return set(rules.WORKFLOW_KEY) <= set(df.columns)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*rules.WORKFLOW_KEY).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of their key."""
    extra = F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))
    return duplicate_rows(df).agg(extra.alias("duplicate_count"))


def null_rates(df: DataFrame) -> DataFrame:
    """Share of nulls per column in percent: one aggregate row, unpivoted."""
    names = sorted(df.columns)
    counted = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(name).isNull()).alias(name) for name in names])
    cells = ", ".join(f"'{name}', `{name}`" for name in names)
    long = counted.selectExpr("_rows", f"stack({len(names)}, {cells}) AS (column_name, nulls)")
    return long.select("column_name", percentage(F.col("nulls"), F.col("_rows")).alias("null_rate"))


def all_null_columns(df: DataFrame) -> DataFrame:
    """Expected columns that have no value at all in a non-empty table."""
    names = _checked_for_values(df)
    counted = df.agg(F.count("*").alias("_rows"), *[F.count(name).alias(name) for name in names])
    cells = ", ".join(f"'{name}', `{name}`" for name in names)
    long = counted.selectExpr("_rows", f"stack({len(names)}, {cells}) AS (column_name, present)")
    return long.where("_rows > 0 AND present = 0").select("column_name")


ROWS, NULLS = "rows", "nulls:"


def watched(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The table, and row and null counts taken while it is written: no second scan.

    Counts of different keys need a shuffle and are not among them.  A plan that is evaluated twice counts the first time.
    """
    observation = Observation()
    counts = [F.count_if(F.col(name).isNull()).alias(NULLS + name) for name in df.columns]
    return df.observe(observation, F.count(F.lit(1)).alias(ROWS), *counts), observation


def watched_null_rates(spark: SparkSession, figures: dict) -> DataFrame:
    """``null_rates`` from the figures of an observation."""
    rows = [(name.removeprefix(NULLS), figures[ROWS], n) for name, n in figures.items() if name.startswith(NULLS)]
    long = spark.createDataFrame(sorted(rows), "column_name string, _rows bigint, nulls bigint")
    return long.select("column_name", percentage(F.col("nulls"), F.col("_rows")).alias("null_rate"))


def watched_issues(figures: dict) -> list[str]:
    """What ``validate`` finds without counting keys: absent columns, and columns without values in a non-empty table."""
    names = {name.removeprefix(NULLS) for name in figures if name.startswith(NULLS)}
    missing = sorted(set(rules.EXPECTED_COLUMNS) - names)
    checked = sorted((set(rules.EXPECTED_COLUMNS) & names) - {"workflow_path"})
    empty = [name for name in checked if figures[ROWS] and figures[NULLS + name] == figures[ROWS]]
    return ([f"missing_columns: {', '.join(missing)}"] if missing else []) + [f"no_values: {name}" for name in empty]


def _checked_for_values(df: DataFrame) -> list[str]:
    return sorted((set(rules.EXPECTED_COLUMNS) & set(df.columns)) - {"workflow_path"})


def quality_summary(df: DataFrame) -> DataFrame:
    """Row, repo and duplicate counts with status and issues."""
    missing = missing_columns(df)
    if _has_key(df):
        keyed = df.groupBy(*rules.WORKFLOW_KEY).agg(F.count("*").alias("copies"))
        counted = keyed.agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
            _distinct_repos().alias("repo_count"),
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_count"),
        )
    else:
        repos = _distinct_repos() if "repo" in df.columns else F.lit(0).cast("bigint")
        counted = df.agg(
            F.count("*").alias("row_count"),
            repos.alias("repo_count"),
            F.lit(0).cast("bigint").alias("duplicate_count"),
        )
    listed = ", ".join(missing)
    duplicated = F.col("duplicate_count") > 0
    status = F.lit("fail") if missing else F.when(duplicated, "warn").otherwise("pass")
    issues = F.concat_ws(
        "; ",
        F.lit(f"missing_columns: {listed}" if missing else None).cast("string"),
        F.when(duplicated, F.concat(F.lit("duplicate_rows: "), F.col("duplicate_count").cast("string"))),
    )
    return counted.withColumns(
        {"missing_columns": F.lit(listed), "status": status, "issues": issues}
    )


def _distinct_repos() -> Column:
    """Distinct repos, a null counting as one."""
    return F.count_distinct("repo") + F.coalesce(F.max(F.col("repo").isNull().cast("bigint")), F.lit(0))


def validate(df: DataFrame) -> DataFrame:
    """Gate at a table boundary: raises ``ContractViolation``, or returns the table unchanged.

    One pass: rows and values are counted by key, then over all keys; one row reaches the driver.
    """
    missing, checked = missing_columns(df), _checked_for_values(df)
    issues = [f"missing_columns: {', '.join(missing)}"] if missing else []
    keyed = df.groupBy(*(rules.WORKFLOW_KEY if _has_key(df) else ())).agg(
        F.count("*").alias("_rows"), *[F.count(name).alias(f"_n_{name}") for name in checked]
    )
    extra = F.sum(F.col("_rows") - 1) if _has_key(df) else F.lit(0)
    found = keyed.agg(
        F.sum("_rows").alias("_rows"), extra.alias("_extra"), *[F.sum(f"_n_{name}").alias(f"_n_{name}") for name in checked]
    ).first()
    if found["_extra"]:
        issues.append(f"duplicate_rows: {found['_extra']}")
    if found["_rows"]:
        issues.extend(f"no_values: {name}" for name in checked if not found[f"_n_{name}"])
    if issues:
        raise ContractViolation(issues)
    return df
