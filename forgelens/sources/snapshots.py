"""Workflow and result snapshots, partitioned by crawl date; all of them are kept."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgelens import schemas
from forgelens.operators import quality

PARTITION = "crawl_date"


def empty_workflows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.WORKFLOW)


def conform(df: DataFrame) -> DataFrame:
    """An older snapshot in today's shape: absent columns get typed defaults.

    A missing path or source file falls back to the workflow name, a missing list is empty, a missing flag false.
    """
    present = set(df.columns)
    columns = []
    for field in schemas.WORKFLOW.fields:
        if field.name in present:
            column = F.col(field.name).cast(field.dataType)
        elif field.name in ("workflow_path", "source_file"):
            column = F.col("workflow_name")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array().cast(field.dataType)
        elif isinstance(field.dataType, T.BooleanType):
            column = F.lit(False)
        else:
            column = F.lit(None).cast(field.dataType)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def write_snapshot(workflows: DataFrame, path: str) -> None:
    """Replace the partitions of the crawl dates in ``workflows``; other dates stay."""
    (
        workflows.select(*schemas.WORKFLOW.names)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PARTITION)
        .parquet(path)
    )


def write_watched(workflows: DataFrame, path: str) -> dict:
    """``write_snapshot``, and the row and null counts of what was written (``quality.watched_issues`` reads them)."""
    rows, observation = quality.watched(workflows.select(*schemas.WORKFLOW.names))
    write_snapshot(rows, path)
    return observation.get


def write_latest(workflows: DataFrame, path: str) -> None:
    workflows.select(*schemas.WORKFLOW.names).write.mode("overwrite").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots; a filter on the crawl date prunes partitions.  A missing table reads as an empty one."""
    try:
        return spark.read.schema(schemas.WORKFLOW).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_workflows(spark)


def read_as_view(spark: SparkSession, path: str, name: str = "cicd") -> DataFrame:
    """Snapshots registered as a SQL view."""
    df = read_snapshots(spark, path)
    df.createOrReplaceTempView(name)
    return df


def write_results(tables: dict[str, DataFrame], crawl_date: str, root: str) -> None:
    """Result tables of one run, each under its name and the run's crawl date."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/{PARTITION}={crawl_date}")


def read_result(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def write_profiles(documents: DataFrame, path: str, by_owner: bool = False) -> None:
    """One JSON line per repo profile; a folder per owner only where owners are few."""
    writer = documents.write.mode("overwrite")
    (writer.partitionBy("owner") if by_owner else writer).json(path)


def write_observations(tables: dict[str, DataFrame], root: str) -> None:
    """Repository observations (file signals, configuration files, structure signals) as JSON lines."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{root}/{name}")


def write_export(repos: DataFrame, patterns: DataFrame, root: str) -> None:
    """Relational export: the ``repos`` and ``patterns`` tables."""
    repos.write.mode("overwrite").parquet(f"{root}/repos")
    patterns.write.mode("overwrite").parquet(f"{root}/patterns")
