"""Incremental extraction: only new or changed workflow files are parsed.

``run`` reads the corpus as it is now and parses the files whose content hash differs from the stored one, also those
that changed in place.  ``start`` is the form for landing folders whose files are only ever added, under unique names: a
file stream delivers each path once.  Both write the outcome of a run under its number:

    workflows/run=N    rows of the files parsed in run N
    errors/run=N       files that could not be parsed in run N, with the reason
    state/run=N        every file known after run N: its hash, the run that parsed it, whether it gave a row

A run reads the state of the last run before it alone, so the state does not grow with the number of runs; a run
that is repeated replaces its own output and adds nothing twice.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forgelens import schemas
from forgelens.operators import extract
from forgelens.sources.corpus import WORKFLOW_GLOB, read_corpus, stream_corpus

STATE_SCHEMA = "repo string, file_name string, sha string, parsed_in bigint, usable boolean, run bigint"
FILE = ["repo", "file_name"]


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("sha", F.sha2(F.coalesce("content", F.lit("")), 256))


def one_version(files: DataFrame) -> DataFrame:
    """One row a file; of several versions in one run the one whose path, then hash, sorts last."""
    columns = F.struct("source_file", "sha", "content")
    newest = files.groupBy(*FILE).agg(F.max(columns).alias("_newest"))
    return newest.select(*FILE, "_newest.*")


def state_before(spark: SparkSession, tables: str, run: int | None = None) -> DataFrame:
    """Files known after the last run (before ``run``)."""
    try:
        state = spark.read.schema(STATE_SCHEMA).parquet(f"{tables}/state")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE_SCHEMA)
    earlier = state if run is None else state.where(F.col("run") < run)
    last = earlier.agg(F.max("run")).first()[0]  # answered by the partition names
    return earlier.where(F.col("run") == F.lit(last))


def unseen(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose content differs from the stored one."""
    return one_version(with_hash(files)).join(state.select(*FILE, "sha"), [*FILE, "sha"], "left_anti")


def process(files: DataFrame, run: int, tables: str) -> None:
    """Parse what is new or changed in ``files`` and write the outcome as run ``run``."""
    spark = files.sparkSession
    state = state_before(spark, tables, run)
    fresh = unseen(files, state)
    parsed = extract.parse(fresh).persist()  # read three times below; lost blocks are parsed again
    rows = extract.workflows_from(parsed, F.current_date())
    extract.parse_errors(parsed).write.mode("overwrite").parquet(f"{tables}/errors/run={run}")
    rows.write.mode("overwrite").parquet(f"{tables}/workflows/run={run}")
    outcome = parsed.select(*FILE, F.col("_error").isNull().alias("usable"))
    now = fresh.select(*FILE, "sha").join(outcome, FILE).withColumn("parsed_in", F.lit(run).cast("bigint"))
    kept = state.drop("run").join(now.select(*FILE), FILE, "left_anti")
    kept.unionByName(now).write.mode("overwrite").parquet(f"{tables}/state/run={run}")
    parsed.unpersist()


def run(spark: SparkSession, root: str, tables: str, glob: str = WORKFLOW_GLOB, number: int | None = None) -> int:
    """One incremental run over the corpus as it is now; returns its number."""
    if number is None:
        last = state_before(spark, tables).agg(F.max("run")).first()[0]
        number = 0 if last is None else last + 1
    process(read_corpus(spark, root, glob), number, tables)
    return number


def start(
    spark: SparkSession, root: str, tables: str, checkpoint: str, glob: str = WORKFLOW_GLOB
) -> StreamingQuery:
    """Process the files that were added since the last time, then stop; the landing folder is append-only."""
    return (
        stream_corpus(spark, root, glob)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda files, batch: process(files, batch, tables))
        .start()
    )


def workflows(spark: SparkSession, tables: str) -> DataFrame:
    """The current row of each workflow file; files whose current version is unusable have none."""
    current = state_before(spark, tables).where("usable").select(
        "repo", F.concat(F.lit(".github/workflows/"), "file_name").alias("workflow_path"), F.col("parsed_in").alias("run")
    )
    rows = spark.read.parquet(f"{tables}/workflows")
    return rows.join(current, ["repo", "workflow_path", "run"], "left_semi").select(*schemas.WORKFLOW.names)
