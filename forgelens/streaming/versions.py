"""Newest version of every file as keyed streaming state, for files that change in place.

A crawler appends observations: (repo, file_name, source_file, content, seen_at), ``content`` null where the file was gone.
The state store keeps, by (repo, file_name), the hash and time of the newest observation, so that a run costs what it
observes, not what is known.  An observation that is not newer is ignored: replayed ones, late ones and other splits into
batches lead to the same state.  Of observations at one time the largest hash wins; rows without a time are left out.

    versions/run=N     files whose content changed in batch N, with their content
    workflows/run=N    their workflow rows (``start`` with ``parse``), errors/run=N the files without one

A repeated batch replaces its own output.  State is kept by RocksDB; a task's memory does not grow with the versions of a file.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from forgelens import schemas
from forgelens.operators import extract

OBSERVATION = "repo string, file_name string, source_file string, content string, seen_at timestamp"
CHANGE = f"{OBSERVATION}, sha string, outcome string"
FILE = ["repo", "file_name"]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def hashed(observations: DataFrame) -> DataFrame:
    """With the hash of the content, empty where the file was gone."""
    return observations.where("seen_at IS NOT NULL").withColumn("sha", F.coalesce(F.sha2("content", 256), F.lit("")))


class Newest(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("newest", "at bigint, sha string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda row: (row.at, row.sha))
        was = self.known.get() if self.known.exists() else None
        if was and (newest.at, newest.sha) <= tuple(was):
            return
        self.known.update((newest.at, newest.sha))
        before = was[1] if was else ""
        if newest.sha != before:
            outcome = "removed" if not newest.sha else "changed" if before else "new"
            row = newest.asDict()
            del row["at"]
            yield Row(**row, outcome=outcome)

    def close(self) -> None:
        pass


def changes(observations: DataFrame) -> DataFrame:
    """Files of a stream whose content is another than before, once a batch."""
    columns = hashed(observations).select(*FILE, "source_file", "content", "seen_at", "sha", F.unix_micros("seen_at").alias("at"))
    return columns.groupBy(*FILE).transformWithState(Newest(), CHANGE, "Update", "None")


def keep(batch: DataFrame, run: int, tables: str, parse: bool) -> None:
    batch.write.mode("overwrite").parquet(f"{tables}/versions/run={run}")  # the one evaluation of the stateful plan
    if parse:
        files = batch.sparkSession.read.schema(CHANGE).parquet(f"{tables}/versions/run={run}").where("sha <> ''")
        parsed = extract.parse(files.select(*FILE, "source_file", "content")).persist()
        extract.parse_errors(parsed).write.mode("overwrite").parquet(f"{tables}/errors/run={run}")
        rows = extract.workflows_from(parsed, F.current_date())
        rows.write.mode("overwrite").parquet(f"{tables}/workflows/run={run}")
        parsed.unpersist()


def start(observations: DataFrame, tables: str, checkpoint: str, parse: bool = True) -> StreamingQuery:
    """Take in the observations that arrived since the last time, then stop."""
    spark = observations.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # a started query keeps its own copy of the settings
    try:
        return (
            changes(observations).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(lambda batch, run: keep(batch, run, tables, parse)).start()
        )
    finally:
        spark.conf.set(PROVIDER, before)


def current(spark: SparkSession, tables: str) -> DataFrame:
    """(repo, file_name, sha, seen_at, run) of the files that are there; seen_at is when this content came."""
    log = spark.read.schema(f"{CHANGE}, run bigint").parquet(f"{tables}/versions")
    last = log.groupBy(*FILE).agg(F.max(F.struct("seen_at", "sha", "run")).alias("_last"))
    return last.where("_last.sha <> ''").select(*FILE, "_last.sha", "_last.seen_at", "_last.run")


def newest(observations: DataFrame) -> DataFrame:
    """The same files from all observations at once: (repo, file_name, sha)."""
    last = hashed(observations).groupBy(*FILE).agg(F.max(F.struct("seen_at", "sha")).alias("_last"))
    return last.where("_last.sha <> ''").select(*FILE, "_last.sha")


def workflows(spark: SparkSession, tables: str) -> DataFrame:
    """Workflow rows of the current files; files whose current content is unusable have none."""
    now = current(spark, tables).select("repo", F.concat(F.lit(".github/workflows/"), "file_name").alias("workflow_path"), "run")
    rows = spark.read.parquet(f"{tables}/workflows")
    return rows.join(now, ["repo", "workflow_path", "run"], "left_semi").select(*schemas.WORKFLOW.names)
