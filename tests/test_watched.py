"""Quality figures taken while a snapshot is written."""

from forgelens import schemas
from forgelens.operators import quality
from forgelens.sources import snapshots


def test_figures_come_from_the_write(spark, make_workflows, tmp_path):
    rows = make_workflows(
        {"repo": "a/x", "permissions": "{}"}, {"repo": "a/x", "permissions": None}, {"repo": None}, {"repo": "b/y", "triggers": None}
    )
    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            passed.add(len(batch))
            yield batch

    figures = snapshots.write_watched(rows.mapInPandas(count, schemas.WORKFLOW), str(tmp_path))
    assert passed.value == figures["rows"] == 4  # every row was computed once
    got = {row.column_name: row.null_rate for row in quality.watched_null_rates(spark, figures).collect()}
    again = snapshots.read_snapshots(spark, str(tmp_path))
    assert got == {row.column_name: row.null_rate for row in quality.null_rates(again).collect()}
    assert got["triggers"] == 25.0 and got["permissions"] == 75.0
    assert quality.watched_issues(figures) == []


def test_issues(spark, make_workflows):
    rows = make_workflows({"triggers": None}, {"triggers": None}).drop("repo")
    df, observation = quality.watched(rows)
    df.write.format("noop").mode("overwrite").save()
    assert quality.watched_issues(observation.get) == ["missing_columns: repo", "no_values: triggers"]
    df, observation = quality.watched(make_workflows({}).limit(0))
    df.write.format("noop").mode("overwrite").save()
    assert quality.watched_issues(observation.get) == []
