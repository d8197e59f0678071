"""Small rule tables as inline literals, so that the planner sees their true size."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rule_table(spark: SparkSession, names: tuple[str, ...], rows) -> DataFrame:
    """A DataFrame over constant rows; the number of rows is fixed by the code."""
    structs = [F.struct(*[F.lit(value).alias(name) for name, value in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
