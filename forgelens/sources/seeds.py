"""Seed lists and repository metadata from JSON."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgelens import schemas

_NUMBER = T.LongType()
_ITEM = T.StructType(
    schemas.SEED.fields
    + [field for field in schemas.METADATA.fields if field.name not in ("license",)]
    + [
        T.StructField("license", T.StringType()),
        T.StructField("stargazers_count", _NUMBER),
        T.StructField("forks_count", _NUMBER),
    ]
)
ENVELOPES = ("repos", "items", "data")


class NotAList(ValueError):
    """A seed file whose top level is not a list."""


def read_seed_list(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed (owner, repo) entries of a seed file; anything but a top-level list is refused."""
    _refuse_objects(spark, path)
    seeds = spark.read.schema(schemas.SEED).option("multiLine", True).json(path)
    return seeds.where((F.coalesce("owner", F.lit("")) != "") & (F.coalesce("repo", F.lit("")) != ""))


def _refuse_objects(spark: SparkSession, path: str) -> None:
    """Looks at the first line that is not blank; the rest of the file is not read."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if first and not first[0]["value"].lstrip().startswith("["):
        raise NotAList("not a list of repositories")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata rows from a list, from an object that wraps one, or from an object keyed by full name."""
    wrapped = T.StructType([T.StructField(name, T.ArrayType(_ITEM)) for name in ENVELOPES])
    any_shape = T.StructType(_ITEM.fields + wrapped.fields)
    rows = spark.read.schema(any_shape).option("multiLine", True).json(path)
    nested = F.coalesce(*ENVELOPES)
    bare = rows.where(nested.isNull()).select(*_ITEM.names)
    unwrapped = rows.where(nested.isNotNull()).select(F.inline(nested))
    known = _named(bare.unionByName(unwrapped))
    if known.limit(1).count():
        return known
    # neither shape: names are the keys, so the object is one map (and one value of Spark: at most 2 GB)
    keyed = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", T.MapType(T.StringType(), _ITEM))).alias("_key", "_item")
    )
    items = _named(keyed.where(F.contains("_key", F.lit("/"))).select("_key", "_item.*"), F.col("_key")).drop("_key")
    if not items.limit(1).count() and not rows.where(nested.isNotNull()).limit(1).count():
        if spark.read.text(path).where(~F.trim("value").isin("", "[]", "{}")).limit(1).count():
            raise NotAList("no repositories in any known shape")
    return items


def _named(items: DataFrame, *names) -> DataFrame:
    by_parts = F.concat("owner", F.lit("/"), "repo")
    named = items.withColumn("full_name", F.coalesce("full_name", by_parts, *names)).drop("owner", "repo")
    return named.where(F.col("full_name").isNotNull())
