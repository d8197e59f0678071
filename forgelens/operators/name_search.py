"""Substring search over names (repos, actions) through an index of trigrams.

    counts      (trigram, names): how many names hold a trigram
    postings    (bucket, trigram, name): partitioned by a hash of the trigram, sorted by it inside a file
    names       all names, for terms of fewer than three characters

A search reads the counts of the term's own trigrams, then the postings of the ``RAREST`` of them alone: partitions are
pruned by bucket, row groups by trigram.  Names that hold them all are checked for the term.  A trigram that a third of all
names share is read only when the term has no rarer ones.  Case is ignored as ``lower`` does; nulls are left out.
"""

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH, RAREST, BUCKETS = 3, 3, 256


def _grams(text: str) -> list[str]:
    return sorted({text[at : at + LENGTH] for at in range(len(text) - LENGTH + 1)})


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def write_index(names: DataFrame, column: str, path: str) -> None:
    """Index of the distinct values of a text column."""
    spark = names.sparkSession
    names.where(F.col(column).isNotNull()).select(F.col(column).alias("name")).distinct().write.mode("overwrite").parquet(f"{path}/names")
    held = spark.read.schema("name string").parquet(f"{path}/names").withColumn("_low", F.lower("name"))
    places = F.sequence(F.lit(1), F.length("_low") - (LENGTH - 1))
    grams = F.array_distinct(F.transform(places, lambda at: F.substring("_low", at, F.lit(LENGTH))))
    postings = held.where(F.length("_low") >= LENGTH).select("name", F.explode(grams).alias("trigram"))
    postings = postings.withColumn("bucket", (F.crc32(F.encode("trigram", "UTF-8")) % BUCKETS).cast("int"))
    # a frequent trigram is cut into as many parts as the planner finds right: rebalancing splits large partitions
    rebalanced = postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "trigram")
    rebalanced.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    counted = read_postings(spark, path).groupBy("trigram").agg(F.count("*").alias("names"))
    counted.sortWithinPartitions("trigram").write.mode("overwrite").parquet(f"{path}/counts")


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, trigram string, bucket int").parquet(f"{path}/postings")


def chosen(spark: SparkSession, path: str, term: str) -> list[str] | None:
    """The rarest trigrams of a term; None if it has one that no name holds."""
    grams = _grams(term)
    counts = spark.read.schema("trigram string, names bigint").parquet(f"{path}/counts")
    found = counts.where(F.col("trigram").isin(grams)).collect()  # at most one row a trigram of the term
    if len(found) < len(grams):
        return None
    return [row.trigram for row in sorted(found, key=lambda row: (row["names"], row.trigram))[:RAREST]]


def search(spark: SparkSession, path: str, term: str) -> DataFrame:
    """(name) of all names that contain the term, blanks around it and case ignored."""
    term = term.strip().lower()
    if len(term) < LENGTH:
        held = spark.read.schema("name string").parquet(f"{path}/names")
    else:
        grams = chosen(spark, path, term)
        if grams is None:
            return spark.createDataFrame([], "name string")
        wanted = F.col("bucket").isin(sorted({_bucket(gram) for gram in grams})) & F.col("trigram").isin(grams)
        listed = read_postings(spark, path).where(wanted)
        held = listed.groupBy("name").agg(F.count("*").alias("_n")).where(F.col("_n") == len(grams)).select("name")
    return held.where(F.contains(F.lower("name"), F.lit(term)))
