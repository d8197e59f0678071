"""The trigram index against a search in every name."""

import random
import re

import pytest
from pyspark.sql import functions as F

from forgelens.operators import name_search


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(6)
    names = [f"common-org/{''.join(rng.choices('abcdÄß9-', k=rng.randrange(0, 9)))}" for _ in range(400)]
    names += ["ab", "", "a", "Acme/ÜBER-tool", "acme/aaaaaa", "日本/語の道具", None, "x\ny/z", "p%q_r/s"]
    path = str(tmp_path_factory.mktemp("index"))
    name_search.write_index(spark.createDataFrame([(name,) for name in names + names[:9]], "repo string"), "repo", path)
    return {name for name in names if name is not None}, path


@pytest.mark.parametrize(
    "term", ["common-org/", "acb", " ACME/ ", "über", "aaa", "aaaaaaa", "b", "", "本/語", "y/z", "%q_", "org/ab", "nowhere", "9-a"]
)
def test_search_equals_contains(spark, index, term):
    names, path = index
    found = [row.name for row in name_search.search(spark, path, term).collect()]
    assert sorted(found) == sorted(name for name in names if term.strip().lower() in name.lower())


def test_only_listed_postings_are_read(spark, index):
    _, path = index
    df = name_search.search(spark, path, "org/ab")
    plan = df._jdf.queryExecution().executedPlan().toString()
    buckets = {name_search._bucket(gram) for gram in name_search.chosen(spark, path, "org/ab")}
    assert len(name_search.chosen(spark, path, "org/ab")) == name_search.RAREST
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*trigram", plan)
    scanned = name_search.read_postings(spark, path).where(F.col("bucket").isin(sorted(buckets)))
    read = {int(re.search(r"bucket=(\d+)", row[0]).group(1)) for row in scanned.select(F.input_file_name()).distinct().collect()}
    assert read == buckets and name_search.read_postings(spark, path).select("bucket").distinct().count() > 3 * len(buckets)


def test_frequent_trigrams_come_last(spark, index):
    grams = name_search.chosen(spark, index[1], "common-org/abc")
    assert "com" not in grams and name_search.chosen(spark, index[1], "nowhere") is None


def test_empty_table(spark, tmp_path):
    path = str(tmp_path)
    name_search.write_index(spark.createDataFrame([], "repo string"), "repo", path)
    assert name_search.search(spark, path, "abc").count() == name_search.search(spark, path, "a").count() == 0
