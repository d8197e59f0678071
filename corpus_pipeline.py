"""A training corpus from the documents table: five stages, each written and read again before the next."""

from pyspark.sql import DataFrame, SparkSession

from forgelens.llm import language_id, line_dedup, near_dedup, sentence_pieces, soft_mixing
from forgelens.llm.common import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; texts without a letter and ties between languages go."""
    return language_id.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least two others share, which stay in one document."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the rates that bring the domains of the label table to their target weights."""
    return soft_mixing.mixed(docs, soft_mixing.read_labels(spark, sf_dir))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, n_byte_pieces, ids, round_trip): the encoded corpus."""
    return sentence_pieces.encode(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("minhash_dedup", near_duplicates),
    ("soft_mixing", mixture),
    ("sentence_pieces", pieces),
]

ORACLE_SQL = None  # trained models decide; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
