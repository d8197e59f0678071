"""Raw file corpus: <root>/<owner>/<repo>/<file>."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelens import schemas
from forgelens.operators.extract import EXTRACTORS

WORKFLOW_GLOB = "*.{yml,yaml}"


def _located(path: Column) -> dict[str, Column]:
    """Repository, file name and full path from a file's location; percent escapes of the URI are undone."""
    plain = F.try_url_decode(F.regexp_replace(path, r"\+", "%2B"))
    parts = F.split(plain, "/")
    return {
        "repo": F.concat(F.element_at(parts, -3), F.lit("/"), F.element_at(parts, -2)),
        "file_name": F.element_at(parts, -1),
        "source_file": F.regexp_replace(plain, r"^file:(//)?", ""),
    }


def _whole_files(reader, root: str, glob: str) -> DataFrame:
    files = reader.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    located = _located(F.col("_metadata.file_path"))
    columns = [column.alias(name) for name, column in located.items()]
    return files.select(*columns, F.col("value").alias("content")).select(*schemas.RAW_FILE.names)


def read_corpus(spark: SparkSession, root: str, glob: str = WORKFLOW_GLOB) -> DataFrame:
    """Every matching file as one row; Spark packs many small files into each task."""
    return _whole_files(spark.read, root, glob)


def stream_corpus(spark: SparkSession, root: str, glob: str = WORKFLOW_GLOB) -> DataFrame:
    """The same as a file stream: each file is delivered once."""
    return _whole_files(spark.readStream, root, glob)


def extract(spark: SparkSession, root: str, extractor: str = "cicd") -> DataFrame:
    """Run a registered extractor over a corpus."""
    chosen = EXTRACTORS[extractor]
    return chosen.extract(read_corpus(spark, root, chosen.file_glob))
