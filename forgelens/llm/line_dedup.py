"""Line deduplication with per-document keep bitmaps (built-in functions only).

The key of a line is its text without ASCII white space at both ends and with A-Z lower-cased.  Keys of at least
``min_length`` code points that occur in at least ``min_docs`` documents stay only in the largest doc_id that
holds them; every occurrence there stays.

Hashes of the lines are range-partitioned by (hash, document) and sorted by (hash, document, position), so the first
occurrence of a key in a document is the first row of its run.  A key that stands in a third of all documents spans
many ranges; its runs meet only as one partial row per task (document count, largest document).  Text is not moved:
lines travel as 128-bit hashes, decisions as bitmaps.

Defined results: null and empty texts are one empty line; rows with null doc_id keep all lines and are not
counted; rows that repeat a doc_id are one document and each row gets the bitmap of its own text; an empty table gives
an empty table.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, written

SPACE = "\t\n\x0b\x0c\r "
WORD_BITS = 64
MIN_LENGTH, MIN_DOCS = 20, 3


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _fingerprint() -> Column:
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(_text())


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def postings(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, row, position, high, low): the 128-bit hash of every line long enough."""
    key = F.btrim(F.col("line"), F.lit(SPACE))
    lines = docs.where("doc_id IS NOT NULL").select(
        "doc_id", _fingerprint().alias("row"), F.posexplode(_lines(ascii_lower(_text()))).alias("position", "line")
    )
    return lines.withColumn("key", key).where(F.char_length("key") >= min_length).select(
        "doc_id",
        "row",
        "position",
        F.xxhash64(F.lit(0), "key").alias("high"),
        F.xxhash64(F.lit(1), "key").alias("low"),
    )


def keep_bitmaps(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row, n_dropped, keep): one row per text that loses lines.

    ``keep`` lists (word, bits): bit p % 64 of word p div 64 is 1 where line p stays.  Words of ones are left
    out, which compresses the bitmap to its changed words; texts that lose nothing have no row at all.
    """
    lines = written(postings(docs, min_length), "lines")
    key = ["high", "low"]
    ranged = lines.repartitionByRange(*key, "doc_id").sortWithinPartitions(*key, "doc_id", "position")
    run = Window.partitionBy(*key, "doc_id").orderBy("position")
    firsts = ranged.withColumn("place", F.row_number().over(run)).where("place = 1")
    shared = (
        firsts.groupBy(*key)
        .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        .where(F.col("n_docs") >= min_docs)
        .drop("n_docs")
    )
    dropped = lines.join(shared, key).where("doc_id <> last_doc")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("position") % WORD_BITS)
    word = (F.col("position") / WORD_BITS).cast("int")
    words = dropped.groupBy("doc_id", "row", word.alias("word")).agg(
        F.bit_or(bit).alias("gone"), F.count_distinct("position").alias("n")
    )
    return words.groupBy("doc_id", "row").agg(
        F.sum("n").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with the kept lines as text, and n_lines, n_dropped."""
    rows = docs.withColumn("_row", _fingerprint())
    maps = bitmaps.select(
        F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.col("n_dropped").alias("_n"),
        F.map_from_entries("keep").alias("_keep"),
    )
    joined = rows.join(
        maps, (rows["doc_id"] == maps["_doc"]) & (rows["_row"] == maps["_row"]), "left"
    ).drop("_doc").drop(maps["_row"])

    def stays(_, position):
        bits = F.coalesce(F.try_element_at(F.col("_keep"), (position / WORD_BITS).cast("int")), F.lit(-1).cast("bigint"))
        return F.call_function("shiftright", bits, position % WORD_BITS).bitwiseAND(F.lit(1)) == 1

    kept = F.when(F.col("_keep").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(_lines(_text()), stays), "\n")
    )
    return joined.select(
        *[kept.alias("text") if name == "text" else F.col(name) for name in docs.columns],
        F.size(_lines(_text())).cast("bigint").alias("_n_lines"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("_n_dropped"),
    )


def dedup_lines(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents without the lines that others hold; same columns."""
    bitmaps = keep_bitmaps(docs, min_length, min_docs)
    return apply_bitmaps(docs, bitmaps).drop("_n_lines", "_n_dropped")


def query(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_bitmaps(docs, keep_bitmaps(docs)).select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(_text().cast("binary"), 256).alias("kept_sha256"),
    )


SQL = """
WITH lines AS (
  SELECT doc_id, position, line,
         translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS position
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), shared AS (
  SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE last_doc IS NOT NULL AND last_doc <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY position)
                       FILTER (WHERE last_doc IS NULL OR last_doc = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN shared USING (key)
GROUP BY doc_id
"""
