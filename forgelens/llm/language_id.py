"""Language identification by compression.

For each language a zstandard raw-content dictionary is filled with text of that language.  A text is cut into
blocks, every block is compressed with every dictionary, and the language with the smallest total wins: its text
repeats the dictionary most.  The score is the relative margin to the second best, 1 - best / second.

Fit: at most ``docs_per_language`` different labelled texts a language (those of the smallest hashes; copies count
once) fill dictionaries of at most ``dictionary_bytes``; the two parameters bound what reaches the driver.  Every
text is scored whole.

Defined results: null texts and texts without a letter are ``und`` with score 0; with one learned language the score
is 1; with none every text is ``und``; ties go to the language that sorts first; repeated rows are scored alike.
"""

import re
import zlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder

UNKNOWN = "und"
DOCS_PER_LANGUAGE = 400
DICTIONARY_BYTES = 96 * 1024
PIECE_BYTES = 256  # so that no single text fills a dictionary
BLOCK_BYTES = 4096
MIN_MARGIN = 0.005
# Short matches tell languages apart: at least four bytes, searched thoroughly.
CODER = dict(
    window_log=17, chain_log=17, hash_log=17, search_log=4, min_match=4, target_length=8,
    strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
)
BETWEEN_WORDS = re.compile(r"[\W\d_]+")
FOLDS, HELD_FOLD = 4, 2
MAX_LANGUAGES = 1000
FOUND = T.StructType().add("_lang", "string").add("_margin", "double")


def sample(labelled: DataFrame, docs_per_language: int) -> DataFrame:
    """(lang, text) of at most ``docs_per_language`` different texts a language, those of the smallest hashes."""
    langs = labelled.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if langs > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different languages")
    hashed = labelled.withColumn("_hash", F.xxhash64("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("_hash"))
    chosen = hashed.select("lang", "_hash").distinct().withColumn("_place", first).where(F.col("_place") <= docs_per_language)
    # the two parameters bound its rows
    held = hashed.join(F.broadcast(chosen.drop("_place")), ["lang", "_hash"])
    return held.groupBy("lang", "_hash").agg(F.min("text").alias("text")).select("lang", "text")


def dictionaries(labelled: DataFrame, docs_per_language: int, dictionary_bytes: int) -> dict[str, bytes]:
    """Raw dictionary content by language; pieces of the sample in the order of a checksum until it is full."""
    lines: dict[str, set[bytes]] = {}
    for lang, text in sample(labelled, docs_per_language).toLocalIterator():
        data = normalised(text)
        lines.setdefault(lang, set()).update(data[at : at + PIECE_BYTES] for at in range(0, len(data), PIECE_BYTES))
    out = {}
    for lang, found in sorted(lines.items()):
        parts, room = [], dictionary_bytes
        for line in sorted(found, key=lambda line: (zlib.crc32(line), line)):
            if 0 < len(line) <= room:
                parts.append(line)
                room -= len(line) + 1
        out[lang] = b"\n".join(parts)
    return out


def normalised(text: str) -> bytes:
    """Lower-cased words with one blank between them: no punctuation, digits or line ends."""
    return BETWEEN_WORDS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def classifier(contents: dict[str, bytes], block_bytes: int = BLOCK_BYTES):
    """text -> (language, margin) from dictionary contents."""
    names, coders = [], []
    for lang, content in sorted(contents.items()):
        if len(content) >= 8:
            settings = zstandard.ZstdCompressionParameters(**CODER)
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=settings)
            names.append(lang)
            coders.append(zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress)

    def classify(text):
        if text is None or not names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        data = normalised(text)
        blocks = [data[at : at + block_bytes] for at in range(0, len(data), block_bytes)]
        sizes = [sum(len(code(block)) for block in blocks) for code in coders]
        best = min(sizes)
        if len(sizes) == 1:
            return names[0], 1.0
        return names[sizes.index(best)], 1.0 - best / sorted(sizes)[1]

    return classify


def identify(
    docs: DataFrame,
    training: DataFrame,
    docs_per_language: int = DOCS_PER_LANGUAGE,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> DataFrame:
    """``docs`` with _lang and _margin; learns from (lang, text) of ``training``."""
    labelled = training.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    contents = dictionaries(labelled, docs_per_language, dictionary_bytes)
    schema = T.StructType([*docs.schema.fields, *FOUND.fields])

    def run(batches):
        classify = classifier(contents)
        for batch in batches:
            found = [classify(text) for text in batch.column("text").to_pylist()]
            langs, margins = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            names = [*batch.schema.names, *FOUND.names]
            yield pa.RecordBatch.from_arrays([*batch.columns, langs, margins], names)

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Pipeline form: rows whose language is certain, columns unchanged.

    Rejected are texts without a letter and texts whose margin is below ``min_margin``.  It learns from all labelled rows.
    """
    found = identify(docs, docs)
    return found.where((F.col("_lang") != UNKNOWN) & (F.col("_margin") >= min_margin)).drop(*FOUND.names)


def query(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.withColumn("held_out", remainder("doc_id", FOLDS) == HELD_FOLD)
    training = rows.where("NOT coalesce(held_out, false)")
    return identify(rows.drop("lang"), training).select(
        "doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_margin").alias("score")
    )
