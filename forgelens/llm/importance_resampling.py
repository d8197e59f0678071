"""Target-distribution importance resampling on hashed n-grams of words, with a head-tail vocabulary.

A text is lower-cased in A-Z and cut into words; its features are all runs of one to three consecutive words joined by a
blank, each in the bucket crc32 modulo ``BUCKETS``.  Exact bucket totals of the corpus and of the target give a gain a
bucket, the gains of its features the weight of a document, and a Gumbel term from a hash of its id makes the highest
scores a draw without replacement in proportion to the exponential of the weight.

Head and tail: words are counted over the whole corpus.  At most ``HEAD`` most frequent words of at most ``WORD_BYTES`` bytes are
broadcast with their exact CRC states (of the word, and of the word after a blank), and all pairs of the ``PAIRED`` most
frequent of these with their states and buckets.  A pair that occurs more often than the last of these has uses consists of
two of them, so the pair table holds every pair as frequent as that.  The tail takes its CRC directly: words that are not in
the table from their bytes, other pairs and all triples by carrying the state of their first words over the bytes of the
last one.  The broadcast is bounded by the three parameters, whatever the corpus; buckets do not depend on them.

Documents with at least ``least_words`` words are candidates; the draw numbers them by score over ranges
of the scores, so no task sorts all of them.

Defined results: null and empty texts, and texts without a word, have no features and weight 0; repeated rows are documents of
their own and share their Gumbel term, and where doc_id and score tie the one with fewer features comes first; a null doc_id
has a null score and is not drawn nor counted among the candidates; empty tables give no rows or, as a target, gains of
an empty one; very long texts and words are taken whole.  Only doc_id and text are read, so other columns cannot clash.
"""

import math
import zlib
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.functions.ranking import numbered

from .common import written

BUCKETS = 10_000
SIZES = 3  # words of the longest feature
HEAD, PAIRED, WORD_BYTES = 65_536, 1024, 64
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
GROUP_BYTES = 1 << 20
STEPS_PER_OCTAVE = 8
COUNTED_WORDS = 1 << 19  # words that a task counts before it sends them on
# A-Z become a-z; other bytes below 0x80 but digits and small letters become blanks
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
COUNTS = pa.schema([("word", pa.binary()), ("uses", pa.int64())])
TOTALS = pa.schema([("bucket", pa.int32()), ("uses", pa.int64())])


def groups(batches, column: int = 0):
    """Runs of rows of a batch with about ``GROUP_BYTES`` of text: (first row, texts as bytes)."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary()).to_pylist()
        first, size = 0, 0
        for at, text in enumerate(texts):
            size += len(text or b"")
            if size >= GROUP_BYTES:
                yield batch, first, texts[first : at + 1]
                first, size = at + 1, 0
        if first < len(texts) or not texts:
            yield batch, first, texts[first:]


def words_of(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """All words of some texts in order, and the number of words of each text."""
    lists = [text.translate(FOLD).split() if text else [] for text in texts]
    return [word for held in lists for word in held], np.array([len(held) for held in lists], np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, uses) over whole texts; a task adds up before it sends."""

    def run(batches):
        counts: dict[bytes, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(counts.values(), pa.int64())], schema=COUNTS)

        for _, _, held in groups(batches):
            for word in words_of(held)[0]:
                counts[word] = counts.get(word, 0) + 1
            if len(counts) > COUNTED_WORDS:
                yield out()
                counts.clear()
        yield out()

    return texts.select("text").mapInArrow(run, "word binary, uses long").groupBy("word").agg(F.sum("uses").alias("uses"))


def frequent_words(texts: DataFrame, head: int = HEAD) -> list[bytes]:
    """The most frequent words of at most ``WORD_BYTES`` bytes, by falling count and then by bytes.

    These are all words with at least so many uses that no more than ``head`` words have them, in steps of an eighth of
    an octave: the driver receives one row a step and then at most ``head`` words.
    """
    counted = written(word_counts(texts).where(F.octet_length("word") <= WORD_BYTES), "word-counts")
    step = F.floor(F.log2("uses") * STEPS_PER_OCTAVE).cast("int")
    steps = counted.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()
    total, least = 0, None
    for row in sorted(steps, reverse=True):
        total += row.words
        if total > head:
            break
        least = row.step
    if least is None:
        return []
    rows = counted.where(step >= least).collect()
    return [bytes(row.word) for row in sorted(rows, key=lambda row: (-row.uses, bytes(row.word)))]


def carry_tables() -> np.ndarray:
    """[k]: a CRC state carried over k zero bytes, as the exclusive or of four table entries, one a byte of the state."""
    table = np.empty((WORD_BYTES + 2, 4, 256), np.uint32)
    byte = np.arange(256, dtype=np.uint32)
    one = byte.copy()
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    table[0] = [byte << np.uint32(8 * k) for k in range(4)]
    for k in range(1, len(table)):
        table[k] = one[table[k - 1] & 255] ^ (table[k - 1] >> 8)
    return table


class Vocabulary:
    """CRC states of frequent words and of pairs of the most frequent ones."""

    def __init__(self, words: list[bytes], paired: int = PAIRED):
        self.words, self.carry = words, carry_tables()
        self.alone, self.after, self.size = self.states(words)
        self.paired = min(paired, len(words))
        first, second = np.divmod(np.arange(self.paired**2), max(1, self.paired))
        self.pairs = self.carried(self.alone[first], self.after[second], self.size[second])
        self.pair_buckets = (self.pairs % BUCKETS).astype(np.uint16)

    @staticmethod
    def states(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC of each word, CRC of a blank and the word, and the size of these."""
        return (
            np.array([zlib.crc32(word) for word in words], np.uint32),
            np.array([zlib.crc32(b" " + word) for word in words], np.uint32),
            np.array([len(word) + 1 for word in words], np.int32),
        )

    def carried(self, states: np.ndarray, after: np.ndarray, size: np.ndarray) -> np.ndarray:
        """States after a blank and a word: the CRC of a + b is that of a, carried over as many zero bytes as b has, ^ that
        of b."""
        k = np.minimum(size, WORD_BYTES + 1)
        out = self.carry[k, 0, states & 255]
        for part in range(1, 4):
            out ^= self.carry[k, part, (states >> np.uint32(8 * part)) & 255]
        return out ^ after


class Features:
    """Buckets of the features of texts, for a worker that holds a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.ids = {word: i for i, word in enumerate(vocabulary.words)}

    def _extend(self, states, ids, after, size, words):
        """States of features one word longer; words too long for the tables byte by byte."""
        out = self.vocabulary.carried(states, after[ids], size[ids])
        for at in np.flatnonzero(size[ids] > WORD_BYTES + 1):
            out[at] = zlib.crc32(b" " + words[at], int(states[at]))
        return out

    def buckets(self, texts: list[bytes | None]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For runs of 1, 2 and 3 words: their buckets and the position of their text; and words of each text."""
        v = self.vocabulary
        words, counts = words_of(texts)
        tail = list(dict.fromkeys(filterfalse(self.ids.__contains__, words)))
        local = dict(zip(tail, range(len(v.words), len(v.words) + len(tail))))
        known = self.ids.get
        ids = np.fromiter((i if (i := known(word)) is not None else local[word] for word in words), np.int64, len(words))
        alone, after, size = (np.concatenate(pair) for pair in zip((v.alone, v.after, v.size), v.states(tail)))
        text = np.repeat(np.arange(len(texts)), counts)
        states, buckets, owners = alone[ids], [], []
        buckets.append(states % BUCKETS)
        owners.append(text)
        for length in range(2, SIZES + 1):
            if len(words) < length:
                break
            inside = text[length - 1 :] == text[: 1 - length]
            last = ids[length - 1 :]
            carried = np.zeros(len(last), np.uint32)
            held = np.zeros(len(last), bool)
            if length == 2:
                held = (ids[:-1] < v.paired) & (last < v.paired)
                pair = ids[:-1][held] * v.paired + last[held]
                carried[held] = v.pairs[pair]
            rest = np.flatnonzero(~held & inside)
            carried[rest] = self._extend(states[rest], last[rest], after, size, _Shifted(words, rest, length - 1))
            found = carried % BUCKETS
            if length == 2:
                found[held] = v.pair_buckets[pair]
            buckets.append(found[inside])
            owners.append(text[length - 1 :][inside])
            states = carried  # of runs that cross texts: never used inside one
        return buckets, owners, counts


class _Shifted:
    """words[at + offset] of chosen positions."""

    def __init__(self, words, at, offset):
        self.words, self.at, self.offset = words, at, offset

    def __getitem__(self, k):
        return self.words[self.at[k] + self.offset]


def bucket_totals(texts: DataFrame, vocabulary) -> np.ndarray:
    """Exact number of features in each bucket over whole texts; a task sends one row a bucket."""

    def run(batches):
        features, totals = Features(vocabulary.value), np.zeros(BUCKETS, np.int64)
        for _, _, held in groups(batches):
            for found in features.buckets(held)[0]:
                totals += np.bincount(found, minlength=BUCKETS)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(totals[used])], schema=TOTALS)

    rows = texts.select("text").mapInArrow(run, "bucket int, uses long").groupBy("bucket").agg(F.sum("uses").alias("uses"))
    out = np.zeros(BUCKETS, np.int64)
    for row in rows.collect():  # one a bucket
        out[row.bucket] = row.uses
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio) of every bucket."""
    all_s, all_t = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array(
        [math.floor(1000 * math.log((float(t) + 1) * all_s / ((float(s) + 1) * all_t))) for s, t in zip(corpus, target)], np.int64
    )


def weighted(docs: DataFrame, vocabulary, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    fields = pa.schema([("doc_id", pa.int64()), *[(name, pa.int64()) for name in ("n_words", "n_features", "weight")]])

    def run(batches):
        features = Features(vocabulary.value)
        for batch, first, held in groups(batches, 1):
            buckets, owners, counts = features.buckets(held)
            n, weight = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
            for found, owner in zip(buckets, owners):
                n += np.bincount(owner, minlength=len(held))
                sums = np.concatenate([[0], np.cumsum(gain[found])])
                ends = np.searchsorted(owner, np.arange(len(held) + 1))
                weight += sums[ends[1:]] - sums[ends[:-1]]
            ids = batch.column(0).slice(first, len(held))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(n), pa.array(weight)], schema=fields)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
    head: int = HEAD, paired: int = PAIRED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` counts the drawn ones from 1."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary = spark.sparkContext.broadcast(Vocabulary(frequent_words(rows, head), paired))
    gain = gains(bucket_totals(rows, vocabulary), bucket_totals(target.select(F.col("text").cast("string").alias("text")), vocabulary))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256)
    uniform = (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    gumbel = F.floor(-1000 * F.ln(-F.ln(uniform)))
    scores = written(weighted(rows, vocabulary, gain).withColumn("score", F.col("weight") + gumbel), "scores")
    eligible = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    candidates = scores.where(eligible)
    drawn = percent * candidates.count() // 100
    order = [("score", True), ("doc_id", False), ("n_features", False)]
    places = numbered(candidates.drop("n_words"), order, "rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scores.where(~eligible).select(*columns, F.lit(None).cast("long").alias("rank"))
    return places.select(*columns, rank.alias("rank")).unionByName(rest)


def query(spark, sf_dir) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target)


SQL = r"""
WITH table_of_bytes AS (
  SELECT list(crc ORDER BY i) AS t
  FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS crc
        FROM (SELECT unnest(range(256)) AS i))
), texts AS (
  SELECT 'corpus' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'target', item_id, text FROM benchmark
), cut AS (
  SELECT side, id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), features AS (
  SELECT side, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                            || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS feature
  FROM cut
), coded AS (
  SELECT feature,
         list_transform(range(len(hex(feature)) // 2), lambda i: CAST('0x' || substr(hex(feature), 2 * i + 1, 2) AS BIGINT)) AS bytes
  FROM (SELECT DISTINCT feature FROM features)
), buckets AS (
  SELECT feature,
         xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM coded, table_of_bytes
), totals AS (
  SELECT b AS bucket, count(*) FILTER (WHERE side = 'corpus') AS s, count(*) FILTER (WHERE side = 'target') AS t
  FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN (features JOIN buckets USING (feature)) ON b = bucket
  GROUP BY b
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (sum(s) OVER () + 10000)
                                      / ((CAST(s AS DOUBLE) + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain
  FROM totals
), weights AS (
  SELECT id, count(*) AS n_features, sum(gain) AS weight
  FROM features JOIN buckets USING (feature) JOIN gains USING (bucket) WHERE side = 'corpus' GROUP BY id
), scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                                                         / 4294967296))) AS BIGINT) AS score
  FROM cut LEFT JOIN weights USING (id) WHERE side = 'corpus'
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER () // 100 AS drawn
  FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""
