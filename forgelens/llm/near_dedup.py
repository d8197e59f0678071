"""MinHash near-deduplication by an inverted join over signature coordinates.

A document is its set of distinct word shingles; two documents are linked if 100 * intersection >= ``percent`` *
union.  Documents with equal sets are one class from the start.  A class has a signature of ``COORDINATES`` minima, and
each (coordinate, value) pair posts the classes that share it.

Prefix: pairs that agree in at least ``MATCHES`` coordinates share one of any COORDINATES - MATCHES + 1 of them, so a
class is posted only under that many of its rarest values, of which those no other class holds need no list either.
Skip: the long lists of its other values are never merged; the collisions there are counted by comparing the
signatures of a candidate pair.  Retained pairs (MATCHES collisions or more) are confirmed on the full sets.

Lists of at most ``LONG_LIST`` classes give their pairs.  Longer ones are not expanded: every class is compared with the
most central class of its list (the one whose values are shared most), which connects most of a group of near copies.
Those that are not connected with the centre are compared with all others of the lists of that centre, in blocks
of ``BLOCK_SETS`` full sets; a task holds two blocks and returns a spanning forest of the links it finds.  So every pair
that shares a list is compared or already connected: no cap, and the components are those of all links.

With similarity 0.8 a pair agrees in 51 of 64 coordinates on average; fewer than 36 have a probability of about
3 in a million.

Defined results: null and empty texts have no shingles and link with nothing; fewer words than a shingle are one
shingle; rows that repeat a doc_id are one document, compared by one of its texts; rows with null doc_id are not linked;
an empty table gives an empty table.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components, forest

COORDINATES, MATCHES = 64, 36
PREFIX = COORDINATES - MATCHES + 1
PERCENT = 80
LONG_LIST, BLOCK_SETS, COLUMNS = 32, 256, 8192
CACHE_WORDS = 300_000
GROUP_SHINGLES = 1 << 16
U64 = np.uint64
SIGNATURE_SCHEMA = "doc_id long, print long, n_shingles long, high long, low long, signature array<int>"
SIGNATURES = pa.schema(
    [("doc_id", pa.int64()), ("print", pa.int64()), ("n_shingles", pa.int64()), ("high", pa.int64()), ("low", pa.int64()),
     ("signature", pa.list_(pa.int32()))]
)


class WordHashes(dict):
    """64-bit hashes of words; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII space only
    if not found:
        return np.zeros(0, U64)
    codes = np.fromiter(map(hashes.__getitem__, found), U64, len(found))
    size = min(words, len(codes))
    mixed = np.full(len(codes) - size + 1, U64(size))
    for at in range(size):
        mixed = (mixed ^ codes[at : at + len(mixed)]) * U64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> U64(29)
    return np.unique(mixed)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 2**63, COORDINATES, U64) * U64(2) + U64(1), rng.integers(0, 2**63, COORDINATES, U64)


def signatures_of(sets: list[np.ndarray]) -> np.ndarray:
    """Signature matrix of nonempty sets: upper 32 bits of the least value under each hash function."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    values = np.concatenate(sets)
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k, (factor, term) in enumerate(zip(*_coefficients())):
        hashed = (values * factor + term)
        hashed = (hashed ^ (hashed >> U64(32))) * factor
        out[:, k] = np.minimum.reduceat(hashed, starts) >> U64(32)
    return out.view(np.int32)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, print, n_shingles, high, low, signature): fingerprint of the text, size of the set, its 128-bit digest and
    its minima."""

    def rows(held):
        full = [s for _, _, s in held if len(s)]
        minima = iter(signatures_of(full)) if full else iter(())
        for doc_id, fingerprint, found in held:
            digest = xxhash.xxh3_128_intdigest(found.tobytes())
            high, low = np.array([digest >> 64, digest & (2**64 - 1)], U64).view(np.int64).tolist()
            yield doc_id, fingerprint, len(found), high, low, next(minima).tolist() if len(found) else None

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            held, size = [], 0
            out = []
            for doc_id, fingerprint, text in zip(*(column.to_pylist() for column in batch.columns)):
                held.append((doc_id, fingerprint, shingles(text, words, hashes)))
                size += len(held[-1][2])
                if size >= GROUP_SHINGLES:
                    out.extend(rows(held))
                    held, size = [], 0
            out.extend(rows(held))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip(zip(*out), SIGNATURES)] if out else
                [pa.array([], field.type) for field in SIGNATURES], schema=SIGNATURES,
            )

    return docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(run, SIGNATURE_SCHEMA)


def prefix_postings(classes: DataFrame) -> DataFrame:
    """(key, id, n, mass): classes under the rarest of their shared values."""
    posted = classes.select(
        "id", "n", F.posexplode("signature").alias("coordinate", "value")
    ).select("id", "n", (F.col("coordinate").cast("long") * (1 << 32) + F.col("value")).alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    held = posted.join(shared, "key").groupBy("id", "n").agg(
        F.sort_array(F.collect_list(F.struct("size", "key"))).alias("values"), F.sum("size").alias("mass")
    )
    # values that no other class holds come first in the order of rarity and use up their part of the prefix
    length = PREFIX - (COORDINATES - F.size("values"))
    return held.where(length > 0).select(
        "id", "n", "mass", F.explode(F.slice("values", F.lit(1), length)).alias("value")
    ).select("value.key", "id", "n", "mass")


def _could_link(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def retained(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b, pa, pb), with fingerprints of the texts, whose signatures collide in at least MATCHES coordinates."""
    left = classes.select(F.col("id").alias("a"), F.col("print").alias("pa"), F.col("signature").alias("sa"))
    right = classes.select(F.col("id").alias("b"), F.col("print").alias("pb"), F.col("signature").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b")

    def run(batches):
        for batch in batches:
            sides = [batch.column(name).flatten().to_numpy().reshape(-1, COORDINATES) for name in ("sa", "sb")]
            same = pa.array((sides[0] == sides[1]).sum(axis=1) >= MATCHES)
            yield batch.select(["a", "b", "pa", "pb"]).filter(same)

    return joined.select("a", "b", "pa", "pb", "sa", "sb").mapInArrow(run, "a long, b long, pa long, pb long")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough; ``texts`` holds (doc_id, text)."""
    left = texts.select(F.col("doc_id").alias("a"), F.xxhash64("text").alias("pa"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.xxhash64("text").alias("pb"), F.col("text").alias("tb"))
    joined = pairs.join(left, ["a", "pa"]).join(right, ["b", "pb"]).select("a", "b", "ta", "tb")

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            keep, last, known = [], None, None
            for a, b in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                if b != last:
                    last, known = b, shingles(b, words, hashes)
                mine = shingles(a, words, hashes)
                common = len(np.intersect1d(mine, known, assume_unique=True))
                keep.append(100 * common >= percent * (len(mine) + len(known) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def _pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a list that lie in different components and have sizes that allow a link."""
    one, two = (lists.select("key", *[F.col(x).alias(f"{x}{i}") for x in ("id", "n", "c")]) for i in (1, 2))
    pairs = one.join(two, "key").where("id1 < id2 AND c1 <> c2").where(_could_link("n1", "n2", percent))
    return pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct()


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    labels = found.withColumnRenamed("component", "_c")
    return rows.join(labels, "id", "left").withColumn("c", F.coalesce("_c", "id")).drop("_c")


def set_table(ids: DataFrame, classes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(id, shingles): full sets of some classes as sorted little-endian 64-bit hashes."""
    known = ids.join(classes.select("id", "print"), "id")
    held = texts.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("print"), "text")
    rows = known.join(held, ["id", "print"]).dropDuplicates(["id"]).select("id", "text")

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(text, words, hashes).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    return rows.mapInArrow(run, "id long, shingles binary")


def block_cells(groups: DataFrame) -> DataFrame:
    """(centre, kind, i, j, id, side) of the pairs of blocks that are to be compared.

    ``groups`` holds (centre, id, inner): members of a list group, and whether they are already connected with the centre.
    Outer members meet all others (kind o: outer with outer, x: inner with outer); inner ones need not meet.
    """
    counts = groups.groupBy("centre").agg(F.count_if("inner").alias("n_in"), F.count_if(~F.col("inner")).alias("n_out"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_SETS)
    rows = groups.join(counts.where("n_out > 0"), "centre").select(
        "centre", "id", "inner", blocks("n_in").alias("in_blocks"), blocks("n_out").alias("out_blocks")
    )
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("inner"), F.col("in_blocks")).otherwise(F.col("out_blocks")))
    rows = rows.withColumn("mine", mine.cast("int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    inner = rows.where("inner").select("centre", F.lit("x").alias("kind"), F.col("mine").alias("i"), upto("out_blocks").alias("j"), "id", F.lit(0).alias("side"))
    across = rows.where("NOT inner AND in_blocks > 0").select("centre", F.lit("x").alias("kind"), upto("in_blocks").alias("i"), F.col("mine").alias("j"), "id", F.lit(1).alias("side"))
    outer = rows.where("NOT inner").select("centre", "mine", "id", upto("out_blocks").alias("other")).select(
        "centre", F.lit("o").alias("kind"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "id",
        (F.col("mine") > F.col("other")).cast("int").alias("side"),
    )
    return inner.unionByName(across).unionByName(outer)


def compare_blocks(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix of the pairs that are similar enough; intersections are counted exactly."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    shared = np.zeros((len(left), len(right)), np.float64)
    for start in range(0, len(common), COLUMNS):
        part = common[start : start + COLUMNS]
        sides = []
        for sets in (left, right):
            matrix = np.zeros((len(sets), len(part)), np.float32)
            for row, found in enumerate(sets):
                own = found[np.searchsorted(found, part[0]) : np.searchsorted(found, part[-1], "right")]
                at = np.searchsorted(part, own)
                matrix[row, at[part[np.minimum(at, len(part) - 1)] == own]] = 1
            sides.append(matrix)
        shared += sides[0] @ sides[1].T
    sizes = np.add.outer([len(x) for x in left], [len(x) for x in right])
    return 100 * shared >= percent * (sizes - shared)


def block_links(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links between the two sides of every cell."""

    def compare(frame):
        frame = frame.sort_values("id")
        sides = [frame[frame["side"] == side] for side in (0, 1)]
        if not len(sides[1]):  # a block with itself
            sides[1] = sides[0]
        if not len(sides[0]):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        held = [[np.frombuffer(x, U64) for x in side["shingles"]] for side in sides]
        at, to = np.nonzero(compare_blocks(*held, percent))
        a, b = sides[0]["id"].to_numpy()[at], sides[1]["id"].to_numpy()[to]
        left, right = forest(a[a != b], b[a != b])
        return pd.DataFrame({"a": left, "b": right}).astype("int64")

    return cells.join(sets, "id").groupBy("centre", "kind", "i", "j").applyInPandas(compare, "a long, b long")


def links(classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): edges that connect the classes as all links do."""
    postings = written(prefix_postings(classes), "postings")
    sizes = postings.groupBy("key").agg(F.count("*").alias("size"), F.max(F.struct("mass", "id", "n")).alias("top"))
    lists = postings.join(sizes, "key").select(
        "key", "id", "n", "size", F.col("top.id").alias("centre"), F.col("top.n").alias("centre_n")
    )
    lists = written(lists.where("size > 1"), "lists")
    is_long = F.col("size") > LONG_LIST
    # long lists: every class with the centre of its list
    stars = lists.where(is_long).where("id <> centre").where(_could_link("n", "centre_n", percent))
    stars = stars.select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    stars = written(confirmed(retained(stars, classes), texts, words, percent), "stars")
    lists = _with_component(lists, components(stars))
    lists = written(lists, "lists")
    # short lists: the pairs that are not connected yet
    pairs = _pairs(lists.where(~is_long), percent)
    pairs = written(confirmed(written(retained(pairs, classes), "retained"), texts, words, percent), "links")
    # long lists, joined by their centre: whoever is not connected with it, with all others, in blocks
    centres = lists.where("id = centre").select("centre", F.col("c").alias("centre_c")).distinct()
    groups = lists.where(is_long).select("centre", "id", "c").distinct().join(centres, "centre")
    cells = written(block_cells(groups.select("centre", "id", (F.col("c") == F.col("centre_c")).alias("inner"))), "cells")
    sets = written(set_table(cells.select("id").distinct(), classes, texts, words), "sets")
    blocks = written(block_links(cells, sets, percent), "block-links")
    return stars.unionByName(pairs).unionByName(blocks)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    measured = written(signatures(docs, words), "signatures")
    known = measured.where("doc_id IS NOT NULL AND n_shingles > 0")
    own = known.groupBy("doc_id").agg(F.min(F.struct("print", "high", "low")).alias("own")).select("doc_id", "own.*")
    own = written(own, "own-sets")
    sets = own.groupBy("high", "low").agg(F.min("doc_id").alias("id"))
    members = own.join(sets, ["high", "low"])
    leaders = members.where("doc_id = id").select("id", "print")
    classes = leaders.join(
        known.select(F.col("doc_id").alias("id"), "print", F.col("n_shingles").alias("n"), "signature"), ["id", "print"]
    ).dropDuplicates(["id"])
    classes = written(classes, "classes")
    found = components(links(classes, docs, words, percent))
    labels = members.select("doc_id", "id").join(found, "id", "left")
    labels = labels.select(F.col("doc_id").alias("_doc"), F.coalesce("component", "id").alias("_component"))
    rows = measured.select("doc_id", "n_shingles")
    joined = rows.join(labels, rows["doc_id"] == labels["_doc"], "left")
    component = F.coalesce("_component", "doc_id")
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """Pipeline form: the documents without all but the first of each group; same columns."""
    gone = near_duplicates(docs, words, percent).where("NOT kept").select(F.col("doc_id").alias("_doc")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_doc"], "left_anti")


def query(spark, sf_dir) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)
