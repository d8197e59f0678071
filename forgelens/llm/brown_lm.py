"""Class-based n-gram language model (Brown clusters found by the exchange algorithm).

    P(word | word before) = P(class of the word | context class of the word before) * P(word | class of the word)

Every training word gets its class by exchange.  The ``UNITS`` most frequent words come first, together with
``ENDINGS`` groups of all other words by a checksum of their last two letters and with the end of a document, which is
a class of its own and the context of first words: unit after unit moves to the class that raises the likelihood of the
class bigrams most, until none moves.  The bigrams of units are counted over all training text; of the corpus only
they reach the driver, a table of (UNITS + ENDINGS + 1) squared cells whatever the corpus, and the DIRECT most frequent
words.

Then all other words, however rare, move one by one out of their ending's class (predictive exchange, as Uszkoreit and
Brants described it for distributed clustering, 2008).  A table keeps each word with the context classes it was met
after, and every pass over it takes each word to the class of the largest gain, its own counts taken out first.  The
class bigrams are summed anew after each pass.  A pass that does not raise the likelihood, because too many words moved
together, is dropped and the words move in parts instead; the passes end when the likelihood rises by less than
``TOLERANCE`` a token.  As the context of the next word, a word outside the most frequent acts by its ending, so that no
text waits for the classes of its rare words; endings also class the words that training lacks.

Word counts cover all words.  The ``DIRECT`` most frequent go to the workers with counts and classes; the tail of the
text meets its own in a join, as rows (text, word, context, times) that are summed within a text first.  So frequent
words never cross the network, and no table grows in a worker with the vocabulary.

Smoothing: class transitions are interpolated with class frequencies (``TRANSITION_WEIGHT`` pseudo-counts), word
emissions get ``EMISSION_WEIGHT`` more than counted, also one unknown word a class.

Defined results: null and empty texts are one end token; words of a held-out text that training lacks count as the
unknown word of their ending's class; texts are read whole, however long; rows that repeat a doc_id are scored one by
one; an input column named like a result (or like an intermediate column, see ``PARTS``) gives way to it; without
training text all classes and words are equally likely; an empty table gives an empty table.
"""

import itertools
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import remainder, written

UNITS, ENDINGS, CLASSES, ROUNDS = 2048, 256, 64, 10
DIRECT = 100_000
TOLERANCE = 1e-3  # rise of the log likelihood a token below which the passes over rare words end
PARTS_AT_ONCE = 8  # words move in up to this many parts before a pass counts as the last
MOVED_WORDS = 1024  # words whose gains are held together
TIE = 1e-9  # far below any gain
SMALL = 8  # counts up to this one share a table of gains
TRANSITION_WEIGHT, EMISSION_WEIGHT = 20.0, 0.5
FOLDS, HELD_FOLD = 7, 2
END = UNITS + ENDINGS  # the unit of a document's end
COUNT_BLOCKS = 16
FLUSH_WORDS, FLUSH_TOKENS, GROUP_CHARS = 200_000, 1 << 19, 1 << 20
# sums over frequent words; with a word set, a row of the tail instead
PARTS = (
    T.StructType().add("_key", "long").add("_tokens", "long").add("_known", "long").add("_base", "double")
    .add("_score", "double").add("_word", "binary").add("_before", "integer").add("_times", "long")
)
RESULTS = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def ending(word: bytes) -> int:
    """Unit of a word outside the most frequent."""
    return UNITS + zlib.crc32(word[-2:]) % ENDINGS


# --- counts ---------------------------------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts; each task sums its own words before the shuffle."""

    def run(batches):
        held: dict[bytes, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word in words_of(text):
                    held[word] = held.get(word, 0) + 1
                if len(held) >= FLUSH_WORDS:
                    yield rows()
                    held = {}
        yield rows()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent words with rank and count."""

    def __init__(self, words: list[tuple[bytes, int]]):
        self.rank = {word: i for i, (word, _) in enumerate(words)}
        self.counts = np.array([n for _, n in words], np.int64)

        self.unit_of = np.array([i if i < UNITS else ending(word) for word, i in self.rank.items()], np.int64)

    def read(self, texts: list[str | None]) -> "Read":
        """The words of some texts, looked up together."""
        words, lengths = [], []
        for text in texts:
            found = words_of(text)
            words += found
            lengths.append(len(found))
        rank = np.fromiter(map(self.rank.get, words, itertools.repeat(-1)), np.int64, len(words))
        tail, units = np.flatnonzero(rank < 0), np.full(len(words) + 1, END)
        units[:-1][rank >= 0] = self.unit_of[rank[rank >= 0]]
        tail_words = [words[at] for at in tail.tolist()]
        units[tail] = list(map(ending, tail_words))
        lengths = np.array(lengths, np.int64)
        ends, full = np.cumsum(lengths), lengths > 0
        before = np.append(END, units[:-1])[: len(words)]
        before[(ends - lengths)[full]] = END
        last = np.where(full, units[ends - 1], END)
        return Read(np.repeat(np.arange(len(texts)), lengths), lengths, rank, units[:-1], before, last, tail, tail_words)


class Read(NamedTuple):
    text: np.ndarray  # of each word: the text, its rank or -1, its unit and the unit before it
    lengths: np.ndarray
    rank: np.ndarray
    units: np.ndarray
    before: np.ndarray
    last: np.ndarray  # of each text: the unit before its end
    tail: np.ndarray  # places and words without rank
    tail_words: list[bytes]


def _groups(batches, column):
    """(rows, their texts) of about GROUP_CHARS characters."""
    for whole in batches:
        texts, start, size = whole.column(column).to_pylist(), 0, 0
        for at, text in enumerate(texts, 1):
            size += len(text or "")
            if size >= GROUP_CHARS or at == len(texts):
                yield whole.slice(start, at - start), texts[start:at]
                start, size = at, 0


def unit_bigrams(texts: DataFrame, head) -> np.ndarray:
    """How often each unit follows each: summed in the tasks, then in COUNT_BLOCKS blocks of cells."""
    size = END + 1
    bounds = np.linspace(0, size * size, COUNT_BLOCKS + 1).astype(np.int64)

    def add(cells, held):
        met, times = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
        cells[met] += times.astype(np.int32)

    def count(batches):
        known, held, tokens, cells = Vocabulary(head.value), [], 0, np.zeros(size * size, np.int32)
        for _, texts in _groups(batches, 0):
            read = known.read(texts)
            held += [read.before * size + read.units, read.last * size + END]
            tokens += len(read.units) + len(read.last)
            if tokens >= FLUSH_TOKENS:
                add(cells, held)
                held, tokens = [], 0
        add(cells, held)
        at = np.flatnonzero(cells)
        cuts = np.searchsorted(at, bounds)
        for block, (start, stop) in enumerate(zip(cuts, cuts[1:])):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([(at[start:stop] - bounds[block]).astype(np.uint32).tobytes()]),
                 pa.array([cells[at[start:stop]].astype(np.int64).tobytes()])],
                ["block", "cells", "counts"],
            )

    def total(frame):
        block = int(frame["block"].iloc[0])
        out = np.zeros(bounds[block + 1] - bounds[block], np.int64)
        for cells, counts in zip(frame["cells"], frame["counts"]):
            out[np.frombuffer(cells, np.uint32)] += np.frombuffer(counts, np.int64)
        return pd.DataFrame({"block": [block], "counts": [zlib.compress(out.tobytes(), 1)]})

    partial = texts.select("text").mapInArrow(count, "block int, cells binary, counts binary")
    out = np.zeros(size * size, np.int64)
    for block, counts in partial.groupBy("block").applyInPandas(total, "block int, counts binary").toLocalIterator():
        out[bounds[block] : bounds[block + 1]] = np.frombuffer(zlib.decompress(counts), np.int64)
    return out.reshape(size, size)


# --- exchange -------------------------------------------------------------------------------------------------------


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(matrix: np.ndarray) -> float:
    """Log likelihood of class bigrams, up to what no assignment changes."""
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(0)).sum() - _xlogx(matrix.sum(1)).sum())


def class_matrix(bigrams: np.ndarray, classes: np.ndarray) -> np.ndarray:
    member = np.eye(CLASSES)[classes]
    return member.T @ bigrams @ member


def exchange(bigrams: np.ndarray, classes: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Moves units, the most frequent first, to the class that raises the likelihood most, until none moves.  The end
    stays alone in its class."""
    bigrams, classes = bigrams.astype(np.float64), classes.copy()
    member = np.eye(CLASSES)[classes]
    after, before = bigrams @ member, bigrams.T @ member  # of every unit with every class
    matrix = member.T @ after
    rows, columns = matrix.sum(1), matrix.sum(0)
    every, own = np.arange(CLASSES), classes[END]
    order = np.argsort(-bigrams.sum(1), kind="stable")
    for _ in range(rounds):
        moved = 0
        for unit in order:
            out, into, twice = after[unit].copy(), before[unit].copy(), bigrams[unit, unit]
            n_out, n_in, old = out.sum(), into.sum(), classes[unit]
            if unit == END or n_in == 0:
                continue
            matrix[old] -= out
            matrix[:, old] -= into
            matrix[old, old] += twice
            rows[old] -= n_out
            columns[old] -= n_in
            out[old] -= twice
            into[old] -= twice
            now = _xlogx(matrix)
            right, down = _xlogx(matrix + out) - now, _xlogx(matrix + into[:, None]) - now
            diagonal = matrix[every, every]
            gain = right.sum(1) - right[every, every] + down.sum(0) - down[every, every]
            gain += _xlogx(diagonal + out + into + twice) - now[every, every]
            gain -= _xlogx(rows + n_out) - _xlogx(rows) + _xlogx(columns + n_in) - _xlogx(columns)
            gain[own] = -np.inf
            new = int(gain.argmax()) if gain.max() > gain[old] + 1e-6 else old
            matrix[new] += out
            matrix[:, new] += into
            matrix[new, new] += twice
            rows[new] += n_out
            columns[new] += n_in
            if new != old:
                moved += 1
                classes[unit] = new
                for table, step in ((after, bigrams[:, unit]), (before, bigrams[unit])):
                    table[:, old] -= step
                    table[:, new] += step
        if not moved:
            break
    return classes


def first_classes(bigrams: np.ndarray) -> np.ndarray:
    """Units in turn, by frequency, over all classes but the last, which the end keeps."""
    classes = np.empty(END + 1, np.int64)
    classes[np.argsort(-bigrams.sum(1), kind="stable")] = np.arange(END + 1) % (CLASSES - 1)
    classes[END] = CLASSES - 1
    return classes


# --- classes of all other words ---------------------------------------------------------------------------------------


def contexts(texts: DataFrame, shared) -> DataFrame:
    """(word, n, cells) of all words outside the UNITS most frequent: how often each follows each context class."""

    def rows(words, before, times):
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array(before, pa.int32()), pa.array(times, pa.int64())], ["word", "before", "n"]
        )

    def count(batches):
        head, classes = shared.value
        known, held = Vocabulary(head), {}
        frequent, pending, tokens = np.zeros(len(head) * CLASSES, np.int32), [], 0
        for _, texts in _groups(batches, 0):
            read = known.read(texts)
            before, direct = classes[read.before], read.rank >= UNITS
            pending.append(read.rank[direct] * CLASSES + before[direct])
            tokens += len(before)
            for pair in zip(read.tail_words, before[read.tail].tolist()):
                held[pair] = held.get(pair, 0) + 1
            if len(held) >= FLUSH_WORDS:
                yield rows(*zip(*held), held.values())
                held = {}
            if tokens >= FLUSH_TOKENS:
                met, times = np.unique(np.concatenate(pending), return_counts=True)
                frequent[met] += times.astype(np.int32)
                pending, tokens = [], 0
        if pending:
            met, times = np.unique(np.concatenate(pending), return_counts=True)
            frequent[met] += times.astype(np.int32)
        if held:
            yield rows(*zip(*held), held.values())
        at, words = np.flatnonzero(frequent), list(known.rank)
        yield rows([words[i] for i in (at // CLASSES).tolist()], at % CLASSES, frequent[at])

    # by word alone, so that both sums find their rows in place; the tasks have summed theirs already
    met = texts.select("text").mapInArrow(count, "word binary, before int, n long").repartition("word")
    cells = met.groupBy("word", "before").agg(F.sum("n").alias("n"))
    return cells.groupBy("word").agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("before", "n"))).alias("cells")  # CLASSES at most
    )


class Gains:
    """Gains of the likelihood by moving words; ``own`` takes none."""

    def __init__(self, matrix: np.ndarray, own: int):
        self.matrix, self.own, self.totals, self.now = matrix, own, matrix.sum(0), _xlogx(matrix)
        self.small = np.stack([_xlogx(matrix + k) - self.now for k in range(SMALL + 1)])

    def best(self, n, starts, before, times, old) -> np.ndarray:
        """The class of largest gain for each word, its old one where none is better.  The cells (before, times) of a
        word begin at its start.  Of classes alike, such as empty ones, a word's main context decides, so that words of
        one context move together and others elsewhere."""
        matrix, totals, every = self.matrix, self.totals, np.arange(len(n))
        gain = self.small[np.minimum(times, SMALL), before]
        large = np.flatnonzero(times > SMALL)
        gain[large] = _xlogx(matrix[before[large]] + times[large, None]) - self.now[before[large]]
        gain = np.add.reduceat(gain, starts, 0)
        gain -= _xlogx(totals + n[:, None]) - _xlogx(totals)
        left = matrix[before, np.repeat(old, np.diff(np.append(starts, len(times))))]
        stay = np.add.reduceat(_xlogx(left) - _xlogx(left - times), starts)  # of coming back to what the word leaves
        stay -= _xlogx(totals[old]) - _xlogx(totals[old] - n)
        main = np.maximum.reduceat(times * CLASSES + before, starts) % CLASSES
        gain += TIE * ((np.arange(CLASSES) - main[:, None]) % CLASSES)
        gain[:, self.own] = -np.inf
        gain[every, old] = stay
        new = gain.argmax(1)
        return np.where(gain[every, new] > stay + 1e-6, new, old)


def moved(words: DataFrame, matrix: np.ndarray, own: int, part: int, parts: int) -> DataFrame:
    """``words`` (word, n, cells, class) after one pass, in which one part of the words may move."""
    shared = words.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        gains = Gains(shared.value, own)
        for batch in (whole.slice(at, MOVED_WORDS) for whole in batches for at in range(0, whole.num_rows, MOVED_WORDS)):
            cells, old = batch.column("cells"), batch.column("class").to_numpy(zero_copy_only=False)
            flat, offsets = cells.flatten(), cells.offsets.to_numpy()
            before, times = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            n = batch.column("n").to_numpy(zero_copy_only=False)
            new = gains.best(n, offsets[:-1] - offsets[0], before, times, old)
            turn = parts == 1 or np.array([zlib.crc32(word) % parts == part for word in batch.column("word").to_pylist()])
            fresh = pa.array(np.where(turn, new, old).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], fresh], ["word", "n", "cells", "class"])

    return words.select("word", "n", "cells", "class").mapInArrow(run, words.schema)


def following(words: DataFrame) -> np.ndarray:
    """How often words of each class follow each context class."""
    out = np.zeros((CLASSES, CLASSES))
    cells = words.select("class", F.explode("cells").alias("cell"))
    for before, into, n in cells.groupBy("cell.before", "class").agg(F.sum("cell.n")).collect():  # CLASSES squared rows
        out[before, into] = n
    return out


def predictive_likelihood(matrix: np.ndarray) -> float:
    """Log likelihood of all words after their contexts, up to what no class of a word changes."""
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(0)).sum())


def exchange_rest(words: DataFrame, matrix: np.ndarray, own: int) -> tuple[DataFrame, np.ndarray]:
    """(words, matrix) after passes over all words until the likelihood rises no more.  ``matrix`` counts classes after
    context classes, the most frequent words and ends included."""
    fixed, parts, tokens = matrix - following(words), 1, max(matrix.sum(), 1)
    now, idle = predictive_likelihood(matrix), 0
    for turn in itertools.count():
        after = written(moved(words, matrix, own, turn % parts, parts), "word-classes")
        fresh = fixed + following(after)
        rise = predictive_likelihood(fresh) - now
        if rise > 0:
            words, matrix, now = after, fresh, now + rise
        if rise <= 0 and parts < PARTS_AT_ONCE and not np.array_equal(fresh, matrix):
            parts, idle = parts * 2, 0
        elif rise > TOLERANCE * tokens:
            idle = 0
        elif (idle := idle + 1) >= parts:  # every part had its turn
            return words, matrix


# --- model ----------------------------------------------------------------------------------------------------------


class Model:
    """Everything that scoring needs besides the counts of the tail."""

    def __init__(self, head, classes, into, matrix, n_words, types, tokens, distinct, n_texts):
        self.vocabulary, self.classes, self.n_texts = (vocabulary := Vocabulary(head)), classes, n_texts
        self.into = into  # classes of the frequent words; ``classes``: context classes of all units
        self.tokens, self.distinct = tokens, distinct  # of the training text, ends included
        self.base_divisor = tokens + 1 * (distinct + 1)
        shares = (matrix.sum(0) + 1) / (matrix.sum() + CLASSES)
        smoothed = matrix + TRANSITION_WEIGHT * shares
        self.transition = np.log10(smoothed / smoothed.sum(1, keepdims=True))
        # of each class but the end's: counted words and types, and one unknown word
        self.divisor = n_words + EMISSION_WEIGHT * (types + 1)
        self.emission = np.log10((vocabulary.counts + EMISSION_WEIGHT) / self.divisor[into])
        self.base = np.log10((vocabulary.counts + 1) / self.base_divisor)

    def score(self, texts: list[str | None]):
        """(tokens, known, base, score), each of every text, and the rest: sums over the frequent words and the end; the
        other words as (text, word, context class) with their numbers."""
        read = self.vocabulary.read(texts)
        before, direct, count = self.classes[read.before], read.rank >= 0, len(texts)
        at, rank = read.text[direct], read.rank[direct]
        base = np.bincount(at, self.base[rank], count) + float(np.log10((self.n_texts + 1) / self.base_divisor))
        words = self.emission[rank] + self.transition[before[direct], self.into[rank]]
        score = np.bincount(at, words, count) + self.transition[self.classes[read.last], self.classes[END]]
        known = np.bincount(at, minlength=count) + (self.n_texts > 0)
        tail = Counter(zip(read.text[read.tail].tolist(), read.tail_words, before[read.tail].tolist()))
        return (read.lengths + 1, known, base, score), tail


def train(texts: DataFrame):
    """(parts, words): what Model is made of, and the (word, n, class) table of all training words but the UNITS most
    frequent."""
    spark = texts.sparkSession
    counts = written(word_counts(texts), "word-counts")
    n_texts = texts.count()
    frequent = written(counts.orderBy(F.desc("n"), "word").limit(DIRECT), "frequent-words")
    head = sorted(((bytes(word), n) for word, n in frequent.collect()), key=lambda pair: (-pair[1], pair[0]))
    bigrams = unit_bigrams(texts, spark.sparkContext.broadcast(head))
    classes = exchange(bigrams, first_classes(bigrams))
    met = contexts(texts, spark.sparkContext.broadcast((head, classes)))
    words = written(met.withColumn("class", _of_ending(classes)), "word-classes")
    words, matrix = exchange_rest(words, class_matrix(bigrams, classes), classes[END])
    rank, into = {word: i for i, (word, _) in enumerate(head)}, np.zeros(len(head), np.int64)
    into[:UNITS] = classes[: min(UNITS, len(head))]
    later = words.join(F.broadcast(frequent.select("word")), "word", "left_semi")  # DIRECT rows
    for word, found in later.select("word", "class").collect():
        into[rank[bytes(word)]] = found
    n_words, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for (_, n), found in zip(head[:UNITS], into):
        n_words[found] += n
        types[found] += 1
    for found, n, m in words.groupBy("class").agg(F.sum("n"), F.count("*")).collect():
        n_words[found] += n
        types[found] += m
    n_all, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    parts = (head, classes, into, matrix, n_words, types, n_all + n_texts, distinct + (n_texts > 0), n_texts)
    return parts, words.select("word", "n", "class")


def _numbers(values) -> Column:
    return F.expr(f"array({', '.join(map(repr, values))})")


def _of_ending(classes: np.ndarray) -> Column:
    """The class of a word's ending."""
    return F.element_at(_numbers(classes[UNITS:END].tolist()), _ending() - UNITS + 1).cast("int")


def _ending() -> Column:
    last = F.expr("substring(word, greatest(length(word) - 1, 1), 2)")
    return (UNITS + F.crc32(last) % ENDINGS).cast("int")


def score_texts(docs: DataFrame, training: DataFrame) -> DataFrame:
    """``docs`` without text, with n_tokens, n_known, train_tokens, base_score and score."""
    parts, counts = train(training)
    model, shared = Model(*parts), docs.sparkSession.sparkContext.broadcast(parts)
    taken = {"text", *PARTS.names, *RESULTS}
    kept = [name for name in docs.columns if name.lower() not in taken]
    fields = {name: docs.schema[name] for name in kept}
    schema = T.StructType([*fields.values(), *PARTS.fields])

    def run(batches):
        known, part, row = Model(*shared.value), TaskContext.get().partitionId(), 0
        for batch, texts in _groups(batches, "text"):
            sums, tail = known.score(texts)
            rows = [(part << 40) + row + np.arange(len(texts)), *sums]
            tails = [((part << 40) + row + at, word, before, times) for (at, word, before), times in tail.items()]
            row += len(texts)
            own = batch.select(kept)
            none = pa.nulls(len(texts))
            columns = list(map(pa.array, rows))
            table = pa.Table.from_arrays(
                [*own.columns, *columns, *(none.cast(arrow_schema.field(name).type) for name in PARTS.names[5:])], names=[*kept, *PARTS.names]
            )
            yield from table.cast(arrow_schema).to_batches()
            if tails:
                keys, *found = (pa.array(side) for side in zip(*tails))
                blank = [pa.nulls(len(tails), arrow_schema.field(name).type) for name in [*kept, *PARTS.names[1:5]]]
                columns = [*blank[: len(kept)], keys, *blank[len(kept) :], *found]
                table = pa.Table.from_arrays(columns, names=[*kept, *PARTS.names])
                yield from table.cast(arrow_schema).to_batches()

    arrow_schema = to_arrow_schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]))
    rows = written(docs.mapInArrow(run, schema), "scored")
    tail = rows.where("_word IS NOT NULL").select("_key", F.col("_word").alias("word"), "_before", "_times")
    into = F.coalesce("class", _of_ending(model.classes))
    divisor = F.element_at(_numbers(model.divisor.tolist()), into + 1)
    transition = F.element_at(_numbers(model.transition.ravel().tolist()), F.col("_before") * CLASSES + into + 1)
    n = F.coalesce("n", F.lit(0))
    late = tail.join(counts, "word", "left").groupBy("_key").agg(
        F.sum(F.when(n > 0, F.col("_times")).otherwise(0)).alias("_known_tail"),
        F.sum(F.col("_times") * F.log10((n + 1) / F.lit(float(model.base_divisor)))).alias("_base_tail"),
        F.sum(F.col("_times") * (transition + F.log10((n + EMISSION_WEIGHT) / divisor))).alias("_score_tail"),
    )
    zero = F.lit(0.0)
    return rows.where("_word IS NULL").join(late, "_key", "left").select(
        *kept,
        F.col("_tokens").alias("n_tokens"),
        (F.col("_known") + F.coalesce("_known_tail", F.lit(0))).alias("n_known"),
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_base_tail", zero)).alias("base_score"),
        (F.col("_score") + F.coalesce("_score_tail", zero)).alias("score"),
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """(perplexity, base_perplexity) over all scored texts."""
    tokens = F.sum("n_tokens")
    return scored.agg(
        F.pow(F.lit(10.0), -F.sum("score") / tokens).alias("perplexity"),
        F.pow(F.lit(10.0), -F.sum("base_score") / tokens).alias("base_perplexity"),
    )


def query(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.withColumn("held_out", remainder("doc_id", FOLDS) == HELD_FOLD)
    return score_texts(rows, rows.where("NOT coalesce(held_out, false)"))
