"""Token ids as grammar-compressed binary files (Re-Pair).

Documents are range-partitioned and sorted by doc_id, encoded with a public byte-level BPE, and closed with an end id.
Each partition is a shard, written by Spark as one Parquet file of blocks.  A block holds about ``BLOCK_TOKENS`` ids of
whole documents:

    shard, block        place of the block; (shard, block) ascends with doc_id
    first               ids of the same shard before the block
    doc_ids, lengths    little-endian int64 doc_ids, uint32 ids per document
    rules               little-endian uint32 pairs; rule r stands for symbol ``N_IDS + r``
    spans               little-endian uint32: number of ids that each rule expands to
    symbols             little-endian uint16 sequence of ids and nonterminals

Re-Pair replaces the most frequent pairs of neighbours by new symbols, level by level, until no pair occurs
``MIN_USES`` times.  Pairs of one level whose counts are within ``LEVEL_RATIO`` of the largest are replaced at once,
the more frequent first where they overlap.  Prefix sums over ``spans`` find any document without decoding others.

Defined results: a null text is empty, so its ids are the end id alone; a null doc_id sorts first; rows with one
doc_id keep their number, ordered by text; an empty table gives no file rows.
"""

import itertools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import of_worker, tokenizer_file, written
from .word_table import grouped

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
N_IDS = 50_257
MAX_RULES = 65_536 - N_IDS  # a symbol has 16 bits
BLOCK_TOKENS = 1 << 18
MIN_USES = 16  # a rule takes the room of six symbols
LEVEL_RATIO = 32
HASH_BITS = 16
GROUP_CHARS = 1 << 22
HELD_WORDS, JOINED_WORDS = 500_000, 100
BLOCK_SCHEMA = (
    "shard int, block int, first long, n_tokens long, doc_ids binary, lengths binary, rules binary, spans binary,"
    " symbols binary"
)
RUNS = ("  ", " \n", "\n ", "\n\n")
# what is white space to Python or the vocabulary's pattern alone, and the mark of first words
ASCII_SPACE = "\x00\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
OTHER_SPACE = "\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
FIRST = "\x00"  # marks the first word of a text


class Encoder:
    """Ids of texts as little-endian uint32 bytes.  The words met last are held, between ``HELD_WORDS`` and twice as many
    and those of a group.  A group's words are told apart by Arrow, so that a word is looked up once a group."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.literals = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.leads = {}  # ids that begin with a blank, with a newline
        for space, mark in ((" ", "Ġ"), ("\n", "Ċ")):
            self.leads[space] = np.zeros(max(vocabulary.values()) + 1, bool)
            self.leads[space][[i for piece, i in vocabulary.items() if piece.startswith(mark)]] = True
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _after(self, space: str, words: list[str]) -> list[bytes]:
        """Words with the blank or newline that leads them, many in one text, cut where a token begins with it."""
        out = []
        for at in range(0, len(words), JOINED_WORDS):
            some = words[at : at + JOINED_WORDS]
            raw = self.ids([space + space.join(some)])[0]
            cuts = (4 * np.flatnonzero(self.leads[space][np.frombuffer(raw, "<u4")])).tolist()
            if len(cuts) == len(some) and cuts[0] == 0:
                out += [raw[start:stop] for start, stop in zip(cuts, [*cuts[1:], len(raw)])]
            else:  # of another kind of vocabulary
                out += self.ids([space + word for word in some])
        return out

    def _learn(self, words: list[str]):
        """Takes up words that are not held in ``recent``."""
        known = [self.older.get(word) for word in words]
        self.recent.update((word, ids) for word, ids in zip(words, known) if ids is not None)
        missing = [word for word, ids in zip(words, known) if ids is None]
        inner = [word for word in missing if word[0] not in "\n\x00"]
        lines = [word for word in missing if word[0] == "\n"]
        first = [word for word in missing if word[0] == FIRST]
        self.recent.update(zip(inner, self._after(" ", inner)))
        self.recent.update(zip(lines, self._after("\n", [word[1:] for word in lines])))
        self.recent.update(zip(first, self.ids([word[1:] for word in first])))

    def _of_words(self, marked: list[str]) -> Iterator[bytes]:
        if len(self.recent) > HELD_WORDS:
            self.older, self.recent = self.recent, {}
        split = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each
        found = list(map(self.recent.get, distinct))
        gone = [at for at, ids in enumerate(found) if ids is None]
        self._learn([distinct[at] for at in gone])
        for at in gone:
            found[at] = self.recent[distinct[at]]
        row = pa.array(found, pa.large_binary()).take(words.indices)
        ends, data = np.frombuffer(row.buffers()[1], "<i8", len(row) + 1), row.buffers()[2]
        bounds = ends[split.offsets.to_numpy()].tolist()
        for start, stop in itertools.pairwise(bounds):
            yield data[start:stop].to_pybytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for group in grouped(texts, GROUP_CHARS):
            # a text with the literal of an added token is encoded as one
            marked = ["" if any(map(text.__contains__, self.literals)) else marked_words(text) for text in group]
            by_words = self._of_words(list(filter(None, marked)))
            for text, words in zip(group, marked):
                yield next(by_words) if words else self.ids([text])[0] if text else b""


def marked_words(text: str) -> str:
    """Pieces whose tokens do not depend on their neighbours, parted by blanks: words, each led by the blank (left out
    here) or newline before it, the first one marked.  Nothing for a text with other white space or runs of it: such a
    text is encoded as one."""
    if not text or text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, RUNS)):
        return ""
    if any(map(text.__contains__, ASCII_SPACE)) or not text.isascii() and any(map(text.__contains__, OTHER_SPACE)):
        return ""
    return FIRST + text.replace("\n", " \n")


def _slots(keys: np.ndarray) -> np.ndarray:
    return keys * np.uint32(2654435761) >> np.uint32(32 - HASH_BITS)


def _level(seq: np.ndarray, hot: np.ndarray, newest: int, min_uses: int, room: int):
    """(positions, ranks, pairs, hot): pairs to replace now, where, and the slots of pairs that may be frequent still.
    Only pairs of hot slots and those with a symbol from ``newest`` on are counted, by sorting: no other pair got more
    uses since it was found rare.  Of frequent pairs with one slot the first is replaced, the others on a later level."""
    keys = seq[:-1] << np.uint32(16) | seq[1:]
    slots, new = _slots(keys), seq >= newest
    near = np.flatnonzero(hot[slots] | new[:-1] | new[1:])
    keys, slots = keys[near], slots[near]
    in_order = np.sort(keys)
    starts = np.flatnonzero(np.append(in_order[:1] == in_order[:1], in_order[1:] != in_order[:-1]))
    uses = np.diff(np.append(starts, len(keys)))
    least = max(min_uses, uses.max(initial=0) // LEVEL_RATIO)
    chosen = np.flatnonzero(uses >= least)
    chosen = chosen[np.argsort(-uses[chosen], kind="stable")][:room]
    pairs = in_order[starts[chosen]]
    if not len(pairs):
        return near[:0], near[:0], np.zeros((0, 2), np.uint32), hot
    rank, hot = np.zeros(1 << HASH_BITS, np.int32), np.full(1 << HASH_BITS, least > min_uses)
    rank[_slots(pairs)[::-1]] = np.arange(len(pairs))[::-1]  # of equal slots the last entry stays
    hot[_slots(pairs)] = True
    ranks = rank[slots]
    found = np.flatnonzero(pairs[ranks] == keys)
    return near[found], ranks[found], np.stack([pairs >> np.uint32(16), pairs & np.uint32(0xFFFF)], 1), hot


def repair(symbols: np.ndarray, min_uses: int = MIN_USES, max_rules: int = MAX_RULES):
    """(symbols, rules): the shortened sequence and the pairs that the new symbols stand for."""
    seq, rules = symbols.astype(np.uint32), np.zeros((0, 2), np.uint32)
    hot, newest = np.ones(1 << HASH_BITS, bool), N_IDS
    while len(rules) < max_rules and len(seq) > 1:
        at, ranks, pairs, hot = _level(seq, hot, newest, min_uses, max_rules - len(rules))
        newest = N_IDS + len(rules)
        if not len(at):
            break
        touches = np.append(at[1:] == at[:-1] + 1, False)  # the next pair overlaps this one
        repeats = np.append(False, touches[:-1] & (ranks[1:] == ranks[:-1]))  # aaaa: every other pair is taken
        starts = np.flatnonzero(~repeats)
        offset = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        free = ~np.append(False, touches[:-1]) | (ranks < np.append(0, ranks[:-1]))  # of the pair before
        free = np.repeat(free[starts], np.diff(np.append(starts, len(at))))
        take = free & (offset % 2 == 0) & (~touches | (ranks <= np.append(ranks[1:], 0)))
        at, ranks = at[take], ranks[take]
        used = np.bincount(ranks, minlength=len(pairs)) > 0
        seq[at] = N_IDS + len(rules) + (np.cumsum(used) - 1)[ranks]
        kept = np.ones(len(seq), bool)
        kept[at + 1] = False
        seq = seq[kept]
        rules = np.concatenate([rules, pairs[used]])
    return seq, rules


def spans_of(rules: np.ndarray) -> np.ndarray:
    """Number of ids under each rule; rules refer to earlier ones only."""
    spans: list[int] = []
    for left, right in (rules.astype(np.int64) - N_IDS).tolist():
        spans.append((spans[left] if left >= 0 else 1) + (spans[right] if right >= 0 else 1))
    return np.array(spans, np.int64)


def expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that ``symbols`` stand for.  Each nonterminal among them is unfolded once, one level a pass, and its ids
    are copied to its places."""
    symbols = symbols.astype(np.int64)
    met = np.flatnonzero(np.bincount(symbols, minlength=N_IDS)[N_IDS:])
    seq, owner = met + N_IDS, np.arange(len(met))
    while (inner := seq >= N_IDS).any():
        width = 1 + inner
        starts = (np.cumsum(width) - width)[inner]
        pairs = rules[seq[inner] - N_IDS]
        seq, owner = np.repeat(seq, width), np.repeat(owner, width)
        seq[starts], seq[starts + 1] = pairs[:, 0], pairs[:, 1]
    ids = np.concatenate([np.arange(N_IDS, dtype=np.uint32), seq.astype(np.uint32)])
    own = np.bincount(owner, minlength=len(met))
    first, spans = np.arange(N_IDS + len(rules)), np.ones(N_IDS + len(rules), np.int64)
    first[met + N_IDS], spans[met + N_IDS] = N_IDS + np.cumsum(own) - own, own
    width = spans[symbols]
    return ids[np.arange(width.sum()) + np.repeat(first[symbols] - np.cumsum(width) + width, width)]


def pack(shard: int, block: int, first: int, doc_ids: list, ids: list[bytes]) -> dict:
    lengths = np.array([len(x) // 4 for x in ids], "<u4")
    symbols, rules = repair(np.frombuffer(b"".join(ids), "<u4"))
    known = np.array([-1 if d is None else d for d in doc_ids], "<i8").tobytes()
    absent = np.packbits([d is None for d in doc_ids]).tobytes()
    return {
        "shard": shard, "block": block, "first": first, "n_tokens": int(lengths.sum()),
        "doc_ids": known + absent, "lengths": lengths.tobytes(), "rules": rules.astype("<u4").tobytes(),
        "spans": spans_of(rules).astype("<u4").tobytes(), "symbols": symbols.astype("<u2").tobytes(),
    }


def _parts(row: dict):
    lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
    n = len(lengths)
    absent = np.unpackbits(np.frombuffer(row["doc_ids"][8 * n :], np.uint8), count=n).astype(bool)
    doc_ids = [None if gone else d for d, gone in zip(np.frombuffer(row["doc_ids"][: 8 * n], "<i8").tolist(), absent)]
    rules = np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2)
    return doc_ids, lengths, rules, np.frombuffer(row["symbols"], "<u2")


def unpack(row: dict):
    """(doc_id, ids) of every document of a block."""
    doc_ids, lengths, rules, symbols = _parts(row)
    ids, ends = expand(symbols, rules), np.cumsum(lengths)
    for doc_id, length, end in zip(doc_ids, lengths.tolist(), ends.tolist()):
        yield doc_id, ids[end - length : end]


def read_document(row: dict, index: int) -> np.ndarray:
    """Ids of one document of a block: only the symbols that cover it are expanded."""
    _, lengths, rules, symbols = _parts(row)
    spans = np.ones(N_IDS + len(rules), np.int64)
    spans[N_IDS:] = np.frombuffer(row["spans"], "<u4")
    ends = np.cumsum(spans[symbols])
    start = int(lengths[:index].sum())
    stop = start + int(lengths[index])
    low, high = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
    skipped = int(ends[low - 1]) if low else 0
    return expand(symbols[low : high + 1], rules)[start - skipped : stop - skipped]


def blocks(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Blocks of the documents in ascending doc_id order."""
    path = vocabulary or tokenizer_file(VOCABULARY)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        # one encoder a worker process: what it has learned serves later tasks
        encode, shard = of_worker(f"encoder {path}", lambda: Encoder(path)).encode, TaskContext.get().partitionId()
        block = first = held = 0
        doc_ids, ids = [], []

        def close():
            row = pack(shard, block, first, doc_ids, ids)
            return pa.RecordBatch.from_pylist([row], BLOCKS)

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                doc_ids.append(doc_id)
                ids.append(found + end)
                held += len(ids[-1]) // 4
                if held >= BLOCK_TOKENS:
                    yield close()
                    block, first, held, doc_ids, ids = block + 1, first + held, 0, [], []
        if ids:
            yield close()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, BLOCK_SCHEMA)


BLOCKS = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64())]
    + [(name, pa.binary()) for name in ("doc_ids", "lengths", "rules", "spans", "symbols")]
)
ROWS = pa.schema(
    [("shard", pa.int32()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()),
     ("ids_crc32", pa.int64())]
)


def _documents(batches):
    for batch in batches:
        for row in batch.to_pylist():
            every = list(unpack(row))
            lengths = np.array([len(ids) for _, ids in every])
            sums = [zlib.crc32(ids.astype("<u4", copy=False)) for _, ids in every]
            columns = [
                np.full(len(every), row["shard"], np.int32), [doc_id for doc_id, _ in every],
                row["first"] + np.cumsum(lengths) - lengths, lengths, sums,
            ]
            yield pa.record_batch([pa.array(x, field.type) for x, field in zip(columns, ROWS)], schema=ROWS)


def read_back(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the blocks."""
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))  # a row per file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = files.mapInArrow(_documents, "shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, "shard").select(
        "doc_id", (F.col("_before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def query(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_back(written(blocks(docs), "token-blocks"))
