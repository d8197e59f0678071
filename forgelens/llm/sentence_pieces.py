"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces come from a public SentencePiece model file (a parameter; nothing is trained).  That file ranks its pieces and
gives no probabilities, so a piece of rank r gets the log probability of Zipf's law, log(1 / ((r + 1) * H)).

Encoding: a blank is put before the text and blanks are the white-space marker of the pieces.  The segmentation with the
largest sum of log scores is taken; at equal scores the one whose last piece starts first.  A character that is no
piece is unknown (the least score less 10) and becomes its UTF-8 bytes as byte pieces.  Decoding joins the pieces, turns
markers into blanks and removes the first; encoding and decoding give every text back, also one that holds the marker
character itself, which is encoded as bytes.

No piece holds a marker after another character (checked on load), so the best segmentation is that of each run of
blanks with the word after it.  Words that a task has not met before are segmented together: the search walks the
trie for all of them at once, position by position.  A long word, as in scripts without blanks, is cut before between any
two characters that are neighbours in no piece: every segmentation has a border there, so the best one is that of the
parts, and different parts are segmented once, together.  The trie and a bounded table of words are all that a worker holds.

Defined results: null and empty texts have no pieces; rows are independent.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import of_worker, tokenizer_file
from .word_table import WordTable, grouped

MODEL = "piece_bpe_32k.model"
MARKER = "\u2581"
NORMAL, BYTE = 1, 6  # piece types of the file format
UNKNOWN_PENALTY = 10.0
GROUP_CHARS, LONG_WORD = 1 << 20, 96
FIT_WINDOW = 512
SCORE_UNIT = 1 << 16
OUT = (
    T.StructType().add("n_pieces", "long").add("n_byte_pieces", "long").add("ids", T.ArrayType(T.IntegerType()))
    .add("round_trip", "boolean")
)
RUNS = re.compile(" *[^ ]+| +")


def read_pieces(path: str) -> list[tuple[str, int]]:
    """(piece, type) of a model file: field 1 of the message, whose fields are text (1), score (2) and type (3)."""

    def varint(at):
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    def fields(at, end):
        while at < end:
            key, at = varint(at)
            if key & 7 == 2:
                size, at = varint(at)
                yield key >> 3, (at, at + size)
                at += size
            elif key & 7 == 0:
                value, at = varint(at)
                yield key >> 3, value
            else:
                at += 4 if key & 7 == 5 else 8

    with open(path, "rb") as file:
        data = file.read()
    out = []
    for field, span in fields(0, len(data)):
        if field == 1:
            parts = dict(fields(*span))
            out.append((data[slice(*parts[1])].decode(), parts.get(3, NORMAL)))
    return out


def double_array(words: dict[bytes, int]):
    """(base, check, value): from state s byte c leads to t = base[s] + c where check[t] == s; value[t] is the number of
    the word that ends there, or -1."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for word, number in words.items():
        node = 0
        for byte in word:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][byte]
        ends[node] = number
    size = 4 * len(children) + 4096
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, bool)
    free[0], check[0], queue = False, 0, [(0, 0)]
    first, front = 257, 1  # codes are below 256, so bases stay positive
    for node, state in queue:  # breadth first
        codes = np.array(sorted(children[node]), np.int64)
        if not len(codes):
            continue
        if len(codes) == 1:  # any free cell will do
            first += int(free[first:].argmax())
            at = first - int(codes[0])
        else:  # cells left free behind ``front`` are for single children
            at = front = _fitting(free, front, codes)
        base[state], free[at + codes], check[at + codes] = at, False, state
        for byte in codes.tolist():
            child = children[node][byte]
            value[at + byte] = ends[child]
            queue.append((child, at + byte))
    used = int(np.flatnonzero(~free).max()) + 257
    return base[:used], check[:used], value[:used]


def _fitting(free: np.ndarray, at: int, codes: np.ndarray) -> int:
    """The first place from ``at`` on where all ``codes`` fall on free cells."""
    while True:
        fits = free[at : at + FIT_WINDOW + 256]
        found = np.logical_and.reduce([fits[code : code + FIT_WINDOW] for code in codes.tolist()])
        if found.any():
            return at + int(found.argmax())
        at += FIT_WINDOW


def _pair(a, b):
    return a << 21 | b


class Pieces:
    """A vocabulary for encoding and decoding."""

    def __init__(self, path: str, scores: np.ndarray | None = None):
        listed = read_pieces(path)
        normal = [i for i, (_, kind) in enumerate(listed) if kind == NORMAL]
        ranks = np.arange(1, len(normal) + 1)
        self.scores = np.zeros(len(listed))
        self.scores[normal] = -np.log(ranks) - np.log((1 / ranks).sum()) if scores is None else scores[normal]
        self.scores = np.round(self.scores * SCORE_UNIT) / SCORE_UNIT  # sums are exact, so equal paths tie
        self.unknown = float(self.scores[normal].min()) - UNKNOWN_PENALTY
        texts = {i: listed[i][0].replace(MARKER, " ").encode() for i in normal}
        if any(b" " in text.lstrip(b" ") for text in texts.values()):
            raise ValueError("a piece holds a marker after another character")
        self.base, self.check, self.value = double_array({text: i for i, text in texts.items()})
        self.bytes = np.zeros(256, np.int32)
        self.texts = [b""] * len(listed)
        for i, (piece, kind) in enumerate(listed):
            if kind == BYTE:
                self.bytes[int(piece[3:5], 16)] = i
                self.texts[i] = bytes([int(piece[3:5], 16)])
        for i, text in texts.items():
            self.texts[i] = text
        self.is_byte = np.zeros(len(listed), bool)
        self.is_byte[self.bytes] = True
        inner = {(text[at], text[at + 1]) for text in map(bytes.decode, texts.values()) for at in range(len(text) - 1)}
        self.inner = np.array(sorted(_pair(ord(a), ord(b)) for a, b in inner), np.int64)
        self.table = WordTable(self._words)

    # --- encoding ---------------------------------------------------------------------------------------------------

    def segment(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of the best segmentation of each word, all searched together."""
        lengths = np.array([len(word) for word in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
        best, piece = np.full(len(data), -np.inf), np.full(len(data), -1, np.int32)
        origin = np.zeros(len(data), np.int64)
        best[starts] = 0.0
        opens = (data & 0xC0) != 0x80  # first bytes of characters
        wide = 1 + (data >= 0xC0) + (data >= 0xE0) + (data >= 0xF0)
        for offset in range(int(lengths.max(initial=0))):
            at = (starts + offset)[lengths > offset]
            at = at[opens[at]]
            state, place, single = np.zeros(len(at), np.int64), at, np.zeros(len(at), bool)
            live = np.arange(len(at))
            while len(live):
                reached = self.base[state] + data[place]
                step = self.check[reached] == state
                step &= reached > 0
                state, place, live = reached[step], place[step] + 1, live[step]
                number = self.value[state]
                ends = number >= 0
                source, target = at[live[ends]], place[ends]
                score = best[source] + self.scores[number[ends]]
                better = score > best[target]
                best[target[better]], origin[target[better]] = score[better], source[better]
                piece[target[better]] = number[ends][better]
                single[live[ends]] |= target - source == wide[source]
            alone = at[~single]
            target = alone + wide[alone]
            better = best[alone] + self.unknown > best[target]
            alone, target = alone[better], target[better]
            best[target], origin[target], piece[target] = best[alone] + self.unknown, alone, -1
        return self._trace(words, starts, lengths, origin, piece, data)

    def _trace(self, words, starts, lengths, origin, piece, data) -> list[np.ndarray]:
        place, path = starts + lengths, []
        while (place > starts).any():
            moving = place > starts
            path.append((np.where(moving, piece[place], -2), origin[place], place))
            place = np.where(moving, origin[place], place)
        if not path:
            return [np.zeros(0, np.int32)] * len(words)
        ids = np.stack([step[0] for step in path[::-1]], 1)
        plain = (ids != -1).all(1)
        kept = ids != -2
        flat, cuts = ids[kept].astype(np.int32), np.cumsum(kept.sum(1))[:-1]
        out = np.split(flat, cuts)
        for i in np.flatnonzero(~plain):
            parts = []
            for step_ids, step_from, step_to in path[::-1]:
                if step_ids[i] >= 0:
                    parts.append(step_ids[i : i + 1].astype(np.int32))
                elif step_ids[i] == -1:
                    parts.append(self.bytes[data[step_from[i] : step_to[i]]])
            out[i] = np.concatenate(parts)
        return out

    def _parts(self, word: str) -> list[str]:
        """The word cut between characters that are neighbours in no piece."""
        code = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
        cuts = np.flatnonzero(~np.isin(_pair(code[:-1], code[1:]), self.inner)) + 1
        return [word[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(word)])]

    def _together(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words; those that stay long are searched alone, as the search takes a step a byte."""
        data = [word.encode() for word in words]
        short = [i for i, word in enumerate(data) if len(word) <= LONG_WORD]
        out = [np.zeros(0, np.int32)] * len(data)
        for group in [short, *([i] for i, word in enumerate(data) if len(word) > LONG_WORD)]:
            if group:
                for i, ids in zip(group, self.segment([data[i] for i in group])):
                    out[i] = ids
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words with a blank before them."""
        parts = [[" " + word] if len(word) * 4 <= LONG_WORD else self._parts(" " + word) for word in words]
        different = list(dict.fromkeys(part for cut in parts for part in cut))
        ids = dict(zip(different, (found.tobytes() for found in self._together(different))))
        return [b"".join(map(ids.__getitem__, cut)) for cut in parts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        return [np.frombuffer(ids, np.int32) for ids in self.table.join([words_of(text) for text in texts])]

    # --- decoding ---------------------------------------------------------------------------------------------------

    def decode(self, ids) -> str:
        text = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def words_of(text: str) -> list[str]:
    """Runs of blanks with the word after them, each without its first blank, of the text with a blank before it."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [run[1:] for run in RUNS.findall(" " + text)]
    return text.split(" ")


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``docs`` without text, with n_pieces, n_byte_pieces, ids and round_trip (decoding gives the text back)."""
    path = model or tokenizer_file(MODEL)
    kept = [name for name in docs.columns if name != "text"]
    schema = T.StructType([*(docs.schema[name] for name in kept), *OUT.fields])
    arrow = to_arrow_schema(OUT)

    def run(batches):
        pieces = of_worker(f"pieces {path}", lambda: Pieces(path))
        for batch in batches:
            done = 0
            for texts in grouped(batch.column("text").to_pylist(), GROUP_CHARS):
                if not texts:
                    continue
                ids = pieces.encode(texts)
                sizes = [len(x) for x in ids]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype(np.int32), pa.array(np.concatenate(ids)))
                own = [
                    pa.array(sizes, pa.int64()),
                    pa.array([int(pieces.is_byte[x].sum()) for x in ids], pa.int64()),
                    lists.cast(arrow.field("ids").type),
                    pa.array([pieces.decode(x.tolist()) == text for x, text in zip(ids, texts)]),
                ]
                rows = batch.select(kept).slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([*rows.columns, *own], names=[*kept, *OUT.names])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """``rows`` with text decoded from ids (null for null ids)."""
    path = model or tokenizer_file(MODEL)
    schema = T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())])

    def run(batches):
        pieces = of_worker(f"pieces {path}", lambda: Pieces(path))
        for batch in batches:
            texts = [None if ids is None else pieces.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return rows.mapInArrow(run, schema)


def query(spark, sf_dir) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
