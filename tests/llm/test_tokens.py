"""Token files, pieces: exact round trips and independent restatements."""

import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from forgelens.llm import sentence_pieces, token_output
from forgelens.llm.common import tokenizer_file, written
from forgelens.llm.word_table import WordTable
from tests.llm.helpers import documents

ODD = [
    None, "", " ", "a", " a", "a ", "  two  blanks ", "tab\tand\nline\n\n end", "x▁y ▁", "éÉ naïve café", "日本語 \U0001f600",
    "\x00 nul", "it's they'll 'quoted' don't", "1,234.5 (a.b) !. ...", "\xa0nbsp\x85nel\x1cfs", "z" * 700, "<|endoftext|> <s>", "\r\nwin\r\n",
]


@given(st.lists(st.integers(0, 6), max_size=400), st.integers(2, 5))
@settings(max_examples=60, deadline=None)
def test_grammar_round_trip(ids, min_uses):
    symbols, rules = token_output.repair(np.array(ids, np.uint32), min_uses, 50)
    assert token_output.expand(symbols, rules).tolist() == ids
    spans = token_output.spans_of(rules)
    assert len(rules) <= 50 and all(span >= 2 for span in spans)
    assert sum(1 if s < token_output.N_IDS else spans[s - token_output.N_IDS] for s in symbols) == len(ids)


def test_frequent_pairs_become_rules():
    ids = [1, 2, 3, 4] * 200
    symbols, rules = token_output.repair(np.array(ids, np.uint32), 8)
    assert len(symbols) < 40 and len(rules) >= 3


def test_no_frequent_pair_is_left_among_many_rare_ones():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 40_000, 600_000).astype(np.uint32)
    places = rng.choice(len(ids) // 2 - 1, (400, 20), replace=False) * 2
    for pair, at in enumerate(places):  # 400 pairs, each 20 times
        ids[at], ids[at + 1] = 41_000 + pair, 42_000 + pair
    symbols, rules = token_output.repair(ids, 16)
    assert token_output.expand(symbols, rules).tolist() == ids.tolist()
    _, uses = np.unique(symbols[:-1].astype(np.int64) << 16 | symbols[1:], return_counts=True)
    assert len(rules) >= 400 and uses.max() < 16


def test_long_runs_are_unfolded():
    ids = [7] * 100_000 + [8, 9] * 1000
    symbols, rules = token_output.repair(np.array(ids, np.uint32), 2)
    assert len(symbols) < 100 and token_output.expand(symbols, rules).tolist() == ids


@pytest.mark.parametrize("block", [64, 1 << 18])
def test_files_hold_every_id(spark, monkeypatch, block):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "BLOCK_TOKENS", block)
    monkeypatch.setattr(token_output, "MIN_USES", 4)
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice(["alpha", "beta.", "Gamma,", "delta\nline"]) for _ in range(80)) for _ in range(20)]
    docs = documents(spark, texts, ids=[3 * i % 41 for i in range(len(texts))])
    files = written(token_output.blocks(docs), "test-blocks")
    tokenizer = Tokenizer.from_file(tokenizer_file(token_output.VOCABULARY))
    expected, start = {}, 0
    for doc_id, text in sorted(zip([3 * i % 41 for i in range(len(texts))], texts), key=lambda x: x[0]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        expected[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rows = token_output.read_back(files).collect()
    assert {row.doc_id: (row.start, row.n_tokens, row.ids_crc32) for row in rows} == expected
    row = files.orderBy("shard", "block").first().asDict()
    every = list(token_output.unpack(row))
    assert all(token_output.read_document(row, i).tolist() == ids.tolist() for i, (_, ids) in enumerate(every))
    assert token_output.read_back(written(token_output.blocks(docs.limit(0)), "test-blocks")).count() == 0


def test_absent_and_repeated_ids_in_files(spark):
    docs = documents(spark, ["b", "a", "n"], ids=[5, 5, None])
    rows = token_output.read_back(written(token_output.blocks(docs), "test-blocks")).orderBy("start").collect()
    assert [(row.doc_id, row.start, row.n_tokens) for row in rows] == [(None, 0, 2), (5, 2, 2), (5, 4, 2)]


def test_encoder_equals_the_library_on_odd_texts(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "HELD_WORDS", 30)
    monkeypatch.setattr(token_output, "JOINED_WORDS", 7)
    monkeypatch.setattr(token_output, "GROUP_CHARS", 200)
    path = tokenizer_file(token_output.VOCABULARY)
    encoder, tokenizer, rng = token_output.Encoder(path), Tokenizer.from_file(path), random.Random(6)
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["\u200b", "\u180e", "\ufeff", "\x00"]
    parts = ["don't", "'s", "a", "Ünïcode", "e\u0301", "漢字", "12", "½", "!?", "😀", "Ġ", "<|endoftext|>", "\n", *spaces]
    common = ["don't", "we'll", "'s", "x'", "Ünïcode", "漢字", "12.5", "-", "😀!", "Ġ", "\u0301e", "#1"]
    for _ in range(150):
        texts = ["".join(rng.choices([" ", *parts], k=rng.randrange(12))) for _ in range(4)]
        texts += [rng.choice([" ", " ", "\n"]).join(rng.choices(common, k=rng.randrange(30))) for _ in range(4)]
        texts += [" ".join(f"{rng.choice(common)}{rng.randrange(99)}" for _ in range(20)), None, ""]
        ids = [tokenizer.encode(text or "", add_special_tokens=False).ids for text in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == ids
    assert len(encoder.recent) <= 100 and len(encoder.older) <= 100


def test_a_word_is_looked_up_once_a_group():
    class Counted(dict):
        looked = 0

        def get(self, *args):
            self.looked += 1
            return super().get(*args)

        def __getitem__(self, key):
            self.looked += 1
            return super().__getitem__(key)

    from tokenizers import Tokenizer

    path = tokenizer_file(token_output.VOCABULARY)
    encoder, tokenizer = token_output.Encoder(path), Tokenizer.from_file(path)
    encoder.recent = Counted()
    texts = ["naïve words, met\nagain and again " * 100 + "end"] * 20
    ids = tokenizer.encode(texts[0], add_special_tokens=False).ids
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [ids] * 20
    assert encoder.recent.looked <= 2 * len(encoder.recent)


def test_words_after_newlines_are_encoded_many_to_a_text(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_file(token_output.VOCABULARY)
    encoder, tokenizer, given_texts = token_output.Encoder(path), Tokenizer.from_file(path), []
    plain = encoder.ids
    monkeypatch.setattr(encoder, "ids", lambda texts: given_texts.extend(texts) or plain(texts))
    text = "\n".join(f"{lead}é{i}." for i in range(150) for lead in ("'s", "Line", "(#"))
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([text])] == [ids]
    assert len(given_texts) <= 6


def test_word_table_forgets_but_stays_right():
    calls = []

    def encode(words):
        calls.append(len(words))
        return [word.encode() for word in words]

    table, rng = WordTable(encode, capacity=20), random.Random(2)
    for _ in range(50):
        texts = [[f"w{rng.randrange(60)}," for _ in range(rng.randrange(9))] for _ in range(3)]
        assert table.join(texts) == ["".join(text).encode() for text in texts]
    assert len(table.recent) <= 50 and len(table.older) <= 50


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.Pieces(tokenizer_file(sentence_pieces.MODEL))


@pytest.fixture(scope="module")
def library(pieces):
    """The sentencepiece library with the same pieces and scores as a unigram model."""
    import sentencepiece

    def number(n):
        out = b""
        while True:
            out += bytes([(n & 127) | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    model = b""
    for i, (piece, kind) in enumerate(sentence_pieces.read_pieces(tokenizer_file(sentence_pieces.MODEL))):
        data = piece.encode()
        message = b"\x0a" + number(len(data)) + data + b"\x15" + struct.pack("<f", pieces.scores[i]) + b"\x18" + number(kind)
        model += b"\x0a" + number(len(message)) + message
    trainer = b"\x18\x01" + number(35 << 3) + b"\x01"  # unigram, byte fallback
    normalizer = b"\x0a\x08identity\x18\x01\x20\x00\x28\x01"
    model += b"\x12" + number(len(trainer)) + trainer + b"\x1a" + number(len(normalizer)) + normalizer
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def test_pieces_score_as_the_library(pieces, library):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "Licence", "naïve", "x=1;", "日本", "un", "able!!"]) for _ in range(6)) for _ in range(60)]

    def score(ids):
        return sum(pieces.unknown / 1 if pieces.is_byte[i] else pieces.scores[i] for i in ids)

    for text, ids in zip(texts, pieces.encode(texts)):
        other = library.encode(text)
        assert list(ids) == other or abs(score(ids) - score(other)) < 1e-3, text


def test_segmentation_is_the_best_of_all(pieces):
    known = {text: pieces.scores[i] for i, text in enumerate(pieces.texts) if text and not pieces.is_byte[i]}

    def best(data):
        scores = [0.0] + [float("-inf")] * len(data)
        for end in range(1, len(data) + 1):
            for start in range(end):
                if data[start:end] in known:
                    scores[end] = max(scores[end], scores[start] + known[data[start:end]])
        return scores[-1]

    for word in (" segmentation", " unbelievable", " aaaaaaa", " Grammars", "  x", " ing"):
        ids = pieces.segment([word.encode()])[0]
        assert abs(sum(pieces.scores[i] for i in ids) - best(word.encode())) < 1e-9
        assert b"".join(pieces.texts[i] for i in ids) == word.encode()


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_pieces_round_trip(text):
    pieces = sentence_pieces.Pieces.__dict__.get("_shared") or sentence_pieces.Pieces(tokenizer_file(sentence_pieces.MODEL))
    sentence_pieces.Pieces._shared = pieces
    text = text.encode("utf-8", "ignore").decode()
    assert pieces.decode(pieces.encode([text])[0].tolist()) == text


def test_trie_holds_exactly_its_words():
    words = {b"a": 0, b"ab": 1, b"abc": 2, b"b": 3, b"\xc3\xa9": 4, b" a": 5}
    base, check, value = sentence_pieces.double_array(words)

    def look(word):
        state = 0
        for byte in word:
            reached = base[state] + byte
            if check[reached] != state:
                return -1
            state = reached
        return value[state]

    assert {word: look(word) for word in words} == words
    assert look(b"c") == look(b"ac") == look(b" ") == look(b"\xc3") == -1


def test_encoded_table(spark):
    docs = documents(spark, ODD)
    rows = sentence_pieces.encode(docs)
    assert "text" not in rows.columns and rows.columns[-4:] == sentence_pieces.OUT.names
    got = {row.doc_id: row for row in rows.collect()}
    assert all(row.round_trip for row in got.values()) and got[0].ids == [] == got[1].ids
    assert got[8].n_byte_pieces >= 6 and got[3].n_byte_pieces == 0
    decoded = {row.doc_id: row.text for row in sentence_pieces.decode(rows.select("doc_id", "ids")).collect()}
    assert decoded == {i: text or "" for i, text in enumerate(ODD)}
    assert sentence_pieces.encode(docs.limit(0)).count() == 0


def test_texts_without_blanks_are_cut_where_no_piece_spans():
    pieces = sentence_pieces.Pieces(tokenizer_file(sentence_pieces.MODEL))
    rng = random.Random(12)
    parts = ["the", "ing", "国", "日本", "ü", "-", "2024", "#", "\n", "\u2581", "😀", "\x00", "ab"]
    for size in (1, 25, 97, 700):
        text = "".join(rng.choice(parts) for _ in range(size))
        ids = pieces.encode([text])[0]
        assert "\x00" in text or ids.tolist() == pieces.segment([(" " + text).encode()])[0].tolist()
        assert pieces.decode(ids.tolist()) == text
    long = "".join(chr(0x4E00 + rng.randrange(4000)) for _ in range(350_000))  # over 1 MB
    assert pieces.decode(pieces.encode([long])[0].tolist()) == long
