"""Importance resampling against a brute-force restatement."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from forgelens.llm import importance_resampling as resampling
from tests.llm.helpers import documents, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(found), [" ".join(found[i : i + k]) for k in (1, 2, 3) for i in range(len(found) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def expected(docs, target, percent=5, least=20):
    """{row number: (doc_id, n_features, weight, score, rank)} of (doc_id, text) pairs."""
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)
    ]
    out, candidates = [], []
    for i, (doc_id, text) in enumerate(docs):
        n, found = features(text)
        weight = sum(gain[bucket(f)] for f in found)
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= least:
                candidates.append((-score, doc_id, len(found), i))
        out.append([doc_id, len(found), weight, score, None])
    for place, (*_, i) in enumerate(sorted(candidates)[: len(candidates) * percent // 100], 1):
        out[i][4] = place
    return sorted(map(tuple, out), key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


VOCABULARY = [*"the of and to in is for on with as by at from or an be this that".split(), "Élan", "straße", "数据", "x1", "A9z", "ÀÉ"]


@pytest.mark.parametrize("head, paired", [(65_536, 1024), (7, 3), (1, 0), (0, 0)])
def test_against_brute_force(spark, head, paired):
    rng = random.Random(1)
    texts = [words(rng, rng.randrange(0, 60), VOCABULARY) for _ in range(150)]
    texts += [None, "", "...", "one", "Two-words\tTHREE", "a" * 500 + " b " + "c" * 65 + " d " + "e" * 64 + " f", "\x00\x7f`{@[/:"]
    texts += [texts[0]] * 3 + [words(rng, 30_000, VOCABULARY)]
    ids = [*range(len(texts) - 2), 5, None]
    target = spark.createDataFrame([(i, words(rng, 40, VOCABULARY[:9])) for i in range(20)] + [(21, None)], "item_id long, text string")
    docs = documents(spark, texts, ids=ids)
    benchmark = [row.text for row in target.collect()]
    result = resampling.resample(docs, target, head=head, paired=paired)
    assert got(result) == expected(list(zip(ids, texts)), benchmark)


def test_ties_and_empty_tables(spark):
    texts = ["same words here and there " * 5] * 40
    ids = [3] * 20 + [9] * 20
    target = spark.createDataFrame([], "text string")
    docs = documents(spark, texts, ids=ids)
    result = resampling.resample(docs, target, percent=50)
    assert got(result) == expected(list(zip(ids, texts)), [], percent=50)
    assert resampling.resample(docs.limit(0), target).count() == 0


def test_words_are_cut_like_the_pattern():
    every = "".join(map(chr, [*range(0x180), 0x4E00, 0x2028, 0x1F600]))
    found, counts = resampling.words_of([every.encode(), None, b"", b"A b"])
    pattern = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", every.translate(LOWER))
    assert [word.decode() for word in found] == [*pattern, "a", "b"] and counts.tolist() == [len(pattern), 0, 0, 2]


def test_frequent_words(spark):
    texts = ["b b b a a c c", "A " + "w" * 65, None, "d" * 64]
    assert resampling.frequent_words(documents(spark, texts), 3) == [b"a", b"b", b"c"]
    counted = {bytes(row.word): row.uses for row in resampling.word_counts(documents(spark, texts)).collect()}
    assert counted == {b"a": 3, b"b": 3, b"c": 2, b"w" * 65: 1, b"d" * 64: 1}


def test_head_and_tail_give_the_same_buckets():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["ab", "c", "longer", "é" * 40, "z" * 70], 50)).encode() for _ in range(30)]
    held = [resampling.Features(resampling.Vocabulary(words, paired)).buckets(texts) for words, paired in (([], 0), ([b"ab", b"c"], 2), ([b"c", b"ab", b"longer"], 1))]
    for buckets, owners, counts in held[1:]:
        for k in range(3):
            assert (buckets[k] == held[0][0][k]).all() and (owners[k] == held[0][1][k]).all()
