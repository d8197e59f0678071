"""Small corpora and brute-force restatements."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, key long"


def documents(spark, texts, langs=None, ids=None):
    """A documents table with extra columns whose names clash with those that operators use."""
    langs = langs or ["en"] * len(texts)
    ids = range(len(texts)) if ids is None else ids
    rows = [
        (i, text, lang, "s", None if text is None else len(text), "extra", 7) for i, text, lang in zip(ids, texts, langs)
    ]
    return spark.createDataFrame(rows, DOCS)


def words(rng: random.Random, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def smallest_reachable(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
