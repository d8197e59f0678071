"""Language identification, language model, mixing and licences."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from forgelens.llm import brown_lm, language_id, license_scan, soft_mixing
from tests.llm.helpers import documents, words

SYLLABLES = {"en": ["th", "ing", "er", "wh", "ed"], "fr": ["eau", "oi", "é", "que", "ment"], "de": ["sch", "ung", "pf", "ich", "ü"]}


@pytest.fixture(scope="module")
def tongues():
    rng = random.Random(4)
    vocabularies = {lang: ["".join(rng.choices(s, k=rng.randrange(1, 4))) for _ in range(80)] for lang, s in SYLLABLES.items()}
    langs = [rng.choice(list(SYLLABLES)) for _ in range(240)]
    return [words(rng, 40, vocabularies[lang]) for lang in langs], langs


def test_held_out_languages(spark, tongues):
    texts, langs = tongues
    docs = documents(spark, texts, langs)
    training, rest = docs.where("doc_id < 150"), docs.where("doc_id >= 150").withColumn("lang", F.lit(None).cast("string"))
    found = language_id.identify(rest, training).collect()
    assert sum(row._lang == langs[row.doc_id] for row in found) >= 0.97 * len(found)
    assert all(0 <= row._margin <= 1 for row in found)


def test_language_edge_cases(spark, tongues):
    texts, langs = tongues
    odd = [None, "", "123 !!", "²½", texts[0] * 300, texts[1].upper(), texts[1]]
    docs = documents(spark, [*texts[:60], *odd], [*langs[:60], *["en", None, "en", "fr", None, None, None]])
    rows = {row.doc_id: row for row in language_id.identify(docs, docs).collect()}
    assert [rows[i]._lang for i in range(60, 64)] == ["und"] * 4 and rows[60]._margin == 0
    assert rows[64]._lang == langs[0] and rows[65]._lang == rows[66]._lang == langs[1]
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns and {row.doc_id for row in kept.collect()} >= {0, 1, 64} and kept.where("doc_id BETWEEN 60 AND 63").count() == 0
    assert [row._lang for row in language_id.identify(docs.limit(3), docs.limit(0)).collect()] == ["und"] * 3
    one = language_id.identify(docs.where("doc_id = 1"), docs.where(F.col("lang") == langs[1])).first()
    assert (one._lang, one._margin) == (langs[1], 1.0)
    assert language_id.identify(docs.limit(0), docs).count() == 0


# --- language model


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "UNITS", 12)
    monkeypatch.setattr(brown_lm, "ENDINGS", 5)
    monkeypatch.setattr(brown_lm, "END", 17)
    monkeypatch.setattr(brown_lm, "CLASSES", 6)
    monkeypatch.setattr(brown_lm, "DIRECT", 20)
    rng = random.Random(9)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    sentence = lambda: " ".join(x for _ in range(rng.randrange(1, 9)) for x in (rng.choice(nouns), rng.choice(verbs)))
    texts = [sentence() for _ in range(120)] + [None, "", "Unknown WORDS only", "N1 V1\tn1"]
    docs = documents(spark, texts)
    training = docs.where("doc_id % 3 <> 2")
    rows = {row.doc_id: row for row in brown_lm.score_texts(docs, training).collect()}
    assert len(rows) == len(texts)
    counts = Counter()
    for i, text in enumerate(texts):
        if i % 3 != 2:
            counts.update([*(text or "").lower().split(), None])
    total, distinct = sum(counts.values()), len(counts)
    (head, classes, into, matrix, n_words, types, tokens, known, n_texts), table = brown_lm.train(training)
    later = {bytes(row["word"]).decode(): row for row in table.collect()}
    frequent = [word.decode() for word, _ in head]
    assert {word: row.n for word, row in later.items()} == {w: n for w, n in counts.items() if w and w not in frequent[:12]}
    assert (tokens, known, n_texts) == (total, distinct, counts[None])
    rank = {word.decode(): i for i, (word, _) in enumerate(head)}
    smoothed = matrix + brown_lm.TRANSITION_WEIGHT * (matrix.sum(0) + 1) / (matrix.sum() + 6)
    transition = smoothed / smoothed.sum(1, keepdims=True)

    def context_of(word):
        at = rank.get(word, 99)
        return classes[at if at < 12 else 12 + zlib.crc32(word.encode()[-2:]) % 5]

    def class_of(word):
        return later[word]["class"] if word in later else context_of(word)

    assert [class_of(word) for word in frequent] == into.tolist()
    path = [(a, b) for i, t in enumerate(texts) if i % 3 != 2 for a, b in zip([None, *(t or "").lower().split()], [*(t or "").lower().split(), None])]
    met = Counter((context_of(a) if a else classes[17], class_of(b) if b else classes[17]) for a, b in path)
    assert {(i, j): n for (i, j), n in np.ndenumerate(matrix) if n} == met

    for i, text in enumerate(texts):
        tokens_of = (text or "").lower().split()
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in [*tokens_of, None])
        before, after = [classes[17], *map(context_of, tokens_of)], [*map(class_of, tokens_of), classes[17]]
        score = sum(math.log10(transition[a, b]) for a, b in zip(before, after))
        score += sum(math.log10((counts[w] + 0.5) / (n_words[class_of(w)] + 0.5 * (types[class_of(w)] + 1))) for w in tokens_of)
        row = rows[i]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(tokens_of) + 1, sum(counts[x] > 0 for x in [*tokens_of, None]), total)
        assert row.base_score == pytest.approx(base) and row.score == pytest.approx(score)
    # the words after a word, the unknown ones and the end add up to one
    for c in range(6):
        mass = sum((counts[w] + 0.5) / (n_words[c] + 0.5 * (types[c] + 1)) for w in counts if w and class_of(w) == c)
        assert c == classes[17] or mass + 0.5 / (n_words[c] + 0.5 * (types[c] + 1)) == pytest.approx(1.0)
    result = brown_lm.perplexity(spark.createDataFrame([row for i, row in rows.items() if i % 3 == 2 and i < 120])).first()
    assert result.perplexity < result.base_perplexity


def test_exchange_only_raises_the_likelihood(monkeypatch):
    monkeypatch.setattr(brown_lm, "CLASSES", 4)
    monkeypatch.setattr(brown_lm, "END", 20)
    rng = np.random.default_rng(3)
    bigrams = rng.poisson(np.where(np.add.outer(np.arange(21), np.arange(21)) % 2, 9, 1))
    classes, before = brown_lm.first_classes(bigrams), -math.inf
    for _ in range(4):
        value = brown_lm.likelihood(brown_lm.class_matrix(bigrams, classes))
        assert value >= before - 1e-9
        classes, before = brown_lm.exchange(bigrams, classes, rounds=1), value
    alone = Counter(classes.tolist())[classes[20]]
    assert alone == 1 and len({tuple(sorted({i % 2 for i in range(20) if classes[i] == c})) for c in set(classes[:20])}) == 2


def test_rare_words_move_to_the_class_of_their_contexts(spark, monkeypatch):
    for name, value in {"UNITS": 4, "ENDINGS": 3, "END": 7, "CLASSES": 8, "DIRECT": 6, "TOLERANCE": 1e-6}.items():
        monkeypatch.setattr(brown_lm, name, value)
    rng = random.Random(5)
    # 200 rare words of either kind, alike in their endings, after four frequent words
    texts = [" ".join(f"{('sun the', 'moon a')[k]} {k}w{rng.randrange(200)}zz" for _ in range(8)) for k in (0, 1) for _ in range(80)]
    training = documents(spark, texts)
    (head, classes, into, matrix, *_), table = brown_lm.train(training)
    rows = table.collect()
    words_by_context = {"0": Counter(), "1": Counter()}
    for row in rows:
        words_by_context[bytes(row["word"]).decode()[0]][row["class"]] += 1
    (first, n), (second, m) = (words_by_context[k].most_common(1)[0] for k in "01")
    assert first != second and n + m >= 0.95 * len(rows)
    start = brown_lm.class_matrix(*_start(brown_lm, training, head, classes))
    assert brown_lm.predictive_likelihood(matrix) > brown_lm.predictive_likelihood(start)


def _start(module, training, head, classes):
    return module.unit_bigrams(training, training.sparkSession.sparkContext.broadcast(head)), classes


def test_gain_of_a_move_is_the_change_of_the_likelihood(monkeypatch):
    monkeypatch.setattr(brown_lm, "CLASSES", 4)
    rng = np.random.default_rng(8)
    fixed = rng.poisson(5, (4, 4)).astype(float)
    cells = [np.array([[d, n] for d, n in enumerate(row) if n]) for row in rng.poisson(2, (40, 4)) if row.any()]
    cells[0] = np.array([[0, 30], [2, 1]])
    old = rng.integers(0, 3, len(cells))
    matrix = fixed.copy()
    for row, at in zip(cells, old):
        matrix[row[:, 0], at] += row[:, 1]
    flat, n = np.concatenate(cells), np.array([row[:, 1].sum() for row in cells])
    starts = np.concatenate([[0], np.cumsum([len(row) for row in cells])[:-1]])
    new = brown_lm.Gains(matrix, 3).best(n, starts, flat[:, 0], flat[:, 1], old)
    for row, was, at in zip(cells, old, new):
        values = []
        for into in range(3):
            other = matrix.copy()
            other[row[:, 0], was] -= row[:, 1]
            other[row[:, 0], into] += row[:, 1]
            values.append(brown_lm.predictive_likelihood(other))
        assert values[at] == pytest.approx(max(values))


def test_language_model_columns_that_clash(spark):
    docs = documents(spark, ["a b a", "b " * 200_000, None]).select("doc_id", "text", F.lit("x").alias("Score"), F.lit(1).alias("_word"), F.lit(2).alias("n"), F.lit(3).alias("class"), F.lit(4).alias("word"))
    rows = brown_lm.score_texts(docs, docs).orderBy("doc_id").collect()
    assert [row.n_tokens for row in rows] == [4, 200_001, 1] and {(row.n, row["class"], row.word) for row in rows} == {(2, 3, 4)}
    assert all(isinstance(row.score, float) for row in rows) and "_word" not in rows[0].asDict()


def test_language_model_without_training_text(spark):
    docs = documents(spark, ["a b", None, "x " * 5000])
    rows = brown_lm.score_texts(docs, docs.limit(0)).collect()
    assert {row.train_tokens for row in rows} == {0} and all(row.base_score == 0.0 and math.isfinite(row.score) for row in rows)
    assert brown_lm.score_texts(docs.limit(0), docs).count() == 0
    twice = brown_lm.score_texts(docs.union(docs), docs)
    assert twice.count() == 6


# --- mixing


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    plain = [f"word{i}" for i in range(60)]
    texts, domains = [], []
    for i in range(300):
        domain = rng.choices(["good", "low", "toxic"], [6, 3, 2])[0]
        text = words(rng, 40, plain)
        text = {"good": text, "low": text.replace(" ", "!! ").upper(), "toxic": text + " idiot scum"}[domain]
        texts.append(text)
        domains.append(domain)
    labels = spark.createDataFrame([(i, d) for i, d in enumerate(domains) if i % 3], "doc_id long, domain string")
    return texts, domains, labels


def test_rates_meet_the_targets(spark, labelled):
    texts, domains, labels = labelled
    rows = soft_mixing.mix(documents(spark, texts), labels).collect()
    names = ["good", "low", "toxic"]
    assert sum(max(names, key=lambda n: row[f"p_{n}"]) == domains[row.doc_id] for row in rows) > 290
    held = {n: sum(row.n_tokens * row[f"p_{n}"] for row in rows) for n in names}
    got = {n: sum(row.n_tokens * row[f"p_{n}"] * row.rate for row in rows) for n in names}
    budget = min(held[n] / soft_mixing.TARGETS[n] for n in names)
    for n in names:
        assert got[n] == pytest.approx(soft_mixing.TARGETS[n] * budget, rel=0.05)
    assert all(0 <= row.rate <= 1 and sum(row[f"p_{n}"] for n in names) == pytest.approx(1) for row in rows)
    clean = [row for row in rows if domains[row.doc_id] == "good"]
    assert sum(row.kept for row in clean) >= 0.97 * len(clean)


def test_projected_gradient_is_the_least_squares_optimum(spark):
    rows = spark.createDataFrame([(100, [0.9, 0.1]), (50, [0.2, 0.8]), (70, [0.5, 0.5])], "tokens long, p array<double>")
    steps = soft_mixing.fit_rates(rows, [0.5, 0.5])
    rates = [r for (r,) in rows.select(soft_mixing.rate(steps)).collect()]
    t, p = np.array([100, 50, 70.0]), np.array([[0.9, 0.1], [0.2, 0.8], [0.5, 0.5]])
    held = t @ p
    target = np.array([0.5, 0.5]) * (held / 0.5).min()
    loss = lambda r: ((((t * r) @ p - target) ** 2) / held).sum()
    grid = min(loss(np.array(r)) for r in itertools.product(np.linspace(0, 1, 41), repeat=3))
    assert loss(np.array(rates)) <= grid + 1e-2


def test_mixing_edge_cases(spark, labelled):
    texts, _, labels = labelled
    docs = documents(spark, [*texts[:30], None, "", "x" * 100_000, texts[0]], ids=[*range(30), 30, 31, None, 0])
    rows = soft_mixing.mix(docs, labels).collect()
    assert len(rows) == 34 and {row.n_tokens for row in rows if row.doc_id in (30, 31)} == {0}
    assert len({row.kept for row in rows if row.doc_id == 0}) == 1
    kept = soft_mixing.mixed(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(row.kept for row in rows)
    nothing = soft_mixing.mix(docs, labels.limit(0)).collect()
    assert all(row.rate == 1 and row.p_good == 1 for row in nothing)
    assert soft_mixing.mix(docs.limit(0), labels).count() == 0


# --- licences


def dice(unit, template):
    grams = lambda text: (lambda w: {f"{a} {b}" for a, b in zip(w, w[1:])})(re.sub(r"[\W_]+", " ", text.lower()).split())
    a, b = grams(unit), grams(template)
    return 2 * len(a & b) / (len(a) + len(b)) if a else 0.0


def expected_license(text):
    lines = (text or "").split("\n")
    units = [*enumerate(lines), *([(-1, text)] if len(lines) > 1 else [])]
    hits = [
        (-score, name, line)
        for line, unit in units
        for name, template in license_scan.TEMPLATES.items()
        if (score := dice(unit, template)) >= license_scan.THRESHOLD
    ]
    best = min(hits, default=(0.0, None, None))
    return best[1], pytest.approx(-best[0]), best[2], len(hits)


def test_licenses(spark):
    known = list(license_scan.TEMPLATES.values())
    header = license_scan.TEMPLATES["Apache-2.0-header"]
    texts = [
        *known, None, "", "one", "plain text\nthat says nothing", "intro line\n  * RELEASED under the M.I.T. license\nReleased under the MIT License!\nend",
        header.replace("; ", ";\n").replace(". ", ".\n"), "Licensed under the Apache License, Version 2.0 or later terms of use", "x " * 30_000,
        "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.",
    ]
    rows = license_scan.scan(documents(spark, texts)).collect()
    got = {row.doc_id: (row.license, row.dice, row.line, row.n_matches) for row in rows}
    assert {i: expected_license(text) for i, text in enumerate(texts)} == got
    assert sum(name is not None for name, *_ in got.values()) >= len(known) + 3
    assert license_scan.scan(documents(spark, ["x"]).limit(0)).count() == 0


def test_wrapped_and_inline_notices(spark):
    def wrapped(name, width):
        words = license_scan.TEMPLATES[name].split()
        return "\n".join("# " + " ".join(words[at : at + width]) for at in range(0, len(words), width))

    around = "\n".join(f"filler{i} text of line {i} that says other things" for i in range(40))
    names = ["MIT-grant", "GPL-3.0-header", "Apache-2.0-header"]
    texts = [f"{around}\n{wrapped(name, 9)}\n{around}" for name in names]
    texts.append("Copyright 2020 Foo Authors. All rights reserved. Licensed under the Apache License, Version 2.0.")
    texts.append(f"{around}\nReleased under the MIT License.\n{wrapped('GPL-3.0-header', 8)}\n{around}")
    texts.append(around)
    rows = {row.doc_id: row for row in license_scan.scan(documents(spark, texts)).collect()}
    assert [rows[i].license for i in range(4)] == [*names, "Apache-2.0"]
    assert [(rows[i].dice, rows[i].line) for i in range(4)] == [(1.0, 40)] * 3 + [(1.0, 0)]
    assert rows[4].n_matches == 2 and rows[5].license is None


def test_scarce_unwanted_domains_cost_no_clean_text(spark):
    rng = random.Random(12)
    plain = [f"word{i}" for i in range(60)]
    domains = ["toxic"] * 3 + ["low"] * 6 + ["good"] * 391
    change = {"good": str, "low": lambda text: text.replace(" ", "!! ").upper(), "toxic": lambda text: text + " idiot scum"}
    texts = [change[domain](words(rng, 40, plain)) for domain in domains]
    labels = spark.createDataFrame(list(enumerate(domains)), "doc_id long, domain string")
    rows = soft_mixing.mix(documents(spark, texts), labels).collect()
    clean = [row for row in rows if domains[row.doc_id] == "good"]
    assert sum(row.kept for row in clean) >= 0.97 * len(clean)
    assert all(row.rate > 0.9 for row in rows if domains[row.doc_id] == "toxic")


def test_rates_are_fitted_to_tolerance(spark):
    rows = spark.createDataFrame([(100, [0.55, 0.45]), (100, [0.45, 0.55]), (300, [0.6, 0.4])], "tokens long, p array<double>")
    steps = soft_mixing.fit_rates(rows, [0.5, 0.5])
    r = np.array([x for (x,) in rows.select(soft_mixing.rate(steps)).collect()])
    t, p = np.array([100, 100, 300.0]), np.array([[0.55, 0.45], [0.45, 0.55], [0.6, 0.4]])
    held = t @ p
    move = p @ (((t * r) @ p - 0.5 * (held / 0.5).min()) / held)
    assert t @ abs(np.clip(r - move, 0, 1) - r) <= 1e-4 * held.sum() and len(steps) > 16


def test_every_language_with_text_is_learned(spark):
    rng = random.Random(13)
    few = [(f"l{i}", words(rng, 30, [f"{i}a{j}b" for j in range(40)])) for i in range(8)]
    rows = [pair for pair in few for _ in range(200)] + [("many", words(rng, 30, ["x", "yy", "zzz"])) for _ in range(50)]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    found = [tuple(row) for row in language_id.sample(labelled, 10).collect()]
    assert set(few) < set(found) and len(found) == len(set(found)) == 18
    assert set(language_id.dictionaries(labelled, 10, 1 << 16)) == {lang for lang, _ in rows}
