"""Top-k search and line deduplication against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from forgelens.llm import line_dedup, topk_search
from tests.llm.helpers import documents


def test_top_k(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(400, 12)).astype(np.float32)
    data[50:60] = data[0]  # ties
    rows = [(i, [float(x) for x in v], "extra") for i, v in enumerate(data)]
    rows += [(900, None, ""), (901, [None] * 12, ""), (902, [float("nan")] * 12, ""), (903, [1.0], ""), (7, rows[7][1], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect()
    whole = np.floor(256 * data.astype(np.float64)).astype(np.int64)
    expected = []
    for q in range(0, 400, 50):
        best = sorted((-int(whole[q] @ whole[v]), v) for v in range(400) if v != q)[:5]
        expected += [(q, rank, v, -score) for rank, (score, v) in enumerate(best, 1)]
    assert sorted((row.query_id, row["rank"], row.vec_id, row.score) for row in got) == expected
    few = df.where("vec_id IN (0, 3, 9)")
    assert topk_search.top_k(few, F.col("vec_id") == 0).count() == 2
    assert topk_search.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_reading_stops_early():
    rng = np.random.default_rng(6)
    data = np.floor(256 * rng.normal(size=(3000, 16))).astype(np.int64)
    data[5] = data[17]
    lists = topk_search.Lists(np.arange(3000), data)
    asked = np.array([5, 200, 1999])
    left = lists.top(data[asked], asked, 5)
    for q, at, (ids, scores) in zip(asked, left, lists.best(data[asked], asked, 5)):
        true = sorted((-int(data[q] @ data[v]), v) for v in range(3000) if v != q)[:5]
        assert list(zip((-scores).tolist(), ids.tolist())) == true
        assert len(at) < 300  # the others were ruled out by their bounds


def test_huge_components_are_still_exact():
    data = np.array([[2**40, 1], [2**40, 2], [-(2**40), 3], [1, 4]], np.int64)
    (ids, scores), = topk_search.Lists(np.arange(4), data).best(np.array([[2**20, 1]]), np.array([9]), 2)
    assert ids.tolist() == [1, 0] and scores.tolist() == [2**60 + 2, 2**60 + 1]


LINES = [
    "Shared passage of many documents\nown line of the first one here",
    "  shared PASSAGE of many documents\t\nshort\nshort",
    "Shared passage of many documents\r\nShared passage of many documents\nlast",
    "short\nshort\n",
    None,
    "",
    "\n\n",
    "Élan et Été des passages partagés\nx",
    "élan et été des passages partagés\nx",
    "Élan et Été des passages partagés\ny",
    "Élan et Été des passages partagés",
]


def expected_lines(texts, min_length=20, min_docs=3):
    space = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(space).translate(lower)
    holders = {}
    for i, text in enumerate(texts):
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    shared = {k: max(v) for k, v in holders.items() if len(k) >= min_length and len(v) >= min_docs}
    out = {}
    for i, text in enumerate(texts):
        lines = (text or "").split("\n")
        kept = [line for line in lines if shared.get(key(line), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines(spark):
    many = "\n".join(f"this line has number {i % 150} of the text" for i in range(300))
    texts = [*LINES, many, many, "head\n" + many]
    docs = documents(spark, texts)
    bitmaps = line_dedup.keep_bitmaps(docs)
    rows = line_dedup.apply_bitmaps(docs, bitmaps).collect()
    expected = expected_lines(texts)
    assert {row.doc_id: (row._n_lines, row._n_dropped, row.text or "") for row in rows} == expected
    assert bitmaps.count() == sum(n > 0 for _, n, _ in expected.values())  # no bitmap where nothing goes
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(texts)


def test_line_edge_cases(spark):
    docs = documents(spark, ["a shared line that is long enough"] * 4 + ["a shared line that is long enough\nz"], ids=[1, 1, 2, None, 1])
    rows = line_dedup.dedup_lines(docs, min_docs=2).collect()
    assert sorted((str(row.doc_id), row.text) for row in rows) == [
        ("1", ""), ("1", ""), ("1", "z"), ("2", "a shared line that is long enough"), ("None", "a shared line that is long enough"),
    ]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_other_capitals_are_kept_apart():
    """Every character whose lower case the built-in function changes is matched by the guard, A-Z excepted."""
    import unicodedata

    for code in range(0x110000):
        char = chr(code)
        if char.lower() != char and not "A" <= char <= "Z" and not 0xD800 <= code <= 0xDFFF:
            other_uppercase = 0x2160 <= code <= 0x216F or 0x24B6 <= code <= 0x24CF or 0x1F130 <= code <= 0x1F189
            assert unicodedata.category(char) in ("Lu", "Lt") or other_uppercase, hex(code)


@pytest.mark.parametrize("name", ["op8_line_dedup"])
def test_digest(spark, sf_dir, name):
    row = line_dedup.query(spark, sf_dir).where("doc_id = 0").first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id = 0").first().text
    assert row.n_dropped > 0 or row.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
