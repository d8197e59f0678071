import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from forgelens.functions.ranking import numbered
from forgelens.operators import seeds
from forgelens.sources import seeds as seed_files

META = (
    "full_name string, description string, language string, stars long, topics array<string>, archived boolean,"
    " workflow_count long, error string"
)


def meta(spark, *rows):
    blank = {"full_name": "a/b", "description": None, "language": "Go", "stars": 1, "topics": [], "archived": False,
             "workflow_count": 5, "error": None}
    full = [{**blank, **row} for row in rows]
    return spark.createDataFrame([tuple(row[name] for name in blank) for row in full], META)


def test_links_in_first_seen_order(spark):
    docs = spark.createDataFrame(
        [
            (2, "[a/x](https://github.com/a/x)"),
            (1, "see [b/y](https://github.com/b/y), [a/x](https://github.com/a/x) [b/y](https://github.com/b/y) "
                "[c](https://github.com/c/d) [e/f](http://github.com/e/f) [g.h/i_j](https://github.com/g.h/i_j)"),
        ],
        "id long, body string",
    )
    got = seeds.repo_links(docs, "id", "body").orderBy("first_document", "first_place").collect()
    assert [(row.owner, row.repo, row.first_document, row.first_place) for row in got] == [
        ("b", "y", 1, 0), ("a", "x", 1, 1), ("g.h", "i_j", 1, 3),
    ]


def test_skip_reasons_in_order(spark):
    rows = [
        {"full_name": "obra/superpowers", "archived": True},
        {"archived": True, "language": None},
        {"language": ""},
        {"topics": ["Tutorial", "AWESOME", "go"], "description": "A curated list"},
        {"topics": ["tutorial"], "description": "real code"},
        {"full_name": "x/awesome-y", "topics": ["list"]},
        {"description": "Cookbook of things"},
        {"workflow_count": 0},
        {"workflow_count": 1},
        {},
    ]
    got = [row.reason for row in seeds.with_reason(meta(spark, *rows)).collect()]
    assert got == [
        "in skip list", "archived", "no programming language", "skip keywords in topics: awesome, tutorial", None,
        "skip keywords in topics: list", "skip keyword in description: 'cookbook'", "no .github/workflows/",
        "only 1 workflow file (minimum 2)", None,
    ]


def test_fill_and_merge(spark):
    candidates = meta(
        spark,
        *[{"full_name": f"s/r{i}", "stars": i} for i in range(10)],
        {"full_name": "s/dead", "stars": 99, "archived": True},
        {"full_name": "s/small", "stars": 98, "workflow_count": 1},
        {"full_name": "s/r9", "stars": 9},
    )
    accepted = spark.createDataFrame([("s/r8",), ("x/kept",)], "full_name string")
    got = {(row.full_name, row.source) for row in seeds.fill_to_target(accepted, candidates, 5).collect()}
    assert got == {("s/r8", "research"), ("x/kept", "research"), ("s/r9", "search"), ("s/r7", "search"), ("s/r6", "search")}
    full = {row.full_name for row in seeds.fill_to_target(accepted, candidates, 1).collect()}
    assert full == {"s/r8", "x/kept"}
    extras = spark.createDataFrame(
        [("s", "r1"), ("s", "r1"), ("s", "r8"), ("s", "dead"), ("no", "where"), (None, "x"), ("y", "")],
        "owner string, repo string",
    )
    base = accepted.withColumn("source", F.lit("research"))
    merged = {(row.full_name, row.source, row.reason) for row in seeds.merge_extras(base, extras, candidates.limit(12)).collect()}
    assert {row for row in merged if row[1] == "manual"} == {
        ("s/r1", "manual", None), ("s/dead", "manual", "archived"), ("no/where", "manual", "not found on GitHub"),
    }
    assert len(merged) == 5


def fingerprint(names):
    hashes = [hashlib.sha256(name.encode()).hexdigest() for name in set(names)]
    sums = [sum(int(h[8 * i : 8 * i + 8], 16) for h in hashes) for i in range(8)]
    return hashlib.sha256(",".join(map(str, [len(hashes), *sums])).encode()).hexdigest()[:16]


def test_fingerprint_ignores_order_and_repeats(spark):
    names = [f"o{i % 3}/r{i}" for i in range(40)]
    shuffled = names + names[:5]
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame([("all", name) for name in shuffled], "list string, full_name string")
    row = seeds.seed_fingerprints(df, "list").first()
    listed = hashlib.sha256("\n".join(sorted(set(names))).encode()).hexdigest()[:16]
    assert (row.names, row.fingerprint, row.additive) == (40, listed, fingerprint(names))
    other = df.where(F.col("full_name") != "o1/r7")
    assert seeds.seed_fingerprints(other, "list").first().additive != row.additive
    assert seeds.seed_fingerprints(other, "list").first().fingerprint != row.fingerprint


def test_only_well_formed_seeds_have_names(spark):
    rows = [("a", "x"), ("a", "x"), ("", "y"), (None, "z"), ("b", None)]
    assert [row.full_name for row in seeds.seed_names(spark.createDataFrame(rows, "owner string, repo string")).collect()] == ["a/x"]


def test_compare(spark):
    previous = spark.createDataFrame([("a",), ("b",), ("b",)], "full_name string")
    current = spark.createDataFrame([("b",), ("c",)], "full_name string")
    assert {tuple(row) for row in seeds.seed_compare(previous, current).collect()} == {
        ("a", "previous_only"), ("b", "intersection"), ("c", "current_only"),
    }


def test_categories_and_verdicts(spark):
    table = meta(
        spark,
        {"full_name": "a", "topics": ["React", "api"], "stars": 5},
        {"full_name": "b", "description": "Learn neural nets", "stars": 7},
        {"full_name": "c", "description": "roadmap", "stars": 9},
        {"full_name": "d", "error": "HTTP 404", "workflow_count": None, "language": None, "stars": None},
        {"full_name": "e", "topics": ["api"], "workflow_count": 1, "stars": 2},
        {"full_name": "f", "topics": ["rest", "x", "y", "z", "more"], "archived": True, "stars": 4},
    )
    listed = {row.full_name: row for row in seeds.seed_verdicts(table).collect()}
    assert [listed[k].category for k in "abcdef"] == [
        "Frontend", "AI / ML", "Education / Docs", "Error", "Backend / Web", "Backend / Web",
    ]
    assert [listed[k].verdict for k in "abcdef"] == ["OK", "OK", "SKIP (not code)", "SKIP (error)", "SKIP (1 wf)", "SKIP (archived)"]
    assert (listed["f"].position, listed["e"].position, listed["f"].topics) == (1, 2, ["rest", "x", "y", "z"])
    stats = {row.category: row for row in seeds.category_stats(table).collect()}
    assert (stats["Backend / Web"].repos, stats["Backend / Web"].average_stars) == (2, 3)
    assert tuple(seeds.seed_summary(table).first()) == (6, 4, 1, 0, 0, 1, 1, 2, 4)


def test_languages(spark):
    table = meta(spark, *[{"language": language} for language in ["Go", "Go", None, "", "C"]])
    assert [tuple(row) for row in seeds.language_stats(table, 2).collect()] == [("(none)", 2), ("Go", 2)]


def test_row_numbers_over_levels(spark):
    rng = random.Random(3)
    rows = [(rng.choice("gh"), rng.randrange(3), "".join(rng.choice("ab") for _ in range(rng.randrange(1, 7)))) for _ in range(300)]
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, "g string, s int, n string").withColumn("p", F.substring("n", 1, 2))
    got = numbered(df, [("s", True), ("p", False), ("n", False)], "k", ("g",), ranges=16).collect()
    for group in "gh":
        ordered = sorted((row for row in rows if row[0] == group), key=lambda row: (-row[1], row[2]))
        assert {(row.s, row.n): row.k for row in got if row.g == group} == {row[1:]: i + 1 for i, row in enumerate(ordered)}


def test_seed_files(spark, tmp_path):
    good = tmp_path / "seeds.json"
    good.write_text(json.dumps([{"owner": "a", "repo": "x"}, {"owner": "", "repo": "y"}, {"repo": "z"}, {"owner": "b", "repo": "y", "k": 1}]))
    assert {tuple(row) for row in seed_files.read_seed_list(spark, str(good)).collect()} == {("a", "x"), ("b", "y")}
    wrong = tmp_path / "object.json"
    wrong.write_text('{"owner": "a", "repo": "x"}')
    with pytest.raises(seed_files.NotAList):
        seed_files.read_seed_list(spark, str(wrong))


@pytest.mark.parametrize("envelope", [None, "repos", "items", "data"])
def test_metadata_envelopes(spark, tmp_path, envelope):
    items = [{"owner": "a", "repo": "x", "stars": 3}, {"full_name": "b/y", "stargazers_count": 4}, {"stars": 1}]
    path = tmp_path / "meta.json"
    path.write_text(json.dumps(items if envelope is None else {envelope: items}))
    got = {(row.full_name, row.stars, row.stargazers_count) for row in seed_files.read_metadata(spark, str(path)).collect()}
    assert got == {("a/x", 3, None), ("b/y", None, 4)}


def test_metadata_keyed_by_full_name(spark, tmp_path):
    path = tmp_path / "meta.json"
    path.write_text(json.dumps({"a/x": {"stars": 3}, "b/y": {"full_name": "b/y", "language": "Go"}}))
    got = {(row.full_name, row.stars, row.language) for row in seed_files.read_metadata(spark, str(path)).collect()}
    assert got == {("a/x", 3, None), ("b/y", None, "Go")}
    path.write_text(json.dumps({"unknown": 1}))
    with pytest.raises(seed_files.NotAList):
        seed_files.read_metadata(spark, str(path))
