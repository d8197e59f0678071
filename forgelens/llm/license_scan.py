"""Licence scan: Dice coefficient of word bigrams against licence templates (built-in functions only).

Texts are compared line by line, as a whole and in windows (below).  A unit is normalised (lower case, runs of other characters than
letters and digits become one blank) and stands for its set of distinct word bigrams A; a template for its set B:

    dice = 2 |A & B| / (|A| + |B|)

Size bounds: dice >= t needs t / (2 - t) * |B| <= |A| <= (2 - t) / t * |B|; units outside the bounds of every template are
dropped by their size alone, and the others meet only the templates whose bounds hold.  Templates are literals of
the plan, a fixed small list; nothing is shuffled.

Windows find notices that are wrapped or share their line: runs of words of the whole text that begin and end with a
bigram of the template, of every such length up to the upper bound (trimming other bigrams off the ends only raises
dice).  They are tried for the templates of which the text holds at least the lower bound of distinct bigrams.  A line
or whole text that matched some template and is long enough for this one was compared already and is left out.  A
window match counts once a template and text, with the line of its first word; one inside the window of a larger
template is that one's part and does not count.

``TEMPLATES`` are notices and short forms of common licences; ``scan`` takes others.  The best template of a text has the
largest dice; ties go to the first name, then to the whole text (line -1) before the first line.

Defined results: null and empty texts match nothing (null licence, dice 0); units of one word have no bigram and match
nothing; rows are independent, so repeated rows give the same row each.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.7

# fixed values: public notices, SPDX identifier to text
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright to this work to the public domain.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
OTHER = r"[^\p{L}\p{N}]+"


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def words_of(text: Column) -> Column:
    """Normalised words."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), OTHER, " "), " "), lambda word: word != "")


def bigrams(words: Column) -> Column:
    """Distinct bigrams of an array of words; empty for fewer than two."""
    pairs = F.zip_with(
        words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    return F.array_distinct(F.array_compact(pairs))  # the last word has no partner: null


def _literal(templates: dict[str, str], threshold: float) -> tuple[Column, int, int]:
    sets = {name: template_bigrams(text) for name, text in sorted(templates.items())}
    reach = (2 - threshold) / threshold
    rows = [
        F.struct(
            F.lit(name).alias("name"), F.array(*map(F.lit, found)).alias("bigrams"), F.lit(len(found)).alias("n"),
            F.lit(len(found) / reach).alias("least"), F.lit(len(found) * reach).alias("most"),
        )
        for name, found in sets.items()
    ]
    sizes = [len(found) for found in sets.values()]
    return F.array(*rows), int(min(sizes) / reach), int(max(sizes) * reach) + 1


def matches(units: Column, templates: Column, threshold: float) -> Column:
    """(dice, name, line) of all units (line, bigrams) and templates that are similar enough."""

    def of_unit(unit):
        n = F.size(unit["bigrams"])
        near = F.filter(templates, lambda t: (n >= t["least"]) & (n <= t["most"]))
        scored = F.transform(
            near,
            lambda t: F.struct(
                (2.0 * F.size(F.array_intersect(unit["bigrams"], t["bigrams"])) / (n + t["n"])).alias("dice"),
                t["name"].alias("name"),
                unit["line"].alias("line"),
                n.alias("size"),
            ),
        )
        return F.filter(scored, lambda hit: hit["dice"] >= threshold)

    return F.flatten(F.transform(units, of_unit))


def window_matches(lines: Column, hits: Column, whole: Column, rest: Column, templates: Column, threshold: float) -> Column:
    """(dice, name, line) of the best window of each template, from lines (line, words), the hits of units and the bigrams
    of all templates that the text holds, at all and outside the lines that match."""

    def best_of(t):
        done = F.transform(F.filter(hits, lambda hit: hit["size"] >= t["least"]), lambda hit: hit["line"])
        words = F.flatten(
            F.transform(
                lines,
                lambda unit: F.transform(
                    F.when(F.array_contains(done, unit["line"]), F.array(F.lit("\n"))).otherwise(unit["words"]),
                    lambda word: F.struct(unit["line"].alias("line"), word.alias("word")),
                ),
            )
        )
        pairs = lambda seq: F.zip_with(
            seq, F.slice(seq, F.lit(2), F.greatest(F.size(seq) - 1, F.lit(0))),
            lambda a, b: F.struct(a["line"].alias("line"), F.concat(a["word"], F.lit(" "), b["word"]).alias("gram")),
        )

        def of_pairs(grams):
            places = F.filter(
                F.transform(grams, lambda pair, at: F.struct(at.alias("at"), pair["line"].alias("line"), pair["gram"].alias("gram"))),
                lambda place: F.array_contains(t["bigrams"], place["gram"]),
            )
            texts = F.transform(grams, lambda pair: pair["gram"])

            def from_start(place, i):
                # as many places as fit in the upper bound, so the work is linear in the text
                ends = F.filter(F.slice(places, i + 1, F.ceil(t["most"]).cast("int") + 1), lambda end: end["at"] - place["at"] < t["most"])
                long = F.filter(ends, lambda end: end["at"] - place["at"] + 1 >= t["least"])

                def dice(end):
                    own = F.array_distinct(F.slice(texts, place["at"] + 1, end["at"] - place["at"] + 1))
                    return 2.0 * F.size(F.array_intersect(own, t["bigrams"])) / (F.size(own) + t["n"])

                return F.array_max(
                    F.transform(
                        long,
                        lambda end: F.struct(
                            dice(end).alias("dice"), (-place["at"]).alias("start"), (-end["at"]).alias("stop"),
                            place["line"].alias("line"), t["name"].alias("name"), t["n"].alias("n"),
                        ),
                    )
                )

            return F.array_max(F.transform(places, from_start))

        return F.get(F.transform(F.array(pairs(words)), of_pairs), 0)

    possible = F.filter(
        templates,
        lambda t: (F.size(F.array_intersect(whole, t["bigrams"])) >= t["least"])
        & (F.exists(hits, lambda hit: hit["size"] < t["least"]) | (F.size(F.array_intersect(rest, t["bigrams"])) >= t["least"]))
        & ~F.exists(hits, lambda hit: (hit["line"] == -1) & (hit["size"] >= t["least"])),
    )
    return F.filter(F.transform(possible, best_of), lambda found: found.isNotNull() & (found["dice"] >= threshold))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without text, with license, dice, line (of the best match; -1: the whole text) and n_matches."""
    known, least, most = _literal(templates or TEMPLATES, threshold)
    lines = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n", -1),
        lambda line, at: F.struct(at.alias("line"), words_of(line).alias("words")),
    )
    # a set has at most one bigram less than words: too short a unit fails every lower bound
    sized = F.filter("_lines", lambda unit: F.size(unit["words"]) > least)
    whole = F.flatten(F.transform("_lines", lambda unit: unit["words"]))
    units = F.transform(sized, lambda unit: F.struct(unit["line"].alias("line"), bigrams(unit["words"]).alias("bigrams")))
    several = F.when(F.size("_lines") > 1, F.array(F.struct(F.lit(-1).alias("line"), F.col("_whole").alias("bigrams"))))
    met = lambda unit: F.exists("_of_units", lambda hit: hit["line"] == unit["line"])
    rest = F.flatten(F.transform("_lines", lambda unit: F.when(met(unit), F.array(F.lit("\n"))).otherwise(unit["words"])))
    every = sorted({gram for text in (templates or TEMPLATES).values() for gram in template_bigrams(text)})
    largest = lambda w, v: (v["n"] > w["n"]) & (v["start"] >= w["start"]) & (v["stop"] <= w["stop"])
    plain = lambda hit: F.struct(hit["dice"].alias("dice"), hit["name"].alias("name"), hit["line"].alias("line"))
    bounded = lambda unit: F.size(unit["bigrams"]).between(least, most)
    found = (
        docs.withColumn("_lines", lines)
        .withColumn("_whole", bigrams(whole))
        .withColumn("_units", F.filter(F.concat(F.coalesce(several, F.array()), units), bounded))
        .withColumn("_of_units", matches(F.col("_units"), known, threshold))
        .withColumn("_present", F.array_intersect("_whole", F.array(*map(F.lit, every))))
        .withColumn("_rest", F.when(F.size("_of_units") > 0, F.array_intersect(bigrams(rest), F.array(*map(F.lit, every)))).otherwise(F.col("_present")))
        .withColumn("_windows", window_matches(F.col("_lines"), F.col("_of_units"), F.col("_present"), F.col("_rest"), known, threshold))
        .withColumn("_outer", F.filter("_windows", lambda w: ~F.exists("_windows", lambda v: largest(w, v))))
        .withColumn("_hits", F.concat(F.transform("_of_units", plain), F.transform("_outer", plain)))
    )
    best = F.get(
        F.array_sort(
            "_hits",
            lambda a, b: F.when(a["dice"] != b["dice"], F.when(a["dice"] > b["dice"], -1).otherwise(1))
            .when(a["name"] != b["name"], F.when(a["name"] < b["name"], -1).otherwise(1))
            .otherwise(a["line"] - b["line"]),
        ),
        0,
    )
    kept = [name for name in docs.columns if name != "text"]
    return found.withColumn("_best", best).select(
        *kept,
        F.col("_best.name").alias("license"),
        F.coalesce("_best.dice", F.lit(0.0)).alias("dice"),
        F.col("_best.line").cast("long").alias("line"),
        F.size("_hits").cast("long").alias("n_matches"),
    )


def query(spark, sf_dir) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql(templates: dict[str, str], threshold: float) -> str:
    def quote(text):
        return "'" + text.replace("'", "''") + "'"

    rows = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in sorted(templates.items()))
    return f"""
WITH known(name, text) AS (VALUES {rows}), units AS (
  SELECT 't' AS kind, name AS key, CAST(0 AS BIGINT) AS line, text FROM known
  UNION ALL
  SELECT 'd', CAST(doc_id AS VARCHAR), line - 1, parts[line] FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts,
           unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line FROM documents)
  UNION ALL
  SELECT 'd', CAST(doc_id AS VARCHAR), -1, text FROM documents WHERE contains(text, chr(10))
), words AS (
  SELECT kind, key, line,
         list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w
  FROM units
), sets AS (
  SELECT kind, key, line,
         list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words WHERE len(w) > 1
), sized AS (SELECT *, len(b) AS n FROM sets),
hits AS (
  SELECT CAST(d.key AS BIGINT) AS doc_id, t.key AS license, d.line,
         2.0 * len(list_intersect(d.b, t.b)) / (d.n + t.n) AS dice
  FROM sized d JOIN sized t ON d.kind = 'd' AND t.kind = 't' AND d.n BETWEEN t.n * {threshold / (2 - threshold)} - 1
       AND t.n * {(2 - threshold) / threshold} + 1
), best AS (
  SELECT doc_id, count(*) AS n_matches, first(license ORDER BY dice DESC, license, line) AS license,
         first(line ORDER BY dice DESC, license, line) AS line, max(dice) AS dice
  FROM hits WHERE dice >= {threshold} GROUP BY doc_id
)
SELECT doc_id, license, CAST(coalesce(dice, 0) AS DOUBLE) AS dice, line, coalesce(n_matches, 0) AS n_matches
FROM documents LEFT JOIN best USING (doc_id)
"""


SQL = _sql(TEMPLATES, THRESHOLD)
