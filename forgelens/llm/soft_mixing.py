"""Mixing to target weights with soft domain membership (built-in functions only).

1. A Bernoulli naive Bayes classifier learns the domains from a labelled table.  Features of a text are its distinct
   lower-cased words and tokens for its style: tenths of capital letters, of symbols and of distinct words.  It
   is fitted on about ``SAMPLE_DOCS`` labelled documents (a hash sample; labels beyond that are not needed) and uses the
   ``FEATURES`` features that tell most about the domain among those that one domain has ``LEAST_LIFT`` times as often
   as the others: words that merely come with long texts would be counted again and again.
2. Every document gets posteriors p_d, and its expected tokens of domain d are tokens * p_d.
3. Projected gradient: rates r in [0, ``most``], all 1 at first, are fitted so that the totals sum(tokens * p_d * r) match
   the targets in the least-squares sense.  A step moves each rate by -sum_d p_d (total_d - target_d) / available_d,
   the gradient scaled by tokens and by what a domain holds, and projects it back.  A step is one aggregate over
   a narrow table; the driver sees one number a domain.
4. A document is kept if a hash of it, as a number in [0, 1), is below its rate.

Targets are weights of the domains.  Their sum of tokens is the largest for which no wanted domain (by default the one
with the largest weight) needs more than it has; the other domains stay below their targets where they are scarce.
With ``most`` = 1 no text is repeated.  Steps go on until the rates of a share of ``TOLERANCE`` of the tokens move;
what is left between totals and targets is logged, as a warning if ``STEPS`` did not suffice.

Defined results: null and empty texts have no words, no tokens and the posterior of an empty feature set; without any
labelled document all belong to the first domain; domains without tokens have no target; rows with one doc_id and
text share their fate; null ids are rows like others; an empty table gives an empty table.
"""

import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SAMPLE_DOCS, FEATURES = 20_000, 64
LEAST_LIFT = 2.5
STEPS, TOLERANCE = 256, 1e-4
SPACE = 1 << 30
TARGETS = {"good": 0.90, "low": 0.08, "toxic": 0.02}
MOST = 1.0


def label_domain() -> Column:
    """Domain of a row of ``labels``; null where it is not labelled."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "low")


def _share(part: Column, whole: Column, name: str) -> Column:
    tenth = F.least(F.floor(10 * part / F.greatest(whole, F.lit(1))), F.lit(9))
    return F.concat(F.lit(f"#{name}"), tenth.cast("string"))


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with features (distinct) and tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), " "), lambda word: word != "")
    kept = [name for name in docs.columns if name != "text"]
    sized = docs.select(
        *kept,
        words.alias("_words"),
        F.length(text).alias("_length"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("_capitals"),
        F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", "")).alias("_symbols"),
    ).withColumn("_distinct", F.array_distinct("_words"))
    style = F.array(
        _share(F.col("_capitals"), F.col("_length"), "capitals"),
        _share(F.col("_symbols"), F.col("_length"), "symbols"),
        _share(F.size("_distinct"), F.size("_words"), "distinct"),
    )
    return sized.select(*kept, F.concat("_distinct", style).alias("features"), F.size("_words").cast("long").alias("tokens"))


def _point(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SPACE)) / SPACE


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], sample_docs: int = SAMPLE_DOCS) -> dict | None:
    """Log odds by feature and domain, from (doc_id, text) and (doc_id, domain); null without labelled documents."""
    known = labels.where("doc_id IS NOT NULL").where(F.col("domain").isin(domains)).dropDuplicates(["doc_id"])
    n_known = known.count()
    if not n_known:
        return None
    sample = known.where(_point("doc_id") < min(1.0, sample_docs / n_known)).select("doc_id", "domain")
    # about sample_docs narrow rows, whatever the table
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = written(with_features(rows), "labelled")
    sizes = {row["domain"]: row["n"] for row in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return None
    held = [sizes.get(domain, 0) for domain in domains]
    counts = rows.select("domain", F.explode("features").alias("feature")).groupBy("feature").agg(
        *[F.count_if(F.col("domain") == domain).alias(f"n{i}") for i, domain in enumerate(domains)]
    )
    seen = sum((F.col(f"n{i}") for i in range(1, len(domains))), F.col("n0"))

    def part(n, row, column):  # of the mutual information of feature and domain
        return F.when(n > 0, n * F.log(n * total / (row * F.lit(column)))).otherwise(0.0)

    told = sum(
        (part(F.col(f"n{i}"), seen, n) + part(n - F.col(f"n{i}"), total - seen, n) for i, n in enumerate(held) if n),
        F.lit(0.0),
    )
    lift = F.greatest(*[
        F.col(f"n{i}") * (total - n) / (F.lit(n) * F.greatest(seen - F.col(f"n{i}"), F.lit(0.5))) for i, n in enumerate(held) if n
    ], F.lit(0.0))
    best = counts.where(lift >= LEAST_LIFT).withColumn("told", told).orderBy(F.desc("told"), "feature").limit(FEATURES).collect()
    odds, base = {}, [math.log((n + 1) / (total + len(domains))) for n in held]
    for row in best:
        shares = [(row[f"n{i}"] + 1) / (n + 2) for i, n in enumerate(held)]
        odds[row["feature"]] = [math.log(p) - math.log(1 - p) for p in shares]
        base = [b + math.log(1 - p) for b, p in zip(base, shares)]
    return {"odds": odds, "base": base}


def _adder(odds: Column):
    return lambda total, name: total + F.element_at(odds, name)


def posteriors(featured: DataFrame, model: dict | None, domains: list[str]) -> DataFrame:
    """``featured`` with p (an array, one number a domain) instead of features."""
    kept = [name for name in featured.columns if name != "features"]
    if model is None:
        return featured.select(*kept, F.array(*[F.lit(float(i == 0)) for i in range(len(domains))]).alias("p"))
    names = sorted(model["odds"])
    present = F.array_intersect("features", F.array(*map(F.lit, names)))
    logs = []
    for i in range(len(domains)):
        odds = F.create_map(*[x for name in names for x in (F.lit(name), F.lit(model["odds"][name][i]))])
        logs.append(F.aggregate("_present", F.lit(model["base"][i]), _adder(odds)))
    scored = featured.select(*kept, present.alias("_present")).select(*kept, F.array(*logs).alias("_logs"))
    powers = F.transform("_logs", lambda x: F.exp(x - F.array_max("_logs")))
    summed = F.aggregate("_powers", F.lit(0.0), lambda s, x: s + x)
    return scored.withColumn("_powers", powers).select(*kept, F.transform("_powers", lambda x: x / summed).alias("p"))


def rate(steps: list[list[float]], most: float = MOST) -> Column:
    """Rate of a document after the given steps (one number a domain each) from rate 1."""
    now = F.lit(min(1.0, most))
    if not steps:
        return now
    moves = F.array(*[F.array(*map(F.lit, step)) for step in steps])

    def move(r, step):
        shift = F.aggregate(F.zip_with("p", step, lambda p, g: p * g), F.lit(0.0), lambda s, x: s + x)
        return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), r - shift))

    return F.aggregate(moves, now, move)


def fit_rates(rows: DataFrame, weights: list[float], most: float = MOST, wanted: list[int] | None = None) -> list[list[float]]:
    """Steps of the projected gradient over (tokens, p); ``wanted`` domains bound the budget, by default all."""

    def totals(steps):
        now = rate(steps, most)
        amount, moved = F.col("tokens") * now, F.col("tokens") * F.abs(now - rate(steps[:-1], most))
        sums = rows.agg(*[F.sum(amount * F.get("p", F.lit(i))) for i in range(len(weights))], F.sum(moved)).first()
        return [x or 0.0 for x in sums[:-1]], sums[-1] or 0.0

    (available, _), steps = totals([]), []
    holds = lambda among: [available[i] / weights[i] for i in among if available[i] > 0 and weights[i] > 0]
    every = range(len(weights))
    most_tokens = min(holds(every if wanted is None else wanted) or holds(every), default=0.0)
    targets = [w * most_tokens for w in weights]
    now, moved = available, math.inf
    while moved > TOLERANCE * sum(available) and len(steps) < STEPS:
        step = [(x - t) / a if a > 0 else 0.0 for x, t, a in zip(now, targets, available)]
        if max(map(abs, step), default=0.0) < TOLERANCE:
            moved = 0.0
            break
        steps.append(step)
        now, moved = totals(steps)
    level = logging.INFO if moved <= TOLERANCE * sum(available) else logging.WARNING
    left = [x - t for x, t in zip(now, targets)]
    logging.getLogger(__name__).log(level, "%d steps; tokens above targets %s: %s", len(steps), targets, left)
    return steps


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, most: float = MOST,
    wanted: list[str] | None = None,
) -> DataFrame:
    """(doc_id, print, n_tokens, p_<domain>..., rate, kept) of every row of ``docs``; ``labels`` is (doc_id, domain)."""
    targets = targets or TARGETS
    domains, weights = list(targets), [float(w) for w in targets.values()]
    docs = docs.select("doc_id", F.xxhash64("text").alias("print"), "text")
    model = fit(docs, labels, domains)
    rows = written(posteriors(with_features(docs), model, domains), "posteriors")
    wanted = wanted or [max(domains, key=targets.get)]
    steps = fit_rates(rows, weights, most, [domains.index(domain) for domain in wanted])
    return rows.withColumn("rate", rate(steps, most)).select(
        "doc_id",
        "print",
        F.col("tokens").alias("n_tokens"),
        *[F.get("p", F.lit(i)).alias(f"p_{domain}") for i, domain in enumerate(domains)],
        "rate",
        (_point("doc_id", "print") < F.col("rate")).alias("kept"),
    )


def read_labels(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", label_domain().alias("domain"))


def mixed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline form: the documents that are kept; same columns."""
    gone = mix(docs, labels).where("NOT kept").select(F.col("doc_id").alias("_doc"), F.col("print").alias("_print")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["_doc"]) & (F.xxhash64(docs["text"]) == gone["_print"])
    return docs.join(gone, same, "left_anti")


def query(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mix(docs, read_labels(spark, sf_dir)).drop("print")
