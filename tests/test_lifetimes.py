"""Validity intervals against a plain restatement, in one pass and merged snapshot by snapshot."""

import datetime
import random

from forgelens.operators import lifetimes

DAYS = [datetime.date(2026, 1, 1) + datetime.timedelta(days=7 * i) for i in range(9)]


def intervals_of(members, taken):
    out = []
    for key in {key for _, *key in members for key in [tuple(key)]}:
        held, start = {day for day, *k in members if tuple(k) == key}, None
        for i, day in enumerate(taken):
            if day in held and start is None:
                start = day
            if start and (day not in held):
                out.append((*key, start, taken[i - 1], day))
                start = None
        if start:
            out.append((*key, start, taken[-1], None))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("repo", "slug", *lifetimes.INTERVAL).collect()), key=repr)


def make(spark, members):
    return spark.createDataFrame(members, "snapshot date, repo string, slug string")


def test_batch_and_merges_agree(spark):
    rng = random.Random(5)
    members = [(day, f"r{i % 7}", f"s{i % 3}") for day in DAYS for i in range(21) if rng.random() < 0.6]
    members += members[:20]
    members += [(day, "always", "x") for day in DAYS]
    whole = lifetimes.lifetimes(make(spark, members), "repo", "slug")
    assert rows(whole) == intervals_of(members, DAYS)
    state = lifetimes.lifetimes(make(spark, [m for m in members if m[0] <= DAYS[2]]), "repo", "slug")
    for day in DAYS[3:]:
        now = make(spark, [m for m in members if m[0] == day])
        state = spark.createDataFrame(lifetimes.merged(state, now, day, "repo", "slug").collect(), whole.schema)
        again = lifetimes.merged(state, now, day, "repo", "slug")
        assert rows(again) == rows(state)
    assert rows(state) == rows(whole)
    for day in DAYS:
        alive = {tuple(row) for row in lifetimes.alive_at(whole, day).collect()}
        assert alive == {(repo, slug) for at, repo, slug in members if at == day}
    changed = {tuple(row) for row in lifetimes.changes_between(whole, DAYS[1], DAYS[6], "repo", "slug").collect()}
    before, after = ({(r, s) for at, r, s in members if at == day} for day in (DAYS[1], DAYS[6]))
    assert changed == {(*k, "added") for k in after - before} | {(*k, "removed") for k in before - after}


def test_snapshots_without_members_end_runs(spark):
    members = [(DAYS[0], "a", "x"), (DAYS[2], "a", "x")]
    taken = spark.createDataFrame([(day,) for day in DAYS[:3]], "snapshot date")
    whole = lifetimes.lifetimes(make(spark, members), "repo", "slug", snapshots=taken)
    assert rows(whole) == [("a", "x", DAYS[0], DAYS[0], DAYS[1]), ("a", "x", DAYS[2], DAYS[2], None)]
    assert lifetimes.lifetimes(make(spark, []), "repo", "slug").count() == 0


def test_a_merge_reads_no_earlier_snapshot(spark):
    state = spark.createDataFrame([("a", "x", DAYS[0], DAYS[1], None)], "repo string, slug string, first_seen date, last_seen date, gone_at date")
    got = lifetimes.merged(state, make(spark, []), DAYS[2], "repo", "slug")
    assert rows(got) == [("a", "x", DAYS[0], DAYS[1], DAYS[2])]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan
