"""Operators on busy keys in ranges and stretches against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from watchtide.operators import lifecycle, quotes, stretches


@pytest.mark.parametrize("ranges", [2, 7, 256])
def test_weighted_median_in_ranges(spark, ranges):
    r = random.Random(ranges)
    rows = [(r.choice("ab"), r.choice([round(r.uniform(0, 2), 2), 1.0, 1.0]), r.choice([0.0, 0.5, 1.0, 2.5])) for _ in range(800)] + [("one", 3.0, 1.0), ("none", 1.0, 0.0), ("null", None, 1.0)]
    got = dict(map(tuple, quotes.weighted_median_by(spark.createDataFrame(rows, "k string, price double, weight double"), ["k"], ranges).collect()))
    want = {}
    for k in {"a", "b", "one"}:
        mine = sorted((p, w) for x, p, w in rows if x == k and p is not None and w > 0)
        run, half = 0.0, sum(w for _, w in mine) / 2
        for p, w in mine:
            run += w
            if run >= half:
                want[k] = p
                break
    assert got == want


def test_running_sums_and_timelines(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.randint(0, 300), i, r.randint(0, 5)) for i in range(250)]
    df = spark.createDataFrame(rows, "k string, at long, i long, v long")
    got = stretches.running_sum(df, ["k"], "at", ["i"], {"s": F.col("v")}, 13).collect()
    assert {x["i"]: x["s"] for x in got} == {i: sum(w for y, u, j, w in rows if y == k and (u, j) < (t, i)) for k, t, i, _ in rows}
    placed = lifecycle.timeline(df.withColumn("ts", F.timestamp_seconds("at")), "k", "ts", ["i"], width_us=20_000_000).collect()
    assert {x["i"]: x["position"] for x in placed} == {i: 1 + sum(y == k and (u, j) < (t, i) for y, u, j, _ in rows) for k, t, i, _ in rows}


@pytest.mark.parametrize("seconds", [9, 10**6])
def test_incidents_in_stretches(spark, seconds):
    r = random.Random(seconds)
    rows = [(r.choice("ab"), "p", "market", r.choice(["x", None]), None, r.randint(0, 200), i, r.choice(["trigger", "escalate", "resolve", "retract", "update", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "tenant_id string, pattern_id string, subject_type string, subject_key string, chain_slug string, sec long, arrival long, incident_transition string").withColumn("created_at", F.timestamp_seconds("sec"))
    got = {x["arrival"]: (x["incident_seq"], x["from_state"], x["to_state"]) for x in lifecycle.incident_lifecycle(df, seconds * 1_000_000).collect()}
    name, state, want = {"trigger": "triggered", "resolve": "resolved", "retract": "retracted", None: "triggered"}, {}, {}
    for t, _, _, k, _, s, i, change in sorted(rows, key=lambda x: (x[5], x[6])):
        seq, last = state.get((t, k), (0, None))
        to = name.get(change, "active")
        want[i] = (seq, last or to, to)
        state[t, k] = (seq + 1, None) if to in ("resolved", "retracted") else (seq, to)
    assert got == want


def test_missing_targets(spark):
    wanted = spark.createDataFrame([("s1", "a", True), ("s1", "b", False), ("s2", "a", True)], "stream_id string, tenant_id string, enabled boolean")
    have = spark.createDataFrame([("s2", "a", False)], "stream_id string, tenant_id string, enabled boolean")
    assert [tuple(x) for x in lifecycle.missing_targets(wanted, have).collect()] == [("s1", "a")]
