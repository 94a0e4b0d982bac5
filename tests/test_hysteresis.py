"""Hysteresis in stretches and runs against one evaluation after the other."""

import random

import numpy as np
import pytest

from watchtide.operators import detectors, hysteresis

SCHEMA = "tenant_id string, market_key string, event_id long, now long, breach boolean, rank int, divergence double, has_quotes boolean, floor double, sustained_window_ms long, cooldown_sec long, deescalation_blocks long, resolution_blocks long"
SECOND = 1_000_000


def random_market(r, name, n):
    sustained, cool, down, ends = r.choice([0, 2000, 30_000]), r.choice([0, 5, 60, 3000]), r.randint(1, 5), r.randint(1, 6)
    rows, now, kind = [], 0, 0
    for i in range(n):
        now += r.choice([0, 1, 1, 2, 40]) * SECOND
        if r.random() < 0.25:
            kind = r.choice([-1] + [0] * 6 + [3, 3, 4, 5])
        if r.random() < 0.01:
            now += 5000 * SECOND
        divergence = r.choice([0.1, 0.4, 0.7, 2.0]) if kind == 0 else 3.0 * max(kind, 0)
        rows.append(("t", name, i, now, kind > 0, max(kind, 0), divergence, kind >= 0, r.choice([0.3, 0.5]), sustained, cool, down, ends))
    return rows


def one_by_one(rows):
    out, states = [], {}
    for x in sorted(rows, key=lambda x: (x[3], x[2])):
        policy = dict(zip(hysteresis.SETTINGS, x[9:], strict=True))
        got = detectors.peg_step(states.setdefault(x[:2], detectors.peg_start()), x[3], x[4], x[5], x[6], x[7], policy, x[8])
        if got:
            out.append((*x[:3], *got, x[6]))
    return sorted(out)


@pytest.mark.parametrize("seed", range(60))
def test_runs_agree_with_single_steps(seed):
    r = random.Random(seed)
    rows = random_market(r, "m", 400)
    want = [(x[2], *x[3:5]) for x in sorted(one_by_one(rows), key=lambda x: x[2])]
    s, got, at = detectors.peg_start(), [], 0
    while at < len(rows):  # in pieces, as batches come
        size = r.randint(1, 90)
        part = [np.array(c) for c in zip(*rows[at : at + size], strict=True)]
        got += [(at + i, t, k) for i, t, k in hysteresis.runs(part[3], part[4], part[5], part[6], part[7], part[8], np.stack(part[9:], 1), s)]
        at += size
    assert got == want


@pytest.mark.parametrize("width", [20, 500, 10**9])
def test_stretches_agree_with_one_fold(spark, width):
    r = random.Random(width)
    rows = [x for k in range(12) for x in random_market(r, f"m{k}", 300)]
    rows += [("t", "open", i, i * SECOND, True, 4, 2.0, True, 0.5, 1000, 10, 2, 2) for i in range(300)]  # in breach all the time
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(x) for x in detectors.peg_transitions(df, width_us=width * SECOND).collect()]
    assert sorted(got) == one_by_one(rows) and {g[3] for g in got} == {"trigger", "escalate", "deescalate", "resolve"}
    assert detectors.peg_transitions(df.limit(0)).collect() == []
