"""Finality in ranges against the fold of whole chains, one event after the other."""

import random

import pytest
from pyspark.sql import functions as F

from watchtide.operators import chain, finality
from watchtide.plans import chain as plans
from watchtide.plans.registry import view

SCHEMA = "chain string, event_id long, block_number long, block_hash string, event_key string, requires_confirmation boolean, confirmation_depth long"


def folded(rows, depths, default=3):
    """The reference process: every event of a chain in order of arrival."""
    out = []
    for c in {r[0] for r in rows}:
        own = depths.get(c, default)
        events = [(e, b, h, k, max(1, d or 1) if q else own) for x, e, b, h, k, q, d in sorted(rows, key=lambda r: r[1]) if x == c]
        out += chain.finality_step(chain.new_state(), c, events)
    return sorted(map(str, out))


def random_chain(r, name, n, start, forks):
    rows, height, made = [], 5, {}
    for e in range(start, start + n):
        height = max(1, height + r.choice([0, 1, 1, 2] if r.random() > forks else [-1, -3, -9, 0, 30]))
        h = made.setdefault(height, "a") if r.random() > forks else r.choice(["a", "b", None])
        made[height] = h or made.get(height)
        rows.append((name, e, height, h, f"k{r.randrange(n // 2)}" if r.random() < 0.15 else f"{name}{e}", r.random() < 0.3, r.choice([None, 0, 1, 4, 9])))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_ranges_agree_with_the_fold(spark, seed, monkeypatch):
    """Small ranges of heights and arrivals, so that everything crosses them."""
    r = random.Random(seed)
    monkeypatch.setattr(finality, "HEIGHTS", r.choice([4, 16]))
    monkeypatch.setattr(finality, "ARRIVALS", r.choice([8, 64]))
    rows = [x for i, f in enumerate((0.02, 0.1, 0.4)) for x in random_chain(r, "abc"[i], 300, 1000 * i, f)]
    rows += [("far", 5000 + i, b, h, f"f{i}", False, None) for i, (b, h) in enumerate([(3, "a"), (10**9, "a"), (10**9, "b"), (7, "a"), (3, "b"), (2_000_000, "x"), (2_000_000, "y")])]
    depths = {"a": 2, "b": 6}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(x) for x in finality.finality(df, depths).collect()]
    assert sorted(map(str, got)) == folded(rows, depths) and {g[3] for g in got} == {"provisional", "confirmed", "retracted", "reorg"}


def test_no_events_no_forks(spark):
    assert finality.finality(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [("offchain", i, i, None if i % 2 else "a", f"k{i}", False, None) for i in range(9)]
    got = finality.finality(spark.createDataFrame(rows, SCHEMA)).where("status = 'confirmed'").collect()
    assert {(g["event_key"], g["event_id"]) for g in got} == {("k0", 0), *((f"k{i}", i + 1) for i in range(1, 8))}


def test_depth_of_event_or_chain(spark):
    df = spark.createDataFrame([("base", 1, 1, "a", "k", False, 9), ("eth", 2, 1, "a", "k", None, 9), ("eth", 3, 1, "a", "k", True, 0), ("offchain", 4, 1, "a", "k", True, 7)], SCHEMA)
    assert [r[0] for r in df.select(finality.own_depth(df)).collect()] == [64, 3, 1, 7]


def test_horizon_bounds_the_state():
    s = chain.new_state()
    chain.finality_step(s, "a", [(i, i, "h", f"k{i}", 2) for i in range(500)], horizon=10)
    assert len(s["blocks"]) == len(s["status"]) == 11


def test_notices_roll_back_once(spark):
    events = spark.createDataFrame([("a", 1, "k1"), ("a", 2, "k2"), ("a", 3, "k3"), ("b", 2, "k2")], "chain string, block_number long, event_key string")
    status = events.select("chain", "event_key", F.lit("confirmed").alias("status"))
    notices = spark.createDataFrame([("a", 2, ["k2", "k3"]), ("a", 2, ["k2", "k3"]), ("c", 1, [])], "chain string, orphaned_from long, affected array<string>")
    left, head, after = finality.apply_notices(events, status, notices)
    assert {tuple(r) for r in head.collect()} == {("a", 1), ("b", 2)} and left.count() == 2
    assert {(r["chain"], r["event_key"]) for r in after.where("changed").collect()} == {("a", "k2"), ("a", "k3")}
    again = finality.apply_notices(left, after.drop("changed"), notices)
    assert again[2].where("changed").count() == 0 and {tuple(r) for r in again[1].collect()} == {("a", 1), ("b", 2)}


def test_fixture_has_forks(spark, sf):
    n = finality.conflicts(view(spark, sf, "chain_events")).count()
    assert n > 3 and plans.DEPTHS


def test_reorganisations_walk_no_further_than_they_reach():
    """A reorganisation takes back the blocks at and above it, without a walk over all blocks there are."""

    class Blocks(dict):
        walks = longest = 0

        def __iter__(self):
            Blocks.walks += 1
            return super().__iter__()

        def __setitem__(self, k, v):
            super().__setitem__(k, v)
            Blocks.longest = max(Blocks.longest, len(self))

    def events(n):
        for i in range(n):
            yield (2 * i, i, "a", f"k{i}", 3)
            if i % 20 == 19:
                yield (2 * i + 1, i - 2, "b", f"f{i}", 3)

    s = chain.new_state() | {"blocks": Blocks()}
    got = chain.finality_step(s, "a", events(2_000), horizon=50)
    assert Blocks.walks <= 1 and Blocks.longest <= 110
    assert sum(r[3] == "reorg" for r in got) == 100
    assert got == chain.finality_step(chain.new_state(), "a", events(2_000))
