"""Drawdown rules against a model that takes events one after the other, and what configurations mean."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchtide.operators import drawdown, stretches
from watchtide.sources.configs import tvl_rules

RANK = {"high": 4, "critical": 5}
SAMPLES = "event_id long, observed_at timestamp, tenant_id string, protocol_id string, chain_slug string, market_id string, tvl_usd double"


def rules_of(spark, configs):
    rows = [(t, c if isinstance(c, str) else json.dumps(c)) for t, c in configs.items()]
    return tvl_rules(spark.createDataFrame(rows, "tenant_id string, config string"))


def at(second):
    return f"2024-01-01T{second // 3600:02}:{second // 60 % 60:02}:{second % 60:02}"


def samples_of(spark, rows):
    text = SAMPLES.replace("observed_at timestamp", "observed_at string")
    return spark.createDataFrame([(i, at(s), t, p, c, m, v) for i, s, t, p, c, m, v in rows], text).withColumn("observed_at", F.to_timestamp("observed_at"))


def model(rows, rules):
    """State by rule and subject; ``rules`` as rows of the table."""
    state, out = {}, {}
    for i, sec, tenant, protocol, chain, market, value in sorted(rows, key=lambda r: (r[1], r[0])):
        if value is None or not np.isfinite(value) or value <= 0:
            continue
        for r in sorted((r for r in rules if r["tenant_id"] == tenant), key=lambda r: r["rule_order"]):
            if (r["protocol_id"], r["chain_slug"]) != (protocol.lower(), chain.lower()) or (r["market_id"] and r["market_id"] != (market or "").lower()):
                continue
            place = f"{protocol.lower()}:{chain.lower()}"
            key = tenant, r["rule_order"], place + (f":{r['market_id']}" if r["market_id"] else "")
            s = state.setdefault(key, {"seen": [], "severity": None, "context": "isolated", "drop": 0.0, "breach": None})
            s["seen"].append((sec, value))
            drops = {}
            for w in drawdown.WINDOWS:
                peak = max(v for t, v in s["seen"] if t >= sec - 60 * r[f"{w}_minutes"])
                drops[w] = (peak - value) / peak * 100
            most = max(drops.values())
            velocity = drops["velocity"] >= r["velocity_critical_pct"]
            breach = value >= r["min_tvl_floor_usd"] and (velocity or drops["fast"] >= r["fast_drop_pct"] or drops["slow"] >= r["slow_drop_pct"])
            if breach:
                systemic = r["contagion_enabled"] and any(k[0] == tenant and ":".join(k[2].split(":")[:2]) != place and x["breach"] is not None and x["breach"] >= sec - 60 * r["concurrent_minutes"] for k, x in state.items())
                severity, context = "critical" if velocity or systemic else "high", "systemic" if systemic else "isolated"
                if s["severity"] is None:
                    change = "trigger"
                elif RANK[severity] > RANK[s["severity"]]:
                    change = "escalate"
                else:
                    change = "update" if most >= s["drop"] + 1.0 or context != s["context"] else None
                out[i, r["rule_id"], key[2]] = severity, context, change, round(most, 9)
                s.update(severity=severity, context=context, breach=sec)
            s["drop"] = most
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_number_of_windows_in_one_plan(spark, seed):
    r = random.Random(seed)
    configs = {}
    for tenant in ("a", "b"):
        rules = []
        for k in range(25):
            scope = {"protocol_id": r.choice(["P1", "p2", "p3"]), "chain_slug": r.choice(["Base", "eth"]), "market_id": r.choice([None, None, "all", "M", "n"])}
            rules.append({"rule_id": f"r{k}", "scope": scope, "fast_drop_pct": r.choice([5, 20]), "slow_drop_pct": r.choice([10, 35]), "velocity_critical_pct": r.choice([15, 40]), "fast_window_minutes": r.randint(1, 40), "slow_window_minutes": r.randint(1, 90), "velocity_critical_minutes": r.randint(1, 9), "concurrent_window_minutes": r.randint(1, 20), "min_tvl_floor_usd": r.choice([0, 40, 70]), "contagion_enabled": r.random() < 0.7})
        configs[tenant] = {"rules": rules}
    rows = [(i, r.choice([s, s // 60 * 60]), r.choice("aab"), r.choice(["p1", "P2", "p3", "other"]), r.choice(["base", "ETH"]), r.choice([None, "m", "N"]), r.choice([None, 0.0, float("nan"), float("inf"), -1.0] + [r.uniform(30, 100) for _ in range(25)])) for i, s in enumerate(r.randint(0, 20_000) for _ in range(700))]
    rules = rules_of(spark, configs)
    got = drawdown.detections(samples_of(spark, rows).repartition(3), rules).collect()
    want = model(rows, rules.collect())
    assert {(x["event_id"], x["rule_id"], x["subject_key"]): (x["severity"], x["context"], x["transition"], round(x["drop"], 9)) for x in got} == want and len(got) == len(want) > 50
    assert {w[1] for w in want.values()} == {"isolated", "systemic"} and {"trigger", "escalate", "update", None} == {w[2] for w in want.values()}


def test_peaks_across_batches(spark):
    """One long series in small Arrow batches, and a series that only falls."""
    r = np.random.default_rng(0)
    values = [*r.normal(size=3000), *range(0, -1000, -1)]
    rows = [("k", i * 10, i, float(v), [0, 10, 450, int(r.integers(0, 20_000))]) for i, v in enumerate(values)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        df = spark.createDataFrame(rows, "k string, at long, event_id long, v double, w array<long>")
        got = {x["event_id"]: x["peaks"] for x in drawdown.peaks(df, ["k"], "at", ["event_id"], "v", F.lit(20_000), F.col("w")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: [max(values[max(0, i - x // 10) : i + 1]) for x in w] for _, _, i, _, w in rows}


def test_what_configurations_mean(spark):
    got = {t: [r.asDict() for r in rules_of(spark, {t: c}).orderBy("rule_order").collect()] for t, c in {
        "default": {}, "broken": "oops", "no array": {"rules": {"rule_id": "x"}}, "all invalid": {"rules": [{"fast_drop_pct": 0}, {"scope": "market"}, 5]}, "all off": {"rules": [{"enabled": False}]},
        "kinds": {"rules": [{"rule_id": "a", "thresholds": {"fast_window_sec": 61, "slow_drop_pct": "12.5"}, "fast_drop_pct": 7}, {"market_id": "ALL", "protocol_id": " "}, {"scope": {"market_id": " M1 "}}, {"scope": "protocol", "market_id": "m1", "protocol_id": "Curve", "fast_window_minutes": 0, "concurrent_window_sec": 30}]},
    }.items()}
    for t in ("default", "broken", "no array", "all invalid"):
        assert [(r["rule_id"], r["protocol_id"], r["chain_slug"], r["market_id"], r["fast_minutes"], r["concurrent_minutes"], r["min_tvl_floor_usd"]) for r in got[t]] == [("tvl-default", "aave_v3", "base", None, 10, 5, 1e6)]
    assert got["all off"] == []
    a, b, c, d = got["kinds"]
    assert (a["fast_minutes"], a["slow_drop_pct"], a["fast_drop_pct"]) == (2, 12.5, 7.0)
    assert (b["rule_id"], b["market_id"], b["protocol_id"]) == ("tvl-rule-2", None, "aave_v3") and c["market_id"] == "m1"
    assert (d["market_id"], d["protocol_id"], d["fast_minutes"], d["concurrent_minutes"]) == (None, "curve", 1, 1)


def test_no_rules_or_samples(spark):
    rows = samples_of(spark, [(1, 0, "t", "aave_v3", "base", None, 9e6), (2, 30, "t", "aave_v3", "base", None, 2e6), (3, 60, "u", "aave_v3", "base", None, 2e6)])
    rules = rules_of(spark, {"t": {}})
    assert [(r["event_id"], r["severity"], r["transition"]) for r in drawdown.detections(rows, rules).collect()] == [(2, "critical", "trigger")]
    assert drawdown.detections(rows, rules.limit(0)).collect() == [] and drawdown.detections(rows.limit(0), rules).collect() == []


def test_pauses_update_open_incidents(spark):
    rows = samples_of(spark, [(1, 0, "t", "aave_v3", "base", None, 9e6), (2, 30, "t", "aave_v3", "base", None, 2e6)])
    rules = rules_of(spark, {"t": {}})
    pauses = samples_of(spark, [(0, 10, "t", "aave_v3", "base", None, 0.0), (5, 18_000, "t", "AAVE_v3", "Base", "m", 0.0), (6, 99, "u", "aave_v3", "base", None, 0.0), (7, 99, "t", "x", "base", None, 0.0)]).withColumn("paused", F.lit(True))
    got = drawdown.pause_updates(pauses, rules, drawdown.detections(rows, rules)).collect()
    assert [(r["event_id"], r["rule_id"], r["severity"], r["context"]) for r in got] == [(5, "tvl-default", "critical", "isolated")]


def test_last_before_in_stretches(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), r.randint(0, 500), i, r.choice([None, i])) for i in range(300)]
    got = stretches.last_before(spark.createDataFrame(rows, "k string, at long, i long, v long"), ["k"], "at", ["i"], {"last": F.col("v")}, 17).collect()
    for x in got:
        before = [v for k, t, i, v in sorted(rows, key=lambda y: y[1:3]) if k == x["k"] and (t, i) < (x["at"], x["i"]) and v is not None]
        assert x["last"] == (before[-1] if before else None)


def test_rules_are_read_once(spark):
    """A rule's text is parsed once for all its settings, scopes and thresholds, whatever kind of value stands there."""
    rows = [("a", '{"rules":[{"scope":"market","market_id":"M","fast_drop_pct":"7"},{"scope":{"market_id":" X ","chain_slug":"Eth"},"thresholds":"none","contagion":{"overlap_window_sec":61}},{"scope":"{\\"market_id\\":\\"no\\"}"},5]}')]
    rules = tvl_rules(spark.createDataFrame(rows, "tenant_id string, config string"))
    got = {r["rule_order"]: (r["market_id"], r["chain_slug"], r["fast_drop_pct"], r["concurrent_minutes"]) for r in rules.collect()}
    assert got == {0: ("m", "base", 7.0, 5), 1: ("x", "eth", 20.0, 2), 2: (None, "base", 20.0, 5)}
    assert rules._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") <= 12
