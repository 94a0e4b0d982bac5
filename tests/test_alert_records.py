"""Records of alerts against plain folds over the rows in order."""

import datetime
import random

from pyspark.sql import functions as F

from watchtide.operators.alert_records import dispatch_outcomes, exposure_summary, incident_events, incident_states, usage_totals

SCHEMA = "detection_id string, tenant_id string, pattern_id string, subject_type string, subject_key string, chain_slug string, protocol string, severity string, lifecycle_state string, incident_transition string, event_key string, classification string, score double, confidence double, context string, created_at timestamp_ntz, arrival long"


def rows(n, seed=1):
    r = random.Random(seed)
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=r.randrange(24 * 75))
    return [
        (f"d{i}", r.choice(["a", "a", "a", "b", None]), r.choice(["dpeg", "tvl"]), "market", r.choice(["a:USDC/USD", "DAI/USD", "", None, "x:y:eth"]), r.choice(["base", "BSC", "offchain", None]), r.choice(["market:USDC/USD", "aave", None]),
         r.choice(["critical", "high", "low"]), r.choice(["provisional", "confirmed", "retracted"]), r.choice(["trigger", "escalate", "deescalate", "update", "resolve", "retract", None]), r.choice(["dpeg:1", "x", None]), r.choice(["isolated", None]),
         r.choice([-5.0, 20.0, 130.0]), 0.5, r.choice(['{"weighted_median_price":0.9}', '{"weighted_median_price":-1}', "oops", None]), at(), i)
        for i in range(n)
    ]


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def test_incidents(spark):
    data = rows(400)
    events = incident_events(spark.createDataFrame(data, SCHEMA), F.create_map(F.lit("total"), F.col("score")), width_us=3 * 86_400_000_000)
    got = {e["detection_id"]: e for e in events.collect()}
    now, number, states = {}, {}, {}
    for d in sorted((dict(zip(NAMES, x, strict=True)) for x in data), key=lambda d: (d["created_at"], d["arrival"])):
        key = (d["tenant_id"], d["pattern_id"], d["subject_key"] or "", d["chain_slug"])
        to = {"trigger": "triggered", "resolve": "resolved", "retract": "retracted", None: "triggered"}.get(d["incident_transition"], "active")
        e, before = got[d["detection_id"]], now.get(key)
        assert (e["from_status"], e["to_status"], e["event_type"]) == (before[1] if before else to, to, d["incident_transition"] or "trigger")
        assert before is None or before[0] == e["incident_id"]
        now[key] = (e["incident_id"], to)
        s = states.setdefault(e["incident_id"], {"opened_at": d["created_at"], "events": 0, "closed_at": None})
        s |= {"status": to, "current_severity": d["severity"], "updated_at": d["created_at"], "events": s["events"] + 1}
        if to in ("resolved", "retracted"):
            s["closed_at"] = d["created_at"]
            number[key] = number.get(key, 0) + 1
            del now[key]
    found = {r["incident_id"]: {k: r[k] for k in ("status", "current_severity", "opened_at", "updated_at", "closed_at", "events")} for r in incident_states(events).collect()}
    assert found == states and len(got) == 400
    assert all('"event_key":null' in e["payload"] for e in got.values() if data[e["arrival"]][NAMES.index("event_key")] is None)


def test_exposure_equals_single_positions(spark):
    data = rows(100, 2)
    held = [("e1", "a", "USDC", 10.0, 11.0, True), ("e2", "a", "USDC", 2.5, None, True), ("e3", "a", "USDC", 9.0, 9.0, False), ("e4", "b", "DAI", None, 7.0, True), ("e5", None, "DAI", 1.0, 1.0, True), ("e6", "a", "eth", 1.0, 3.0, None)]
    df = spark.createDataFrame(data, SCHEMA)
    got = exposure_summary(df, spark.createDataFrame(held, "entity_id string, tenant_id string, asset_symbol string, quantity double, valuation_usd double, enabled boolean"))
    assert got.columns == [*df.columns, "entities", "exposure_summary"]
    for g in got.collect():
        asset = (g["subject_key"] or "").split(":")[-1].split("/")[0]
        price = 0.9 if g["context"] and "0.9" in g["context"] else 0
        mine = [(q or 0) * price if price else (v or 0) for _, t, a, q, v, on in held if on and t and t == g["tenant_id"] and a == asset]
        assert g["entities"] == len(mine) and (g["exposure_summary"] is None) == (not mine)
        if mine:
            s, capital = g["exposure_summary"], sum(mine)
            want = (capital, capital * 0.05, capital * 0.1, capital * max(g["score"] / 100, 0))
            assert s["asset_symbol"] == asset and all(abs(x - y) < 1e-9 for x, y in zip((s["capital_at_risk"], s["loss_5"], s["loss_10"], s["savings"]), want, strict=True))


def test_quota_and_usage(spark):
    data = rows(500, 3)
    limits = [("a", 20), ("b", None), ("c", 1), (None, 0), ("nobody", 9)]
    for most in (20, 0, -1):
        limits[0] = ("a", most)
        out = dispatch_outcomes(spark.createDataFrame(data, SCHEMA), spark.createDataFrame(limits, "tenant_id string, max_alerts_per_month long"), "nobody", width_us=5 * 86_400_000_000)
        got, used, usage = {g["detection_id"]: g for g in out.collect()}, {}, {}
        for d in sorted((dict(zip(NAMES, x, strict=True)) for x in data), key=lambda d: (d["created_at"], d["arrival"])):
            d["tenant_id"] = d["tenant_id"] or "nobody"
            month, g = (d["tenant_id"], d["created_at"].month), got[d["detection_id"]]
            limit, fired = dict(limits)[d["tenant_id"]], used.get(month, 0)
            held = limit is not None and limit >= 0 and fired >= limit and d["severity"] != "critical" and d["lifecycle_state"] != "retracted"
            assert g["lifecycle_state"] == ("suppressed" if held else d["lifecycle_state"])
            assert (g["quota_limit"], g["quota_used"]) == ((limit, fired) if held else (None, None))
            used[month] = fired + (not held)
            kind = "dpeg" if (d["event_key"] or "").startswith("dpeg:") or (d["protocol"] or "").startswith("market:") else "generic"
            key = (d["tenant_id"], d["created_at"].strftime("%Y-%m"), "alert_suppressed_quota" if held else "alert_fired", kind, {"base": 8453, "BSC": 56}.get(d["chain_slug"]))
            usage[key] = usage.get(key, 0) + 1
        assert {tuple(r)[:5]: r["quantity"] for r in usage_totals(out).collect()} == usage and len(got) == len(data)


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    events = incident_events(none, F.create_map(F.lit("total"), F.col("score")))
    limits = spark.createDataFrame([], "tenant_id string, max_alerts_per_month long")
    assert incident_states(events).count() == 0 and usage_totals(dispatch_outcomes(none, limits)).count() == 0
