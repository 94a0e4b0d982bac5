"""Rules from a table against one rule after the other."""

import random

import pytest

from watchtide.operators import rules as ops

RULES = "tenant_id string, rule_order int, rule_id string, severity string, tests array<struct<attribute:string,op:string,value:string>>"
EVENTS = "tenant_id string, event_id long, attributes map<string,string>"


def number(x):
    try:
        return float(x)
    except ValueError:
        return None


def plain(events, rules):
    hits, errors = set(), {}
    for tenant, i, own in events:
        for r in sorted((r for r in rules if r[0] == tenant), key=lambda r: r[1]):
            ok = True
            for a, op, v in r[4]:
                x = (own or {}).get(a)
                if op in ops.NUMERIC:
                    if x is not None and number(x) is None:
                        first, n, seen = errors.get((tenant, i, a), (r[2], 0, set()))
                        errors[tenant, i, a] = (first, n + (r[2] not in seen), seen | {r[2]})
                        ok = False
                    else:
                        ok &= x is not None and {">=": float(x) >= float(v), ">": float(x) > float(v), "<=": float(x) <= float(v), "<": float(x) < float(v)}[op]
                else:
                    ok &= x is not None and (x == v) == (op == "=")
            if ok and not any(h[:2] == (tenant, i) for h in hits if len(h) == 4):
                hits.add((tenant, i, r[2], None))
    return hits | {(t, i, first, f"{a} is not a number", n) for (t, i, a), (first, n, _) in errors.items()}


def got(df):
    return {(r["tenant_id"], r["event_id"], r["rule_id"], r["error"]) if r["error"] is None else (r["tenant_id"], r["event_id"], r["rule_id"], r["error"], r["n_rules"]) for r in df.collect()}


@pytest.mark.parametrize("block", [ops.BLOCK, 7])
def test_first_matches(spark, block):
    r = random.Random(block)
    rules = []
    for k in range(60):
        tests = [(r.choice("xyz"), r.choice([">=", ">", "<=", "<", "<", ">=", "=", "!="]), str(r.randint(0, 20))) for _ in range(r.choice([1, 1, 1, 2, 3]))]
        rules.append((r.choice("ab"), k, f"r{k}", "high", tests))
    events = [(r.choice("abc"), i, r.choice([None, {}] + [{a: r.choice([str(r.randint(-5, 25)), str(r.randint(0, 20)), "text", "7.5"]) for a in "xyz" if r.random() < 0.8} for _ in range(8)])) for i in range(200)]
    df = ops.first_matches(spark.createDataFrame(events, EVENTS).repartition(2), spark.createDataFrame(rules, RULES), block)
    assert got(df) == plain(events, rules)


def test_ten_thousand_rules(spark):
    """Thresholds from the hardest to the easiest: the first that a value passes is the one right below it."""
    rules = [("t", 10_000 - k, f"over {k}", "low", [("x", ">=", str(k))]) for k in range(10_000)]
    events = [("t", i, {"x": str(i * 37 % 10_007 + 0.5)}) for i in range(3000)]
    out = ops.first_matches(spark.createDataFrame(events, EVENTS), spark.createDataFrame(rules, RULES)).collect()
    assert {(x["event_id"], x["rule_id"]) for x in out} == {(i, f"over {min(i * 37 % 10_007, 9999)}") for i in range(3000)}


def test_bad_rules_and_none(spark):
    rules = [("t", 0, "odd", "high", [("x", "~", "1")]), ("t", 1, "no number", "high", [("x", ">", "many")]), ("t", 2, "good", "low", [])]
    events = spark.createDataFrame([("t", 1, {"x": "1"}), ("u", 2, {})], EVENTS)
    out = ops.first_matches(events, spark.createDataFrame(rules, RULES)).collect()
    assert sorted((x["rule_id"], x["event_id"], x["error"] is None) for x in out if x["event_id"]) == [("good", 1, True)] and {x["rule_id"] for x in out if x["event_id"] is None} == {"odd", "no number"}
    assert ops.first_matches(events, spark.createDataFrame([], RULES)).collect() == []
