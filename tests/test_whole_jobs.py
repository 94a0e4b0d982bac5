"""Queries that must take every row, in full precision."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from watchtide.functions import numbers
from watchtide.operators import lifecycle
from watchtide.plans.all import QUERIES
from watchtide.plans.registry import view


def test_words_as_longs(spark):
    """Words beyond 2**53 stay exact, larger ones are null."""
    values = [0, 2**53 + 1, 9019431321631735, 2**63 - 1, 2**63, 2**64 - 1, 2**64, 2**255]
    rows = spark.createDataFrame([(i, f"0x{v:064x}") for i, v in enumerate(values)], "i int, w string")
    got = [r[0] for r in rows.orderBy("i").select(numbers.u256_to_long(F.col("w"))).collect()]
    assert got == [v if v < 2**63 else None for v in values]


def test_periods(spark):
    """Every row has its period; the newest one holds both its ends."""
    now, hour = datetime(2024, 5, 6, 7), timedelta(hours=1)
    back = [timedelta(0), 24 * hour, 24 * hour + timedelta(microseconds=1), 48 * hour, 49 * hour, 720 * hour]
    rows = spark.createDataFrame([(i, now - b) for i, b in enumerate(back)] + [(9, None)], "i int, at timestamp")
    got = lifecycle.by_period(rows, "at", 24, "back").orderBy("i").collect()
    assert [r["back"] for r in got] == [0, 0, 1, 1, 2, 29]


def test_all_rows_are_reported(spark, sf):
    """Health and performance count every row of their tables."""
    health, runs = (QUERIES[n](spark, sf).agg(F.sum(c)).first()[0] for n, c in (("f8_protocol_health", "n"), ("f9_rule_performance", "runs")))
    assert health == view(spark, sf, "detections").where("protocol IS NOT NULL").count() and runs == view(spark, sf, "rule_metrics").count()


def test_rates_of_dense_times(spark):
    """Of many rates at one time one counts, the largest; a rate counts up to the width, and not after."""
    from watchtide.operators.asof import latest_within

    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, at + timedelta(seconds=s)) for i, s in enumerate((0, 30, 31, 59, 60, 90, 91))], "i int, at timestamp")
    rates = spark.createDataFrame([(at, float(v)) for v in range(200)] + [(at + timedelta(seconds=60), 7.0), (at + timedelta(seconds=60), None)], "at timestamp, rate double")
    plan = latest_within(rows, rates, [], "at", "rate", 30, "rate")
    assert [r["rate"] for r in plan.orderBy("i").collect()] == [199.0, 199.0, None, None, 7.0, 7.0, None]
    assert "RANGE" not in plan._jdf.queryExecution().toString().upper().replace("RANGEPARTITIONING", "")  # a sliding frame is walked for each row


def test_drawdowns_with_equal_times(spark):
    """Drops by brute force, where samples share their times and some have no value."""
    import random

    from watchtide.operators.detectors import drawdowns

    r, at = random.Random(4), datetime(2024, 1, 1)
    rule = {"fast_minutes": 10, "slow_minutes": 60, "velocity_minutes": 2}
    data = [(i, at + timedelta(minutes=r.randrange(400)), r.choice("pq"), r.choice([None, -1.0, 0.0, *(float(x) for x in range(1, 9))])) for i in range(900)]
    plan = drawdowns(spark.createDataFrame(data, "event_id int, observed_at timestamp, protocol_id string, tvl_usd double"), rule, ("protocol_id",))
    assert "Window" not in plan._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]  # no frame that slides
    for x in plan.collect():
        for name in ("fast", "slow", "velocity"):
            near = [v for _, t, p, v in data if p == x["protocol_id"] and v is not None and x["observed_at"] - timedelta(minutes=rule[f"{name}_minutes"]) <= t <= x["observed_at"]]
            peak = max(near, default=0.0)
            want = 0.0 if peak <= 0 else None if x["tvl_usd"] is None else (peak - x["tvl_usd"]) / peak * 100
            assert x[f"{name}_drop"] == want


def test_configs_are_spread_and_of_the_rows(spark):
    """Many configurations are read by many tasks; those of tenants without rows aren't joined."""
    from watchtide.sources import configs

    rows = spark.createDataFrame([(f"t{i}", "[]") for i in range(50)], "tenant_id string, config string").coalesce(1)
    assert configs.spread(rows, a_task=10).rdd.getNumPartitions() == 5 and configs.spread(rows, a_task=50).rdd.getNumPartitions() == 1
    some = spark.createDataFrame([("t3",), ("t3",), ("t7",), ("x",), (None,)], "tenant_id string")
    assert sorted(r[0] for r in configs.of_tenants(rows, some, some).collect()) == ["t3", "t7"]


def test_exposure_totals_meet_sums(spark):
    """Totals come from sums of positions and are those of the single rows."""
    alerts = spark.createDataFrame([("a", "t", "high", "market", "X", 0.9, 50.0), ("b", "t", "low", "market", "X", 0.0, 400.0), ("c", "t", "low", "market", "Y", 1.0, 1.0), ("d", "t", "low", "other", "X", 1.0, 1.0)], "alert_id string, tenant_id string, severity string, subject_type string, asset_symbol string, price double, divergence double")
    positions = spark.createDataFrame([("t", "X", float(i), None if i == 3 else i * 2.0, i % 4 > 0) for i in range(40)], "tenant_id string, asset_symbol string, quantity double, valuation_usd double, enabled boolean")
    got = {r["alert_id"]: r for r in lifecycle.exposure_totals(alerts, positions).collect()}
    want = {r["alert_id"]: r for r in lifecycle.exposure(alerts, positions).groupBy("alert_id").agg(F.count("*").alias("entities"), F.sum("capital").alias("capital"), F.sum("savings").alias("savings")).collect()}
    assert set(got) == set(want) == {"a", "b"}
    assert all(got[k]["entities"] == w["entities"] and abs(got[k]["capital"] - w["capital"]) < 1e-6 and abs(got[k]["savings"] - w["savings"]) < 1e-6 for k, w in want.items())


def test_rules_with_the_same_tests(spark):
    """Many rules of few tests: the first of each is tried, all are counted, and each broken one has its row."""
    from watchtide.operators.rules import first_matches

    tests = "array<struct<attribute:string,op:string,value:string>>"
    rules = spark.createDataFrame([("t", 1000 - i, f"r{i}", "low", [("x", ">=", str(i % 3))] if i % 5 else [("x", "~", "1")]) for i in range(100)], f"tenant_id string, rule_order long, rule_id string, severity string, tests {tests}")
    events = spark.createDataFrame([("t", 1, {"x": "1"}), ("t", 2, {"x": "no"})], "tenant_id string, event_id long, attributes map<string,string>")
    for block in (1, 100_000):
        got = first_matches(events, rules, block).collect()
        assert [(r["rule_id"], r["error"]) for r in got if r["event_id"] == 1] == [("r99", None)]
        assert [(r["rule_id"], r["error"], r["n_rules"]) for r in got if r["event_id"] == 2] == [("r99", "x is not a number", 80)]
        assert sorted(int(r["rule_id"][1:]) for r in got if r["event_id"] is None) == list(range(0, 100, 5))


def test_pairs_of_a_busy_key_are_shared_out(spark):
    """All pairs of one tenant and asset come, once each and with the alert's own columns, and from many tasks."""
    alerts = spark.range(900).select(F.concat(F.lit("al-"), "id").alias("alert_id"), F.lit("t").alias("tenant_id"), F.when(F.col("id") % 7 == 0, "critical").otherwise("low").alias("severity"), F.lit("market").alias("subject_type"), F.lit("A").alias("asset_symbol"), F.when(F.col("id") % 3 > 0, F.col("id") % 3 / 2.0).alias("price"), F.when(F.col("id") != 5, (F.col("id") % 300).cast("double")).alias("divergence"), F.col("id").alias("nth"))
    positions = spark.range(50).select(F.concat(F.lit("e-"), "id").alias("entity_id"), F.lit("t").alias("tenant_id"), F.lit("A").alias("asset_symbol"), (F.col("id") * 1.25).alias("quantity"), (F.col("id") * 2.0).alias("valuation_usd"), F.lit(True).alias("enabled"))
    got = lifecycle.exposure(alerts, positions, a_share=2_000)
    assert "price" in got.columns and "nth" in got.columns
    rows = got.select("alert_id", "nth", "entity_id", "capital", "savings", "slippage", "liquidity", F.expr("xxhash64(alert_id)").alias("h")).collect()
    want = {}
    for i in range(900):
        for p in range(50):
            capital = p * 1.25 * (i % 3 / 2.0) if i % 3 else p * 2.0
            want[f"al-{i}", f"e-{p}"] = (i, capital, capital * max(i % 300 / 100, 0.0) if i != 5 else 0.0, "at_risk" if i % 7 == 0 else "degraded")
    assert len(rows) == len(want)
    assert {(r["alert_id"], r["entity_id"]): (r["nth"], r["capital"], r["savings"], r["liquidity"]) for r in rows} == want
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 10 and max(t["count"] for t in tasks) < len(want) / 2


def test_shares_copy_neither_side_for_each(spark):
    """A key of 300 shares: a position goes to a column of them, and alerts that are alike are a few rows however many alerts the key has (F1)."""
    alerts = spark.range(3_000).select(F.concat(F.lit("al-"), "id").alias("alert_id"), F.lit("t").alias("tenant_id"), F.when(F.col("id") % 2 == 0, "low").alias("severity"), F.lit("market").alias("subject_type"), F.lit("A").alias("asset_symbol"), F.lit(1.0).alias("price"), F.when(F.col("id") % 3 > 0, 5.0).alias("divergence"))
    positions = spark.range(200).select(F.concat(F.lit("e-"), "id").alias("entity_id"), F.lit("t").alias("tenant_id"), F.lit("A").alias("asset_symbol"), F.col("id").cast("double").alias("quantity"), F.lit(1.0).alias("valuation_usd"), F.lit(True).alias("enabled"))
    packed, dealt = lifecycle.in_shares(alerts, positions, 2_000)
    assert packed.select("severity", "divergence", "__own").distinct().count() <= 8 and packed.count() <= 40
    assert dealt.select("entity_id").distinct().count() == 200 and dealt.count() <= 200 * 60
    got = lifecycle.exposure(alerts, positions, a_share=2_000)
    assert got.columns[:2] == ["tenant_id", "asset_symbol"] and got.select("alert_id", "entity_id").distinct().count() == got.count() == 600_000
    assert lifecycle.exposure(alerts.limit(0), positions).count() == lifecycle.exposure(alerts, positions.limit(0)).count() == 0
