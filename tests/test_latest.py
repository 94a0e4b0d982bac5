"""Latest quotes of any source, and of any market."""

import random

import pytest
from pyspark.sql import functions as F

from watchtide.operators import latest, quotes

SCHEMA = "event_id long, observed_at timestamp_ntz, tenant_id string, market_key string, source_id string, source_type string, price double"


def quote_rows(r, n, sources, markets):
    return [(i, r.randint(0, 3600), r.choice("ab"), r.choice(markets), r.choice(sources), r.choice(["cex_websocket", "dex_api", "oracle_api"]), r.choice([None, 0.0, round(r.uniform(0.9, 1.1), 3)] + [round(r.uniform(0.97, 1.03), 3)] * 9)) for i in range(n)]


def frame(spark, rows):
    text = SCHEMA.replace("observed_at timestamp_ntz", "sec long")
    return spark.createDataFrame(rows, text).withColumn("observed_at", F.timestamp_micros(F.col("sec") * 1_000_000).cast("timestamp_ntz")).drop("sec")


@pytest.mark.parametrize("batch", [7, 10_000])
def test_latest_of_each(spark, batch, monkeypatch):
    r = random.Random(batch)
    monkeypatch.setattr(latest, "CELLS", 1 << 13)
    rows = quote_rows(r, 900, [f"s{i}" for i in range(40)] + [None], ["m/USD", "n/USD"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = latest.latest_of_each(frame(spark, rows), ("tenant_id", "market_key"), F.col("source_id"), F.struct("event_id", "price"), "seen", 600_000, F.col("event_id") % 3 != 0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    place = {x[0]: (x[1], x[0]) for x in rows}
    for x in got:
        if x["event_id"] % 3 == 0:
            assert x["seen"] is None
            continue
        best = {}
        for q in rows:
            if (q[2], q[3]) == (x["tenant_id"], x["market_key"]) and q[4] is not None and place[q[0]] <= place[x["event_id"]]:
                best[q[4]] = max(best.get(q[4], (-1, -1)), place[q[0]])
        seen = {y["event_id"] for y in x["seen"]}
        assert {i for t, i in best.values() if t >= place[x["event_id"]][0] - 600} <= seen <= {i for _, i in best.values()}


def test_five_hundred_sources_that_nobody_listed(spark):
    """Every source counts, in the consensus and in the market truth."""
    rows = [(i, i, "t", "USDC/USD", f"source {i}", "dex_api", 0.9 + i / 5000) for i in range(500)] + [(500, 500, "t", "USDC/USD", "source 3", "dex_api", 2.0)]
    df = frame(spark, rows)
    last = quotes.consensus(df, {"stale_timeout_ms": 3_600_000, "min_sources": 400}).where("event_id = 500").first()
    prices = sorted([0.9 + i / 5000 for i in range(500) if i != 3] + [2.0])
    assert last["n_sources"] == 500 and last["has_quorum"] and last["median"] == prices[249]
    truth = quotes.market_truth(df, 3600).where("event_id = 500").first()
    assert truth["truth_sources"] == 500 and truth["truth"] == (prices[249] + prices[250]) / 2


def test_markets_that_nobody_listed(spark):
    """Contagion counts all dollar markets of the tenant."""
    rows = [(i, i, "t", f"coin{i}/usd" if i % 2 else f"coin{i}/EUR", "s", "dex_api", 0.5) for i in range(60)] + [(99, 60, "u", "x/USD", "s", "dex_api", 0.5)]
    got = {x["event_id"]: x for x in quotes.consensus(frame(spark, rows), {"stale_timeout_ms": 3_600_000, "contagion_detection": True}, with_markets=True).collect()}
    assert got[59]["n_diverging"] == 30 and got[59]["context"] == "systemic" and got[99]["n_diverging"] == 1 and got[1]["context"] == "isolated"
    none = quotes.consensus(frame(spark, rows), {"stale_timeout_ms": 3_600_000}, with_markets=True)
    assert none.agg(F.max("n_diverging")).first()[0] == 0


def test_divergence_holds_until_a_quote_lapses(spark):
    """Contagion by brute force where quotes lapse between rows; quotes are sorted once for a median, and taken along only where one has lapsed."""
    r = random.Random(28)
    rows = [(i, t, who, m, s, "dex_api", p) for i, t, who, m, s, _, p in quote_rows(r, 400, ["s0", "s1", "s2", "s3"], ["m/USD", "n/usd", "o/EUR"]) if p]
    stale = {"s0": 20, "s1": 200, "s2": 0, "s3": 90}
    policy = {"stale_timeout_ms": 90_000, "overrides": {k: {"stale_timeout_ms": v * 1000, "weight": 1.0 + (k == "s1")} for k, v in stale.items()}, "contagion_detection": True, "systemic_floor_pct": 1.5}
    got = {x["event_id"]: x["n_diverging"] for x in quotes.consensus(frame(spark, rows), policy, with_markets=True).collect()}
    order = sorted(rows, key=lambda x: (x[1], x[0]))
    for k, x in enumerate(order):
        newest = {(q[3], q[4]): q for q in order[: k + 1] if q[2] == x[2] and q[3].upper().endswith("/USD")}
        n = 0
        for market in {m for m, _ in newest}:
            live = sorted((q[6], 1.0 + (s == "s1")) for (m, s), q in newest.items() if m == market and x[1] - q[1] <= stale[s])
            run, half = 0.0, sum(w for _, w in live) / 2
            for p, w in live:
                run += w
                if run >= half:
                    n += abs(p - 1) * 100 >= 1.5
                    break
        assert got[x[0]] == n
    assert quotes.weighted_median(F.col("q"))._jc.toString().count("sort") == 1
    df = spark.range(3).select(F.lit("t").alias("k"), F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("observed_at"), (F.col("id") * 10).alias("now"))
    seen = latest.latest_of_each(df, ("k",), F.lit("s"), F.struct(F.when(F.col("event_id") < 2, F.lit(15)).cast("long").alias("until"), F.col("event_id").alias("i"), F.struct("event_id").alias("more")), "seen", 60_000, None, ("now", "until", "more"))
    given = seen.withColumn("seen", F.transform("seen", lambda s: F.struct(s["i"].alias("i"), s["more"]["event_id"].alias("more"))))
    assert [[tuple(s) for s in x["seen"]] for x in given.orderBy("event_id").collect()] == [[(0, None)], [(1, None)], [(2, None)]]
    held = df.withColumn("s", F.when(F.col("event_id") == 0, "s"))
    seen = latest.latest_of_each(held, ("k",), F.col("s"), F.struct(F.lit(15).cast("long").alias("until"), F.struct("event_id").alias("more")), "seen", 60_000, None, ("now", "until", "more"))
    assert [x["seen"][0]["more"] for x in seen.orderBy("event_id").collect()] == [None, None, (0,)]
