"""Behaviour of the detectors and folds, and batch against stream."""

import random

import pytest
from pyspark.sql import functions as F

from watchtide.operators import chain, detectors, drawdown
from watchtide.operators.lifecycle import matched_records
from watchtide.operators.quotes import consensus
from watchtide.plans import detect as plans
from watchtide.plans.registry import view
from watchtide.streaming import twins

POLICY = {"sustained_window_ms": 0, "cooldown_sec": 0, "deescalation_blocks": 5, "resolution_blocks": 30, "isolated_floor_pct": 0.5}


def test_deescalates_on_the_fifth_evaluation():
    s = detectors.peg_start()
    assert detectors.peg_step(s, 0, True, 4, 1.2, True, POLICY) == ("trigger", 4)
    assert [detectors.peg_step(s, i, True, 3, 0.6, True, POLICY) for i in range(1, 6)] == [None] * 4 + [("deescalate", 3)]


def test_resolves_on_the_thirtieth_evaluation():
    s = detectors.peg_start()
    detectors.peg_step(s, 0, True, 3, 0.6, True, POLICY)
    assert [detectors.peg_step(s, i, False, 0, 0.02, True, POLICY) for i in range(1, 31)] == [None] * 29 + [("resolve", 3)]


def test_no_eligible_source_resets_the_state():
    s = detectors.peg_start()
    detectors.peg_step(s, 0, True, 3, 0.6, True, POLICY)
    detectors.peg_step(s, 1, False, 0, 0.0, False, POLICY)
    assert s == detectors.peg_start()


def test_oracle_confirmation_gates_the_breach(spark):
    rows = spark.sql("SELECT 1L AS event_id, TIMESTAMP '2024-01-01' AS observed_at, 't' AS tenant_id, 'a' AS source_id, 'cex_websocket' AS source_type, 'USDC/USD' AS market_key, 0.99D AS price")
    policy = {"min_sources": 1, "quorum_pct": 0.0}
    assert detectors.peg_evaluations(rows, policy | {"oracle_confirmation": True}).first()["breach"] is False
    assert detectors.peg_evaluations(rows, policy).first()["breach"] is True


def _samples(spark, values):
    return spark.createDataFrame([(i, f"2024-01-01 00:0{i}:00", "t", "p", "base", v) for i, v in enumerate(values)], "event_id long, observed_at string, tenant_id string, protocol_id string, chain_slug string, tvl_usd double").withColumn("observed_at", F.col("observed_at").cast("timestamp"))


RULE = {"fast_drop_pct": 20.0, "slow_drop_pct": 35.0, "velocity_critical_pct": 15.0, "fast_minutes": 10, "slow_minutes": 60, "velocity_minutes": 2, "concurrent_minutes": 5, "min_tvl_floor_usd": 1e6}


def _detected(spark, rows, rule):
    """By one rule for each of two protocols."""
    fields = rule | {"tenant_id": "t", "rule_order": 0, "rule_id": "r", "chain_slug": "base", "contagion_enabled": rule.get("contagion_enabled", True)}
    rules = spark.createDataFrame([fields | {"protocol_id": p} for p in ("p", "q")]).withColumn("market_id", F.lit(None).cast("string"))
    return drawdown.detections(rows, rules)


def test_velocity_is_critical(spark):
    row = _detected(spark, _samples(spark, [100e6, 80e6]), RULE).first()
    assert (row["severity"], row["transition"], row["context"]) == ("critical", "trigger", "isolated")


def test_floor_hides_a_crash(spark):
    assert _detected(spark, _samples(spark, [6e6, 4e6]), RULE | {"min_tvl_floor_usd": 5e6}).count() == 0


def test_drop_is_the_largest_of_the_windows(spark):
    """Slowly, then fast: the fast branch breaches, the drop is that of the longest window; and two protocols are systemic."""
    rows = _samples(spark, [100e6, 99e6, 98e6, 60e6])
    got = _detected(spark, rows, RULE | {"velocity_critical_pct": 90.0, "fast_minutes": 1, "slow_drop_pct": 90.0}).first()
    assert (got["severity"], round(got["drop"], 6)) == ("high", 40.0)
    both = rows.unionByName(rows.withColumn("protocol_id", F.lit("q")).withColumn("event_id", F.col("event_id") + 10))
    contexts = lambda rule: {(r["protocol_id"], r["context"]) for r in _detected(spark, both, rule).collect()}
    assert contexts(RULE) == {("p", "isolated"), ("q", "systemic")}  # the second to breach
    assert contexts(RULE | {"contagion_enabled": False}) == {("p", "isolated"), ("q", "isolated")}


def _quotes(spark, rows):
    return spark.createDataFrame([(i, f"2024-01-01 00:00:{i:02d}", "t", s, k, m, p) for i, (s, k, m, p) in enumerate(rows)], "event_id long, observed_at string, tenant_id string, source_id string, source_type string, market_key string, price double").withColumn("observed_at", F.col("observed_at").cast("timestamp"))


def test_two_diverging_markets_are_systemic(spark):
    """The systemic floor and bands take the place of the isolated ones once two dollar markets diverge."""
    rows = _quotes(spark, [("a", "cex_websocket", "USDC/USD", 0.998), ("a", "cex_websocket", "DAI/USD", 0.997), ("a", "cex_websocket", "EUR/CHF", 0.5), ("a", "cex_websocket", "USDC/USD", 0.9998)])
    policy = {"min_sources": 1, "quorum_pct": 0.0, "stale_timeout_ms": 60_000}
    got = lambda p: [(r["context"], r["breach"], r["rank"]) for r in detectors.peg_evaluations(rows, policy | p, with_markets=True).orderBy("event_id").collect()]
    assert got({}) == [("isolated", False, 0), ("isolated", False, 0), ("isolated", True, 5), ("isolated", False, 0)]
    assert got({"contagion_detection": True}) == [("isolated", False, 0), ("systemic", True, 5), ("systemic", True, 5), ("systemic", True, 3)]


def test_confidence_parts(spark):
    rows = _quotes(spark, [("a", "cex_websocket", "USDC/USD", 0.99), ("b", "oracle_api", "USDC/USD", 0.98), ("c", "dex_api", "USDC/USD", 1.01)])
    policy = {"min_sources": 1, "quorum_pct": 0.0, "stale_timeout_ms": 60_000}
    last = lambda p: consensus(rows, policy | p).orderBy(F.desc("event_id")).first()
    share = 200 / 3
    assert last({})["confidence"] == pytest.approx(share)
    assert last({"oracle_confirmation": True})["confidence"] == pytest.approx((share * 0.7 + 100 * 0.2) / 0.9)
    assert last({"oracle_confirmation": True, "volume_confirmation": True})["confidence"] == pytest.approx(share * 0.7 + 100 * 0.2 + 50 * 0.1)


def test_a_broken_pattern_is_left_out(spark):
    class Good:
        name = "good"

        def detect(self, events, rules):
            return events.select("event_id")

    class Broken(Good):
        name = "broken"

        def detect(self, events, rules):
            return events.select("no_such_column")

    rows, failed = _samples(spark, [1.0, 2.0]), []
    got = detectors.detect_all([(Broken(), rows, rows), (Good(), rows, rows)], failed)
    assert got.count() == 2 and [f[0] for f in failed] == ["broken"]
    with pytest.raises(Exception, match="no_such_column"):
        detectors.detect_all([(Broken(), rows, rows)])


def test_tokens_inside_words(spark):
    """A token may stand anywhere in a text; one of several words must be there as it is."""
    scenarios = spark.createDataFrame([("s1", ["pool", "ab"]), ("s2", ["red bolt", "--"]), ("s3", [" ", ""])], "scenario_id string, tokens array<string>")
    records = spark.createDataFrame([(1, "LiquidityPools"), (2, "a red\nbolt"), (3, "hundred bolts"), (4, "x--y"), (5, None), (6, "")], "record_id long, haystack string")
    got = sorted(map(tuple, matched_records(scenarios, records).collect()))
    assert got == [("s1", 1), ("s2", 3), ("s2", 4)]


def test_tokens_that_others_make_needless(spark, monkeypatch):
    """A token that holds another one of its scenario isn't searched for, and finds no less."""
    from watchtide.operators import lifecycle

    kept, plain = {}, lifecycle.written

    def noted(df, name):
        kept[name] = plain(df, name)
        return kept[name]

    monkeypatch.setattr(lifecycle, "written", noted)
    scenarios = spark.createDataFrame([("s1", ["large ring", "large", "ring", None]), ("s2", ["hot\tbolt", "bolt x", "\n", "x"]), ("s3", ["is a", "no such"])], "scenario_id string, tokens array<string>")
    records = spark.createDataFrame([(1, "A Large  RING"), (2, "rings"), (3, "hot\tbolts"), (4, "hot bolt"), (5, "this as"), (6, "this a"), (7, "ax")], "record_id long, haystack string")
    got = sorted(map(tuple, matched_records(scenarios, records).collect()))
    assert got == [("s1", 1), ("s1", 2), ("s2", 3), ("s2", 7), ("s3", 5), ("s3", 6)]
    assert {r["token"] for r in kept["searches"].collect()} <= {"hot\tbolt", "is a", "no such"} and kept["held"].count() < 12


def _fold(events, depth):
    return chain.finality_step(chain.new_state(), "c", [(*e, depth) for e in events])


def test_third_block_confirms_the_first():
    got = _fold([(1, 100, "a", "k1"), (2, 101, "b", "k2"), (3, 102, "c", "k3")], 2)
    assert [x[2] for x in got if x[3] == "confirmed"] == ["k1"]


def test_second_hash_retracts():
    got = _fold([(1, 100, "a", "k1"), (2, 101, "b", "k2"), (3, 101, "x", "k3")], 5)
    assert [(x[2], x[3]) for x in got[2:]] == [(None, "reorg"), ("k2", "retracted"), ("k3", "provisional")]


def _model(events, depth):
    """Finality, plainly: every block is looked at after every event."""
    blocks, status, head, out = {}, {}, 0, []
    for e, b, h, k in events:
        if b in blocks and h is not None and blocks[b][0] is not None and blocks[b][0] != h:
            out.append((e, None, "reorg"))
            for x in sorted(x for x in blocks if x >= b):
                for y in blocks.pop(x)[1]:
                    if status[y] != "retracted":
                        status[y] = "retracted"
                        out.append((e, y, "retracted"))
            head = max(blocks, default=0)
        blocks.setdefault(b, [h, []])
        blocks[b][0] = blocks[b][0] or h
        blocks[b][1].append(k)
        head = max(head, b)
        if k not in status:
            status[k] = "provisional"
            out.append((e, k, "provisional"))
        for x in sorted(blocks):
            if x <= max(0, head - depth):
                for y in blocks[x][1]:
                    if status[y] == "provisional":
                        status[y] = "confirmed"
                        out.append((e, y, "confirmed"))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_finality_agrees_with_the_model(seed):
    r = random.Random(seed)
    height, events = 5, []
    for e in range(120):
        height = max(1, height + r.choice([0, 1, 1, -1, -2, 2]))
        events.append((e, height, r.choice(["a", "a", "a", "b", None]), f"k{r.randrange(90)}" if r.random() < 0.2 else f"e{e}"))
    assert sorted((x[0], str(x[1]), x[2]) for x in _model(events, 2)) == sorted((x[1], str(x[2]), x[3]) for x in _fold(events, 2))


def _streamed(spark, df, build, tmp_path, columns):
    path = str(tmp_path / "in")
    df.repartition(1).write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    name = f"s{abs(hash(path))}"
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return sorted(map(tuple, spark.table(name).select(*columns).collect()), key=str)


def test_flash_stream_equals_batch(spark, sf, tmp_path):
    rows, rules = view(spark, sf, "flash_events"), plans.flash_of_tenants(spark, sf)
    want = sorted(map(tuple, detectors.flash_detections(rows, rules).select("event_id", "rule_id").collect()), key=str)
    assert want and _streamed(spark, rows, lambda s: twins.flash_detections(s, rules), tmp_path, ["event_id", "rule_id"]) == want


def test_dedupe_and_activity_streams(spark, sf, tmp_path):
    rows = view(spark, sf, "quotes").unionByName(view(spark, sf, "quotes"))
    got = _streamed(spark, rows, lambda s: twins.deduped(s, ["event_id"], late="40 days"), tmp_path, ["event_id"])
    assert len(got) == view(spark, sf, "quotes").count()


def test_conditions_without_value(spark):
    """A condition that divides by zero or reads a bad number on some row isn't passed there; other rows and rules stand."""
    e = spark.createDataFrame([(1, "t", 0.0, 0.0, "7"), (2, "t", 100.0, 1.0, "x"), (3, "t", 50.0, 9.0, "x")], "event_id long, tenant_id string, loan double, profit double, label string")
    rules = [
        {"tenant_id": "t", "rule_id": "share", "severity": "high", "condition": "profit / loan >= {x}", "params": {"x": 0.1}},
        {"tenant_id": "t", "rule_id": "number", "severity": "low", "condition": "CAST(label AS INT) > 5"},
    ]
    got = detectors.rule_detections(e, rules)
    assert sorted((r["event_id"], r["rule_id"]) for r in got.collect()) == [(1, "number"), (3, "share")]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_rule_conditions_with_loans_of_zero(spark, tmp_path):
    """l2 agrees with its SQL where a loan is zero."""
    from oracle import compare

    from watchtide.plans.all import ORACLES, QUERIES

    rows = [(i, "purchase", i % 6, v) for i, v in enumerate((0.0, 12.5, 0.0, 60.0, 0.0, 3.0, 0.0, 1.0))]
    e = spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double").selectExpr("*", "timestamp_ntz'2024-01-01' AS ts")
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    compare(spark, _one_file(tmp_path, "events"), QUERIES["l2_rule_conditions"], ORACLES["l2_rule_conditions"])


def _one_file(path, table):
    """The folder with the table's only part as the table's file."""
    import shutil

    part = next((path / f"{table}.parquet").glob("part-*.parquet"))
    (path / "one").mkdir()
    shutil.copy(part, path / "one" / f"{table}.parquet")
    return str(path / "one")
