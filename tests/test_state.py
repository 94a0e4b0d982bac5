"""Streams on the state API, in several micro-batches with late rows, against the batch forms."""

import datetime
import random

from test_drawdown import rules_of
from test_finality import SCHEMA as CHAIN
from test_finality import folded, random_chain
from test_hysteresis import SCHEMA as PEG
from test_hysteresis import SECOND, one_by_one, random_market

from watchtide.operators import drawdown
from watchtide.streaming import state


def streamed(spark, batches, schema, build, tmp_path):
    """One file for each micro-batch; the stream is stopped after each and started again."""
    state.with_rocksdb(spark)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = build(stream)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None, i
    return [tuple(x) for x in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()]


def test_peg_in_micro_batches(spark, tmp_path):
    r = random.Random(2)
    rows = [x for k in range(4) for x in random_market(r, f"m{k}", 150)]
    cut = [[x for x in rows if x[2] // 50 == i] for i in range(3)]
    assert sorted(streamed(spark, cut, PEG, state.peg_transitions, tmp_path)) == one_by_one(rows)


def test_peg_with_late_rows(spark, tmp_path):
    """Rows come out of order within the watermark, and are taken in order; what is later than that is dropped."""
    r = random.Random(8)
    rows = random_market(r, "m", 240)
    last = max(x[3] for x in rows)
    mixed = sorted(rows, key=lambda x: x[3] + r.randint(0, 300) * SECOND)
    cut = [mixed[i : i + 60] for i in range(0, 240, 60)]
    cut.append([("t", "m", 9999, last + 10_000 * SECOND, False, 0, 0.1, True, *rows[0][8:])])  # lets the watermark pass all
    cut.append([("t", "m", 10_000, 0, True, 5, 9.0, True, *rows[0][8:])])  # far too late
    got = streamed(spark, cut, PEG, lambda s: state.peg_transitions(s, late="600 seconds"), tmp_path)
    assert sorted(got) == one_by_one(rows) and got


def test_finality_in_micro_batches(spark, tmp_path):
    r = random.Random(4)
    rows = random_chain(r, "a", 150, 0, 0.05) + random_chain(r, "b", 150, 0, 0.2)
    cut = [[x for x in rows if x[1] // 50 == i] for i in range(3)]
    got = streamed(spark, cut, CHAIN, lambda s: state.finality(s, {"a": 2}, horizon=None), tmp_path)
    assert sorted(str((*x[:4], None if x[4] is None else int(x[4]))) for x in got) == folded(rows, {"a": 2})


def test_drawdown_in_micro_batches(spark, tmp_path):
    """Late rows within the watermark too: breaches and drops as the batch form finds them."""
    r, schema = random.Random(3), "event_id long, observed_at timestamp, tenant_id string, protocol_id string, chain_slug string, market_id string, tvl_usd double"
    rules = rules_of(spark, {"t": {"rules": [{"rule_id": f"r{k}", "protocol_id": r.choice("pq"), "chain_slug": "base", "market_id": r.choice([None, "m"]), "fast_drop_pct": 5, "fast_window_minutes": r.randint(1, 40), "slow_window_minutes": r.randint(1, 90), "min_tvl_floor_usd": 40} for k in range(9)]}})
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=r.randint(0, 9000)), "t", r.choice("pq"), "BASE", r.choice([None, "M"]), r.choice([None, 0.0] + [r.uniform(30, 100)] * 20)) for i in range(240)]
    want = sorted((x["subject_key"], x["event_id"], x["rule_id"], round(x["fast_drop"], 9), round(x["slow_drop"], 9)) for x in drawdown.detections(spark.createDataFrame(rows, schema), rules).collect())
    mixed = sorted(rows, key=lambda x: x[1] + datetime.timedelta(seconds=r.randint(0, 300)))
    end = start + datetime.timedelta(days=9)
    cut = [*(mixed[i : i + 80] for i in range(0, 240, 80)), [(999, end, "t", "p", "base", None, 1.0), (998, end, "t", "q", "base", None, 1.0)]]
    got = streamed(spark, cut, schema, lambda s: state.drawdown_breaches(s, rules, late="600 seconds"), tmp_path)
    assert sorted((x[1], x[2], x[3], round(x[4], 9), round(x[5], 9)) for x in got if x[2] < 900) == want and len(want) > 50
