"""Readers and writers that work on files."""

import json

from pyspark.sql import functions as F

from watchtide.functions.symbols import split_symbol_pair
from watchtide.operators.feeds import normalize_feed
from watchtide.plans.registry import view
from watchtide.sources import scans, tables


def test_scenarios(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text(json.dumps({"scenario_id": "s", "chain": "c", "incident_class": "depeg", "steps": []}))
    (tmp_path / "y.json").write_text('{"scenario_id": "s"}')
    (tmp_path / "z.json").write_text("{")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in scans.read_scenarios(spark, str(tmp_path)).collect()}
    assert json.loads(rows["x.json"]["scenario"])["tags"] == [] and rows["x.json"]["reject"] is None
    assert rows["y.json"]["reject"] == "missing:chain,incident_class,steps" and rows["z.json"]["reject"].startswith("unreadable")


def test_curated(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"record_id": 1, "haystack": "a"}')
    (tmp_path / "two.json").write_text('[{"record_id": 2, "haystack": "b"}, {"record_id": 3, "haystack": "c"}]')
    assert sorted(r[0] for r in scans.read_curated(spark, str(tmp_path), "record_id long, haystack string").collect()) == [1, 2, 3]


def test_archive_and_landing(spark, sf, tmp_path):
    d = view(spark, sf, "detections")
    manifest = tables.export_manifest(d, ["tenant_id"], ["detection_id"])
    tables.write_archive(d, manifest, str(tmp_path / "arch"), ["tenant_id"])
    assert spark.read.json(str(tmp_path / "arch/events")).count() == d.count()
    assert spark.read.json(str(tmp_path / "arch/manifest")).agg(F.sum("row_count")).first()[0] == d.count()
    rows = tables.landed(d.select(F.col("tx_hash").alias("idempotency_key"), F.lit("dex_api").alias("source_type"), F.col("created_at").alias("observed_at"), F.col("arrival").alias("event_id")))
    tables.write_landed(rows, str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw/raw_dex")).count() == rows.count()


def test_raw_feed_streams(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "e"))
    q = scans.read_raw_feed(spark, str(tmp_path / "e"), streaming=True).writeStream.format("memory").queryName("feed").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("feed").count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_unknown_parser_and_bad_payload_stay(spark):
    raw = spark.createDataFrame([("nope", "{}"), ("okx_tickers_v5", "not json"), ("okx_tickers_v5", None)], "parser_name string, payload string")
    assert [r[0] for r in normalize_feed(raw, ("okx_tickers_v5",)).select("parse_error").collect()] == ["unsupported_parser:nope", "missing_okx_inst_id", "missing_okx_inst_id"]


def test_pairs(spark):
    rows = spark.createDataFrame([("usdc-usdt",), ("A/B/C",), ("usd",), ("",), (None,)], "s string").select(split_symbol_pair(F.col("s")).alias("p")).collect()
    assert [tuple(r["p"]) if r["p"] else None for r in rows] == [("USDC", "USDT"), ("A", "B"), None, None, None]


def test_scenario_files_come_from_many_tasks(spark, sf, monkeypatch):
    """Files are written side by side, and each once."""
    from watchtide.plans import streams

    kind = type(spark.range(1))
    parts, plain = [], kind.repartition

    def noted(df, n, *by):
        got = plain(df, n, *by)
        parts.append(got.groupBy(F.spark_partition_id()).count().count())
        return got

    monkeypatch.setattr(streams, "SCENARIOS_A_TASK", 2, raising=False)
    monkeypatch.setattr(kind, "repartition", noted)
    got = streams.scenarios(spark, sf)
    assert parts[0] > 2 and got.count() == got.select("scenario_id").distinct().count() == spark.read.parquet(f"{sf}/supplier.parquet").count()


def test_last_valid_policy_counts_without_a_shuffle(spark):
    """Of several policies for a market the last valid one counts; parts of configurations are never so many that texts are sorted."""
    from watchtide.sources import configs

    items = [{"market_key": m, "min_sources": n, **more} for m, n, more in (("B/USD", 1, {}), ("A/USD", 2, {}), ("B/USD", 3, {}), ("B/USD", 4, {"quorum_pct": 2}), (" ", 5, {}), ("A/USD", 6, {"peg_target": 0}))]
    rows = spark.createDataFrame([("t", json.dumps(items)), ("u", json.dumps(items[:2])), ("v", "oops"), ("w", "[]"), ("x", None)], "tenant_id string, config string")
    got = configs.peg_policies(rows)
    assert sorted((r["tenant_id"], r["market_key"], r["min_sources"]) for r in got.collect()) == [("t", "A/USD", 2), ("t", "B/USD", 3), ("u", "A/USD", 2), ("u", "B/USD", 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Aggregate" not in plan
    assert configs.spread(spark.range(450).selectExpr("concat('t', id) AS tenant_id"), a_task=1).rdd.getNumPartitions() == 200


def test_payloads_are_parsed_once(spark):
    """Top-level fields are read together, and odd payloads give what single reads of their paths give."""
    texts = ['{"paused":1,"paused":0,"protocol":"A"}', '{"paused":null,"paused":"Paused","protocol":null,"protocol_id":" B "}', '{"protocol":"C","paused":true', '{"protocol":"D","is_paused":2} x', '[{"paused":1}]', None, "", '{"protocol":{"a": 1},"paused":1.0}', '{"chainId":"0x1","protocol":"E","paused":"0"}']
    raw = spark.createDataFrame([(i, "protocol_pause_v1", t) for i, t in enumerate(texts)], "row_id int, parser_name string, payload string").withColumn("event_type", F.lit("protocol_pause"))
    got = normalize_feed(raw, ("protocol_pause_v1",))
    seen = [tuple(r) for r in got.orderBy("row_id").select("normalized.protocol_id", "normalized.paused", "normalized.chain_slug", "event_type", "parse_error").collect()]
    assert seen[0] == ("a", "true", "unknown", "protocol_pause", None) and seen[1] == ("b", "true", "unknown", "protocol_pause", None)
    assert [x[4] for x in seen[2:]] == ["missing_protocol_id", None, "missing_protocol_id", "missing_protocol_id", "missing_protocol_id", "missing_pause_state", None]
    assert seen[3][:4] == ("d", "true", "unknown", "protocol_pause") and seen[8][:4] == ("e", "false", "ethereum", "protocol_unpause")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("$.paused") <= 1
    assert [c for c in got.columns if c.startswith("__")] == []
