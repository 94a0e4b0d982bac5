"""Queries that run as streams over the tables, and readers and writers of files made from them.

A stream's result must be that of its batch form, so both have the same SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lifecycle import feature_vectors
from ..sources import scans, tables
from ..sources.configs import tvl_rules
from ..sources.shared import run_to_end, shared_folder, written
from ..streaming import state, twins
from .chain import _FINALITY, DEPTHS
from .detect import _BREACHES, _PEG_SQL, evaluations_of, flash_of_tenants
from .fixtures import FIXTURES
from .registry import ORACLES, query, view
from .tables import enabled


def _stream(spark, sf_dir, name):
    """A fixture view over the events as a stream."""
    events = scans.read_events(spark, f"{sf_dir}/events.parquet")
    sql = FIXTURES[name].replace("FROM events", "FROM {events}")
    return spark.sql(sql, events=events)


@query("a2_topic", "SELECT event_id, event_type, round(value, 6) AS value FROM events")
def topic(spark, sf_dir):
    """A topic kept as files, read to its end with offsets in the checkpoint."""
    got = run_to_end(scans.read_events(spark, f"{sf_dir}/events.parquet"), "topic")
    return got.select("event_id", "event_type", F.round("value", 6).alias("value"))


@query("s_k6_dedupe_stream", "SELECT event_id FROM quotes")
def dedupe_stream(spark, sf_dir):
    twice = _stream(spark, sf_dir, "quotes").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return run_to_end(twins.deduped(twice, ["event_id"], late="60 days"), "dedupe").select("event_id")


@query("s_k4_flash_stream", ORACLES["k4_flash_loans"])
def flash_stream(spark, sf_dir):
    return run_to_end(twins.flash_detections(_stream(spark, sf_dir, "flash_events"), flash_of_tenants(spark, sf_dir)), "flash").select("event_id", "rule_id")


@query("s_e3_fx_stream", """WITH rates AS (SELECT observed_at, price AS rate FROM fx_quotes WHERE market_key = 'USDT/USD' AND quote_asset = 'USD')
SELECT q.event_id, round(price * rate, 6) AS price_usd FROM fx_quotes q ASOF JOIN rates r ON q.observed_at >= r.observed_at WHERE quote_asset = 'USDT' AND r.observed_at >= q.observed_at - INTERVAL 6 HOUR""")
def fx_stream(spark, sf_dir):
    """Quotes in USDT with the newest rate of the last hours: a lookup in stretches of time that two streams share, then the newest of each quote's rates."""
    quotes = [spark.sql(FIXTURES["fx_quotes"].replace("FROM quotes", "FROM {q}"), q=_stream(spark, sf_dir, "quotes")) for _ in range(2)]
    rates = quotes[1].where("market_key = 'USDT/USD' AND quote_asset = 'USD'")
    found = run_to_end(twins.usd_candidates(quotes[0], rates, 6 * 3600, late="60 days"), "fx")
    return found.groupBy("event_id").agg(F.round(F.max_by(F.col("price") * F.col("rate"), F.struct("rate_at", "rate")), 6).alias("price_usd"))


@query("s_k2_drawdown_stream", f"WITH {_BREACHES} SELECT event_id, rule_id, subject_key, round(fast_drop, 6) AS fast_drop, round(slow_drop, 6) AS slow_drop, round(velocity_drop, 6) AS velocity_drop FROM k")
def drawdown_stream(spark, sf_dir):
    """Breaches of the tenants' drawdown rules over a stream; the state of a subject is the samples that can still be peaks."""
    state.with_rocksdb(spark)
    got = run_to_end(state.drawdown_breaches(_stream(spark, sf_dir, "tvl_samples"), tvl_rules(enabled(spark, sf_dir, "tvl_drop", "tvl_samples"))), "drawdown")
    return got.select("event_id", "rule_id", "subject_key", *(F.round(f"{w}_drop", 6).alias(f"{w}_drop") for w in ("fast", "slow", "velocity")))


@query("s_k7_finality_stream", _FINALITY)
def finality_stream(spark, sf_dir):
    """Rows as in ``k7_finality``, with blocks and keys as maps in the state store."""
    state.with_rocksdb(spark)
    return run_to_end(state.finality(_stream(spark, sf_dir, "chain_events").drop("observed_at"), DEPTHS), "finality").withColumn("orphaned_from", F.col("orphaned_from").cast("long"))


@query("s_k1_peg_stream", _PEG_SQL)
def peg_stream(spark, sf_dir):
    """The hysteresis of the peg over a stream of evaluations, with one value of state for each market."""
    state.with_rocksdb(spark)
    rows = written(evaluations_of(spark, sf_dir), "evaluations")
    stream = spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rpartition("/")[0])
    return run_to_end(state.peg_transitions(stream), "peg").withColumn("divergence", F.round("divergence", 6))


@query("s_f7_activity_stream", """WITH w AS (SELECT source_id, market_key, time_bucket(INTERVAL 1 DAY, observed_at) AS day, count(*) AS n, max(observed_at) AS last FROM quotes GROUP BY ALL)
SELECT source_id, market_key, epoch_ms(day) AS start_ms, CAST(n AS BIGINT) AS n, epoch_us(last) AS last_us FROM w WHERE day + INTERVAL 1 DAY <= (SELECT max(observed_at) FROM quotes)""")
def activity_stream(spark, sf_dir):
    """Activity by day, given out when the watermark has passed the day."""
    got = run_to_end(twins.activity(_stream(spark, sf_dir, "quotes"), ["source_id", "market_key"], late="0 seconds", width="1 day"), "activity")
    return got.select("source_id", "market_key", F.unix_millis("start").alias("start_ms"), "n", F.unix_micros("last").alias("last_us"))


#: Scenario files that one task writes at most, about.
SCENARIOS_A_TASK = 200


@query("a6_scenarios", "SELECT 'sc-' || s_suppkey AS scenario_id, CASE WHEN s_suppkey % 9 = 3 THEN 'missing:chain' END AS reject, CASE WHEN s_suppkey % 9 <> 3 THEN 'case ' || s_name END AS name FROM supplier")
def scenarios(spark, sf_dir):
    """Scenario files, one for each supplier; some lack a required key."""
    path = shared_folder(spark, "scenarios")
    k = F.col("s_suppkey")
    rows = view(spark, sf_dir, "supplier").select(F.concat(F.lit("sc-"), k.cast("string")).alias("scenario_id"), F.concat(F.lit("case "), "s_name").alias("name"), F.when(k % 9 != 3, "base").alias("chain"), F.lit("depeg").alias("incident_class"), F.array().cast("array<string>").alias("steps"))
    parts = -(-max(rows.count(), 1) // SCENARIOS_A_TASK)  # by their size, small rows would be one part, and one task would write all files
    rows.repartition(parts, "scenario_id").write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").json(path)
    return scans.read_scenarios(spark, path).select("scenario_id", "reject", F.get_json_object("scenario", "$.name").alias("name"))


@query("a7_curated", "SELECT doc_id AS record_id, lang FROM documents")
def curated(spark, sf_dir):
    """Curated records: files that hold arrays of objects."""
    path = shared_folder(spark, "curated")
    rows = view(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 8).alias("k"), F.floor(F.col("doc_id") / 4000).alias("file")).agg(F.to_json(F.collect_list(F.struct(F.col("doc_id").alias("record_id"), "lang"))).alias("value"))
    rows.repartition("k", "file").write.partitionBy("k", "file").text(path)
    return scans.read_curated(spark, path, "record_id long, lang string")


@query("b7_archive", "SELECT tenant_id, CAST(count(*) AS BIGINT) AS archived, CAST(count(*) AS BIGINT) AS listed FROM detections GROUP BY tenant_id")
def archive(spark, sf_dir):
    """Archive of events with its manifest, read again: rows found and rows listed."""
    path = shared_folder(spark, "archive")
    d = view(spark, sf_dir, "detections").select("tenant_id", "detection_id", "severity", "pattern_id")
    tables.write_archive(d, tables.export_manifest(d, ["tenant_id"], ["detection_id", "severity"]), path, ["tenant_id"])
    found = spark.read.schema("detection_id string, tenant_id string").json(f"{path}/events").groupBy("tenant_id").agg(F.count("*").alias("archived"))
    return found.join(spark.read.schema("tenant_id string, row_count long").json(f"{path}/manifest"), "tenant_id").select("tenant_id", "archived", F.col("row_count").alias("listed"))


@query("l3_features", "SELECT detection_id, round(risk_score, 6) AS risk, CAST(n_rules AS DOUBLE) AS rules, pattern_id AS pattern, CAST(2 AS INTEGER) + CAST(chain_slug IS NOT NULL AS INTEGER) AS n_labels FROM detections")
def features(spark, sf_dir):
    """Feature vectors: numbers and labels as maps, without nulls (L3)."""
    v = feature_vectors(view(spark, sf_dir, "detections"), "detection_id", {"risk": "risk_score", "rules": "n_rules"}, {"pattern": "pattern_id", "chain": "chain_slug", "tx": "tx_hash"})
    return v.select("detection_id", F.round(F.col("numbers")["risk"], 6).alias("risk"), F.col("numbers")["rules"].alias("rules"), F.col("labels")["pattern"].alias("pattern"), F.size("labels").alias("n_labels"))
