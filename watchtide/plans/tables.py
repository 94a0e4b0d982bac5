"""Queries of the readers, writers and configuration joins."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.severity import rank
from ..sources import configs, cursors, ingest, scans, tables
from ..sources.shared import shared_folder
from ..sources.versioned import CASE_COLUMNS, VersionedTable, cases, inserts, upserts
from .registry import query, view

_EVENTS = "SELECT event_id, stream_id, user_id, round(value, 6) AS value, endpoint FROM (SELECT *, 'st-' || (user_id % 7) AS stream_id FROM events) JOIN ("
EFFECTIVE = """SELECT st.stream_id, s.source_id, s.source_type, coalesce(st.endpoint_override, s.endpoint) AS endpoint, st.parser_name, st.market_key
FROM streams st JOIN sources s ON st.source_id = s.source_id WHERE st.enabled AND s.enabled AND EXISTS (SELECT 1 FROM targets t WHERE t.stream_id = st.stream_id AND t.enabled)"""


@query("a1_raw_feed", f"{_EVENTS}{EFFECTIVE}) USING (stream_id)")
def raw_feed(spark, sf_dir):
    """Payload rows with their stream's configuration (A1)."""
    e = scans.read_raw_feed(spark, f"{sf_dir}/events.parquet").withColumn("stream_id", F.concat(F.lit("st-"), (F.col("user_id") % 7).cast("string")))
    c = configs.effective_streams(*(view(spark, sf_dir, n) for n in ("sources", "streams", "targets")))
    return e.join(c.select("stream_id", "endpoint"), "stream_id").select("event_id", "stream_id", "user_id", F.round("value", 6).alias("value"), "endpoint")


_ON = "FROM tenant_patterns t WHERE t.enabled AND EXISTS (SELECT 1 FROM patterns p WHERE p.pattern_id = t.pattern_id AND p.enabled)"
#: A tenant's market policies from their JSON texts, with defaults.
PEG_POLICIES_SQL = f"""
SELECT tenant_id, p->>'$.market_key' AS market_key, coalesce(CAST(p->>'$.peg_target' AS DOUBLE), 1.0) AS peg_target, coalesce(CAST(p->>'$.min_sources' AS BIGINT), 3) AS min_sources, coalesce(CAST(p->>'$.quorum_pct' AS DOUBLE), 0.6) AS quorum_pct,
       coalesce(CAST(p->>'$.sustained_window_ms' AS BIGINT), 60000) AS sustained_window_ms, coalesce(CAST(p->>'$.cooldown_sec' AS BIGINT), 300) AS cooldown_sec, coalesce(CAST(p->>'$.stale_timeout_ms' AS BIGINT), 30000) AS stale_timeout_ms,
       coalesce(CAST(p->>'$.deescalation_blocks' AS BIGINT), 5) AS deescalation_blocks, coalesce(CAST(p->>'$.resolution_blocks' AS BIGINT), 30) AS resolution_blocks,
       coalesce(CAST(p->>'$.isolated_floor_pct' AS DOUBLE), 0.5) AS isolated_floor_pct, coalesce(CAST(p->>'$.systemic_floor_pct' AS DOUBLE), 0.01) AS systemic_floor_pct,
       coalesce(CAST(p->>'$.severity_bands.medium' AS DOUBLE), 0.5) AS iso_medium, coalesce(CAST(p->>'$.severity_bands.high' AS DOUBLE), 1.0) AS iso_high, coalesce(CAST(p->>'$.severity_bands.critical' AS DOUBLE), 5.0) AS iso_critical,
       coalesce(CAST(p->>'$.severity_bands_systemic.medium' AS DOUBLE), 0.01) AS sys_medium, coalesce(CAST(p->>'$.severity_bands_systemic.high' AS DOUBLE), 0.25) AS sys_high, coalesce(CAST(p->>'$.severity_bands_systemic.critical' AS DOUBLE), 0.25) AS sys_critical,
       CAST(p->'$.source_filter.cex_whitelist' AS VARCHAR[]) AS cex_whitelist, coalesce(CAST(p->>'$.source_filter.include_dex' AS BOOLEAN), true) AS include_dex,
       coalesce(CAST(p->>'$.toggles.oracle_confirmation' AS BOOLEAN), false) AS oracle_confirmation, coalesce(CAST(p->>'$.toggles.volume_confirmation' AS BOOLEAN), false) AS volume_confirmation, coalesce(CAST(p->>'$.toggles.contagion_detection' AS BOOLEAN), false) AS contagion_detection,
       p->'$.source_overrides' AS overrides
FROM (SELECT tenant_id, unnest(json_extract(config, '$[*]')) AS p {_ON} AND pattern_id = 'dpeg')
WHERE coalesce(trim(p->>'$.market_key'), '') <> '' AND coalesce(CAST(p->>'$.peg_target' AS DOUBLE), 1.0) > 0 AND coalesce(CAST(p->>'$.quorum_pct' AS DOUBLE), 0.6) BETWEEN 0 AND 1"""


def _got(*paths: str) -> str:
    return "coalesce(" + ", ".join(f"r->>'$.{p}'" for p in paths) + ", NULL)"


def _whole(*paths: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({_got(*paths)}), '[+-]?[0-9]+') THEN TRY_CAST(trim({_got(*paths)}) AS BIGINT) END"


def _minutes(name: str, default: int, own: tuple, sec: tuple) -> str:
    return f"greatest(1, coalesce({_whole(*own)}, ({_whole(*sec)} + 59) // 60, {default}))::BIGINT AS {name}"


def _number(name: str, default: str, *paths: str) -> str:
    return f"coalesce(TRY_CAST(trim({_got(*paths)}) AS DOUBLE), {default}::DOUBLE) AS {name}"


_both = lambda k: (f"thresholds.{k}", k)
_SCOPE_SAID = "CASE WHEN json_type(r->'$.scope') = 'VARCHAR' THEN lower(trim(r->>'$.scope')) END"
_MARKET = f"nullif(nullif(lower(trim({_got('scope.market_id', 'market_id')})), ''), 'all')"
TVL_RULES_SQL = f"""
WITH of_tenants AS (SELECT tenant_id, config, CASE WHEN json_valid(config) THEN CASE WHEN json_type(config, '$.rules') = 'ARRAY' THEN json_extract(config, '$.rules[*]') END END AS rules {_ON} AND pattern_id = 'tvl_drop'),
items AS (SELECT tenant_id, unnest(rules) AS r, unnest(range(len(rules))) AS rule_order FROM of_tenants),
parsed AS (
  SELECT tenant_id, rule_order, coalesce(nullif(trim(r->>'$.rule_id'), ''), 'tvl-rule-' || (rule_order + 1)) AS rule_id,
         lower(coalesce(nullif(trim({_got("scope.protocol_id", "protocol_id")}), ''), 'aave_v3')) AS protocol_id, lower(coalesce(nullif(trim({_got("scope.chain_slug", "chain_slug")}), ''), 'base')) AS chain_slug,
         {_MARKET} AS market, CASE WHEN {_SCOPE_SAID} IN ('market', 'protocol') THEN {_SCOPE_SAID} = 'market' ELSE {_MARKET} IS NOT NULL END AS of_market,
         {_number("fast_drop_pct", "20", *_both("fast_drop_pct"))}, {_number("slow_drop_pct", "35", *_both("slow_drop_pct"))}, {_number("velocity_critical_pct", "15", *_both("velocity_critical_pct"))},
         {_minutes("fast_minutes", 10, _both("fast_window_minutes"), _both("fast_window_sec"))}, {_minutes("slow_minutes", 60, _both("slow_window_minutes"), _both("slow_window_sec"))},
         {_minutes("velocity_minutes", 2, _both("velocity_critical_minutes"), _both("velocity_window_sec"))},
         {_minutes("concurrent_minutes", 5, ("concurrent_window_minutes", "thresholds.concurrent_window_minutes"), ("contagion.overlap_window_sec", "concurrent_window_sec"))},
         coalesce(CAST({_got("contagion.enabled", "contagion_enabled")} AS BOOLEAN), true) AS contagion_enabled, {_number("min_tvl_floor_usd", "1e6", "min_tvl_floor_usd", "thresholds.min_tvl_floor_usd")},
         coalesce(CAST(r->>'$.enabled' AS BOOLEAN), true) AS on_
  FROM items WHERE json_type(r) = 'OBJECT'),
valid AS (SELECT * FROM parsed WHERE fast_drop_pct > 0 AND slow_drop_pct > 0 AND velocity_critical_pct > 0 AND min_tvl_floor_usd >= 0 AND (NOT of_market OR market IS NOT NULL)),
fallen AS (SELECT DISTINCT tenant_id FROM of_tenants WHERE tenant_id NOT IN (SELECT tenant_id FROM valid))
SELECT tenant_id, CAST(rule_order AS INTEGER) AS rule_order, rule_id, protocol_id, chain_slug, CASE WHEN of_market THEN market END AS market_id, fast_drop_pct, slow_drop_pct, velocity_critical_pct,
       fast_minutes, slow_minutes, velocity_minutes, concurrent_minutes, contagion_enabled, min_tvl_floor_usd FROM valid WHERE on_
UNION ALL SELECT tenant_id, 0, 'tvl-default', 'aave_v3', 'base', NULL, 20, 35, 15, 10, 60, 2, 5, true, 1e6 FROM fallen"""


def enabled(spark, sf_dir, pattern, *rows):
    """The pattern's configurations; with ``rows``, those of the tenants that the views are about."""
    got = configs.enabled_configs(view(spark, sf_dir, "tenant_patterns").where(F.col("pattern_id") == pattern), view(spark, sf_dir, "patterns"), pattern)
    return configs.spread(configs.of_tenants(got, *(view(spark, sf_dir, r) for r in rows)) if rows else got)


_PEG_COLUMNS = ("tenant_id", "market_key", "peg_target", "min_sources", "quorum_pct", "sustained_window_ms", "cooldown_sec", "stale_timeout_ms", "deescalation_blocks", "resolution_blocks", "isolated_floor_pct", "systemic_floor_pct", "include_dex", "oracle_confirmation", "contagion_detection")


@query("a3_peg_policies", f"SELECT {', '.join(_PEG_COLUMNS)}, iso_critical, sys_medium, CAST(coalesce(json_array_length(json_keys(overrides)), 0) AS INTEGER) AS n_overrides, array_to_string(cex_whitelist, ',') AS cex_whitelist FROM ({PEG_POLICIES_SQL})".replace("json_array_length(json_keys(overrides))", "len(json_keys(overrides))"))
def peg_policies(spark, sf_dir):
    got = configs.peg_policies(enabled(spark, sf_dir, "dpeg"))
    bands = F.coalesce("severity_bands_isolated.critical", F.lit(5.0)).alias("iso_critical"), F.coalesce("severity_bands_systemic.medium", F.lit(0.01)).alias("sys_medium")
    return got.select(*_PEG_COLUMNS, *bands, F.size("overrides").alias("n_overrides"), F.array_join("cex_whitelist", ",").alias("cex_whitelist"))


FLASH_RULES_SQL = f"""
WITH c AS (SELECT tenant_id, CASE WHEN json_valid(config) THEN json_extract(config, '$.rules[*]') END AS rules {_ON} AND pattern_id = 'flash_loan'),
r AS (SELECT tenant_id, unnest(rules) AS r, unnest(range(len(rules))) AS rule_order FROM c WHERE rules IS NOT NULL)
SELECT tenant_id, CAST(rule_order AS INTEGER) AS rule_order, r->>'$.rule_id' AS rule_id, coalesce(CAST(r->>'$.min_loan_usd' AS DOUBLE), 100000.0) AS min_loan_usd, coalesce(CAST(r->>'$.min_profit_usd' AS DOUBLE), 1000.0) AS min_profit_usd, coalesce(CAST(r->>'$.cooldown_sec' AS BIGINT), 300) AS cooldown_sec
FROM r WHERE coalesce(CAST(r->>'$.enabled' AS BOOLEAN), true) UNION ALL SELECT tenant_id, 0, 'default', 100000.0, 1000.0, 300 FROM c WHERE rules IS NULL"""


@query("a3_flash_rules", FLASH_RULES_SQL)
def flash_rules(spark, sf_dir):
    return configs.flash_rules(enabled(spark, sf_dir, "flash_loan"))


@query("a3_tvl_rules", TVL_RULES_SQL)
def tvl_rules(spark, sf_dir):
    return configs.tvl_rules(enabled(spark, sf_dir, "tvl_drop"))


@query("a4_effective_streams", EFFECTIVE)
def effective_streams(spark, sf_dir):
    return configs.effective_streams(*(view(spark, sf_dir, n) for n in ("sources", "streams", "targets")))


@query("a5_tenant_sources", "SELECT o.tenant_id, s.source_id, s.source_type, coalesce(o.override_config, '{}') AS config FROM tenant_overrides o JOIN sources s USING (source_id) WHERE o.enabled AND s.enabled")
def tenant_sources(spark, sf_dir):
    return configs.tenant_sources(view(spark, sf_dir, "tenant_overrides"), view(spark, sf_dir, "sources"))


@query("a8_incremental_scan", "SELECT detection_id, arrival FROM detections WHERE (created_at, arrival) > (TIMESTAMP '1995-06-01', 1000)")
def incremental(spark, sf_dir):
    return scans.incremental_scan(view(spark, sf_dir, "detections"), "created_at", "arrival", datetime.datetime(1995, 6, 1), 1000).select("detection_id", "arrival")


@query("a9_confirmed_range", """
WITH heads AS (SELECT chain, max(block_number) - 12 AS safe FROM chain_events GROUP BY chain),
b AS (SELECT h.chain, safe, CASE h.chain WHEN 'base' THEN 51 ELSE greatest(safe - 100, 0) END AS start FROM heads h)
SELECT e.event_id, e.chain, e.block_number FROM chain_events e JOIN b USING (chain) WHERE block_number BETWEEN start AND safe""")
def confirmed(spark, sf_dir):
    base = spark.sql("SELECT 'base' AS chain, 50L AS cursor")
    return scans.confirmed_range(view(spark, sf_dir, "chain_events"), base, 12).select("event_id", "chain", "block_number")


_FILTERS = "SELECT * FROM (VALUES ('0xpool0', '0xanswer'), ('0xpool1', '0xswap'), ('0xpool2', CAST(NULL AS STRING)), ('0xpool2', '0xflash')) AS t(address, topic0)"


@query("a8_resumed_scan", "SELECT detection_id, arrival, CAST((row_number() OVER (ORDER BY created_at, arrival) - 1) // (SELECT CAST(ceil(count(*) / 3.0) AS BIGINT) FROM detections) AS BIGINT) AS batch FROM detections")
def resumed(spark, sf_dir):
    """A keyset scan in three batches, each from where the last one ended; the second is broken off and read again."""
    d, root = view(spark, sf_dir, "detections").select("detection_id", "arrival", "created_at"), shared_folder(spark, "cursor")
    table = VersionedTable(spark, f"{root}/rows", ["detection_id"], parts=4)
    limit = -(-d.count() // 3)

    def sink(rows, batch):
        table.merge(rows.withColumn("batch", F.lit(batch).cast("long")), inserts(["detection_id"], ["arrival"]), "scan", batch)
        if batch == 1 and not broken:
            broken.append(batch)
            raise InterruptedError

    broken: list = []
    while True:
        try:
            if cursors.keyset(cursors.Cursor(spark, root), d, "created_at", "arrival", sink, limit) is None:
                return table.read().drop("created_at")
        except InterruptedError:
            continue


@query("a9_resumed_range", """WITH h AS (SELECT chain, max(block_number) - 12 AS safe, max(block_number) FILTER (event_id < 500) - 12 AS first FROM chain_events GROUP BY chain)
SELECT event_id, e.chain, block_number, CAST(CASE WHEN block_number <= first THEN 0 ELSE 1 END AS BIGINT) AS batch FROM chain_events e JOIN h USING (chain) WHERE block_number BETWEEN 0 AND safe AND (event_id < 500 OR block_number > first)""")
def resumed_range(spark, sf_dir):
    """Confirmed blocks of the events so far, and later of what has been confirmed since."""
    e, root = view(spark, sf_dir, "chain_events").select("event_id", "chain", "block_number"), shared_folder(spark, "cursor")
    table = VersionedTable(spark, f"{root}/rows", ["event_id"], parts=4)
    sink = lambda rows, batch: table.merge(rows.withColumn("batch", F.lit(batch).cast("long")), inserts(["event_id"], ["event_id"]), "range", batch)
    for events in (e.where("event_id < 500"), e, e):
        cursors.confirmed(cursors.Cursor(spark, root), events, 12, sink, lookback=1_000_000)
    return table.read()


@query("a10_select_logs", f"SELECT event_id FROM chain_positions l WHERE EXISTS (SELECT 1 FROM ({_FILTERS}) f WHERE f.address = l.address AND (f.topic0 = l.topic0 OR f.topic0 IS NULL))")
def logs(spark, sf_dir):
    return scans.select_logs(view(spark, sf_dir, "chain_positions"), spark.sql(_FILTERS)).select("event_id")


@query("a11_state_samples", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'tvl' WHEN 1 THEN 'pause' ELSE 'error' END AS metric, round(CASE event_id % 3 WHEN 0 THEN (1000000 + event_id) / 1e6 * 2.0 END, 6) AS tvl_usd,
       CASE event_id % 3 WHEN 1 THEN user_id % 2 = 1 END AS paused, CASE event_id % 3 WHEN 2 THEN 'rpc_state_error' END AS parse_error FROM events""")
def state_samples(spark, sf_dir):
    """Recorded state calls as drawdown and pause samples; failed calls stay as rows."""
    from ..operators.chain import state_samples as samples

    e = view(spark, sf_dir, "events")
    k = F.col("event_id") % 3
    result = F.when(k == 0, F.concat(F.lit("0x"), F.lpad(F.hex(F.col("event_id") + 1000000), 64, "0"))).when(k == 1, F.concat(F.lit("0x"), F.lpad(F.hex(F.col("user_id") % 2), 64, "0")))
    calls = e.select("event_id", F.when(k == 1, "pause").otherwise("tvl").alias("kind"), result.alias("result"), F.lit(6).alias("decimals"), F.lit(2.0).alias("price_usd"))
    return samples(calls).select("event_id", "metric", F.round("tvl_usd", 6).alias("tvl_usd"), "paused", "parse_error")


@query("b1_insert_if_absent", "SELECT arg_min(detection_id, arrival) AS detection_id, tx_hash FROM detections WHERE tx_hash NOT IN (SELECT tx_hash FROM alerts JOIN detections USING (detection_id) WHERE severity = 'critical') GROUP BY tx_hash".replace("WHERE severity", "WHERE alerts.severity"))
def insert_if_absent(spark, sf_dir):
    """Detections whose transaction has no critical alert yet, the first of each transaction."""
    d = view(spark, sf_dir, "detections")
    have = view(spark, sf_dir, "alerts").where("severity = 'critical'").select("detection_id").join(d.select("detection_id", "tx_hash"), "detection_id")
    return tables.insert_if_absent(have, d, ["tx_hash"], ["arrival"]).select("detection_id", "tx_hash")


@query("b2_upsert", "SELECT tx_hash, detection_id, severity FROM detections QUALIFY row_number() OVER (PARTITION BY tx_hash ORDER BY (arrival % 3 = 1) DESC, arrival DESC) = 1")
def upsert(spark, sf_dir):
    """A third of the detections is upserted into the table of the others."""
    d = view(spark, sf_dir, "detections").select("tx_hash", "detection_id", "severity", "arrival")
    return tables.upsert(d.where("arrival % 3 != 1"), d.where("arrival % 3 = 1"), ["tx_hash"], ["arrival"]).drop("arrival")


_CHANGES = """SELECT tx_hash AS case_id, arrival, CASE arrival % 3 WHEN 0 THEN 'incident' WHEN 1 THEN 'alert' ELSE 'detection' END AS kind, severity, incident_transition AS status, chain_slug AS chain, protocol FROM detections"""


def _cases_sql(changes: str, place: str) -> str:
    return f"""
WITH c AS (SELECT *, {place} AS pos, CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 END AS r FROM ({changes})),
k AS (SELECT *, coalesce(max(CASE WHEN kind = 'incident' THEN pos END) OVER (PARTITION BY case_id), -1) AS since FROM c)
SELECT case_id, arg_max(severity, pos) AS severity_last, CAST(max(r) AS INTEGER) AS severity_rank_peak, arg_max(status, pos) FILTER (kind IN ('incident', 'alert')) AS status,
       arg_min(chain, pos) FILTER (chain IS NOT NULL AND kind <> 'alert' AND pos >= since) AS chain, arg_min(protocol, pos) FILTER (protocol IS NOT NULL AND kind <> 'alert' AND pos >= since) AS protocol FROM k GROUP BY case_id"""


@query("b3_upsert_by_policy", _cases_sql(_CHANGES, "arrival"))
def upsert_by_policy(spark, sf_dir):
    changes = spark.sql(_CHANGES.replace("FROM detections", "FROM {d}"), d=view(spark, sf_dir, "detections")).withColumn("severity_rank", rank(F.col("severity")))
    return tables.upsert_by_policy(changes, "case_id", ["arrival"])


def _merged(spark, name, rows, keys, how, schema=None):
    """Rows in three batches by their arrival, the second of them twice, merged into a table that is read again."""
    table = VersionedTable(spark, shared_folder(spark, name), keys, parts=8)
    for batch in (0, 1, 1, 2):
        table.merge(rows.where(F.col("arrival") % 3 == batch), how, "query", batch, schema)
    return table.read()


@query("b1_inserted", "SELECT tx_hash, detection_id FROM detections QUALIFY row_number() OVER (PARTITION BY tx_hash ORDER BY arrival % 3, arrival) = 1")
def inserted(spark, sf_dir):
    """Insert if absent into a stored table, in batches of which one is repeated (B1)."""
    d = view(spark, sf_dir, "detections").select("tx_hash", "detection_id", "arrival")
    return _merged(spark, "inserted", d, ["tx_hash"], inserts(["tx_hash"], ["arrival"])).drop("arrival")


@query("b2_upserted", "SELECT tx_hash, detection_id, severity FROM detections QUALIFY row_number() OVER (PARTITION BY tx_hash ORDER BY arrival % 3 DESC, arrival DESC) = 1")
def upserted(spark, sf_dir):
    """Upserts into a stored table (B2)."""
    d = view(spark, sf_dir, "detections").select("tx_hash", "detection_id", "severity", "arrival")
    return _merged(spark, "upserted", d, ["tx_hash"], upserts(["tx_hash"], ["arrival"])).drop("arrival")


_MIXED = _CHANGES.replace("CASE arrival % 3", "CASE CAST(floor(arrival / 3) AS BIGINT) % 3")


@query("b3_cases_written", _cases_sql(_MIXED, "arrival % 3 * 1000000000000 + arrival"))
def cases_written(spark, sf_dir):
    """Changes of several kinds, merged batch by batch into a stored table of cases."""
    changes = spark.sql(_MIXED.replace("FROM detections", "FROM {d}"), d=view(spark, sf_dir, "detections")).withColumn("severity_rank", rank(F.col("severity")))
    schema = T.StructType([T.StructField(c, T.IntegerType() if c == "severity_rank_peak" else T.StringType()) for c in ("case_id", *CASE_COLUMNS)])
    return _merged(spark, "cases", changes, ["case_id"], cases("case_id", ["arrival"]), schema)


@query("b5_raw_landing", """SELECT tx_hash AS idempotency_key, detection_id, CASE pattern_id WHEN 'dpeg' THEN 'raw_cex' WHEN 'flash_loan' THEN 'raw_dex' ELSE 'raw_chain' END AS landing_table,
'rawdb:' || CASE pattern_id WHEN 'dpeg' THEN 'raw_cex' WHEN 'flash_loan' THEN 'raw_dex' ELSE 'raw_chain' END AS pointer, epoch_ms(last) AS last_ms, strftime(created_at, '%Y-%m-%d') AS partition_key
FROM (SELECT *, max(created_at) OVER (PARTITION BY tx_hash) AS last FROM detections) QUALIFY row_number() OVER (PARTITION BY tx_hash ORDER BY created_at, arrival) = 1""")
def raw_landing(spark, sf_dir):
    d = view(spark, sf_dir, "detections").withColumn("source_type", F.expr("CASE pattern_id WHEN 'dpeg' THEN 'cex_websocket' WHEN 'flash_loan' THEN 'dex_api' ELSE 'evm_chain' END"))
    got = tables.landed(d.select(F.col("tx_hash").alias("idempotency_key"), "detection_id", "source_type", F.col("created_at").alias("observed_at"), F.col("arrival").alias("event_id")))
    return got.select("idempotency_key", "detection_id", "landing_table", "pointer", F.unix_millis(F.col("last_observed_at").cast("timestamp")).alias("last_ms"), "partition_key")


@query("b4_append_log", "SELECT 'incident' AS kind, incident_id AS subject, status, CAST(arrival AS BIGINT) AS arrival FROM incident_table UNION ALL SELECT 'alert', alert_id, status, arrival FROM alerts")
def append_log(spark, sf_dir):
    """An append-only log: incidents, then alerts are appended, and the whole log is read again."""
    path = shared_folder(spark, "log")
    log = lambda name, key: view(spark, sf_dir, name).select(F.lit(name.split("_")[0].removesuffix("s")).alias("kind"), F.col(key).alias("subject"), "status", "arrival", "created_at")
    tables.append_log(log("incident_table", "incident_id"), path, "created_at")
    tables.append_log(log("alerts", "alert_id"), path, "created_at")
    return spark.read.parquet(path).select("kind", "subject", "status", "arrival")


@query("b8_feature_slices", "SELECT detection_id, version, 's3a://features/version=' || version || '/detection=' || detection_id AS uri FROM feature_vectors")
def feature_slices(spark, sf_dir):
    return tables.feature_slices(view(spark, sf_dir, "feature_vectors"), "s3a://features").select("detection_id", "version", "uri")


@query("b9_fan_out", """SELECT q.event_id, t.tenant_id, '{"dedup_key":"' || q.event_id || '","market_key":"' || market_key || '","stream_id":"' || t.stream_id || '","tenant_id":"' || t.tenant_id || '"}' AS payload
FROM (SELECT *, 'st-' || substr(source_id, 5) AS stream_id FROM quotes WHERE market_key IS NOT NULL) q JOIN targets t ON t.stream_id = q.stream_id WHERE t.enabled""")
def fan_out(spark, sf_dir):
    q = view(spark, sf_dir, "quotes").where("market_key IS NOT NULL").select("event_id", F.col("event_id").cast("string").alias("dedup_key"), "market_key", F.lit(None).cast("double").alias("price"), F.concat(F.lit("st-"), F.substring("source_id", 5, 9)).alias("stream_id"))
    return tables.fan_out(q, view(spark, sf_dir, "targets")).select("event_id", "tenant_id", "payload")


@query("b10_dispatch", """SELECT alert_id, channel, alert_id || ':' || channel AS dedup_key, severity FROM (SELECT *, unnest(CASE arrival % 3 WHEN 0 THEN ['slack', 'webhook'] WHEN 1 THEN ['telegram'] ELSE [] END) AS channel FROM alerts)""")
def dispatch(spark, sf_dir):
    return tables.dispatch_requests(view(spark, sf_dir, "alerts"), _channels()).select("alert_id", "channel", "dedup_key", "severity")


def _channels():
    return F.when(F.col("arrival") % 3 == 0, F.array(F.lit("Slack"), F.lit("pager"), F.lit("webhook"), F.lit("slack"))).when(F.col("arrival") % 3 == 1, F.array(F.lit("telegram"))).otherwise(F.array(F.lit("fax")))


@query("b10_dispatch_results", """SELECT alert_id, channel, arrival % 5 <> 0 OR channel = 'slack' AS delivered, CASE WHEN arrival % 5 = 0 AND channel <> 'slack' THEN CASE WHEN arrival % 2 = 0 THEN 'timeout' ELSE 'no_response' END END AS error
FROM (SELECT *, unnest(CASE arrival % 3 WHEN 0 THEN ['slack', 'webhook'] WHEN 1 THEN ['telegram'] ELSE [] END) AS channel FROM alerts)""")
def dispatch_results(spark, sf_dir):
    """Requests with what the gateway answered of each alert: one result per channel."""
    failed = F.expr("""CASE WHEN arrival % 2 = 0 THEN '{"channel":"webhook","success":false,"error":"timeout"},{"channel":"telegram","success":false,"error":"timeout"},' ELSE '' END""")
    answer = F.concat(F.lit('{"results":['), F.when(F.col("arrival") % 5 == 0, failed).otherwise('{"channel":"webhook","success":true},{"channel":"telegram","success":true},'), F.lit('{"channel":"SLACK","success":true}]}'))
    a = view(spark, sf_dir, "alerts")
    return tables.dispatch_results(tables.dispatch_requests(a, _channels()), a.select("alert_id", answer.alias("response"))).select("alert_id", "channel", "delivered", "error")


@query("b11_batch_metrics", "SELECT source_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (price IS NULL) AS BIGINT) AS n_failed, CAST(count(price) AS BIGINT) AS n_parsed FROM quotes GROUP BY source_id")
def batch_metrics(spark, sf_dir):
    return tables.batch_metrics(_batch(spark, sf_dir), ["source_id"])


def _batch(spark, sf_dir):
    return view(spark, sf_dir, "quotes").withColumn("parse_error", F.when(F.col("price").isNull(), "missing_price"))


@query("b11_failure_rows", "SELECT event_id, source_id, 'missing_price' AS parse_error, epoch_us(observed_at) AS failed_us, '{\"event_id\":' || event_id || ',\"source_id\":\"' || source_id || '\"}' AS record FROM quotes WHERE price IS NULL")
def failure_rows(spark, sf_dir):
    """The rows of a batch that failed, with their error and record."""
    got = tables.failure_rows(_batch(spark, sf_dir), ["event_id", "source_id"])
    return got.select("event_id", "source_id", "parse_error", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("failed_us"), "record")


@query("b11_ingest_batches", """WITH q AS (SELECT event_id % 4 AS b, event_id // 3 AS k, price IS NULL AS bad FROM quotes)
SELECT 'batch-' || b AS batch_id, 'feed' AS stream_id, CAST(count(DISTINCT k) FILTER (NOT bad) AS BIGINT) AS rows_ingested, CAST(count(*) FILTER (NOT bad) - count(DISTINCT k) FILTER (NOT bad) AS BIGINT) AS rows_deduped,
       CAST(count(*) FILTER (bad) AS BIGINT) AS rows_failed, CASE WHEN count(*) FILTER (bad) > 0 THEN 'partial' ELSE 'completed' END AS status, CASE WHEN count(*) FILTER (bad) > 0 THEN 'missing_price' END AS error_summary FROM q GROUP BY b
UNION ALL SELECT 'batch-x', 'feed', 0, 0, 0, 'failed', 'the sink is full'""")
def ingest_batches(spark, sf_dir):
    """Batches with metrics that are counted while they are written; the sink of the last one fails."""
    rows, path = _batch(spark, sf_dir).withColumn("k", F.floor(F.col("event_id") / 3)), shared_folder(spark, "ingested")

    def full(df):
        raise OSError("the sink is full")

    done = [ingest.ingest(rows.where(F.col("event_id") % 4 == b), ["k"], lambda df, b=b: df.write.parquet(f"{path}/{b}"), f"batch-{b}", "feed") for b in range(4)]
    done.append(ingest.ingest(rows, ["k"], full, "batch-x", "feed"))
    columns = ("batch_id", "stream_id", "rows_ingested", "rows_deduped", "rows_failed", "status", "error_summary")
    return spark.createDataFrame([tuple(m.as_dict()[c] for c in columns) for m in done], "batch_id string, stream_id string, rows_ingested long, rows_deduped long, rows_failed long, status string, error_summary string")


@query("b11_failures", """SELECT event_id, source_id, source_type, '{"event_id":' || event_id || '}' AS payload_excerpt, CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'parse' END AS error_kind, 'missing_price' AS error_message, event_id % 2 = 0 AS retryable FROM quotes WHERE price IS NULL""")
def ingest_failures(spark, sf_dir):
    """Records of what failed, and whether another try may mend it."""
    got = ingest.failures(_batch(spark, sf_dir), F.to_json(F.struct("event_id")), kind=F.when(F.col("event_id") % 2 == 0, "timeout"))
    return got.select("event_id", "source_id", "source_type", "payload_excerpt", "error_kind", "error_message", "retryable")


@query("b12_export_manifest", "SELECT tenant_id, CAST(count(*) AS BIGINT) AS row_count, CAST(sum(CAST('0x' || substr(sha256(concat_ws('|', detection_id, severity)), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM detections GROUP BY tenant_id")
def export_manifest(spark, sf_dir):
    return tables.export_manifest(view(spark, sf_dir, "detections"), ["tenant_id"], ["detection_id", "severity"])
