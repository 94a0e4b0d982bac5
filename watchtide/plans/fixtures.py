"""Views that turn the given tables into feeds, quotes, samples, detections and configurations.

Every view is one SELECT that Spark and DuckDB both understand, so queries and their SQL counterparts start
from the same rows.
"""

from __future__ import annotations

_Q = "'"

FIXTURES: dict[str, str] = {
    "quotes": """
SELECT event_id, ts AS observed_at, 'tenant-' || (user_id % 3) AS tenant_id, 'src-' || (user_id % 7) AS source_id,
       CASE user_id % 7 WHEN 0 THEN 'cex_websocket' WHEN 1 THEN 'cex_websocket' WHEN 2 THEN 'cex_websocket'
            WHEN 3 THEN 'dex_api' WHEN 4 THEN 'dex_api' WHEN 5 THEN 'oracle_api' ELSE 'custom_api' END AS source_type,
       CASE event_type WHEN 'click' THEN 'USDC/USD' WHEN 'view' THEN 'USDT/USD'
            WHEN 'purchase' THEN 'DAI/USD' WHEN 'signup' THEN 'FRAX/USD' END AS market_key,
       CASE WHEN event_type = 'error' THEN NULL ELSE 1.0 + (value - 35.0) / 1000.0 END AS price
FROM events""",
    "fx_quotes": """
SELECT event_id, observed_at, tenant_id, source_id, market_key, price,
       CASE WHEN source_id IN ('src-1', 'src-2') THEN 'USDT' ELSE 'USD' END AS quote_asset
FROM quotes WHERE market_key IS NOT NULL AND price IS NOT NULL""",
    "tvl_samples": """
SELECT event_id, ts AS observed_at, 'tenant-' || (user_id % 3) AS tenant_id, 'proto-' || (user_id % 4) AS protocol_id,
       CASE user_id % 2 WHEN 0 THEN 'base' ELSE 'ethereum' END AS chain_slug, CASE event_id % 3 WHEN 1 THEN 'm1' WHEN 2 THEN 'M2' END AS market_id,
       value * 1000000.0 AS tvl_usd
FROM events WHERE event_type = 'view'""",
    "pause_events": """
SELECT event_id, ts AS observed_at, 'tenant-' || (user_id % 3) AS tenant_id, 'proto-' || (user_id % 4) AS protocol_id,
       CASE user_id % 2 WHEN 0 THEN 'base' ELSE 'ethereum' END AS chain_slug, CASE event_id % 3 WHEN 1 THEN 'M1' WHEN 2 THEN 'm2' END AS market_id,
       event_id % 2 = 0 AS paused
FROM events WHERE event_type = 'signup'""",
    "flash_events": """
SELECT event_id, ts AS observed_at, 'tenant-' || (user_id % 3) AS tenant_id, 'addr-' || user_id AS attacker_address,
       value * 10000.0 AS loan_amount_usd, value * 100.0 AS profit_usd,
       CASE WHEN user_id % 11 = 0 THEN 'cex_websocket' ELSE 'evm_chain' END AS source_type
FROM events WHERE event_type = 'purchase'""",
    "chain_events": """
SELECT event_id, ts AS observed_at,
       CASE user_id % 3 WHEN 0 THEN 'ethereum' WHEN 1 THEN 'base' ELSE 'arbitrum' END AS chain,
       CAST(floor(event_id / 5) AS BIGINT) - CASE WHEN event_id % 173 = 169 THEN 4 ELSE 0 END AS block_number, 'ev-' || event_id AS event_key,
       CASE WHEN event_id % 29 <> 7 THEN 'h' || CAST(floor(event_id / 5) AS BIGINT)
           || CASE WHEN event_id % 173 = 169 THEN 'c' WHEN event_type = 'error' AND event_id % 50 = 4 THEN 'b' ELSE 'a' END END AS block_hash,
       event_id % 7 = 3 AS requires_confirmation, CAST(event_id % 6 AS BIGINT) AS confirmation_depth
FROM events""",
    "detections": """
SELECT 'det-' || o_orderkey AS detection_id, 'tenant-' || (o_custkey % 5) AS tenant_id,
       CASE o_orderstatus WHEN 'F' THEN 'flash_loan' WHEN 'O' THEN 'dpeg' ELSE 'tvl_drop' END AS pattern_id,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium'
            WHEN '4' THEN 'info' ELSE 'low' END AS severity,
       CASE o_orderkey % 4 WHEN 0 THEN 'USDC' WHEN 1 THEN 'USDT' WHEN 2 THEN 'DAI' ELSE 'FRAX' END AS asset_symbol,
       CASE o_orderkey % 7 WHEN 0 THEN 'resolve' WHEN 1 THEN 'escalate' WHEN 2 THEN 'retract'
            WHEN 3 THEN 'update' ELSE 'trigger' END AS incident_transition,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'ev-' || (o_orderkey % 1000) END AS event_key,
       CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 1 END AS n_rules,
       CASE o_orderkey % 3 WHEN 0 THEN 'ethereum' WHEN 1 THEN 'base' ELSE NULL END AS chain_slug,
       CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE 'proto-' || (o_orderkey % 4) END AS protocol,
       'tx-' || (o_orderkey % 500) AS tx_hash,
       o_totalprice / 10000.0 AS risk_score, o_orderdate AS created_at, o_orderkey AS arrival
FROM orders""",
    "positions": """
SELECT 'ent-' || c_custkey AS entity_id, 'tenant-' || (c_custkey % 5) AS tenant_id,
       CASE c_custkey % 40 WHEN 0 THEN 'USDC' WHEN 6 THEN 'USDT' WHEN 12 THEN 'DAI' WHEN 18 THEN 'FRAX' ELSE 'TOK' || (c_custkey % 40) END AS asset_symbol,
       c_acctbal AS quantity, c_acctbal * 1.01 AS valuation_usd, c_custkey % 10 <> 0 AS enabled
FROM customer""",
    "rule_metrics": """
SELECT 'rule-' || l_returnflag AS rule_id,
       CASE l_suppkey % 3 WHEN 0 THEN 'ethereum' WHEN 1 THEN 'base' ELSE 'arbitrum' END AS chain,
       CAST(l_quantity AS INT) AS execution_time_ms, l_discount > 0.05 AS triggered, l_shipdate AS created_at
FROM lineitem""",
    "dead_letters": """
SELECT event_id, ts AS failed_at, 'stream-' || (user_id % 4) AS stream, CAST(user_id AS STRING) AS entry_id,
       'failed: ' || CAST(floor(value) AS BIGINT) AS error
FROM events WHERE event_type = 'error'""",
    "delivered": """
SELECT 'stream-' || (user_id % 4) AS stream, CAST(user_id AS STRING) AS entry_id, max(ts) AS delivered_at
FROM events WHERE event_type = 'signup' AND user_id % 5 = 0 GROUP BY user_id""",
    "sources": """
SELECT 'src-' || s_suppkey AS source_id,
       CASE s_suppkey % 7 WHEN 0 THEN 'cex_websocket' WHEN 1 THEN 'cex_websocket' WHEN 2 THEN 'cex_websocket' WHEN 3 THEN 'dex_api'
            WHEN 4 THEN 'dex_api' WHEN 5 THEN 'oracle_api' ELSE 'custom_api' END AS source_type,
       s_suppkey % 7 <> 2 AS enabled, 'wss://source/' || s_suppkey AS endpoint, 's' || (s_suppkey % 9) AS auth_ref
FROM supplier""",
    "streams": """
SELECT 'st-' || p_partkey AS stream_id, 'src-' || (p_partkey % 60) AS source_id, p_partkey % 5 <> 3 AS enabled,
       CASE WHEN p_partkey % 3 = 1 THEN 'wss://override/' || p_partkey END AS endpoint_override,
       CASE p_partkey % 4 WHEN 0 THEN 'binance_miniticker_v1' WHEN 1 THEN 'okx_tickers_v5' WHEN 2 THEN 'gate_ticker_v4' ELSE 'chainlink_answer_updated_v1' END AS parser_name,
       CASE p_partkey % 5 WHEN 0 THEN 'USDC/USD' WHEN 1 THEN 'USDT/USD' WHEN 2 THEN 'DAI/USD' WHEN 3 THEN 'FRAX/USD' END AS market_key
FROM part""",
    "targets": """
SELECT 'st-' || (c_custkey % 140) AS stream_id, 'tenant-' || (c_nationkey % 5) AS tenant_id, max(c_custkey % 4 <> 1) AS enabled
FROM customer GROUP BY c_custkey % 140, c_nationkey % 5""",
    "tenant_overrides": """
SELECT 'tenant-' || (c_custkey % 40) AS tenant_id, 'src-' || (c_custkey % 70) AS source_id, max(c_custkey % 3 <> 0) AS enabled,
       max(CASE WHEN c_custkey % 4 = 1 THEN '{"weight":' || (c_nationkey % 3) || '.5}' END) AS override_config
FROM customer GROUP BY c_custkey % 40, c_custkey % 70""",
    "patterns": """
SELECT * FROM (VALUES ('dpeg', true), ('flash_loan', true), ('tvl_drop', true), ('old', false)) AS t(pattern_id, enabled)""",
    "tenant_patterns": """
SELECT 'tenant-' || c_custkey AS tenant_id, 'dpeg' AS pattern_id, c_custkey % 5 <> 3 AS enabled,
       '[{"market_key":"USDC/USD","min_sources":2,"quorum_pct":0.3,"sustained_window_ms":3600000,"cooldown_sec":7200,"stale_timeout_ms":43200000,"deescalation_blocks":2,"resolution_blocks":3,"severity_bands":{"medium":0.5,"high":1.0,"critical":5.0}},'
       || '{"market_key":"USDT/USD","peg_target":0.999,"min_sources":' || (1 + c_custkey % 3) || ',"quorum_pct":0.5,"sustained_window_ms":60000,"cooldown_sec":' || (c_nationkey * 60)
       || ',"stale_timeout_ms":36000000,"deescalation_blocks":2,"resolution_blocks":2,"source_overrides":{"src-1":{"source_id":"src-1","weight":2.5,"enabled":true},"src-4":{"source_id":"src-4","weight":0.5,"enabled":true,"stale_timeout_ms":21600000},"src-6":{"source_id":"src-6","weight":1,"enabled":false}}},'
       || '{"market_key":"DAI/USD","min_sources":1,"quorum_pct":0,"sustained_window_ms":1800000,"stale_timeout_ms":43200000,"deescalation_blocks":3,"resolution_blocks":4,"systemic_floor_pct":2.5,"severity_bands_systemic":{"medium":2.5,"high":3.0,"critical":4.0},"toggles":{"contagion_detection":true,"volume_confirmation":true}},'
       || '{"market_key":"FRAX/USD","min_sources":1,"quorum_pct":0,"sustained_window_ms":60000,"stale_timeout_ms":28800000,"isolated_floor_pct":1.5,"deescalation_blocks":2,"resolution_blocks":2,"source_filter":{"cex_whitelist":["SRC-0","src-2"],"include_dex":false,"min_healthy_sources":1},"toggles":{"oracle_confirmation":true}},'
       || '{"market_key":"","peg_target":1.0},{"market_key":"EUR/USD","peg_target":-' || (1 + c_custkey % 2) || '},{"market_key":"GBP/USD","quorum_pct":1.5}]' AS config
FROM customer
UNION ALL
SELECT 'tenant-' || c_custkey, 'flash_loan', c_custkey % 4 <> 3,
       CASE WHEN c_custkey % 6 = 2 THEN 'oops' ELSE '{"rules":[{"rule_id":"f' || c_nationkey || '","min_loan_usd":' || (100000 + c_custkey) || ',"cooldown_sec":' || (86400 * (1 + c_nationkey % 9)) || '},{"rule_id":"off","enabled":false},{"rule_id":"g","min_profit_usd":500}]}' END
FROM customer
UNION ALL
SELECT 'tenant-' || c_custkey, 'tvl_drop', c_custkey % 7 <> 6,
       CASE WHEN c_custkey % 11 = 4 THEN 'oops' WHEN c_custkey % 9 = 5 THEN '{"rules":[{"protocol_id":"proto-0","slow_drop_pct":0},{"rule_id":"x","min_tvl_floor_usd":-1}]}' WHEN c_custkey % 13 = 6 THEN '{"rules":{"rule_id":"no array"}}' ELSE
       '{"rules":[{"rule_id":"base","scope":{"protocol_id":"PROTO-0","chain_slug":"Base","market_id":"All"},"thresholds":{"fast_drop_pct":20,"slow_drop_pct":35,"velocity_critical_pct":15,"fast_window_sec":36000,"slow_window_sec":216001,"velocity_window_sec":7200},"contagion":{"enabled":true,"overlap_window_sec":18000},"min_tvl_floor_usd":20000000},'
       || '{"protocol_id":"proto-1","chain_slug":"ethereum","fast_drop_pct":"' || (25 + c_nationkey % 3) || '","slow_window_minutes":' || (3000 + 17 * c_nationkey) || ',"fast_window_minutes":"' || (700 + c_custkey % 50) || '","velocity_critical_minutes":90,"concurrent_window_minutes":240,"min_tvl_floor_usd":10000000},'
       || '{"rule_id":"m","scope":{"protocol_id":"proto-2","chain_slug":"base","market_id":" M1 "},"thresholds":{"fast_drop_pct":30,"fast_window_sec":86399,"slow_window_sec":216000,"velocity_window_sec":1,"fast_window_minutes":2.5},"contagion":{"enabled":false},"min_tvl_floor_usd":10000000},'
       || '{"rule_id":"wide","protocol_id":"proto-2","chain_slug":"base","slow_drop_pct":30,"slow_window_minutes":' || (5000 + c_custkey) || ',"fast_window_minutes":4000,"concurrent_window_sec":90000,"thresholds":{"min_tvl_floor_usd":"15000000"}},'
       || '{"rule_id":"no market","scope":"market","protocol_id":"proto-2","chain_slug":"base"},{"rule_id":"neg","protocol_id":"proto-3","chain_slug":"ethereum","velocity_critical_pct":-1},'
       || '{"rule_id":"","scope":"protocol","protocol_id":"proto-3","chain_slug":"ethereum","market_id":"m2","fast_window_minutes":-3,"slow_window_minutes":1500,"contagion_enabled":' || CASE WHEN c_nationkey % 2 = 0 THEN 'true' ELSE 'false' END || '},'
       || '{"rule_id":"m2","scope":"market","protocol_id":"proto-3","chain_slug":"ethereum","market_id":"m2","fast_window_minutes":900,"slow_window_minutes":2000,"fast_drop_pct":10},'
       || '{"rule_id":"off","protocol_id":"proto-1","chain_slug":"ethereum","enabled":false},7]}' END
FROM customer
UNION ALL
SELECT 'tenant-' || c_custkey, 'old', true, '[]' FROM customer""",
    "tenant_rules": """
SELECT 'tenant-' || (p_partkey % 3) AS tenant_id, CAST(1000000 - p_partkey AS BIGINT) AS rule_order, 'part-' || p_partkey AS rule_id, CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity,
       CASE p_partkey % 4 WHEN 0 THEN '[{"attribute":"loan","op":">=","value":"' || (p_size * 20000) || '"}]'
            WHEN 1 THEN '[{"attribute":"profit","op":"<","value":"' || (p_size * 30) || '"},{"attribute":"source","op":"=","value":"evm_chain"}]'
            WHEN 2 THEN '[{"attribute":"loan","op":">","value":"' || (p_size * 10000) || '"},{"attribute":"profit","op":"<=","value":"' || (1000 + p_size * 100) || '"},{"attribute":"source","op":"!=","value":"x"}]'
            ELSE '[{"attribute":"label","op":">","value":"' || p_size || '"}]' END AS tests
FROM part""",
    "chain_positions": """
SELECT event_id, ts AS received_at, CASE user_id % 3 WHEN 0 THEN 'ethereum' WHEN 1 THEN 'base' ELSE 'arbitrum' END AS chain,
       CAST(floor(event_id / 5) AS BIGINT) AS block_number, CAST(event_id % 5 AS BIGINT) AS log_index, 'tx-' || CAST(floor(event_id / 2) AS BIGINT) AS tx_hash,
       '0xpool' || (user_id % 6) AS address,
       CASE event_type WHEN 'click' THEN '0xanswer' WHEN 'view' THEN '0xflash' WHEN 'purchase' THEN '0xswap' ELSE '0xother' END AS topic0, value
FROM events""",
    "bindings": """
SELECT * FROM (VALUES ('0xpool0', '0xanswer', 'lend-a', 'USDC/USD', 8), ('0xpool0', '0xanswer', 'lend-b', 'USDC/USD', 8), ('0xpool1', '0xanswer', 'lend-a', 'DAI/USD', 6),
  ('0xpool2', '0xflash', 'aave_v3', CAST(NULL AS STRING), 6), ('0xpool3', '0xflash', 'balancer_v2', NULL, 18)) AS t(address, topic0, protocol, market_key, decimals)""",
    "incident_table": """
SELECT 'inc-' || detection_id AS incident_id, tenant_id, pattern_id, 'market' AS subject_type, asset_symbol AS subject_key, chain_slug,
       CASE arrival % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'active' ELSE 'triggered' END AS status, severity, created_at, arrival
FROM detections WHERE arrival % 4 = 0""",
    "alerts": """
SELECT 'al-' || detection_id AS alert_id, detection_id, tenant_id, event_key, severity, pattern_id, asset_symbol || '/USD' AS subject_key,
       CASE arrival % 3 WHEN 0 THEN 'provisional' WHEN 1 THEN 'confirmed' ELSE 'retracted' END AS lifecycle_state,
       CASE arrival % 4 WHEN 0 THEN 'closed' ELSE 'active' END AS status, created_at, arrival
FROM detections WHERE event_key IS NOT NULL AND n_rules > 0""",
    "alert_details": """
SELECT *, 'market' AS subject_type, tenant_id || ':' || asset_symbol || '/USD' AS subject_key,
       CASE arrival % 3 WHEN 0 THEN 'isolated' WHEN 1 THEN 'systemic' END AS classification,
       CASE arrival % 3 WHEN 0 THEN 'provisional' WHEN 1 THEN 'confirmed' ELSE 'retracted' END AS lifecycle_state,
       '{"oracle_confirmed":true,"weighted_median_price":' || CASE arrival % 4 WHEN 0 THEN '0' WHEN 1 THEN '0.985' WHEN 2 THEN '1.25' ELSE 'null' END || '}' AS context,
       CAST(arrival % 120 AS DOUBLE) AS score, CAST(arrival % 101 AS DOUBLE) / 100.0 AS confidence
FROM detections""",
    "quota_limits": """
SELECT 'tenant-' || n_nationkey AS tenant_id, CASE n_nationkey % 5 WHEN 2 THEN -1 WHEN 3 THEN NULL ELSE CAST(2 + n_nationkey * 3 AS BIGINT) END AS max_alerts_per_month
FROM nation WHERE n_nationkey <> 4""",
    "offers": """
SELECT 'off-' || s_suppkey AS offer_id, 'src-' || s_suppkey AS source_id, 'tenant-' || (s_suppkey % 5) AS owner_tenant_id,
       CASE WHEN s_suppkey % 6 = 2 THEN 'revoked' ELSE 'active' END AS status, CAST(1 + s_suppkey % 4 AS INT) AS promote_at
FROM supplier""",
    "consents": """
SELECT o_orderkey AS consent_id, 'off-' || (o_orderkey % 12) AS offer_id, 'tenant-' || (o_custkey % 5) AS tenant_id,
       CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'revoked' ELSE 'pending' END AS status, o_orderdate AS changed_at
FROM orders""",
}
FIXTURES["feature_vectors"] = "SELECT detection_id, 'v' || (arrival % 2) AS version, risk_score AS score, created_at, arrival FROM detections"


def _payloads(parser: str, arms: list[str], tail: str = "") -> str:
    """Payload texts of one parser: ``arms`` are SQL text expressions chosen by event id."""
    cases = " ".join(f"WHEN {i} THEN {a}" for i, a in enumerate(arms))
    return f"SELECT event_id, ts AS received_at, '{parser}' AS parser_name, CASE event_id % {len(arms)} {cases} END AS payload, value, user_id{tail} FROM events"


def _num(x: str = "value") -> str:
    return f"' || CAST(round({x}, 3) AS STRING) || '"


_MS = "' || CAST(1700000000000 + event_id * 1000 AS STRING) || '"
_S = "' || CAST(1700000000 + event_id AS STRING) || '"

#: 64 hexadecimal digits of a small number; of a negative one; of 2**96 times a small factor.
WORD = "lpad(lower(hex(CAST({x} AS BIGINT))), 64, '0')"

FIXTURES |= {
    "raw_binance": _payloads("binance_miniticker_v1", [f"'{{\"s\":\"USDCUSDT\",\"c\":\"{_num()}\",\"E\":{_MS},\"id\":\"b' || event_id || '\"}}'", f"'{{\"s\":\"DAI-USD\",\"price\":{_num()}}}'", "'{\"s\":\"FRAXUSDC\"}'", "'{\"c\":\"1.0\"}'"]),
    "raw_coinbase": _payloads("coinbase_ticker_v1", [f"'{{\"product_id\":\"USDC-USD\",\"price\":\"{_num()}\",\"timestamp\":\"2024-01-02T03:04:05Z\",\"sequence_num\":' || event_id || '}}'", f"'{{\"events\":[{{\"tickers\":[{{\"product_id\":\"DAI-EUR\",\"price\":\"{_num()}\"}},{{\"product_id\":\"X-Y\",\"price\":\"9\"}}]}}]}}'", "'{\"product_id\":\"USDC-USD\"}'", "'{\"price\":\"1\"}'"]),
    "raw_kraken": _payloads("kraken_ticker_v2", [f"'{{\"symbol\":\"USDC/USD\",\"last\":{_num()}}}'", f"'{{\"symbol\":\"DAI/USDT\",\"last\":{{\"price\":\"{_num()}\"}}}}'", f"'{{\"data\":[{{\"symbol\":\"USDT/USD\",\"last\":{_num()}}}],\"time_in\":\"2024-01-02T03:04:05Z\"}}'", "'{\"symbol\":\"USDC/USD\"}'", "'{\"last\":1}'"]),
    "raw_okx": _payloads("okx_tickers_v5", [f"'{{\"data\":[{{\"instId\":\"DAI-USDT\",\"last\":\"{_num()}\",\"ts\":\"{_MS}\"}}]}}'", f"'{{\"instId\":\"USDC-USDT\",\"lastPrice\":\"{_num()}\",\"ts\":{_MS}}}'", "'{\"data\":[{\"instId\":\"DAI-USDT\"}]}'", "'{\"data\":[]}'"]),
    "raw_bybit": _payloads("bybit_tickers_v5", [f"'{{\"topic\":\"tickers.usdcusdt\",\"data\":{{\"lastPrice\":\"{_num()}\"}},\"ts\":{_MS}}}'", f"'{{\"data\":[{{\"symbol\":\"DAIUSDT\",\"last\":\"{_num()}\"}}]}}'", "'{\"topic\":\"tickers.\",\"lastPrice\":\"1\"}'", "'{\"symbol\":\"DAIUSDT\"}'"]),
    "raw_gate": _payloads("gate_ticker_v4", [f"'{{\"time\":{_S},\"time_ms\":{_MS},\"result\":{{\"currency_pair\":\"USDC_USDT\",\"last\":\"{_num()}\"}}}}'", f"'{{\"currency_pair\":\"dai_usdc\",\"close\":\"{_num()}\",\"time\":{_S}}}'", f"'{{\"result\":[{{\"currency_pair\":\"FRAX_EUR\",\"lastPrice\":{_num()}}}]}}'", "'{\"result\":{\"last\":\"1\"}}'", "'{\"result\":{\"currency_pair\":\"USDC_USDT\"}}'", "'{\"currency_pair\":\"USDC\",\"last\":\"1\"}'"]),
    "raw_gemini": _payloads("gemini_marketdata_v1", [f"'{{\"symbol\":\"USDCUSD\",\"price\":\"{_num()}\",\"timestampms\":{_MS},\"socket_sequence\":' || event_id || '}}'", f"'{{\"symbol\":\"DAIUSD\",\"events\":[{{\"type\":\"x\"}},{{\"price\":\"{_num()}\",\"timestampms\":{_MS}}}]}}'", "'{\"symbol\":\"USDCUSD\",\"events\":[]}'", "'{\"last\":\"2\"}'"]),
    "raw_pyth": _payloads("pyth_hermes_v2", [
        "'{\"id\":\"f1\",\"price\":{\"price\":\"' || CAST(99000000 + event_id AS STRING) || '\",\"conf\":\"50000\",\"expo\":-8,\"publish_time\":' || CAST(1700000000 + event_id AS STRING) || '},\"ema_price\":{\"price\":\"' || CAST(99900000 + event_id AS STRING) || '\",\"conf\":\"40000\",\"expo\":-8,\"publish_time\":' || CAST(1700000000 + event_id AS STRING) || '},\"metadata\":{\"symbol\":\"Crypto.USDC/USDT\"}}'",
        "'{\"price_feed\":{\"id\":\"f2\",\"symbol\":\"Crypto.DAI/EUR\",\"price\":{\"price\":\"' || CAST(1000 + event_id AS STRING) || '\",\"expo\":-3,\"publish_time\":1700000000}}}'",
        "'{\"id\":\"f3\"}'", "'{\"id\":\"f4\",\"price\":{\"price\":\"-5\",\"expo\":-3}}'"]),
    "raw_evm": _payloads("evm_log_v1", ["'{\"transactionHash\":\"0xt' || event_id || '\",\"blockNumber\":\"0x' || lower(hex(CAST(1000 + event_id AS BIGINT))) || '\",\"logIndex\":\"0x2\",\"chainId\":1,\"topics\":[\"0xa\",\"0xb\"],\"address\":\"0xc\",\"timestamp\":' || CAST(1700000000 + event_id AS STRING) || '}'", "'{\"tx_hash\":\"0xt' || event_id || '\",\"block_number\":' || event_id || ',\"log_index\":\"7\",\"chain_id\":\"8453\",\"topic0\":\"0xq\"}'", "'{}'"]),
    "raw_answer": _payloads("chainlink_answer_updated_v1", [
        f"'{{\"topics\":[\"0xa\",\"0x' || {WORD.format(x='99000000 + event_id')} || '\",\"0x' || {WORD.format(x='event_id')} || '\"],\"data\":\"0x' || {WORD.format(x='1700000000')} || '\"}}'",
        f"'{{\"topics\":[\"0xa\"],\"data\":\"0x' || {WORD.format(x='1000 + event_id')} || {WORD.format(x='7')} || {WORD.format(x='1700000000 + event_id')} || '\"}}'",
        "'{\"topics\":[\"0xa\",\"0x' || repeat('f', 62) || '00\"],\"updatedAt\":1700000001}'",
        "'{\"topics\":[\"0xa\"]}'"]),
    "raw_v2": _payloads("uniswap_v2_swap_price_v1", [
        f"'{{\"data\":\"0x' || {WORD.format(x='1000000 + event_id')} || {WORD.format(x='0')} || {WORD.format(x='0')} || {WORD.format(x='990000 + event_id')} || '\"}}'",
        f"'{{\"data\":\"0x' || {WORD.format(x='0')} || {WORD.format(x='500000 + event_id')} || {WORD.format(x='510000')} || {WORD.format(x='0')} || '\"}}'",
        f"'{{\"data\":\"0x' || {WORD.format(x='7 + event_id')} || {WORD.format(x='5')} || {WORD.format(x='3')} || {WORD.format(x='2')} || '\"}}'",
        "'{\"data\":\"0x' || repeat('0', 256) || '\"}'", "'{\"data\":\"0x00\"}'", "'{}'"]),
    "raw_v3": _payloads("uniswap_v3_swap_price_v1", [
        f"'{{\"data\":\"0x' || {WORD.format(x='5')} || {WORD.format(x='6')} || lpad(lower(hex(CAST(1000 + event_id % 50 AS BIGINT))) || repeat('0', 24), 64, '0') || '\"}}'",
        f"'{{\"data\":\"0x' || {WORD.format(x='2000 + event_id')} || repeat('f', 61) || '800' || {WORD.format(x='0')} || '\"}}'",
        "'{\"data\":\"0x' || repeat('0', 192) || '\"}'", "'{\"data\":\"0x' || repeat('0', 64) || '\"}'", "'{}'"]),
    "raw_tvl": _payloads("protocol_tvl_v1", [f"'{{\"protocol_id\":\" Aave \",\"chainId\":1,\"tvl_usd\":\"{_num()}\",\"timestamp\":{_MS}}}'", f"'{{\"protocol\":\"Curve\",\"chain_slug\":\"Base\",\"tvl_native\":{_num()},\"price_usd\":2.5,\"market_id\":\"All\"}}'", "'{\"protocol_id\":\"x\",\"tvl_raw\":\"' || CAST(event_id AS STRING) || '000\",\"decimals\":3,\"price_usd\":\"2\",\"market_id\":\"M1\",\"event_type\":\"snap\"}'", "'{\"protocol_id\":\"x\",\"tvl_usd\":-1}'", "'{\"tvl_usd\":5}'"]),
    "raw_pause": _payloads("protocol_pause_v1", ["'{\"protocol_id\":\"Aave\",\"paused\":true,\"chain_slug\":\"base\"}'", "'{\"protocol_id\":\"Aave\",\"is_paused\":0,\"chainId\":\"10\"}'", "'{\"protocol\":\"Curve\",\"paused\":\"Unpaused\"}'", "'{\"protocol\":\"Curve\",\"paused\":\"maybe\"}'", "'{\"paused\":true}'", "'{\"protocol\":\"Curve\",\"paused\":1,\"event_type\":\"halt\"}'"]),
    "raw_legacy": "SELECT event_id, ts AS received_at, CASE event_id % 6 WHEN 0 THEN 'legacy_binance' WHEN 1 THEN 'legacy_coinbase' WHEN 2 THEN 'legacy_uniswap' WHEN 3 THEN 'legacy_curve' WHEN 4 THEN 'legacy_chainlink' ELSE 'legacy_pyth' END AS parser_name, "
    "CASE WHEN event_type = 'error' THEN '{\"oops\":1}' ELSE CASE event_id % 6 "
    f"WHEN 0 THEN '{{\"data\":{{\"s\":\"USDCUSDT\",\"p\":\"{_num()}\",\"E\":{_MS}}}}}' WHEN 1 THEN '{{\"type\":\"ticker\",\"product_id\":\"DAI-USD\",\"price\":\"{_num()}\",\"time\":\"2024-01-02T03:04:05Z\"}}' "
    f"WHEN 2 THEN '{{\"pair\":\"USDC/WETH\",\"mid_price\":{_num()},\"timestamp\":{_S}}}' WHEN 3 THEN '{{\"symbol\":\"3CRV\",\"virtual_price\":\"{_num()}\",\"time\":\"{_S}\"}}' "
    f"WHEN 4 THEN '{{\"feed\":\"USDC/USD\",\"answer\":{_num()},\"updated_at\":{_S}}}' ELSE '{{\"price_feed\":{{\"symbol\":\"DAI/USD\",\"price\":\"{_num()}\",\"publish_time\":{_S}}}}}' END END AS payload, value FROM events",
    "flash_logs": f"""
SELECT event_id, ts AS received_at, CASE user_id % 3 WHEN 0 THEN 'Aave V3' WHEN 1 THEN 'balancer' ELSE 'other' END AS protocol,
       CASE WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 3 = 0 THEN 3 ELSE 4 END AS n_topics,
       '0x' || repeat('0', 24) || lpad(lower(hex(CAST(user_id AS BIGINT))), 40, 'a') AS topic1, '0x' || repeat('0', 24) || lpad(lower(hex(CAST(event_id AS BIGINT))), 40, 'b') AS topic2,
       '0x' || repeat('0', 24) || lpad(lower(hex(CAST(event_id AS BIGINT))), 40, 'c') AS topic3,
       '0x' || {WORD.format(x='1000000 + event_id')} || {WORD.format(x='250')} || CASE WHEN event_id % 2 = 0 THEN {WORD.format(x='900')} || {WORD.format(x='0')} ELSE '' END AS data
FROM events""",
}
FIXTURES["raw_payloads"] = " UNION ALL ".join(f"SELECT event_id, received_at, parser_name, payload FROM {n}" for n in FIXTURES if n.startswith("raw_"))
