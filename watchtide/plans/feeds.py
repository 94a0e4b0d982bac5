"""Queries of the feed parsers and the column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys, numbers, severity, symbols, texts, times
from ..operators.feeds import LEGACY, normalize_by_parser, normalize_feed
from ..sources.shared import shared_folder
from .registry import ORACLES, query, view


def _json(path: str) -> str:
    return f"json_extract_string(payload, '$.{path}')"


def _num(x: str) -> str:
    return f"TRY_CAST({x} AS DOUBLE)"


def pair_sql(x: str, part: int) -> str:
    c = f"translate(upper(trim({x})), ': ', '')"
    out = "CASE "
    for mark in "/-":
        parts = f"list_filter(string_split({c}, '{mark}'), lambda p: p <> '')"
        out += f"WHEN contains({c}, '{mark}') AND len({parts}) >= 2 THEN {parts}[{part}] "
    for s in symbols.SUFFIXES:
        out += f"WHEN ends_with({c}, '{s}') AND length({c}) > {len(s)} THEN " + (f"left({c}, length({c}) - {len(s)}) " if part == 1 else f"'{s}' ")
    return out + "END"


def market_sql(x: str) -> str:
    q = pair_sql(x, 2)
    return f"({pair_sql(x, 1)}) || '/' || (CASE WHEN ({q}) IN ('USD', 'USDT', 'USDC') THEN 'USD' ELSE ({q}) END)"


def _parsed(raw: DataFrame, *parsers: str, **config: str) -> DataFrame:
    raw = raw.withColumnRenamed("event_id", "row_id").select("row_id", "received_at", "parser_name", "payload")
    for k, v in config.items():
        raw = raw.withColumn(k, F.lit(v))
    got = normalize_feed(raw, parsers)
    return got.withColumn("price", F.round("price", 6)).withColumn("event_ms", F.unix_millis("event_ts"))


def _ticker(name: str, fixture: str, parser: str, sym: str, price: str, missing: tuple[str, str], ms: str = "NULL", extra: str = "") -> None:
    sql = f"""
WITH p AS (SELECT event_id AS row_id, {sym} AS sym, {price} AS price, {ms} AS ms FROM {fixture}),
e AS (SELECT *, CASE WHEN sym IS NULL THEN '{missing[0]}' WHEN price IS NULL THEN '{missing[1]}' {extra} END AS parse_error FROM p)
SELECT row_id, CASE WHEN parse_error IS NULL THEN sym END AS asset_pair, CASE WHEN parse_error IS NULL THEN {market_sql('sym')} END AS market_key,
       CASE WHEN parse_error IS NULL THEN round(price, 6) END AS price, CASE WHEN parse_error IS NULL THEN CAST(ms AS BIGINT) END AS event_ms, parse_error FROM e"""

    @query(name, sql)
    def run(spark, sf_dir):
        return _parsed(view(spark, sf_dir, fixture), parser).select("row_id", "asset_pair", "market_key", "price", "event_ms", "parse_error")


_ISO = "epoch_ms(CAST(replace(replace({x}, 'T', ' '), 'Z', '') AS TIMESTAMP))"
_ticker("c01_binance_ticker", "raw_binance", "binance_miniticker_v1", _json("s"), f"coalesce({_num(_json('c'))}, {_num(_json('price'))})", ("missing_binance_symbol", "missing_binance_price"), f"CAST({_json('E')} AS BIGINT)")
_ticker("c02_coinbase_ticker", "raw_coinbase", "coinbase_ticker_v1", f"coalesce({_json('product_id')}, {_json('events[0].tickers[0].product_id')})", f"{_num('coalesce(' + _json('price') + ', ' + _json('events[0].tickers[0].price') + ')')}", ("missing_coinbase_product_id", "missing_coinbase_price"), _ISO.format(x=_json("timestamp")))
_ticker("c03_kraken_ticker", "raw_kraken", "kraken_ticker_v2", f"coalesce({_json('symbol')}, {_json('data[0].symbol')})", f"coalesce({_num(_json('last'))}, {_num(_json('last.price'))}, {_num(_json('data[0].last'))})", ("missing_kraken_symbol", "missing_kraken_last"), _ISO.format(x=_json("time_in")))
_ticker("c04_okx_ticker", "raw_okx", "okx_tickers_v5", f"coalesce({_json('instId')}, {_json('data[0].instId')})", f"coalesce({_num(_json('lastPrice'))}, {_num(_json('data[0].last'))})", ("missing_okx_inst_id", "missing_okx_last"), f"CAST(coalesce({_json('ts')}, {_json('data[0].ts')}) AS BIGINT)")
_ticker("c05_bybit_ticker", "raw_bybit", "bybit_tickers_v5", f"coalesce({_json('symbol')}, nullif(upper(regexp_extract({_json('topic')}, '^tickers\\.(.+)$', 1)), ''), {_json('data[0].symbol')})", f"coalesce({_num(_json('lastPrice'))}, {_num(_json('data.lastPrice'))}, {_num(_json('data[0].last'))})", ("missing_bybit_symbol", "missing_bybit_last_price"), f"CAST({_json('ts')} AS BIGINT)")
_G = "coalesce(" + ", ".join(_json(x) for x in ("result.currency_pair", "result[0].currency_pair", "currency_pair")) + ")"
_ticker("c06_gate_ticker", "raw_gate", "gate_ticker_v4", f"upper(replace({_G}, '_', '/'))", "coalesce(" + ", ".join(_num(_json(x)) for x in ("result.last", "result[0].lastPrice", "last", "close")) + ")", ("missing_gate_currency_pair", "missing_gate_last_price"), f"coalesce(CAST({_json('time_ms')} AS BIGINT), CAST({_json('time')} AS BIGINT) * 1000)", "WHEN NOT contains(sym, '/') THEN 'unparseable_gate_pair:' || sym")
_ticker("c07_gemini_marketdata", "raw_gemini", "gemini_marketdata_v1", _json("symbol"), f"coalesce({_num(_json('price'))}, {_num(_json('last'))}, {_num(_json('events[1].price'))})", ("missing_gemini_symbol", "missing_gemini_price"), f"CAST(coalesce({_json('timestampms')}, {_json('events[1].timestampms')}) AS BIGINT)")


@query("c08_evm_log", """
SELECT event_id AS row_id, coalesce(json_extract_string(payload, '$.transactionHash'), json_extract_string(payload, '$.tx_hash')) AS tx_hash,
       CASE event_id % 3 WHEN 0 THEN 1000 + event_id WHEN 1 THEN event_id END AS block_number,
       CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 7 END::BIGINT AS log_index, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 8453 END::BIGINT AS chain_id,
       CASE event_id % 3 WHEN 0 THEN '0xa' WHEN 1 THEN '0xq' END AS topic0, CASE event_id % 3 WHEN 0 THEN (1700000000 + event_id) * 1000 END AS event_ms
FROM raw_evm""")  # fmt: skip
def evm_log(spark, sf_dir):
    return _parsed(view(spark, sf_dir, "raw_evm"), "evm_log_v1").select("row_id", "tx_hash", "block_number", "log_index", "chain_id", "topic0", "event_ms")


@query("c09_oracle_answer", """
SELECT event_id AS row_id, round(CASE event_id % 4 WHEN 0 THEN (99000000 + event_id) / 1e8 WHEN 1 THEN (1000 + event_id) / 1e8 WHEN 2 THEN -256 / 1e8 END, 6) AS price,
       CASE event_id % 4 WHEN 0 THEN 1700000000000 WHEN 1 THEN (1700000000 + event_id) * 1000 WHEN 2 THEN 1700000001000 END AS event_ms,
       CAST(CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN 7 END AS BIGINT) AS round_id
FROM raw_answer""")  # fmt: skip
def oracle_answer(spark, sf_dir):
    got = _parsed(view(spark, sf_dir, "raw_answer"), "chainlink_answer_updated_v1")
    return got.select("row_id", "price", "event_ms", F.col("normalized")["round_id"].cast("double").cast("bigint").alias("round_id"))


@query("c10_pyth_price", """
SELECT event_id AS row_id, round(CASE event_id % 4 WHEN 0 THEN (99900000 + event_id) * 1e-8 WHEN 1 THEN (1000 + event_id) * 1e-3 END, 6) AS price,
       CASE event_id % 4 WHEN 0 THEN 'USDC/USD' WHEN 1 THEN 'DAI/EUR' END AS market_key, CASE event_id % 4 WHEN 0 THEN 'USDC/USDT' WHEN 1 THEN 'DAI/EUR' END AS asset_pair,
       CASE event_id % 4 WHEN 0 THEN 'f1:' || (1700000000 + event_id) WHEN 1 THEN 'f2:1700000000' END AS event_id,
       CASE event_id % 4 WHEN 2 THEN 'missing_pyth_price_object' WHEN 3 THEN 'invalid_pyth_price_mantissa_or_expo' END AS parse_error
FROM raw_pyth""")  # fmt: skip
def pyth_price(spark, sf_dir):
    return _parsed(view(spark, sf_dir, "raw_pyth"), "pyth_hermes_v2").select("row_id", "price", "market_key", "asset_pair", "event_id", "parse_error")


@query("c11_swap_amounts", """
SELECT event_id AS row_id, CASE event_id % 6 WHEN 0 THEN '["' || (1000000 + event_id) || '","0","0","' || (990000 + event_id) || '"]' WHEN 1 THEN '["0","' || (500000 + event_id) || '","510000","0"]'
       WHEN 2 THEN '["' || (7 + event_id) || '","5","3","2"]' WHEN 3 THEN '["0","0","0","0"]' ELSE '[]' END AS swap_amounts
FROM raw_v2""")  # fmt: skip
def swap_amounts(spark, sf_dir):
    raw = view(spark, sf_dir, "raw_v2").withColumn("parser_name", F.lit("uniswap_v2_swap_v1"))
    return _parsed(raw, "uniswap_v2_swap_v1").select("row_id", F.col("normalized")["swap_amounts"].alias("swap_amounts"))


_V2_PRICE = """CASE event_id % 6 WHEN 0 THEN ((990000 + event_id) / 1e6) / ((1000000 + event_id) / 1e6) WHEN 1 THEN ((500000 + event_id) / 1e6) / (510000 / 1e6)
       WHEN 2 THEN (2.0 / (7 + event_id)) END"""
_V2_ERROR = """CASE event_id % 6 WHEN 3 THEN 'unable_to_derive_uniswap_v2_price' WHEN 4 THEN 'invalid_uniswap_v2_swap_data' WHEN 5 THEN 'missing_uniswap_v2_swap_data' END"""
_POOL = '{"token0_symbol":"usdc","token1_symbol":"USDT","token0_decimals":6,"token1_decimals":6}'


@query("c12_v2_swap_price", f"SELECT event_id AS row_id, round({_V2_PRICE}, 6) AS price, CASE WHEN event_id % 6 < 3 THEN 'USDC/USD' END AS market_key, {_V2_ERROR} AS parse_error FROM raw_v2")
def v2_swap_price(spark, sf_dir):
    return _parsed(view(spark, sf_dir, "raw_v2"), "uniswap_v2_swap_price_v1", filter_config=_POOL).select("row_id", "price", "market_key", "parse_error")


_V3_PRICE = "CASE event_id % 5 WHEN 0 THEN pow((1000 + event_id % 50) * pow(2.0, 96), 2) / pow(2.0, 192) * 1e-12 WHEN 1 THEN (2048 / 1e18) / ((2000 + event_id) / 1e6) END"
_V3_ERROR = """CASE event_id % 5 WHEN 2 THEN 'unable_to_derive_uniswap_v3_price' WHEN 3 THEN 'invalid_uniswap_v3_swap_data' WHEN 4 THEN 'missing_uniswap_v3_swap_data' END"""
_POOL3 = '{"token0_symbol":"USDC","token1_symbol":"WETH","base_symbol":"WETH","token0_decimals":6,"token1_decimals":18}'


@query("c13_v3_swap_price", f"SELECT event_id AS row_id, round(1.0 / ({_V3_PRICE}) / 1e6, 6) AS price_m, CASE WHEN event_id % 5 < 2 THEN 'WETH/USD' END AS market_key, {_V3_ERROR} AS parse_error FROM raw_v3")
def v3_swap_price(spark, sf_dir):
    raw = view(spark, sf_dir, "raw_v3").withColumnRenamed("event_id", "row_id").withColumn("filter_config", F.lit(_POOL3))
    got = normalize_feed(raw.select("row_id", "received_at", "parser_name", "payload", "filter_config"), ("uniswap_v3_swap_price_v1",))
    return got.select("row_id", F.round(F.col("price") / 1e6, 6).alias("price_m"), "market_key", "parse_error")


@query("c14_aerodrome_price", f"""
SELECT event_id AS row_id, round({_V2_PRICE}, 6) AS price, 'aerodrome_basic_pool:' || {_V2_ERROR} AS parse_error FROM raw_v2
UNION ALL SELECT -1 - event_id, NULL, 'aerodrome_cl_pool:' || CASE WHEN event_id % 6 < 4 THEN 'x' END FROM raw_v2 WHERE event_id % 6 = 6""")  # fmt: skip
def aerodrome_price(spark, sf_dir):
    raw = view(spark, sf_dir, "raw_v2").withColumn("parser_name", F.lit("aerodrome_swap_price_v1"))
    return _parsed(raw, "aerodrome_swap_price_v1", filter_config=_POOL[:-1] + ',"pool_type":"Volatile"}').select("row_id", "price", "parse_error")


@query("c15_protocol_tvl", """
SELECT event_id AS row_id, CASE event_id % 5 WHEN 0 THEN 'aave' WHEN 1 THEN 'curve' WHEN 2 THEN 'x' END AS protocol_id, CASE event_id % 5 WHEN 0 THEN 'ethereum' WHEN 1 THEN 'base' WHEN 2 THEN 'unknown' END AS chain_slug,
       round(CASE event_id % 5 WHEN 0 THEN round(value, 3) WHEN 1 THEN round(value, 3) * 2.5 WHEN 2 THEN event_id * 2.0 END, 6) AS tvl_usd, CASE event_id % 5 WHEN 2 THEN 'm1' END AS market_id,
       CASE event_id % 5 WHEN 0 THEN 'tvl' WHEN 1 THEN 'tvl' WHEN 2 THEN 'snap' END AS event_type, CASE WHEN event_id % 5 = 3 THEN 'missing_tvl_usd' WHEN event_id % 5 = 4 THEN 'missing_protocol_id' END AS parse_error
FROM raw_tvl""")  # fmt: skip
def protocol_tvl(spark, sf_dir):
    got = _parsed(view(spark, sf_dir, "raw_tvl"), "protocol_tvl_v1", event_type="tvl")
    return got.select("row_id", F.col("normalized")["protocol_id"].alias("protocol_id"), F.col("normalized")["chain_slug"].alias("chain_slug"), F.round(F.col("normalized")["tvl_usd"].cast("double"), 6).alias("tvl_usd"), F.col("normalized")["market_id"].alias("market_id"), "event_type", "parse_error")


@query("c16_protocol_pause", """
SELECT event_id AS row_id, CASE event_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'false' WHEN 5 THEN 'true' END AS paused,
       CASE event_id % 6 WHEN 0 THEN 'base' WHEN 1 THEN 'optimism' WHEN 2 THEN 'unknown' WHEN 5 THEN 'unknown' END AS chain_slug,
       CASE event_id % 6 WHEN 0 THEN 'protocol_pause' WHEN 1 THEN 'protocol_unpause' WHEN 2 THEN 'protocol_unpause' WHEN 5 THEN 'halt' END AS event_type,
       CASE event_id % 6 WHEN 3 THEN 'missing_pause_state' WHEN 4 THEN 'missing_protocol_id' END AS parse_error
FROM raw_pause""")  # fmt: skip
def protocol_pause(spark, sf_dir):
    got = _parsed(view(spark, sf_dir, "raw_pause"), "protocol_pause_v1", event_type="protocol_pause")
    return got.select("row_id", F.col("normalized")["paused"].alias("paused"), F.col("normalized")["chain_slug"].alias("chain_slug"), "event_type", "parse_error")


@query("c19_legacy_quotes", """
SELECT event_id AS row_id, CASE WHEN bad THEN NULL ELSE CASE event_id % 6 WHEN 0 THEN 'USDCUSDT' WHEN 1 THEN 'DAI-USD' WHEN 2 THEN 'USDC/WETH' WHEN 3 THEN '3CRV' WHEN 4 THEN 'USDC/USD' ELSE 'DAI/USD' END END AS market_key,
       CASE WHEN bad THEN NULL ELSE round(value, 3) END AS price,
       CASE WHEN bad THEN NULL ELSE CASE event_id % 6 WHEN 0 THEN 1700000000000 + event_id * 1000 WHEN 1 THEN epoch_ms(TIMESTAMP '2024-01-02 03:04:05') ELSE (1700000000 + event_id) * 1000 END END AS event_ms,
       CASE WHEN bad THEN 'missing_' || substr(parser_name, 8) || '_symbol' END AS parse_error
FROM (SELECT *, payload = '{"oops":1}' AS bad FROM raw_legacy)""")  # fmt: skip
def legacy_quotes(spark, sf_dir):
    names = tuple(f"legacy_{x}" for x in ("binance", "coinbase", "uniswap", "curve", "chainlink", "pyth"))
    return _parsed(view(spark, sf_dir, "raw_legacy"), *names).select("row_id", "market_key", "price", "event_ms", "parse_error")


#: By parser: where its rows' prices and errors come from in SQL.
_PRICED = {
    "binance_miniticker_v1": "c01_binance_ticker", "coinbase_ticker_v1": "c02_coinbase_ticker", "kraken_ticker_v2": "c03_kraken_ticker", "okx_tickers_v5": "c04_okx_ticker", "bybit_tickers_v5": "c05_bybit_ticker",
    "gate_ticker_v4": "c06_gate_ticker", "gemini_marketdata_v1": "c07_gemini_marketdata", "pyth_hermes_v2": "c10_pyth_price", "uniswap_v2_swap_price_v1": "c12_v2_swap_price",
}
_COUNTED = "CAST(count(*) AS BIGINT) AS n, CAST(count(parse_error) AS BIGINT) AS n_failed, CAST(count(price) AS BIGINT) AS n_priced, round(sum(price), 2)::DOUBLE AS price_sum, CAST(count(DISTINCT market_key) AS BIGINT) AS markets"


def _all_sql() -> str:
    parts = [f"SELECT '{name}' AS parser_name, {_COUNTED} FROM ({ORACLES[q]})" for name, q in _PRICED.items()]
    parts.append(f"SELECT 'chainlink_answer_updated_v1', {_COUNTED} FROM (SELECT price, NULL AS parse_error, NULL AS market_key FROM ({ORACLES['c09_oracle_answer']}))")
    parts.append(f"SELECT 'uniswap_v3_swap_price_v1', {_COUNTED} FROM (SELECT price_m AS price, parse_error, market_key FROM ({ORACLES['c13_v3_swap_price']}))")
    parts.append(f"SELECT 'evm_log_v1', {_COUNTED} FROM (SELECT NULL::DOUBLE AS price, NULL AS parse_error, NULL AS market_key FROM ({ORACLES['c08_evm_log']}))")
    parts.append(f"SELECT 'protocol_tvl_v1', {_COUNTED} FROM (SELECT NULL::DOUBLE AS price, parse_error, NULL AS market_key FROM ({ORACLES['c15_protocol_tvl']}))")
    legacy = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(LEGACY))
    parts.append(f"SELECT CASE row_id % 6 {legacy} END, {_COUNTED} FROM ({ORACLES['c19_legacy_quotes']}) GROUP BY row_id % 6")
    parts.append(f"SELECT 'protocol_pause_v1', {_COUNTED} FROM (SELECT NULL::DOUBLE AS price, parse_error, NULL AS market_key FROM ({ORACLES['c16_protocol_pause']}))")
    return " UNION ALL ".join(parts)


@query("c00_normalize_all", _all_sql())
def normalize_all(spark, sf_dir):
    """The mixed feed lands by parser and is parsed, each parser reading its own rows: what they made of it."""
    landing = shared_folder(spark, "landing")
    view(spark, sf_dir, "raw_payloads").write.partitionBy("parser_name").parquet(landing)
    names = (*_PRICED, "chainlink_answer_updated_v1", "uniswap_v3_swap_price_v1", "evm_log_v1", "protocol_tvl_v1", "protocol_pause_v1", *LEGACY)
    raw = spark.read.schema("event_id long, received_at timestamp_ntz, payload string, parser_name string").parquet(landing).withColumnRenamed("event_id", "row_id")
    pool = F.when(F.col("parser_name") == "uniswap_v2_swap_price_v1", _POOL).when(F.col("parser_name") == "uniswap_v3_swap_price_v1", _POOL3)
    got = normalize_by_parser(raw.withColumn("filter_config", pool), names)
    v3 = F.col("parser_name") == "uniswap_v3_swap_price_v1"
    price = F.round(F.when(v3, F.col("price") / 1e6).otherwise(F.col("price")), 6)
    market = F.when(F.col("parser_name") != "chainlink_answer_updated_v1", F.col("market_key"))
    return got.groupBy("parser_name").agg(F.count("*").alias("n"), F.count("parse_error").alias("n_failed"), F.count(price).alias("n_priced"), F.round(F.sum(price), 2).alias("price_sum"), F.count_distinct(market).alias("markets"))


_SYMBOLS = """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'usdc/usdt' WHEN 1 THEN 'DAI-EUR' WHEN 2 THEN 'FRAXUSDC' WHEN 3 THEN ' weth:usd ' WHEN 4 THEN 'USD' WHEN 5 THEN 'a//b' WHEN 6 THEN '/x' ELSE upper(substr(p_name, 1, 3)) || '-USDT' END AS s FROM part"""


@query("j01_split_symbol", f"SELECT p_partkey, {pair_sql('s', 1)} AS base, {pair_sql('s', 2)} AS quote, {market_sql('s')} AS market_key FROM ({_SYMBOLS})")
def split_symbol(spark, sf_dir):
    """Pair, market key and quote."""
    df = spark.sql(_SYMBOLS.replace("FROM part", "FROM {part}"), part=view(spark, sf_dir, "part"))
    pair = symbols.split_symbol_pair(F.col("s"))
    return df.select("p_partkey", pair["base"].alias("base"), pair["quote"].alias("quote"), symbols.symbol_to_market_key(F.col("s")).alias("market_key"))


@query("j03_quote_asset", f"""SELECT p_partkey, coalesce(CASE WHEN p_partkey % 5 = 0 THEN 'USDX' END, {pair_sql('s', 2)}, 'USD') AS quote_asset FROM ({_SYMBOLS})""")
def quote_of(spark, sf_dir):
    df = spark.sql(_SYMBOLS.replace("FROM part", "FROM {part}"), part=view(spark, sf_dir, "part"))
    return df.select("p_partkey", symbols.quote_asset(F.when(F.col("p_partkey") % 5 == 0, "usdx"), F.col("s"), F.lit("X/USD")).alias("quote_asset"))


@query("j04_lenient_numbers", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN NULL ELSE NULL END AS n, round(CASE event_id % 4 WHEN 2 THEN event_id + 0.5 WHEN 0 THEN event_id END, 6)::DOUBLE AS x FROM events""")
def lenient(spark, sf_dir):
    e = view(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 4 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("0x"), F.lower(F.hex("event_id")))).when(F.col("event_id") % 4 == 2, F.concat(F.col("event_id").cast("string"), F.lit(".5"))).otherwise("n/a")
    return e.select("event_id", numbers.lenient_long(text).alias("n"), F.round(numbers.lenient_double(text), 6).alias("x"))


@query("j05_times", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1700000000000 + event_id WHEN 1 THEN (1700000000 + event_id) * 1000 WHEN 2 THEN epoch_ms(TIMESTAMP '2024-05-06 07:08:09') END AS ms,
CASE event_id % 4 WHEN 0 THEN 1700000000000 + event_id WHEN 1 THEN (1700000000 + event_id) * 1000 WHEN 2 THEN epoch_ms(TIMESTAMP '2024-05-06 07:08:09') END AS guessed, CAST(greatest(1, CASE WHEN event_id % 2 = 0 THEN event_id % 7 ELSE ceil((event_id % 500) / 60.0) END) AS BIGINT) AS minutes FROM events""")
def event_times(spark, sf_dir):
    """Times by unit, the epoch guess, and window parameters."""
    e, k = view(spark, sf_dir, "events"), F.col("event_id") % 4
    text = F.when(k == 0, (F.col("event_id") + 1700000000000).cast("string")).when(k == 1, (F.col("event_id") + 1700000000).cast("string")).when(k == 2, "2024-05-06T07:08:09Z").otherwise("soon")
    unit = F.when(k == 0, "ms").when(k == 1, "s").otherwise("iso8601")
    minutes = times.window_minutes(F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 7), F.when(F.col("event_id") % 2 == 1, F.col("event_id") % 500))
    return e.select("event_id", F.unix_millis(times.by_unit(text, unit)).alias("ms"), F.unix_millis(times.epoch_guess(text)).alias("guessed"), minutes.alias("minutes"))


@query("j06_event_ids", "SELECT event_id AS row_id, CASE event_id % 4 WHEN 0 THEN 'b' || event_id END AS event_id FROM raw_binance UNION ALL SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) END FROM raw_coinbase")
def event_ids(spark, sf_dir):
    a = _parsed(view(spark, sf_dir, "raw_binance"), "binance_miniticker_v1").select("row_id", "event_id")
    return a.unionByName(_parsed(view(spark, sf_dir, "raw_coinbase"), "coinbase_ticker_v1").select("row_id", "event_id"))


@query("j07_hex_words", """SELECT event_id, event_id * 4294967296 + user_id AS u, round(CASE WHEN event_id % 2 = 0 THEN -(CAST(event_id AS DOUBLE) + 1) ELSE event_id END, 6)::DOUBLE AS i, round((CAST(event_id AS DOUBLE) * 4294967296 + user_id) / 1e6, 3) AS scaled FROM events""")
def hex_numbers(spark, sf_dir):
    e = view(spark, sf_dir, "events")
    word = F.lpad(F.concat(F.hex("event_id"), F.lpad(F.hex("user_id"), 8, "0")), 64, "0")
    plain = F.lpad(F.lower(F.hex("event_id")), 64, "0")
    signed = F.when(F.col("event_id") % 2 == 0, F.translate(plain, "0123456789abcdef", "fedcba9876543210")).otherwise(plain)
    w = F.get(numbers.hex_words(F.concat(F.lit("0x"), word)), F.lit(0))
    # places are rounded on the number itself, as F.round goes by its shortest decimal text
    scaled = F.round(numbers.scale(numbers.u256_to_double(w), F.lit(6)) * 1000, 0) / 1000
    return e.select("event_id", numbers.u256_to_long(w).alias("u"), F.round(numbers.i256_to_double(signed), 6).alias("i"), scaled.alias("scaled"))


@query("j08_dedup_keys", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'p:' || source_id || ':st:' || event_id ELSE sha256(concat_ws('|', 'p', source_id, 'st', coalesce(market_key, ''), tenant_id)) END AS dedup_key,
sha256(concat_ws('|', tenant_id, coalesce(market_key, ''))) AS digest, 'error:' || sha256(concat_ws('|', 'p', source_id, 'st', tenant_id, 'bad')) AS error_key FROM quotes""")
def dedup_keys(spark, sf_dir):
    """Deduplication keys and deterministic ids."""
    q = view(spark, sf_dir, "quotes")
    own = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string"))
    return q.select("event_id", keys.dedup_key(F.lit("p"), F.col("source_id"), F.lit("st"), own, F.col("market_key"), F.col("tenant_id")).alias("dedup_key"), keys.event_digest(F.col("tenant_id"), F.col("market_key")).alias("digest"), keys.error_key(F.lit("p"), F.col("source_id"), F.lit("st"), F.col("tenant_id"), F.lit("bad")).alias("error_key"))


_CHAINS = " ".join(f"WHEN {k} THEN '{v}'" for k, v in severity.CHAINS.items())


_NAMES = ["ethereum", "Mainnet", "BNB ", "bsc", "polygon", "base", "arbitrum", "optimism", "avalanche", "solana"]


@query("j09_chains", f"""WITH c AS (SELECT *, [1, 10, 56, 137, 8453, 42161, 43114, 7][1 + n_nationkey % 8] AS id, {_NAMES}[1 + n_nationkey % 10] AS raw FROM nation),
k AS (SELECT *, CASE lower(trim(raw)) WHEN 'mainnet' THEN 'ethereum' WHEN 'bnb' THEN 'bsc' WHEN 'solana' THEN 'unknown' ELSE lower(trim(raw)) END AS name FROM c)
SELECT n_nationkey, CASE id {_CHAINS} END AS slug, name, CASE name {" ".join(f"WHEN '{v}' THEN {k}" for k, v in severity.CHAINS.items())} END::BIGINT AS chain_id FROM k""")
def chains(spark, sf_dir):
    n = view(spark, sf_dir, "nation")
    ids = F.element_at(F.array(*(F.lit(x) for x in (*severity.CHAINS, 7))), (F.col("n_nationkey") % 8 + 1).cast("int"))
    raw = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("n_nationkey") % 10 + 1).cast("int"))
    return n.select("n_nationkey", severity.chain_slug(ids).alias("slug"), severity.chain_name(raw).alias("name"), severity.chain_id(raw).alias("chain_id"))


_RANK = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"


@query("j10_severity", f"SELECT detection_id, CAST({_RANK} AS INTEGER) AS rank, CASE WHEN risk_score >= 30 THEN 'critical' WHEN risk_score >= 20 THEN 'high' WHEN risk_score >= 10 THEN 'medium' END AS band, round(abs(risk_score - 20) / 20 * 100, 6) AS divergence FROM detections")
def severities(spark, sf_dir):
    """Ranks, bands and divergence."""
    d = view(spark, sf_dir, "detections")
    s = F.col("risk_score")
    return d.select("detection_id", severity.rank(severity.parse(F.upper("severity"))).alias("rank"), severity.band(s, F.lit(10.0), F.lit(20.0), F.lit(30.0)).alias("band"), F.round(severity.divergence_pct(s, F.lit(20.0)), 6).alias("divergence"))


@query("j12_names", """SELECT p_partkey, regexp_replace(lower(trim(p_name)), '[^a-z0-9]', '_', 'g') AS protocol, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name || '  (X)!'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'scenario') AS slug,
CASE WHEN p_partkey % 4 = 0 THEN 'exploit' WHEN p_partkey % 4 = 1 THEN 'market_stress' ELSE 'anomaly' END AS case_type FROM part""")
def names(spark, sf_dir):
    """Sanitised protocols, slugs, case types."""
    p, k = view(spark, sf_dir, "part"), F.col("p_partkey") % 4
    label = F.when(k == 0, "Flash-Loan").when(k == 1, "stable DEPEG").when(k == 2, "dpeg").otherwise(None)
    return p.select("p_partkey", texts.sanitise_protocol(F.col("p_name")).alias("protocol"), texts.slugify(F.concat("p_name", F.lit("  (X)!"))).alias("slug"), texts.case_type(label).alias("case_type"))


@query("j14_tokens", """WITH t AS (SELECT p_partkey, list_filter([lower(trim(p_name)), lower(trim(p_brand))], lambda x: x <> '') AS low FROM part),
x AS (SELECT p_partkey, list_concat(low, list_filter(flatten(list_transform(low, lambda s: string_split_regex(s, '[^a-z0-9]+'))), lambda w: length(w) > 2)) AS all_tokens FROM t)
SELECT p_partkey, array_to_string(list_sort(list_distinct(all_tokens)), ',') AS tokens, substr(sha256('{"a":' || p_partkey || ',"b":"x"}'), 1, 16) AS checksum FROM x""")
def token_lists(spark, sf_dir):
    """Scenario tokens and stable checksums."""
    p = view(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(texts.tokens(F.array("p_name", "p_brand")), ",").alias("tokens"), keys.stable_checksum(F.struct(F.col("p_partkey").alias("a"), F.lit("x").alias("b")), short=True).alias("checksum"))


def _said(table: dict, otherwise: tuple = ()) -> str:
    text = lambda x: "'" + "|".join(x) + "'"
    return f"CASE severity {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {text(v)}' for k, v in table.items())} ELSE {text(otherwise)} END"


@query("j15_actions", f"""SELECT detection_id, {_said(severity.PEG_ACTIONS)} AS peg, {_said(severity.DRAWDOWN_ACTIONS, severity.DRAWDOWN_OTHERWISE)} AS drawdown,
CASE WHEN arrival % 6 = 0 THEN 'x,y' ELSE CASE arrival % 5 WHEN 0 THEN 'dpeg' WHEN 1 THEN 'oracle_manipulation,flash_loan' WHEN 2 THEN 'flash_loan' WHEN 3 THEN 'flash_loan' ELSE 'anomaly' END END AS patterns,
CASE WHEN arrival % 4 = 0 THEN 'custom' WHEN arrival % 5 = 2 THEN 'flash_loan_candidate' ELSE 'oracle_update' END AS step_type,
asset_symbol AS base, CASE severity WHEN 'critical' THEN 95.0 WHEN 'high' THEN 80.0 WHEN 'medium' THEN 60.0 WHEN 'low' THEN 30.0 ELSE 10.0 END::DOUBLE AS drawdown_score, CASE severity WHEN 'critical' THEN 95.0 WHEN 'high' THEN 80.0 WHEN 'medium' THEN 60.0 WHEN 'low' THEN 35.0 ELSE 10.0 END::DOUBLE AS rule_score FROM detections""")
def actions(spark, sf_dir):
    """Supported patterns, step event types, actions, base assets, fixed scores."""
    d, s = view(spark, sf_dir, "detections"), F.col("severity")
    kind = F.element_at(F.array(*map(F.lit, ("Stable DEPEG", "oracle flash", "Flash-Loan", "exploit", "outage"))), (F.col("arrival") % 5 + 1).cast("int"))
    kind = F.when(F.col("arrival") % 5 == 1, "oracle").otherwise(kind)
    named = F.when(F.col("arrival") % 6 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>"))
    step = F.when(F.col("arrival") % 4 == 0, "custom")
    return d.select("detection_id", F.array_join(severity.peg_actions(s), "|").alias("peg"), F.array_join(severity.drawdown_actions(s), "|").alias("drawdown"), F.array_join(texts.supported_patterns(kind, named), ",").alias("patterns"), texts.step_event_type(kind, step).alias("step_type"),
                    symbols.base_asset(F.concat(F.lit("m:"), "asset_symbol", F.lit("/USD"))).alias("base"), severity.choose(s, severity.DRAWDOWN_SCORE).alias("drawdown_score"), severity.choose(s, severity.RULE_SCORE).alias("rule_score"))


@query("j22_risk_score", """WITH p AS (SELECT *, list_filter([CASE WHEN severity <> 'info' THEN {t: upper(severity[1]) || severity[2:] || ' severity baseline +' || b, f: 'severity_' || severity || '=' || b || ':' || upper(severity[1]) || severity[2:] || ' severity baseline', x: b} END,
  CASE WHEN n_rules > 0 THEN {t: 'Triggered rules present +20', f: 'triggered_rules=20:1 rule(s) triggered', x: 20} END,
  CASE WHEN arrival % 3 = 2 THEN {t: 'Oracle divergence triggered +25', f: 'oracle_divergence=25:' || CASE WHEN arrival % 4 = 0 THEN 'seen' ELSE 'divergence value: 1.5000' END, x: 25} END,
  CASE WHEN arrival % 2 = 0 THEN {t: 'Flash loan in trace summary +15', f: 'trace_flash_loan=15:trace enrichment indicates flash loan', x: 15} END], lambda y: y IS NOT NULL) AS parts
  FROM (SELECT *, CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 30 WHEN 'medium' THEN 20 WHEN 'low' THEN 10 ELSE 0 END AS b FROM detections)),
s AS (SELECT *, least(coalesce(list_sum(list_transform(parts, lambda y: y.x)), 0), 100) AS score FROM p)
SELECT detection_id, score::DOUBLE AS score, round(least(0.6 + score / 250.0, 0.99), 6)::DOUBLE AS confidence, array_to_string(list_transform(parts, lambda y: y.t), '|') AS rationale, array_to_string(list_transform(parts, lambda y: y.f), '|') AS attribution,
       CASE WHEN n_rules > 0 THEN concat_ws(':', 'incident', chain_slug, protocol, arrival) END AS incident_key FROM s""")
def risk(spark, sf_dir):
    """Risk scores with rationale and attribution, and incident keys."""
    d = view(spark, sf_dir, "detections")
    rules = F.when(F.col("n_rules") > 0, F.array(F.lit("r1"))).otherwise(F.array().cast("array<string>"))
    signal = lambda kind, label: F.struct(F.lit(kind).alias("type"), F.lit(1.5).alias("value"), label.cast("string").alias("label"))
    signals = F.slice(F.array(signal("price_deviation", F.lit(None)), signal("oracle_divergence", F.when(F.col("arrival") % 4 == 0, "seen"))), 1, (F.col("arrival") % 3).cast("int"))
    r = severity.risk_score(F.col("severity"), rules, signals, F.col("arrival") % 2 == 0)
    named = F.transform(r["attribution"], lambda a: F.concat(a["feature"], F.lit("="), a["contribution"].cast("int").cast("string"), F.lit(":"), a["detail"]))
    return d.select("detection_id", r["score"].alias("score"), F.round(r["confidence"], 6).alias("confidence"), F.array_join(r["rationale"], "|").alias("rationale"), F.array_join(named, "|").alias("attribution"), keys.incident_key(F.col("chain_slug"), F.col("protocol"), F.col("arrival"), rules).alias("incident_key"))
