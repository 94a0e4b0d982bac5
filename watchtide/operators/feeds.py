"""Feed normalisation: every payload parser in one projection.

``normalize_feed`` dispatches on ``parser_name`` with column expressions; there is no Python in the data path
and no shuffle. A payload that can't be parsed keeps its row, with ``parse_error`` set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.numbers import finite, hex_words, i256_to_double, lenient_double, lenient_long, scale, u256_to_double
from ..functions.severity import chain_slug
from ..functions.symbols import USD_LIKE, split_symbol_pair, symbol_to_market_key
from ..functions.times import by_unit, iso8601, millis, seconds

_FIELDS = ("event_type", "event_id", "market_key", "asset_pair", "price", "chain_id", "block_number", "tx_hash", "log_index", "topic0", "event_ts", "normalized", "parse_error")
_TYPES = dict.fromkeys(_FIELDS, "string") | {"price": "double", "chain_id": "bigint", "block_number": "bigint", "log_index": "bigint", "event_ts": "timestamp", "normalized": "map<string,string>"}


class _Payload:
    """A row's payload text. Its top-level fields are noted while parsers are put together, and then read all at once."""

    def __init__(self, name: str) -> None:
        self.text, self.fields = F.col(name), {}

    def get(self, path: str) -> Column:
        return F.col(self.fields.setdefault(path, f"__at_{path}")) if path.isidentifier() else F.get_json_object(self.text, f"$.{path}")

    def read(self, rows: DataFrame) -> DataFrame:
        """Add the fields that were noted: the text is parsed once for all of them, and once more to see if a key comes twice. Then
        the first one that isn't null counts, as everywhere, and not the last one as in ``json_tuple``."""
        if not self.fields:
            return rows
        keys = F.json_object_keys(self.text)
        rows = rows.select("*", F.json_tuple(self.text, *self.fields).alias(*(f"{n}_last" for n in self.fields.values()))).withColumn("__twice", F.size(F.array_distinct(keys)) < F.size(keys))
        first = {n: F.when(F.col("__twice"), F.get_json_object(self.text, f"$.{k}")).otherwise(F.col(f"{n}_last")) for k, n in self.fields.items()}
        return rows.withColumns(first)


def _at(payload: Column | _Payload, *paths: str) -> Column:
    """The first of the JSON paths that holds something."""
    return F.coalesce(*(payload.get(p) if isinstance(payload, _Payload) else F.get_json_object(payload, f"$.{p}") for p in paths))


def _first(items: Column, *names: str) -> Column:
    """In an array of maps, the first value under any of the names (the names in order, in each item)."""
    return F.get(F.filter(F.transform(items, lambda x: F.coalesce(*(F.try_element_at(x, F.lit(n)) for n in names))), lambda v: v.isNotNull()), F.lit(0))


def _items(payload: _Payload, path: str) -> Column:
    """An array of objects, or one object as an array of one."""
    text = _at(payload, path)
    array = F.when(text.startswith("["), text).when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]")))
    return F.coalesce(F.from_json(array, "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))


class _Input:
    def __init__(self) -> None:
        self.payload, self.hint, self.market, self.type = _Payload("payload"), F.col("asset_pair_hint"), F.col("market_key_hint"), F.col("event_type")
        path = F.regexp_replace(F.col("payload_ts_path"), r"^\$\.", "")
        raw = F.try_element_at(F.from_json(self.payload.text, "map<string,string>"), path)
        self.own_ts = F.when(F.col("payload_ts_path").isNotNull(), by_unit(raw, F.coalesce("payload_ts_unit", F.lit("ms"))))

    def config(self, name: str) -> Column:
        return F.get_json_object(F.col("filter_config"), f"$.{name}")

    def event_id(self) -> Column:
        return _at(self.payload, "id", "event_id", "sequence_num", "socket_sequence")


def _result(**fields: Column) -> Column:
    """A struct with all fields; where ``parse_error`` is set, the others are null."""
    given = F.struct(*(fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in _TYPES.items()))
    return let(given, lambda r: F.struct(*((r[n] if n == "parse_error" else F.when(r["parse_error"].isNull(), r[n])).alias(n) for n in _TYPES)))


def _ticker(i: _Input, name: str, symbol: Column, price: Column, ts: Column, missing: tuple[str, str], error=None) -> Column:
    """``error`` gives a further error from the symbol."""

    def read(r: Column) -> Column:
        symbol, price = r["symbol"], r["price"]
        problem = F.when(symbol.isNull(), missing[0]).when(price.isNull(), missing[1])
        return _result(
            event_type=i.type, event_id=i.event_id(), market_key=F.coalesce(i.market, symbol_to_market_key(symbol)), asset_pair=symbol, price=price,
            event_ts=F.coalesce(i.own_ts, ts), parse_error=F.coalesce(problem, error(symbol)) if error else problem,
            normalized=F.create_map(F.lit("symbol"), symbol, F.lit("raw_price"), price.cast("string"), F.lit("quote_asset"), split_symbol_pair(symbol)["quote"], F.lit("decoded_by"), F.lit(name)),
        )

    return let(F.struct(F.coalesce(symbol, i.hint).alias("symbol"), price.alias("price")), read)


def _binance(i: _Input) -> Column:
    p = i.payload
    return _ticker(i, "binance_miniticker_v1", _at(p, "s"), F.coalesce(lenient_double(_at(p, "c")), lenient_double(_at(p, "price"))), millis(_at(p, "E")), ("missing_binance_symbol", "missing_binance_price"))


def _coinbase(i: _Input) -> Column:
    p = i.payload
    events = F.from_json(_at(p, "events"), "array<struct<tickers:array<map<string,string>>>>")
    tickers = F.coalesce(F.flatten(F.filter(F.transform(events, lambda e: e["tickers"]), lambda t: t.isNotNull())), F.array().cast("array<map<string,string>>"))
    return _ticker(i, "coinbase_ticker_v1", F.coalesce(_at(p, "product_id"), _first(tickers, "product_id")), F.coalesce(lenient_double(_at(p, "price")), lenient_double(_first(tickers, "price", "last"))), iso8601(_at(p, "timestamp")), ("missing_coinbase_product_id", "missing_coinbase_price"))


def _kraken(i: _Input) -> Column:
    p, items = i.payload, _items(i.payload, "data")
    number = lambda x: F.coalesce(lenient_double(x), lenient_double(F.get_json_object(x, "$.price")))
    return _ticker(i, "kraken_ticker_v2", F.coalesce(_at(p, "symbol"), _first(items, "symbol")), F.coalesce(number(_at(p, "last")), number(_first(items, "last", "last_price", "price"))), F.coalesce(iso8601(_at(p, "time_in")), iso8601(_at(p, "time_out"))), ("missing_kraken_symbol", "missing_kraken_last"))


def _okx(i: _Input) -> Column:
    p, items = i.payload, _items(i.payload, "data")
    return _ticker(i, "okx_tickers_v5", F.coalesce(_at(p, "instId"), _first(items, "instId")), F.coalesce(lenient_double(_at(p, "last", "lastPrice")), lenient_double(_first(items, "last", "lastPrice"))), millis(F.coalesce(_at(p, "ts"), _first(items, "ts"))), ("missing_okx_inst_id", "missing_okx_last"))


def _bybit(i: _Input) -> Column:
    p, items = i.payload, _items(i.payload, "data")
    topic = F.upper(F.nullif(F.regexp_extract(F.trim(F.coalesce(_at(p, "topic"), F.lit(""))), r"^tickers\.(.+)$", 1), F.lit("")))
    return _ticker(i, "bybit_tickers_v5", F.coalesce(_at(p, "symbol"), topic, _first(items, "symbol")), F.coalesce(lenient_double(_at(p, "lastPrice", "last")), lenient_double(_first(items, "lastPrice", "last"))), millis(_at(p, "ts")), ("missing_bybit_symbol", "missing_bybit_last_price"))


def _gate(i: _Input) -> Column:
    p, items = i.payload, _items(i.payload, "result")
    inner = F.size(items) > 0
    get = lambda n: F.when(inner, F.try_element_at(items[0], F.lit(n))).otherwise(_at(p, n))
    symbol = F.upper(F.replace(F.coalesce(get("currency_pair"), _at(p, "s"), i.hint), F.lit("_"), F.lit("/")))
    bad = lambda x: F.when(F.size(F.filter(F.split(x, "/", 2), lambda y: y != "")) < 2, F.concat(F.lit("unparseable_gate_pair:"), x))
    price = F.coalesce(lenient_double(get("last")), lenient_double(get("close")), lenient_double(get("lastPrice")))
    return _ticker(i, "gate_ticker_v4", symbol, price, F.coalesce(millis(_at(p, "time_ms")), seconds(_at(p, "time"))), ("missing_gate_currency_pair", "missing_gate_last_price"), bad)


def _gemini(i: _Input) -> Column:
    p, items = i.payload, _items(i.payload, "events")
    ts = F.coalesce(_at(p, "timestampms"), _first(items, "timestampms", "timestamp"))
    return _ticker(i, "gemini_marketdata_v1", _at(p, "symbol"), F.coalesce(lenient_double(_at(p, "price", "last", "last_price")), lenient_double(_first(items, "price", "last", "last_price"))), millis(ts), ("missing_gemini_symbol", "missing_gemini_price"))


def _log(i: _Input, **more: Column) -> Column:
    p = i.payload
    fields = {
        "event_type": i.type, "event_id": i.event_id(), "market_key": i.market, "asset_pair": i.hint,
        "tx_hash": _at(p, "transactionHash", "tx_hash"), "block_number": lenient_long(_at(p, "blockNumber", "block_number")), "log_index": lenient_long(_at(p, "logIndex", "log_index")),
        "chain_id": lenient_long(_at(p, "chainId", "chain_id")), "topic0": _at(p, "topics[0]", "topic0"), "event_ts": F.coalesce(i.own_ts, seconds(_at(p, "timestamp"))),
        "normalized": F.create_map(F.lit("address"), _at(p, "address"), F.lit("topics"), F.coalesce(_at(p, "topics"), F.lit("[]")), F.lit("data"), _at(p, "data")),
    }
    return _result(**(fields | more))


def _answer(i: _Input) -> Column:
    p = i.payload

    def numbers(words: Column) -> Column:
        raw = F.coalesce(i256_to_double(_at(p, "topics[1]")), i256_to_double(F.get(words, F.lit(0))))
        round_id = F.coalesce(u256_to_double(_at(p, "topics[2]")), u256_to_double(F.get(words, F.lit(1))))
        updated = F.coalesce(lenient_long(_at(p, "updatedAt")), u256_to_double(F.try_element_at(words, F.lit(-1))).try_cast("bigint"))
        return F.struct(raw.alias("raw"), round_id.alias("round_id"), updated.alias("updated"))

    decimals = F.coalesce(lenient_long(i.config("decimals")), lenient_long(i.config("price_decimals")), F.lit(8))

    def result(r: Column) -> Column:
        return _log(
            i, price=scale(r["raw"], decimals), market_key=F.coalesce(i.market, i.config("market_key")), asset_pair=F.coalesce(i.hint, i.config("asset_pair")),
            event_ts=F.coalesce(i.own_ts, seconds(_at(p, "timestamp")), F.timestamp_seconds(r["updated"])),
            normalized=F.create_map(F.lit("raw_answer"), r["raw"].cast("string"), F.lit("round_id"), r["round_id"].cast("string"), F.lit("quote_asset"), F.lit("USD")),
        )

    return let(let(hex_words(_at(p, "data")), numbers), result)


def _pyth(i: _Input) -> Column:
    feed = F.coalesce(F.when(_at(i.payload, "price_feed").startswith("{"), _at(i.payload, "price_feed")), i.payload.text)
    spot, ema = _at(feed, "price"), _at(feed, "ema_price")
    chosen = F.when(F.coalesce(i.config("use_spot_price"), F.lit("false")) == "true", F.coalesce(spot, ema)).otherwise(F.coalesce(ema, spot))
    decode = lambda o: let(finite(lenient_double(_at(o, "price")) * F.pow(F.lit(10.0), lenient_long(_at(o, "expo")))), lambda v: F.when(v > 0, v))
    published = F.coalesce(lenient_long(_at(chosen, "publish_time")), lenient_long(_at(feed, "publish_time")))
    symbol = F.upper(F.element_at(F.split(_at(feed, "metadata.symbol", "symbol"), r"\."), -1))
    own = F.struct(feed.alias("feed"), chosen.alias("chosen"), decode(chosen).alias("price"), published.alias("published"), symbol.alias("symbol"), decode(spot).alias("spot"), decode(ema).alias("ema"))
    return let(own, lambda r: _pyth_result(i, r))


def _pyth_result(i: _Input, r: Column) -> Column:
    feed, chosen, price, published, symbol = (r[x] for x in ("feed", "chosen", "price", "published", "symbol"))
    quote = F.regexp_extract(symbol, "/(.*)$", 1)
    market = F.when(F.contains(symbol, F.lit("/")) & quote.isin(*USD_LIKE), F.concat(F.regexp_extract(symbol, "^([^/]*)/", 1), F.lit("/USD"))).otherwise(symbol)
    error = F.when(chosen.isNull(), "missing_pyth_price_object").when(price.isNull(), "invalid_pyth_price_mantissa_or_expo")
    # the feed's id alone is the same for all its updates, so the time of publication belongs to the key
    key = F.when(published.isNotNull(), F.concat_ws(":", _at(feed, "id"), published.cast("string"))).otherwise(_at(feed, "id"))
    conf = finite(lenient_double(_at(chosen, "conf")) * F.pow(F.lit(10.0), F.coalesce(lenient_long(_at(chosen, "expo")), F.lit(-8))))
    return _result(
        event_type=i.type, event_id=key, market_key=F.coalesce(i.market, market), asset_pair=F.coalesce(i.hint, symbol), price=price, event_ts=F.timestamp_seconds(published), parse_error=error,
        normalized=F.create_map(F.lit("spot_price_usd"), r["spot"].cast("string"), F.lit("ema_price_usd"), r["ema"].cast("string"), F.lit("conf_usd"), conf.cast("string")),
    )


def _swap_amounts(i: _Input) -> Column:
    words = F.slice(hex_words(_at(i.payload, "data")), 1, 4)
    wide = lambda w: F.substring(w, 1, 32) != "0" * 32
    amounts = F.transform(words, lambda w: F.when(wide(w), F.concat(F.lit("0x"), w)).otherwise(_decimal(w)))
    return _log(i, normalized=F.create_map(F.lit("swap_amounts"), F.to_json(amounts), F.lit("decoded_by"), F.lit("uniswap_v2_swap_v1")))


def _decimal(word: Column) -> Column:
    """The decimal text of a word below 2**128: exact up to 38 digits."""
    limb = lambda k: F.conv(F.substring(word, 8 * k + 1, 8), 16, 10).try_cast("decimal(38,0)")
    out = limb(4)
    for k in (5, 6, 7):
        out = (out * F.lit(4294967296).cast("decimal(10,0)")).cast("decimal(38,0)") + limb(k)
    return out.cast("decimal(38,0)").cast("string")


def _tokens(i: _Input) -> tuple[Column, Column, Column, Column, Column]:
    t0 = F.upper(F.coalesce(i.config("token0_symbol"), F.lit("TOKEN0")))
    t1 = F.upper(F.coalesce(i.config("token1_symbol"), F.lit("TOKEN1")))
    base = F.upper(F.coalesce(i.config("base_symbol"), t0))
    d = lambda n: F.coalesce(lenient_long(i.config(n)), F.lit(18))
    return t0, t1, base, d("token0_decimals"), d("token1_decimals")


def _pool_price(i: _Input, price: Column, error: Column) -> Column:
    """A log with the pool's price, seen from the base token."""
    t0, t1, base, _, _ = _tokens(i)
    inverse = (base != t0) & (base == t1)
    quote = F.when(inverse, t0).otherwise(t1)
    market = F.concat(base, F.lit("/"), F.when(quote.isin(*USD_LIKE), "USD").otherwise(quote))
    raw = F.when(inverse, 1.0 / price).otherwise(price)
    return _log(i, price=raw, market_key=F.coalesce(i.market, market), asset_pair=F.coalesce(i.hint, F.concat(t0, t1)), parse_error=error, normalized=F.create_map(F.lit("base_symbol"), base, F.lit("quote_asset"), quote, F.lit("raw_price"), raw.cast("string")))


def _v2_price(i: _Input, prefix: str = "") -> Column:
    data = _at(i.payload, "data")
    _, _, _, d0, d1 = _tokens(i)

    def amounts(w: Column) -> Column:
        return F.struct(F.size(w).alias("words"), *(scale(u256_to_double(F.get(w, F.lit(k))), d).alias(n) for k, (n, d) in enumerate((("in0", d0), ("in1", d1), ("out0", d0), ("out1", d1)))))

    def priced(r: Column) -> Column:
        in0, in1, out0, out1 = (r[x] for x in ("in0", "in1", "out0", "out1"))
        price = F.when((in0 > 0) & (out1 > 0), out1 / in0).when((in1 > 0) & (out0 > 0), in1 / out0).when((in0 + out0 > 0) & (in1 + out1 > 0), (in1 + out1) / (in0 + out0))
        return F.struct(r["words"].alias("words"), let(finite(price), lambda v: F.when(v > 0, v)).alias("price"))

    def result(r: Column) -> Column:
        error = F.when(data.isNull(), "missing_uniswap_v2_swap_data").when(r["words"] < 4, "invalid_uniswap_v2_swap_data").when(r["price"].isNull(), "unable_to_derive_uniswap_v2_price")
        return _pool_price(i, r["price"], F.concat(F.lit(prefix), error))

    return let(let(let(hex_words(data), amounts), priced), result)


def _v3_price(i: _Input, prefix: str = "") -> Column:
    data = _at(i.payload, "data")
    _, _, _, d0, d1 = _tokens(i)

    def amounts(w: Column) -> Column:
        root = u256_to_double(F.get(w, F.lit(2)))
        x0, x1 = F.abs(i256_to_double(F.get(w, F.lit(0)))) / F.pow(F.lit(10.0), d0), F.abs(i256_to_double(F.get(w, F.lit(1)))) / F.pow(F.lit(10.0), d1)
        return F.struct(F.size(w).alias("words"), finite(root * root / F.lit(2.0**192) * F.pow(F.lit(10.0), d0 - d1)).alias("by_root"), x0.alias("x0"), x1.alias("x1"))

    def priced(r: Column) -> Column:
        price = F.coalesce(F.when(r["by_root"] > 0, r["by_root"]), F.when((r["x0"] > 0) & (r["x1"] > 0), r["x1"] / r["x0"]))
        return F.struct(r["words"].alias("words"), let(finite(price), lambda v: F.when(v > 0, v)).alias("price"))

    def result(r: Column) -> Column:
        error = F.when(data.isNull(), "missing_uniswap_v3_swap_data").when(r["words"] < 3, "invalid_uniswap_v3_swap_data").when(r["price"].isNull(), "unable_to_derive_uniswap_v3_price")
        return _pool_price(i, r["price"], F.concat(F.lit(prefix), error))

    return let(let(let(hex_words(data), amounts), priced), result)


def _aerodrome(i: _Input) -> Column:
    kind = F.lower(F.coalesce(i.config("pool_type"), F.lit("cl")))
    return F.when(kind.isin("basic", "stable", "volatile"), _v2_price(i, "aerodrome_basic_pool:")).otherwise(_v3_price(i, "aerodrome_cl_pool:"))


def _text(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def _protocol(i: _Input, error: Column, kind: Column, normalized: Column) -> Column:
    p = i.payload
    protocol = F.lower(_text(_at(p, "protocol_id", "protocol")))
    slug = F.coalesce(F.lower(_text(_at(p, "chain_slug"))), let(lenient_long(_at(p, "chainId", "chain_id")), chain_slug), F.lit("unknown"))
    own = F.create_map(F.lit("protocol_id"), protocol, F.lit("chain_slug"), slug)
    return _log(i, event_type=kind, event_ts=F.coalesce(i.own_ts, millis(_at(p, "timestamp"))), parse_error=F.when(protocol.isNull(), "missing_protocol_id").otherwise(error), normalized=F.map_concat(own, normalized))


def _tvl(i: _Input) -> Column:
    p = i.payload
    decimals = F.coalesce(lenient_long(_at(p, "decimals", "tvl_decimals")), F.lit(18))
    price = let(finite(lenient_double(_at(p, "price_usd"))), lambda v: F.when(v > 0, v))
    native = F.coalesce(lenient_double(_at(p, "tvl_native")), scale(lenient_double(_at(p, "tvl_raw")), F.greatest(decimals, F.lit(0))))
    tvl = F.coalesce(lenient_double(_at(p, "tvl_usd")), native * price)
    market = F.lower(_text(_at(p, "market_id")))
    return let(let(finite(tvl), lambda v: F.when(v > 0, v)), lambda tvl: _protocol(i, F.when(tvl.isNull(), "missing_tvl_usd"), F.coalesce(_text(_at(p, "event_type")), i.type), F.create_map(F.lit("metric"), F.lit("tvl"), F.lit("market_id"), F.nullif(market, F.lit("all")), F.lit("tvl_usd"), F.round(tvl, 6).cast("string"))))


def _pause(i: _Input) -> Column:
    p = i.payload
    read = lambda t: F.when(t.isin("true", "1", "paused"), True).when(t.isin("false", "0", "unpaused"), False).when(t.try_cast("bigint").isNotNull(), t.try_cast("bigint") != 0)

    def result(paused: Column) -> Column:
        state = F.when(paused, "protocol_pause").otherwise("protocol_unpause")
        kind = F.coalesce(_text(_at(p, "event_type")), F.when(i.type.isin("protocol_pause", "protocol_unpause") | (F.trim(i.type) == ""), state).otherwise(i.type))
        return _protocol(i, F.when(paused.isNull(), "missing_pause_state"), kind, F.create_map(F.lit("metric"), F.lit("pause"), F.lit("paused"), paused.cast("string")))

    return let(let(F.lower(F.trim(_at(p, "paused", "is_paused"))), read), result)


def _legacy(i: _Input, symbol: Column, price: Column, ts: Column, name: str) -> Column:
    error = F.when(symbol.isNull(), f"missing_{name}_symbol").when(price.isNull(), f"missing_{name}_price")
    return _result(event_type=i.type, market_key=symbol, asset_pair=symbol, price=price, event_ts=ts, parse_error=error)


def _any_time(x: Column) -> Column:
    return F.coalesce(seconds(x), iso8601(x))


def _legacy_parsers(i: _Input) -> dict[str, Column]:
    p = i.payload
    root = F.coalesce(_at(p, "data"), p.text)
    feed = F.coalesce(_at(p, "price_feed"), p.text)
    ticker = _at(p, "type").isin("ticker", "ticker_batch")
    d = lenient_double
    return {
        "legacy_binance": _legacy(i, _at(root, "s", "symbol"), d(_at(root, "c", "p", "price")), millis(_at(root, "E", "eventTime")), "binance"),
        "legacy_coinbase": _legacy(i, F.when(ticker, _at(p, "product_id")), d(_at(p, "price")), iso8601(_at(p, "time")), "coinbase"),
        "legacy_uniswap": _legacy(i, _at(p, "pair", "symbol"), d(_at(p, "price", "mid_price")), _any_time(_at(p, "timestamp", "time")), "uniswap"),
        "legacy_curve": _legacy(i, _at(p, "pair", "symbol"), d(_at(p, "price", "virtual_price")), _any_time(_at(p, "timestamp", "time")), "curve"),
        "legacy_chainlink": _legacy(i, _at(p, "feed", "symbol"), d(_at(p, "answer", "price")), _any_time(_at(p, "updated_at", "timestamp")), "chainlink"),
        "legacy_pyth": _legacy(i, _at(feed, "symbol"), d(_at(feed, "price")), _any_time(_at(feed, "publish_time", "timestamp")), "pyth"),
    }


PARSERS = {
    "binance_miniticker_v1": _binance, "coinbase_ticker_v1": _coinbase, "kraken_ticker_v2": _kraken, "okx_tickers_v5": _okx, "bybit_tickers_v5": _bybit,
    "gate_ticker_v4": _gate, "gemini_marketdata_v1": _gemini, "evm_log_v1": _log, "chainlink_answer_updated_v1": _answer, "pyth_hermes_v2": _pyth,
    "uniswap_v2_swap_v1": _swap_amounts, "uniswap_v2_swap_price_v1": _v2_price, "uniswap_v3_swap_price_v1": _v3_price, "aerodrome_swap_price_v1": _aerodrome,
    "protocol_tvl_v1": _tvl, "protocol_pause_v1": _pause,
}
LEGACY = ("legacy_binance", "legacy_coinbase", "legacy_uniswap", "legacy_curve", "legacy_chainlink", "legacy_pyth")
#: Settings that a raw row may lack.
_OPTIONAL = {"event_type": "string", "asset_pair_hint": "string", "market_key_hint": "string", "filter_config": "string", "payload_ts_path": "string", "payload_ts_unit": "string"}


def normalize_feed(raw: DataFrame, parsers: tuple[str, ...] | None = None) -> DataFrame:
    """Parse ``payload`` by ``parser_name``. The hints, the filter configuration and the path of the time are
    columns of ``raw`` (joined from the stream's configuration), or null. ``parsers`` restricts the plan to
    the parsers that can occur. Without an event time, ``observed_at`` is ``received_at``."""
    kept = raw.columns
    rows = raw.select("*", *(F.lit("quote" if n == "event_type" else None).cast(t).alias(n) for n, t in _OPTIONAL.items() if n not in kept))
    i = _Input()
    names, branches = parsers or (*PARSERS, *LEGACY), F
    legacy = _legacy_parsers(i) if set(names) & set(LEGACY) else {}  # expressions take time to build
    for name in names:
        if name:
            branches = branches.when(F.col("parser_name") == name, legacy[name] if name in legacy else PARSERS[name](i))
    unsupported = _result(parse_error=F.concat(F.lit("unsupported_parser:"), F.col("parser_name")))
    out = unsupported if branches is F else branches.otherwise(unsupported)
    parsed = i.payload.read(rows).withColumn("__parsed", out)
    keep = [c for c in kept if c not in _FIELDS]
    return parsed.select(*keep, "__parsed.*").withColumn("observed_at", F.coalesce("event_ts", F.col("received_at").cast("timestamp")) if "received_at" in kept else F.col("event_ts"))


def normalize_by_parser(raw: DataFrame, parsers: tuple[str, ...] | None = None) -> DataFrame:
    """``normalize_feed`` for a table that is partitioned by ``parser_name``: each parser reads its own partitions and
    has a plan of its own, which is far smaller than one that can do everything; rows of other parsers follow as unsupported."""
    names = parsers or (*PARSERS, *LEGACY)
    other = raw.where(~F.col("parser_name").isin(*names) | F.col("parser_name").isNull())
    return reduce(DataFrame.unionByName, [normalize_feed(raw.where(F.col("parser_name") == name), (name,)) for name in names], normalize_feed(other, ("",)))
