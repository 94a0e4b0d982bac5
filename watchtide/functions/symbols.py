"""Trading symbols: pairs, market keys, quote assets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: Quotes that count as US dollars in a market key, and suffixes tried in this order (fixed values).
USD_LIKE = ("USD", "USDT", "USDC")
SUFFIXES = ("USDT", "USDC", "USD")


def split_symbol_pair(symbol: Column) -> Column:
    """``struct<base, quote>`` of a symbol such as ``USDC-USDT`` or ``USDCUSDT``; null if there is none."""
    return let(F.translate(F.upper(F.trim(symbol)), ": ", ""), _split)


def _split(clean: Column) -> Column:
    out = F.lit(None).cast("struct<base:string,quote:string>")
    for suffix in reversed(SUFFIXES):
        n = len(suffix)
        hit = clean.endswith(suffix) & (F.length(clean) > n)
        out = F.when(hit, F.struct(F.substring(clean, F.lit(1), F.length(clean) - n).alias("base"), F.lit(suffix).alias("quote"))).otherwise(out)
    for mark in ("-", "/"):
        parts = F.filter(F.split(clean, mark), lambda p: p != "")
        out = F.when(F.contains(clean, F.lit(mark)) & (F.size(parts) >= 2), F.struct(parts[0].alias("base"), parts[1].alias("quote"))).otherwise(out)
    return out


def symbol_to_market_key(symbol: Column) -> Column:
    """``BASE/QUOTE``, with every dollar-like quote as ``USD``."""
    key = lambda pair: F.concat(pair["base"], F.lit("/"), F.when(pair["quote"].isin(*USD_LIKE), "USD").otherwise(pair["quote"]))
    return let(split_symbol_pair(symbol), key)


def quote_asset(normalized: Column, asset_pair: Column, market_key: Column) -> Column:
    """The quote: the normalised field, else the pair's, else the market key's."""
    return F.coalesce(F.upper(normalized), split_symbol_pair(asset_pair)["quote"], split_symbol_pair(market_key)["quote"])


def base_asset(subject_key: Column) -> Column:
    """``USDC`` of ``USDC/USD`` or of ``prefix:USDC/USD``."""
    tail = F.element_at(F.split(subject_key, ":"), -1)
    return F.upper(F.element_at(F.split(tail, "[/-]"), 1))
