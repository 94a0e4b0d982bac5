"""Price quotes: validity, eligibility, latest quotes, consensus, exchange rates, market truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.numbers import finite
from .asof import latest_within, micros
from .latest import latest_of_each

KINDS = {"cex_websocket": "cex", "dex_api": "dex", "oracle_api": "oracle"}


def valid_price(df: DataFrame) -> DataFrame:
    """Market key and price present; the price finite and positive."""
    return df.where(F.col("market_key").isNotNull() & (finite(F.col("price")) > 0))


def source_kind(source_type: Column) -> Column:
    out = F.lit("unknown")
    for k, v in KINDS.items():
        out = F.when(source_type == k, v).otherwise(out)
    return out


def setting(policy: dict, name: str, default=None) -> Column:
    """A policy's setting, a plain value or a column, with its default."""
    got = policy.get(name)
    return F.lit(default) if got is None else F.coalesce(got, F.lit(default)) if isinstance(got, Column) and default is not None else F.lit(got)


def eligible(kind: Column, source_id: Column, age_ms: Column, policy: dict) -> Column:
    """Kind toggles, CEX whitelist (case-insensitive, empty: all), overrides, weight, and age.

    ``policy``: ``include_dex, include_oracles, include_aggregators, cex_whitelist, stale_timeout_ms`` and
    ``overrides`` (source id to ``enabled, weight, stale_timeout_ms``; later entries win), as plain values or as
    columns (``cex_whitelist`` an array, ``overrides`` a map)."""
    allowed = policy.get("cex_whitelist", ())
    if isinstance(allowed, Column):
        listed = (F.coalesce(F.size(allowed), F.lit(0)) <= 0) | F.exists(allowed, lambda x: F.lower(x) == F.lower(source_id))
    else:
        listed = F.lower(source_id).isin(*(x.lower() for x in allowed)) if allowed else F.lit(True)
    by_kind = (
        F.when(kind == "cex", listed)
        .when(kind == "dex", setting(policy, "include_dex", True))
        .when(kind == "oracle", setting(policy, "include_oracles", True))
        .when(kind == "aggregator", setting(policy, "include_aggregators", True))
        .otherwise(True)
    )
    stale = override(source_id, policy, "stale_timeout_ms", setting(policy, "stale_timeout_ms", 60_000))
    return by_kind & override(source_id, policy, "enabled", F.lit(True)) & (weight(source_id, policy) > 0) & (age_ms <= stale)


def override(source_id: Column, policy: dict, name: str, default: Column) -> Column:
    own = policy.get("overrides", {})
    if isinstance(own, Column):
        return F.coalesce(F.try_element_at(own, source_id)[name], default)
    return reduce(lambda out, kv: F.when(source_id == kv[0], F.lit(kv[1][name])).otherwise(out) if name in kv[1] else out, own.items(), default)


def weight(source_id: Column, policy: dict) -> Column:
    return override(source_id, policy, "weight", F.lit(1.0))


def enabled_sources(policy: dict) -> Column:
    """How many sources the policy enables by name; if it names none, the least number that it asks for."""
    own, least = policy.get("overrides", {}), setting(policy, "min_sources", 1)
    if isinstance(own, Column):
        n = F.coalesce(F.size(F.filter(F.map_values(own), lambda x: F.coalesce(x["enabled"], F.lit(True)))), F.lit(0))
    else:
        n = F.lit(sum(x.get("enabled", True) for x in own.values()))
    return F.greatest(F.when(n > 0, n).otherwise(least), F.lit(1))


def longest_ms(policy: dict) -> int:
    """The longest time for which a quote can count; ages are whole milliseconds."""
    return 1 + max([policy.get("stale_timeout_ms", 60_000), *(x["stale_timeout_ms"] for x in policy.get("overrides", {}).values() if x.get("stale_timeout_ms"))])


def latest_by_source(df: DataFrame, keys: tuple[str, ...], width_ms: int) -> DataFrame:
    """Add ``latest``: of every source that has quoted, its newest quote up to the row. Quotes older than ``width_ms`` may be
    missing."""
    quote = F.struct(F.col("observed_at").alias("at"), F.col("source_id").alias("source_id"), F.col("source_type").alias("source_type"), F.col("price").alias("price"))
    return latest_of_each(df, keys, F.col("source_id"), quote, "latest", width_ms)


def weighted_median(quotes: Column) -> Column:
    """First price, by price, at which the running weight reaches half of the total; of an array of
    ``struct<price, weight>``."""
    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("price"))

    def middle(r: Column) -> Column:
        step = lambda a, q: F.struct((a["run"] + q["weight"]).alias("run"), F.coalesce(a["price"], F.when(a["run"] + q["weight"] >= r["half"], q["price"])).alias("price"))
        return F.aggregate(r["ordered"], start, step)["price"]

    total = lambda ordered: F.aggregate(ordered, F.lit(0.0), lambda a, q: a + q["weight"])
    halved = let(F.sort_array(F.filter(quotes, lambda q: q["weight"] > 0)), lambda o: F.struct(o.alias("ordered"), (total(o) / 2).alias("half")))
    return let(halved, middle)


def weighted_median_by(df: DataFrame, keys: list[str], ranges: int = 256) -> DataFrame:
    """Weighted median of ``price`` by ``weight`` for each key: the first price, by price, at which the running weight
    reaches half of the key's.

    Prices are cut at approximate quantiles into ranges. Weights are added up by range, and only the rows of the range that
    holds the half are put in order, so a busy key is never sorted as a whole. Equal prices are summed first."""
    summed = df.where(F.col("price").isNotNull() & (F.col("weight") > 0)).groupBy(*keys, "price").agg(F.sum("weight").alias("weight"))
    steps = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    cuts = summed.groupBy(*keys).agg(F.percentile_approx("price", steps, 4 * ranges).alias("__cuts"), F.sum("weight").alias("__total"))
    cut = summed.join(cuts, keys).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col("price")))).drop("__cuts")
    by_range = cut.groupBy(*keys, "__range").agg(F.sum("weight").alias("__here"), F.first("__total").alias("__half"))
    before = F.coalesce(F.sum("__here").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    holds = by_range.withColumn("__before", before).where("__before < __half / 2 AND __before + __here >= __half / 2").select(*keys, "__range", "__before")
    run = F.col("__before") + F.sum("weight").over(Window.partitionBy(*keys).orderBy("price").rowsBetween(Window.unboundedPreceding, 0))
    inside = cut.join(holds, [*keys, "__range"]).withColumn("__run", run)
    return inside.where("__run >= __total / 2").groupBy(*keys).agg(F.min("price").alias("median"))


def live_quotes(latest: Column, now: Column, policy: dict) -> Column:
    return F.filter(latest, lambda q: eligible(source_kind(q["source_type"]), q["source_id"], F.floor((now - micros(q["at"])) / 1000), policy))


def median_of(live: Column, policy: dict) -> Column:
    return weighted_median(F.transform(live, lambda q: F.struct(q["price"].alias("price"), weight(q["source_id"], policy).alias("weight"))))


def consensus(df: DataFrame, policy: dict, with_markets: bool = False, width_ms: int | None = None) -> DataFrame:
    """For every valid quote: eligible sources as of its time, their weighted median, divergence from the peg, the
    tenant's diverging markets, quorum, whether an oracle confirms, and confidence.

    ``policy`` holds plain values, or columns of ``df`` (then ``width_ms`` says for how long a quote can count).
    Adds ``n_sources, median, divergence, n_diverging, context, floor, has_quorum, oracle_confirmed`` and the confidence's parts
    and total: ``direction_share, oracle_score, volume_score, confidence``. With ``with_markets`` and the policy's
    ``contagion_detection``, the context is systemic if at least two of the tenant's dollar markets diverge by the systemic floor.
    """
    peg, width_ms = setting(policy, "peg_target", 1.0), width_ms or longest_ms(policy)
    rows = latest_by_source(valid_price(df), ("tenant_id", "market_key"), width_ms)
    away = lambda x: F.abs(x - peg) / peg * 100
    rows = rows.withColumn("live", live_quotes(F.col("latest"), micros(F.col("observed_at")), policy))
    rows = rows.withColumn("n_sources", F.size("live")).withColumn("median", F.coalesce(median_of(F.col("live"), policy), peg))
    rows = rows.withColumn("divergence", away(F.col("median")))
    side = lambda x: F.when(x < peg, -1).otherwise(1)
    same = F.size(F.filter("live", lambda q: side(q["price"]) == side(F.col("median"))))
    rows = rows.withColumn("direction_share", F.when(F.col("n_sources") > 0, same * 100.0 / F.col("n_sources")).otherwise(0.0))
    oracles = F.filter("live", lambda q: source_kind(q["source_type"]) == "oracle")
    rows = rows.withColumn("__oracle", F.array_max(F.transform(oracles, lambda q: away(q["price"]))))
    rows = contagion(rows, policy, width_ms) if with_markets else rows.drop("latest", "live").withColumn("n_diverging", F.lit(0))
    systemic = setting(policy, "contagion_detection", False) & (F.col("n_diverging") >= 2)
    rows = rows.withColumn("context", F.when(systemic, "systemic").otherwise("isolated"))
    rows = rows.withColumn("floor", F.when(F.col("context") == "systemic", setting(policy, "systemic_floor_pct", 0.01)).otherwise(setting(policy, "isolated_floor_pct", 0.5)))
    need = F.greatest(setting(policy, "min_sources", 1), setting(policy, "min_healthy_sources", 1), F.lit(1))
    rows = rows.withColumn("has_quorum", (F.col("n_sources") >= need) & (F.col("n_sources") / enabled_sources(policy) >= setting(policy, "quorum_pct", 0.0)))
    rows = rows.withColumn("oracle_confirmed", F.coalesce(F.col("__oracle") >= F.col("floor"), F.lit(False)))
    by_oracle, by_volume = setting(policy, "oracle_confirmation", False), setting(policy, "volume_confirmation", False)
    some = F.col("n_sources") > 0
    rows = rows.withColumn("oracle_score", F.when(~some, 0.0).when(~by_oracle, 50.0).when(F.col("oracle_confirmed"), 100.0).otherwise(0.0)).withColumn("volume_score", F.lit(50.0))
    w_oracle, w_volume = F.when(by_oracle, 0.2).otherwise(0.0), F.when(by_volume, 0.1).otherwise(0.0)
    total = (F.col("direction_share") * 0.7 + F.col("oracle_score") * w_oracle + F.col("volume_score") * w_volume) / (w_oracle + w_volume + 0.7)
    return rows.withColumn("confidence", F.when(some, total).otherwise(0.0)).drop("__oracle")


def contagion(rows: DataFrame, policy: dict, width_ms: int) -> DataFrame:
    """Add ``n_diverging``: how many of the tenant's ``*/USD`` markets, each by its own policy and its quotes that
    count now, diverge by the row's systemic floor or more; 0 where the policy doesn't ask. ``rows`` have each market's
    ``latest`` and ``live`` quotes, which are dropped.

    A market's divergence stays as it was at its newest row until the first of the quotes that counted then is too old. Only
    after that are its quotes taken along and its median worked out again."""
    columns = {k: v for k, v in policy.items() if isinstance(v, Column)}
    stale = lambda q: override(q["source_id"], policy, "stale_timeout_ms", setting(policy, "stale_timeout_ms", 60_000))
    until = F.array_min(F.transform("live", lambda q: micros(q["at"]) + ((F.floor(stale(q)) + 1) * 1000).cast("long")))
    detail = F.struct(F.col("latest"), *(v.alias(f"p_{k}") for k, v in columns.items()))
    own = F.struct(until.alias("until"), F.when(F.col("n_sources") > 0, F.col("divergence")).alias("divergence"), detail.alias("detail"))
    dollar = F.when(F.upper("market_key").endswith("/USD"), F.col("market_key"))
    rows = rows.withColumns({"__subject": dollar, "__value": own, "__now": micros(F.col("observed_at"))}).drop("latest", "live")
    out = latest_of_each(rows, ("tenant_id",), F.col("__subject"), F.col("__value"), "__markets", width_ms, setting(policy, "contagion_detection", False), ("__now", "until", "detail"))
    now, floor = F.col("__now"), setting(policy, "systemic_floor_pct", 0.01)

    def again(m: Column) -> Column:
        theirs = policy | {k: m["detail"][f"p_{k}"] for k in columns}
        peg = setting(theirs, "peg_target", 1.0)
        return F.abs(median_of(live_quotes(m["detail"]["latest"], now, theirs), theirs) - peg) / peg * 100

    diverges = lambda m: F.coalesce(F.when(m["detail"].isNull(), m["divergence"]).otherwise(again(m)) >= floor, F.lit(False))
    return out.withColumn("n_diverging", F.coalesce(F.size(F.filter("__markets", diverges)), F.lit(0))).drop("__markets", "__now")


def usd_prices(quotes: DataFrame, width_sec: int = 30) -> DataFrame:
    """Quotes in USDT times the newest USDT/USD rate of the last ``width_sec`` seconds; ``fx_status`` is
    ``converted``, ``partial`` (no rate: price null, the row stays) or ``native``."""
    rates = quotes.where("market_key = 'USDT/USD' AND quote_asset = 'USD'").select("observed_at", F.col("price").alias("rate"))
    found = latest_within(quotes, rates, [], "observed_at", "rate", width_sec, "rate")
    status = F.when(F.col("quote_asset") != "USDT", "native").when(F.col("rate").isNull(), "partial").otherwise("converted")
    return found.withColumn("fx_status", status).withColumn("price_usd", F.when(F.col("quote_asset") != "USDT", F.col("price")).otherwise(F.col("price") * F.col("rate")))


def market_truth(df: DataFrame, width_sec: int = 30, peg: float = 1.0) -> DataFrame:
    """Unweighted median of each source's newest price of the last ``width_sec`` seconds, in the market."""
    rows = latest_by_source(valid_price(df), ("market_key",), width_sec * 1000)
    now = micros(F.col("observed_at"))
    prices = F.array_sort(F.transform(F.filter("latest", lambda q: now - micros(q["at"]) <= width_sec * 1_000_000), lambda q: q["price"]))
    rows = rows.withColumn("prices", prices).withColumn("truth_sources", F.size("prices"))
    middle = lambda k: F.get("prices", F.floor((F.col("truth_sources") + k) / 2).cast("int"))
    truth = (middle(-1) + middle(0)) / 2
    return rows.withColumn("truth", truth).withColumn("truth_divergence", F.abs(F.col("truth") - peg) / peg * 100).drop("latest", "prices")
