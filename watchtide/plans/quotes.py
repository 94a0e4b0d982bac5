"""Queries on quotes, joins in time, and market statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quotes as ops
from .registry import query, view

#: The fixture's quotes are about an hour apart, so times are hours instead of seconds.
POLICY = {"peg_target": 1.0, "stale_timeout_ms": 12 * 3_600_000, "min_sources": 2, "quorum_pct": 0.3, "isolated_floor_pct": 0.5}
STRICT = POLICY | {"cex_whitelist": ["SRC-0", "src-1"], "include_dex": True, "include_oracles": False, "overrides": {"src-3": {"weight": 0.0}, "src-4": {"weight": 2.5, "stale_timeout_ms": 6 * 3_600_000}, "src-6": {"enabled": False}}}


@query("d1_valid_price", "SELECT event_id, market_key, round(price, 6) AS price FROM quotes WHERE market_key IS NOT NULL AND price IS NOT NULL AND isfinite(price) AND price > 0")
def valid_price(spark, sf_dir):
    return ops.valid_price(view(spark, sf_dir, "quotes")).select("event_id", "market_key", F.round("price", 6).alias("price"))


@query("d2_eligible_sources", """SELECT event_id FROM quotes WHERE CASE source_type WHEN 'cex_websocket' THEN source_id IN ('src-0', 'src-1') WHEN 'oracle_api' THEN false ELSE true END
AND source_id NOT IN ('src-6', 'src-3') AND event_id % 20 <= CASE source_id WHEN 'src-4' THEN 6 ELSE 12 END""")
def eligible_sources(spark, sf_dir):
    q = view(spark, sf_dir, "quotes")
    age = (F.col("event_id") % 20) * 3_600_000
    return q.where(ops.eligible(ops.source_kind(F.col("source_type")), F.col("source_id"), age, STRICT)).select("event_id")


_LATEST = """
latest AS (
  SELECT e.event_id, e.tenant_id, e.market_key AS own_market, q.market_key, q.source_id, q.source_type, q.price,
         row_number() OVER (PARTITION BY e.event_id, q.market_key, q.source_id ORDER BY q.observed_at DESC, q.event_id DESC) AS nth
  FROM good e JOIN good q ON e.tenant_id = q.tenant_id AND (q.observed_at, q.event_id) <= (e.observed_at, e.event_id) AND q.observed_at >= e.observed_at - INTERVAL 12 HOUR),
medians AS (
  SELECT event_id, market_key, any_value(own_market) AS own_market, count(*) AS n_sources, quantile_disc(price, 0.5) AS median FROM latest WHERE nth = 1 GROUP BY event_id, market_key)"""
_GOOD = "good AS (SELECT * FROM quotes WHERE market_key IS NOT NULL AND price > 0)"
CONSENSUS_SQL = f"""
WITH {_GOOD}, {_LATEST},
own AS (SELECT *, abs(median - 1) / 1 * 100 AS divergence FROM medians WHERE market_key = own_market),
side AS (SELECT l.event_id, count(*) FILTER ((l.price < 1) = (a.median < 1)) AS same, bool_or(source_type = 'oracle_api' AND abs(price - 1) * 100 >= 0.5) AS oracle_confirmed
         FROM latest l JOIN own a USING (event_id, market_key) WHERE nth = 1 GROUP BY l.event_id)
SELECT a.event_id, CAST(n_sources AS INTEGER) AS n_sources, round(median, 6) AS median, round(divergence, 6) AS divergence,
       n_sources >= 2 AND n_sources / 2.0 >= 0.3 AS has_quorum, oracle_confirmed, round(same * 100.0 / n_sources, 6)::DOUBLE AS direction_share,
       round((same * 100.0 / n_sources * 0.7 + CASE WHEN oracle_confirmed THEN 100 ELSE 0 END * 0.2 + 50 * 0.1) / (0.7 + 0.2 + 0.1), 6)::DOUBLE AS confidence
FROM own a JOIN side USING (event_id)"""


@query("e4_consensus", CONSENSUS_SQL)
def consensus(spark, sf_dir):
    """Latest quote per source as of each event, weighted median, quorum, oracle confirmation, confidence."""
    got = ops.consensus(view(spark, sf_dir, "quotes"), POLICY | {"oracle_confirmation": True, "volume_confirmation": True})
    return got.select("event_id", "n_sources", *(F.round(c, 6).alias(c) for c in ("median", "divergence", "direction_share", "confidence")), "has_quorum", "oracle_confirmed")


@query("f1_weighted_median", """WITH w AS (SELECT tenant_id, market_key, price, CASE source_id WHEN 'src-4' THEN 2.5 WHEN 'src-1' THEN 0.5 ELSE 1.0 END AS weight, event_id FROM quotes WHERE price > 0),
r AS (SELECT *, sum(weight) OVER (PARTITION BY tenant_id, market_key ORDER BY price, weight, event_id ROWS UNBOUNDED PRECEDING) AS run, sum(weight) OVER (PARTITION BY tenant_id, market_key) AS total FROM w)
SELECT tenant_id, market_key, round(min(price), 6) AS median FROM r WHERE run >= total / 2 GROUP BY ALL""")
def weighted_median(spark, sf_dir):
    """Weighted median of each market, searched for in the range of prices that holds half of the weight."""
    q = view(spark, sf_dir, "quotes").where("price > 0")
    policy = {"overrides": {"src-4": {"weight": 2.5}, "src-1": {"weight": 0.5}}}
    return ops.weighted_median_by(q.withColumn("weight", ops.weight(F.col("source_id"), policy)), ["tenant_id", "market_key"]).select("tenant_id", "market_key", F.round("median", 6).alias("median"))


@query("e3_asof_fx", """
WITH rates AS (SELECT observed_at, price AS rate FROM fx_quotes WHERE market_key = 'USDT/USD' AND quote_asset = 'USD')
SELECT q.event_id, CASE WHEN quote_asset <> 'USDT' THEN 'native' WHEN r.observed_at >= q.observed_at - INTERVAL 6 HOUR THEN 'converted' ELSE 'partial' END AS fx_status,
       round(CASE WHEN quote_asset <> 'USDT' THEN price WHEN r.observed_at >= q.observed_at - INTERVAL 6 HOUR THEN price * rate END, 6) AS price_usd
FROM fx_quotes q ASOF LEFT JOIN rates r ON q.observed_at >= r.observed_at""")
def asof_fx(spark, sf_dir):
    return ops.usd_prices(view(spark, sf_dir, "fx_quotes"), 6 * 3600).select("event_id", "fx_status", F.round("price_usd", 6).alias("price_usd"))


@query("f2_market_truth", f"""
WITH {_GOOD}, latest AS (
  SELECT e.event_id, q.price, row_number() OVER (PARTITION BY e.event_id, q.source_id ORDER BY q.observed_at DESC, q.event_id DESC) AS nth
  FROM good e JOIN good q ON e.market_key = q.market_key AND (q.observed_at, q.event_id) <= (e.observed_at, e.event_id) AND q.observed_at >= e.observed_at - INTERVAL 6 HOUR)
SELECT event_id, CAST(count(*) AS INTEGER) AS truth_sources, round(median(price), 6) AS truth, round(abs(median(price) - 1) * 100, 6) AS truth_divergence FROM latest WHERE nth = 1 GROUP BY event_id""")
def market_truth(spark, sf_dir):
    got = ops.market_truth(view(spark, sf_dir, "quotes"), 6 * 3600)
    return got.select("event_id", "truth_sources", F.round("truth", 6).alias("truth"), F.round("truth_divergence", 6).alias("truth_divergence"))


@query("g3_contagion", f"""
WITH {_GOOD}, {_LATEST},
n AS (SELECT event_id, count(*) FILTER (abs(median - 1) / 1 * 100 >= 2.5) AS n_diverging FROM medians WHERE market_key LIKE '%/USD' GROUP BY event_id)
SELECT event_id, CAST(n_diverging AS INTEGER) AS n_diverging, CASE WHEN n_diverging >= 2 THEN 'systemic' ELSE 'isolated' END AS context FROM n""")
def contagion(spark, sf_dir):
    """The tenant's dollar markets that diverge as of each quote, and the context that follows."""
    policy = POLICY | {"contagion_detection": True, "systemic_floor_pct": 2.5}
    return ops.consensus(view(spark, sf_dir, "quotes"), policy, with_markets=True).select("event_id", "n_diverging", "context")


@query("f7_activity_per_minute", "SELECT source_id, market_key, source_type, epoch_ms(date_trunc('minute', observed_at)) AS minute_ms, CAST(count(*) AS BIGINT) AS n, epoch_us(max(observed_at)) AS last_us FROM quotes GROUP BY ALL")
def activity(spark, sf_dir):
    minute = F.date_trunc("minute", "observed_at")
    return view(spark, sf_dir, "quotes").groupBy("source_id", "market_key", "source_type", F.unix_millis(minute.cast("timestamp")).alias("minute_ms")).agg(F.count("*").alias("n"), F.unix_micros(F.max("observed_at").cast("timestamp")).alias("last_us"))


@query("f13_reference_price", "SELECT market_key, round(avg(price), 6) AS reference_price, CAST(count(*) AS BIGINT) AS n FROM (SELECT market_key, source_id, arg_max(price, observed_at) AS price FROM quotes WHERE price > 0 GROUP BY ALL) GROUP BY market_key")
def reference_price(spark, sf_dir):
    """Mean over the sources of their newest positive price."""
    newest = view(spark, sf_dir, "quotes").where("price > 0").groupBy("market_key", "source_id").agg(F.max_by("price", "observed_at").alias("price"))
    return newest.groupBy("market_key").agg(F.round(F.avg("price"), 6).alias("reference_price"), F.count("*").alias("n"))


@query("g4_latest_sample", "SELECT source_id, market_key, source_type, event_id, round(price, 6) AS price FROM quotes QUALIFY row_number() OVER (PARTITION BY source_id, market_key, source_type ORDER BY observed_at DESC, event_id DESC) = 1")
def latest_sample(spark, sf_dir):
    newest = view(spark, sf_dir, "quotes").groupBy("source_id", "market_key", "source_type").agg(F.max_by(F.struct("event_id", "price"), F.struct("observed_at", "event_id")).alias("x"))
    return newest.select("source_id", "market_key", "source_type", "x.event_id", F.round("x.price", 6).alias("price"))


@query("g7_latest_fresh_prices", "WITH m AS (SELECT max(observed_at) AS newest_at FROM quotes) SELECT source_id, market_key, event_id FROM quotes, m WHERE price > 0 AND observed_at >= newest_at - INTERVAL 24 HOUR QUALIFY row_number() OVER (PARTITION BY source_id, market_key ORDER BY observed_at DESC, event_id DESC) = 1")
def latest_fresh(spark, sf_dir):
    q = view(spark, sf_dir, "quotes")
    fresh = q.where("price > 0").join(F.broadcast(q.agg(F.max("observed_at").alias("newest_at"))), F.expr("observed_at >= newest_at - INTERVAL 24 HOURS"))
    return fresh.groupBy("source_id", "market_key").agg(F.max_by("event_id", F.struct("observed_at", "event_id")).alias("event_id"))


@query("h1_latest_market_price", "SELECT event_id, round(price, 6) AS price FROM quotes WHERE market_key = 'DAI/USD' AND price > 0 AND observed_at >= TIMESTAMP '2024-01-10' - INTERVAL 6 HOUR AND observed_at <= TIMESTAMP '2024-01-10' ORDER BY observed_at DESC, event_id DESC LIMIT 1")
def latest_market_price(spark, sf_dir):
    q = view(spark, sf_dir, "quotes").where("market_key = 'DAI/USD' AND price > 0 AND observed_at BETWEEN TIMESTAMP_NTZ '2024-01-09 18:00:00' AND TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    return q.orderBy(F.desc("observed_at"), F.desc("event_id")).limit(1).select("event_id", F.round("price", 6).alias("price"))


@query("k6_dedupe", "SELECT tenant_id, source_id, market_key, min(event_id) AS event_id FROM quotes GROUP BY tenant_id, source_id, market_key, date_trunc('hour', observed_at)")
def dedupe(spark, sf_dir):
    """First event of each deduplication key (here: tenant, source, market and hour)."""
    q = view(spark, sf_dir, "quotes").withColumn("hour", F.date_trunc("hour", "observed_at"))
    return q.groupBy("tenant_id", "source_id", "market_key", "hour").agg(F.min("event_id").alias("event_id")).drop("hour")


@query("k16_source_health", "SELECT source_id, event_id, price IS NOT NULL AS healthy, epoch_us(last_error) AS last_error_us FROM (SELECT *, max(CASE WHEN price IS NULL THEN observed_at END) OVER (PARTITION BY source_id) AS last_error FROM quotes) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY observed_at DESC, event_id DESC) = 1")
def source_health(spark, sf_dir):
    """Newest state of each source, and when it last failed."""
    got = view(spark, sf_dir, "quotes").groupBy("source_id").agg(F.max_by(F.struct("event_id", "price"), F.struct("observed_at", "event_id")).alias("x"), F.max(F.when(F.col("price").isNull(), F.col("observed_at"))).alias("e"))
    return got.select("source_id", "x.event_id", F.col("x.price").isNotNull().alias("healthy"), F.unix_micros(F.col("e").cast("timestamp")).alias("last_error_us"))


@query("b6_retention", "WITH m AS (SELECT max(observed_at) AS newest_at FROM quotes) SELECT event_id FROM quotes, m WHERE NOT (source_type IN ('cex_websocket', 'dex_api') AND observed_at < newest_at - INTERVAL 300 SECOND)")
def retention(spark, sf_dir):
    """Rows that stay when quick-lived types older than 300 s are purged."""
    q = view(spark, sf_dir, "quotes")
    return q.join(F.broadcast(q.agg(F.max("observed_at").alias("newest_at"))), F.lit(True)).where("NOT (source_type IN ('cex_websocket', 'dex_api') AND observed_at < newest_at - INTERVAL 300 SECONDS)").select("event_id")


@query("entry_off_peg", f"""
WITH {_GOOD}, m AS (SELECT max(observed_at) AS newest_at FROM good),
l AS (SELECT tenant_id, market_key, source_id, arg_max(price, (observed_at, event_id)) AS price, max(observed_at) AS seen FROM good GROUP BY ALL),
a AS (SELECT tenant_id, market_key, count(*) AS n_sources, quantile_disc(price, 0.5) AS median FROM l, m WHERE seen >= newest_at - INTERVAL 12 HOUR GROUP BY ALL)
SELECT tenant_id, market_key, CAST(n_sources AS BIGINT) AS n_sources, round(median, 6) AS median, round(abs(median - 1) * 100, 6) AS divergence,
       CASE WHEN abs(median - 1) * 100 >= 5 THEN 'critical' WHEN abs(median - 1) * 100 >= 1 THEN 'high' WHEN abs(median - 1) * 100 >= 0.5 THEN 'medium' END AS severity, n_sources >= 2 AS has_quorum FROM a""")
def off_peg(spark, sf_dir):
    """Which markets are off their peg now, how badly, and with how many sources?"""
    from ..functions.severity import band, divergence_pct

    good = ops.valid_price(view(spark, sf_dir, "quotes"))
    newest = good.groupBy("tenant_id", "market_key", "source_id").agg(F.max_by("price", F.struct("observed_at", "event_id")).alias("price"), F.max("observed_at").alias("at"))
    fresh = newest.join(F.broadcast(good.agg(F.max("observed_at").alias("newest_at"))), F.expr("at >= newest_at - INTERVAL 12 HOURS")).withColumn("weight", F.lit(1.0))
    keys = ["tenant_id", "market_key"]
    got = ops.weighted_median_by(fresh, keys).join(fresh.groupBy(*keys).agg(F.count("*").alias("n_sources")), keys)
    d = divergence_pct(F.col("median"), F.lit(1.0))
    return got.select(*keys, "n_sources", F.round("median", 6).alias("median"), F.round(d, 6).alias("divergence"), band(d, F.lit(0.5), F.lit(1.0), F.lit(5.0)).alias("severity"), (F.col("n_sources") >= 2).alias("has_quorum"))
