"""The feed as one stream over payloads that come twice, in two micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.feeds import normalize_feed
from ..sources.shared import shared_folder
from ..streaming.feed import FeedPipeline
from .feeds import _json, _num, market_sql
from .registry import query, view

_ROWS = f"""p AS (SELECT event_id AS row_id, user_id, received_at, payload, {_json('s')} AS sym, coalesce({_num(_json('c'))}, {_num(_json('price'))}) AS price, {_json('id')} AS own FROM raw_binance),
g AS (SELECT *, 'st-' || (user_id % 140) AS stream_id, {market_sql('sym')} AS market_key FROM p WHERE sym IS NOT NULL AND price IS NOT NULL),
o AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id % 7, stream_id, coalesce(own, received_at || payload) ORDER BY row_id) = 1)"""


def _run(spark, sf_dir) -> FeedPipeline:
    folder = shared_folder(spark, "payloads")
    raw = view(spark, sf_dir, "raw_binance").select(
        F.col("event_id").alias("row_id"), "received_at", "parser_name", "payload", F.lit("binance").alias("provider"), F.concat(F.lit("src-"), F.col("user_id") % 7).alias("source_id"),
        F.lit("cex_websocket").alias("source_type"), F.concat(F.lit("st-"), F.col("user_id") % 140).alias("stream_id"),
    )
    feed = FeedPipeline(spark, shared_folder(spark, "feed"), lambda df: normalize_feed(df, ("binance_miniticker_v1",)), view(spark, sf_dir, "targets"), parts=8)
    for _ in range(2):  # what comes again changes nothing but the time when it was last seen
        raw.write.mode("append").parquet(folder)
        feed.run(spark.readStream.schema(raw.schema).parquet(folder))
    return feed


@query("s_feed_events", f"WITH {_ROWS} SELECT row_id, t.tenant_id, market_key, round(price, 6) AS price, CASE WHEN own IS NOT NULL THEN 'binance:src-' || (user_id % 7) || ':' || o.stream_id || ':' || own END AS own_key FROM o JOIN targets t ON o.stream_id = t.stream_id WHERE t.enabled")
def feed_events(spark, sf_dir):
    """The tenants' events that the feed sends, once for each new payload and enabled tenant."""
    got = _run(spark, sf_dir).events.read()
    return got.select("row_id", "tenant_id", "market_key", F.round("price", 6).alias("price"), F.when(F.col("dedup_key").startswith("binance:"), F.col("dedup_key")).alias("own_key"))


@query("s_feed_metrics", f"WITH {_ROWS}, c AS (SELECT (SELECT count(*) FROM p) AS n, (SELECT count(*) FROM g) AS good, (SELECT count(*) FROM o) AS fresh) SELECT CAST(unnest([0, 1]) AS BIGINT) AS batch, n AS rows_received, n - good AS rows_failed, good - unnest([fresh, 0]) AS rows_deduped, unnest([fresh, 0]) AS rows_ingested FROM c")
def feed_metrics(spark, sf_dir):
    """What each micro-batch of the feed brought."""
    return _run(spark, sf_dir).metrics.read().select("batch", "rows_received", "rows_failed", "rows_deduped", "rows_ingested")
