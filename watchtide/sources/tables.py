"""Writers and table upkeep: insert if absent, upserts, routing, fan-out, archives, manifests.

Upserts are full-refresh: they return the new content of the table, to be written to a new version. Each is
one shuffle on the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Landing tables by source type (fixed values).
ROUTES = {"cex_websocket": "raw_cex", "dex_api": "raw_dex", "oracle_api": "raw_chain", "evm_chain": "raw_chain"}
CHANNELS = ("webhook", "slack", "telegram", "discord")


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows to append: the first of each key, where the target has none."""
    first = incoming.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    return first.join(target.select(*keys), keys, "left_anti")


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; incoming rows win over the target."""
    both = target.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.desc("__new"), *(F.desc(c) for c in order))
    return both.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n", "__new")


def upsert_by_policy(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Cases from an ordered log of changes of several kinds. Incidents set everything; alerts set severity
    and status; detections set severity, and chain and protocol only where the last incident and what came since left none."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("kind")
    sets = lambda c, cond: F.when(cond, F.col(c))
    log = changes.withColumn("__severity", F.last("severity", ignorenulls=True).over(w))
    log = log.withColumn("__status", F.last(sets("status", kind.isin("incident", "alert")), ignorenulls=True).over(w))
    # an incident sets chain and protocol even to nothing; detections after it fill them
    since = Window.partitionBy(key, "__incidents").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    log = log.withColumn("__incidents", F.count(sets("kind", kind == "incident")).over(w))
    log = log.withColumns({f"__{c}": F.first(sets(c, kind != "alert"), ignorenulls=True).over(since) for c in ("chain", "protocol")})
    rank = F.max("severity_rank").over(w)
    last = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    done = log.withColumn("severity_rank_peak", rank).withColumn("__n", F.row_number().over(last)).where("__n = 1")
    return done.select(key, F.col("__severity").alias("severity_last"), "severity_rank_peak", F.col("__status").alias("status"), F.col("__chain").alias("chain"), F.col("__protocol").alias("protocol"))


def route(source_type: Column) -> Column:
    return reduce(lambda out, kv: F.when(source_type == kv[0], kv[1]).otherwise(out), ROUTES.items(), F.lit("raw_cex"))


def landed(envelopes: DataFrame, key: str = "idempotency_key", seen: str = "observed_at") -> DataFrame:
    """Landing rows: the first of each key with the latest time it was seen, and the pointer to its table."""
    w = Window.partitionBy(key)
    rows = envelopes.withColumn("__n", F.row_number().over(w.orderBy(seen, "event_id"))).withColumn("last_observed_at", F.max(seen).over(w)).where("__n = 1").drop("__n")
    return rows.withColumn("landing_table", route(F.col("source_type"))).withColumn("pointer", F.concat(F.lit("rawdb:"), "landing_table")).withColumn("partition_key", F.date_format(seen, "yyyy-MM-dd"))


def write_landed(rows: DataFrame, root: str) -> None:
    """One append per landing table, partitioned by day; for ``foreachBatch``."""
    for name in sorted(set(ROUTES.values())):
        rows.where(F.col("landing_table") == name).write.mode("append").partitionBy("partition_key").parquet(f"{root}/{name}")


def append_log(rows: DataFrame, path: str, ts: str) -> None:
    """Append rows to a log that is partitioned by kind and month; nothing that stands there is touched."""
    rows.withColumn("month", F.date_format(ts, "yyyy-MM")).write.mode("append").partitionBy("kind", "month").parquet(path)


def fan_out(events: DataFrame, targets: DataFrame, key: str = "stream_id") -> DataFrame:
    """One event for each enabled tenant of its stream, with ids and price in the payload."""
    rows = events.join(targets.where("enabled").select(key, "tenant_id"), key)
    return rows.withColumn("payload", F.to_json(F.struct("dedup_key", "market_key", F.round("price", 6).alias("price"), key, "tenant_id")))


def dispatch_requests(alerts: DataFrame, channels: Column) -> DataFrame:
    """A request for each allowed channel of each alert."""
    allowed = F.filter(channels, lambda c: F.lower(c).isin(*CHANNELS))
    rows = alerts.withColumn("channel", F.explode(F.array_distinct(F.transform(allowed, F.lower))))
    return rows.withColumn("dedup_key", F.concat_ws(":", "alert_id", "channel"))


def dispatch_results(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """What became of each request: ``responses`` has a JSON text per alert with a result for each channel. Where
    a response or its result for the channel is missing, the request failed with ``no_response``."""
    parsed = F.from_json("response", "struct<results:array<struct<channel:string,success:boolean,error:string>>>")["results"]
    answered = responses.select("alert_id", F.explode(parsed).alias("r")).groupBy("alert_id", F.lower("r.channel").alias("channel")).agg(F.max(F.struct("r.success", "r.error")).alias("r"))
    rows = requests.join(answered, ["alert_id", "channel"], "left")
    return rows.withColumn("delivered", F.coalesce("r.success", F.lit(False))).withColumn("error", F.when(~F.col("delivered"), F.coalesce("r.error", F.lit("no_response")))).drop("r")


def batch_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count("parse_error").alias("n_failed"), F.count(F.when(F.col("parse_error").isNull(), 1)).alias("n_parsed"))


def failure_rows(rows: DataFrame, record: list[str]) -> DataFrame:
    """Side output of a batch: the rows that couldn't be parsed, with the columns ``record`` as JSON."""
    return rows.where("parse_error IS NOT NULL").withColumn("record", F.to_json(F.struct(*record)))


def export_manifest(rows: DataFrame, partition: list[str], columns: list[str]) -> DataFrame:
    """Row count and checksum of each partition. Rows are digested first, and the digests are added up in a
    way that doesn't depend on their order, so no partition is gathered in one task."""
    digest = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    part = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return rows.withColumn("__part", part).groupBy(*partition).agg(F.count("*").alias("row_count"), F.sum("__part").alias("checksum"))


def write_archive(events: DataFrame, manifest: DataFrame, root: str, partition: list[str]) -> None:
    """Hive-partitioned JSON lines of the events, and the manifest beside them."""
    events.write.mode("overwrite").partitionBy(*partition).json(f"{root}/events")
    manifest.write.mode("overwrite").json(f"{root}/manifest")


def feature_slices(vectors: DataFrame, root: str) -> DataFrame:
    return vectors.withColumn("uri", F.concat(F.lit(f"{root}/version="), "version", F.lit("/detection="), "detection_id"))
