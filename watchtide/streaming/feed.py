"""The feed from raw payloads to the tenants' events, as one stream.

Every micro-batch is parsed once; what could be parsed and is new by its key goes into the operational table and, for each
enabled tenant, into the events; every payload leaves a landing row; what couldn't be parsed leaves a failure record. All
tables are merged once for each batch number. What is new in a batch is written down before the first of them changes, so a
batch that is repeated after a failure, wherever it broke off, ends in the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import dedup_key, error_key
from ..sources import ingest, tables
from ..sources.shared import written
from ..sources.versioned import VersionedTable, inserts, refreshes, upserts

WRITER = "feed"
METRICS = "batch long, rows_received long, rows_failed long, rows_deduped long, rows_ingested long, status string"
ORDER = ["observed_at", "row_id"]


class FeedPipeline:
    """``parse`` takes the raw rows (``row_id, provider, source_id, source_type, stream_id, payload``, and what the parsers
    read) and adds ``event_id, event_type, market_key, price, observed_at, parse_error``; ``targets`` has ``stream_id, tenant_id, enabled``."""

    def __init__(self, spark: SparkSession, root: str, parse: Callable[[DataFrame], DataFrame], targets: DataFrame, parts: int = 64):
        self.spark, self.root, self.parse, self.targets = spark, root.rstrip("/"), parse, targets
        table = lambda name, keys: VersionedTable(spark, f"{self.root}/{name}", keys, parts)
        self.operational, self.landing = table("operational", ["dedup_key"]), table("landing", ["idempotency_key"])
        self.failures, self.events = table("failures", ["dedup_key"]), table("events", ["dedup_key", "tenant_id"])
        self.metrics = VersionedTable(spark, f"{self.root}/metrics", ["batch"], 1)

    def keyed(self, parsed: DataFrame) -> DataFrame:
        """With ``dedup_key``: of the event's own id, else of its contents; failures have keys of their own."""
        where = (F.col("provider"), F.col("source_id"), F.col("stream_id"))
        key = dedup_key(*where, F.col("event_id"), F.col("event_type"), F.unix_millis(F.col("observed_at").cast("timestamp")), F.col("market_key"), F.col("payload"))
        return parsed.withColumn("dedup_key", F.when(F.col("parse_error").isNull(), key).otherwise(error_key(*where, F.col("payload"), F.col("parse_error"))))

    def batch(self, raw: DataFrame, number: int) -> None:
        """One micro-batch; ``foreachBatch`` calls it."""
        rows = written(self.keyed(self.parse(raw)), "feed")
        good, bad = rows.where("parse_error IS NULL"), rows.where("parse_error IS NOT NULL")
        fresh = f"{self.root}/fresh/{number}"
        if number > self.operational.last_batch(WRITER):
            once = tables.insert_if_absent(self.operational.touched(good), good, ["dedup_key"], ORDER)
            once.write.mode("overwrite").parquet(fresh)
        new = self.spark.read.schema(rows.schema).parquet(fresh)
        self.operational.merge(new.drop("payload", "parse_error"), inserts(["dedup_key"], ORDER), WRITER, number)
        envelopes = rows.select(F.col("dedup_key").alias("idempotency_key"), F.col("row_id").alias("event_id"), "source_type", "observed_at", "payload")
        self.landing.merge(tables.landed(envelopes), refreshes(["idempotency_key"], ["observed_at", "event_id"], "last_observed_at"), WRITER, number)
        records = ingest.failures(bad.drop("event_id").withColumnRenamed("row_id", "event_id"), F.col("payload"))
        records = records.withColumn("dedup_key", F.sha2(F.concat_ws("|", "stream_id", F.col("event_id").cast("string"), "error_message"), 256))
        self.failures.merge(records, inserts(["dedup_key"], ["event_id"]), WRITER, number)
        sent = tables.fan_out(new.select("row_id", "dedup_key", "market_key", "price", "stream_id", "observed_at"), self.targets)
        self.events.merge(sent, inserts(["dedup_key", "tenant_id"], ["row_id"]), WRITER, number)
        n, out = rows.agg(F.count("*").alias("came"), F.count("parse_error").alias("failed")).first(), new.count()
        status = "partial" if n["failed"] else "completed"
        self.metrics.merge(self.spark.createDataFrame([(number, n["came"], n["failed"], n["came"] - n["failed"] - out, out, status)], METRICS), upserts(["batch"], ["batch"]), WRITER, number)

    def run(self, stream: DataFrame, **trigger) -> None:
        """Work through all that the stream has (or as ``trigger`` says), from where the last run ended."""
        q = stream.writeStream.foreachBatch(lambda df, n: self.batch(df, n)).option("checkpointLocation", f"{self.root}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()
