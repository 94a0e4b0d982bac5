"""Scans: raw feeds, topics, scenario files, curated records, keyset and confirmed ranges."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_raw_feed(spark: SparkSession, path: str, configs: DataFrame | None = None, schema: str = RAW_SCHEMA, streaming: bool = False, key: str = "stream_config_id", files_per_batch: int = 100) -> DataFrame:
    """Raw payload rows, in batch or as a stream, with their stream's configuration."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path) if streaming else spark.read.schema(schema).parquet(path)
    return rows if configs is None else rows.join(configs, key)


def read_events(spark: SparkSession, topic: str, **kafka: str) -> DataFrame:
    """A topic: a Kafka topic if servers are given (the connector must be on the class path), else a
    directory of Parquet files, or one file. Offsets live in the query's checkpoint."""
    if kafka:
        return spark.readStream.format("kafka").option("subscribe", topic).options(**kafka).load().select(F.col("value").cast("string").alias("payload"), "timestamp")
    folder, _, name = topic.rpartition("/")
    return spark.readStream.schema(RAW_SCHEMA).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(RAW_SCHEMA).parquet(topic)


def incremental_scan(df: DataFrame, ts: str, key: str, last_ts: datetime.datetime, last_key, limit: int | None = None) -> DataFrame:
    """Rows after ``(last_ts, last_key)``, in order. The plain bound on ``ts`` reaches the file statistics."""
    later = df.where((F.col(ts) >= F.lit(last_ts)) & ((F.col(ts) > F.lit(last_ts)) | (F.col(key) > F.lit(last_key))))
    return later if limit is None else later.orderBy(ts, key).limit(limit)


def confirmed_bounds(events: DataFrame, cursors: DataFrame, depth: int, lookback: int = 100) -> DataFrame:
    """``chain, start, safe``: from each chain's cursor + 1 to its head less ``depth``; without a cursor, from ``lookback`` blocks
    before that."""
    heads = events.groupBy("chain").agg((F.max("block_number") - depth).alias("safe"))
    bounds = heads.join(cursors, "chain", "left").withColumn("start", F.coalesce(F.col("cursor") + 1, F.greatest(F.col("safe") - lookback, F.lit(0))))
    return bounds.select("chain", "start", "safe")


def confirmed_range(events: DataFrame, cursors: DataFrame, depth: int, lookback: int = 100) -> DataFrame:
    """Events from each chain's cursor + 1 to its head less ``depth``; without a cursor, ``lookback`` blocks."""
    return events.join(confirmed_bounds(events, cursors, depth, lookback), "chain").where("block_number BETWEEN start AND safe").drop("start", "safe")


def select_logs(logs: DataFrame, filters: DataFrame) -> DataFrame:
    """Logs of the wanted contracts and topics (a filter without topic takes all of the contract's)."""
    exact = logs.join(filters.where("topic0 IS NOT NULL").select("address", "topic0"), ["address", "topic0"], "left_semi")
    whole = filters.where("topic0 IS NULL").select("address").distinct()
    return exact.unionByName(logs.join(whole, "address", "left_semi").join(filters.where("topic0 IS NOT NULL").select("address", "topic0"), ["address", "topic0"], "left_anti"))


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenario files (yaml, yml, json) below ``path``: ``path, scenario_id, scenario (JSON text), reject``. A file that
    can't be read, or lacks a required key, is a row with ``reject`` set, and with its id if it names one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{yaml,yml,json}").load(path).select("path", "content")

    def parse(batches):
        import json

        try:
            import yaml
        except ImportError:
            yaml = None
        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    doc = yaml.safe_load(content) if yaml else json.loads(content)
                    missing = [k for k in ("scenario_id", "chain", "incident_class", "steps") if k not in doc]
                    doc = {"source_refs": [], "tags": []} | doc
                    out.append((name, None if doc.get("scenario_id") is None else str(doc["scenario_id"]), None if missing else json.dumps(doc, sort_keys=True, default=str), "missing:" + ",".join(missing) if missing else None))
                except Exception as e:  # noqa: BLE001  a bad file is a row
                    out.append((name, None, None, f"unreadable:{type(e).__name__}"))
            yield pd.DataFrame(out, columns=["path", "scenario_id", "scenario", "reject"])

    return files.mapInPandas(parse, "path string, scenario_id string, scenario string, reject string")


def read_curated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Curated records: JSON files that hold an object or an array of objects."""
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
