"""The feed's tables after any break and repetition are those of a plain fold."""

import datetime

import pytest
from pyspark.sql import functions as F

from watchtide.streaming.feed import WRITER, FeedPipeline

RAW = "row_id long, provider string, source_id string, source_type string, stream_id string, payload string, minute long"
BATCHES = [
    [(1, "p", "s1", "cex_websocket", "t1", "id=a", 1), (2, "p", "s1", "cex_websocket", "t1", "id=a", 2), (3, "p", "s2", "dex_api", "t2", "plain", 3), (4, "p", "s2", "dex_api", "t2", "bad", 4)],
    [(5, "p", "s1", "cex_websocket", "t1", "id=a", 9), (6, "p", "s2", "dex_api", "t2", "plain", 3), (7, "p", "s2", "dex_api", "t2", "plain", 4), (8, "p", "s1", "evm_chain", "t1", "id=b", 5)],
    [],
    [(9, "p", "s3", "cex_websocket", "t3", "id=a", 1)],
]
TARGETS = [("t1", "x", True), ("t1", "y", True), ("t1", "z", False), ("t2", "x", True)]


def parse(df):
    known = F.when(F.col("payload").startswith("id="), F.substring("payload", 4, 10))
    at = F.timestamp_seconds(F.col("minute") * 60)
    return df.withColumns({"event_id": known, "event_type": F.lit("quote"), "market_key": F.lit("A/USD"), "price": F.lit(1.5), "observed_at": at, "parse_error": F.when(F.col("payload") == "bad", "no price")}).drop("minute")


def tables_of(p):
    return {
        "operational": sorted(r["row_id"] for r in p.operational.read().collect()),
        "events": sorted((r["row_id"], r["tenant_id"]) for r in p.events.read().collect()),
        "landing": sorted((r["event_id"], r["landing_table"], r["last_observed_at"].minute) for r in p.landing.read().collect()),
        "failures": sorted((r["event_id"], r["error_message"], r["retryable"]) for r in p.failures.read().collect()),
        "metrics": sorted(tuple(r) for r in p.metrics.read().collect()),
    }


WANT = {
    "operational": [1, 3, 7, 8, 9],
    "events": [(1, "x"), (1, "y"), (3, "x"), (7, "x"), (8, "x"), (8, "y")],
    "landing": [(1, "raw_cex", 9), (3, "raw_dex", 3), (4, "raw_dex", 4), (7, "raw_dex", 4), (8, "raw_chain", 5), (9, "raw_cex", 1)],
    "failures": [(4, "no price", False)],
    "metrics": [(0, 4, 1, 1, 2, "partial"), (1, 4, 0, 2, 2, "completed"), (2, 0, 0, 0, 0, "completed"), (3, 1, 0, 0, 1, "completed")],
}


def pipeline(spark, root):
    return FeedPipeline(spark, str(root), parse, spark.createDataFrame(TARGETS, "stream_id string, tenant_id string, enabled boolean"), parts=2)


def test_batches_broken_off_anywhere(spark, tmp_path):
    p = pipeline(spark, tmp_path)
    breaks = iter([p.operational, p.landing, p.events, p.metrics])
    for n, rows in enumerate(BATCHES):
        df, table = spark.createDataFrame(rows, RAW), next(breaks)
        real = table.merge

        def fails(*_, **__):
            raise InterruptedError

        table.merge = fails
        with pytest.raises(InterruptedError):
            p.batch(df, n)
        table.merge = real
        p.batch(df, n)
        p.batch(df, n)
    assert tables_of(p) == WANT and p.operational.last_batch(WRITER) == 3


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    p = pipeline(spark, tmp_path / "out")
    for rows in BATCHES[:2]:
        spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(source)
        p.run(spark.readStream.schema(RAW).parquet(source))
    p.run(spark.readStream.schema(RAW).parquet(source))
    got = tables_of(p)
    assert got["operational"] == [1, 3, 7, 8] and got["events"] == WANT["events"] and got["metrics"] == WANT["metrics"][:2]
    assert p.landing.read().select("last_observed_at").first()[0] > datetime.datetime(1969, 1, 1)
