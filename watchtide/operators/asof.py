"""As-of lookups bounded in time.

A lookup never reaches further back than its width, so time is cut into buckets of that width and each
looked-up row is put into its own bucket and the next. Rows are then partitioned by key and bucket: one very
busy key (a single exchange rate that all quotes need) is spread over as many tasks as there are buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def latest_within(rows: DataFrame, looked_up: DataFrame, keys: list[str], ts: str, value: str, width_sec: int, out: str) -> DataFrame:
    """Add to each row the ``value`` of the newest ``looked_up`` row with the same keys, no newer than it and
    no older than ``width_sec`` (equality counts both ways); null if there is none. Of several at the newest time, the
    largest value counts. The frame only grows, so a bucket is one pass over its rows, however dense they are."""
    width = width_sec * 1_000_000
    at = micros(F.col(ts))
    left = rows.withColumn("__at", at).withColumn("__bucket", F.floor(F.col("__at") / width)).withColumn("__value", F.lit(None).cast(looked_up.schema[value].dataType)).withColumn("__own", F.lit(True))
    right = looked_up.select(*keys, at.alias("__at"), F.col(value).alias("__value")).where(F.col("__value").isNotNull())
    right = right.withColumn("__bucket", F.explode(F.array(F.floor(F.col("__at") / width), F.floor(F.col("__at") / width) + 1))).withColumn("__own", F.lit(False))
    both = left.unionByName(right, allowMissingColumns=True)
    frame = Window.partitionBy(*keys, "__bucket").orderBy("__at", "__own", "__value").rowsBetween(Window.unboundedPreceding, 0)
    newest = F.last(F.when(~F.col("__own"), F.struct("__at", "__value")), ignorenulls=True).over(frame)
    found = both.withColumn("__newest", newest).where("__own")
    found = found.withColumn(out, F.when(F.col("__newest.__at") >= F.col("__at") - width, F.col("__newest.__value")))
    return found.drop("__at", "__bucket", "__value", "__own", "__newest")
