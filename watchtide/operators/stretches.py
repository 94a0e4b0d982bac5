"""Looks back along a key without sorting the whole key in one task.

Time is cut into stretches, and windows run within a key's stretch. What a row needs from before its stretch is one
value, the last one of the earlier stretches, which comes from one small row per key and stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(df: DataFrame, keys: list[str], at: str, order: list[str], values: dict[str, Column], width_us: int) -> DataFrame:
    """Add, for each entry of ``values``, its last value that isn't null among the key's rows before the row, or null.

    Rows are ordered by ``at`` (microseconds) and ``order``. ``df`` is read twice, so it should be a table."""
    df = df.withColumn("__stretch", F.floor(F.col(at) / width_us))
    before = Window.partitionBy(*keys, "__stretch").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumns({k: F.last(v, ignorenulls=True).over(before) for k, v in values.items()})
    place = F.struct(at, *order)
    ends = df.groupBy(*keys, "__stretch").agg(*(F.max_by(v, F.when(v.isNotNull(), place)).alias(f"__end_{k}") for k, v in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "__stretch", *(F.last(f"__end_{k}", ignorenulls=True).over(earlier).alias(f"__from_{k}") for k in values))
    both = inside.join(carried, [*keys, "__stretch"], "left")
    return both.withColumns({k: F.coalesce(k, f"__from_{k}") for k in values}).drop("__stretch", *(f"__from_{k}" for k in values))


def latest_of_another(df: DataFrame, keys: list[str], subject: str, at: str, order: list[str], reach_us: Column) -> DataFrame:
    """Add ``other_at``: when a row of the key with another ``subject`` last came before the row, as far as ``reach_us``
    (equal for all rows of a key) back; older ones may be missing.

    Within rows in order of time, the last row of another subject stands right before the run of equal subjects that
    the row is in. Each row stands in its own stretch and the next, so a busy key is spread over many tasks."""
    bucket = F.floor(F.col(at) / reach_us)
    rows = df.select("*", F.inline(F.array(F.struct(bucket.alias("__bucket"), F.lit(True).alias("__own")), F.struct((bucket + 1).alias("__bucket"), F.lit(False).alias("__own")))))
    w = Window.partitionBy(*keys, "__bucket").orderBy(at, *order)
    rows = rows.withColumn("__before", F.lag(F.struct(subject, at)).over(w))
    rows = rows.withColumn("__run", F.when(F.col(f"__before.{subject}") != F.col(subject), F.col(f"__before.{at}")))
    return rows.withColumn("other_at", F.last("__run", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__own").drop("__bucket", "__own", "__before", "__run")


def running_sum(df: DataFrame, keys: list[str], at: str, order: list[str], values: dict[str, Column], width_us: int) -> DataFrame:
    """Add, for each entry of ``values``, its sum over the key's rows before the row (0 if there is none). ``df`` is read
    twice, so it should be a table."""
    df = df.withColumn("__stretch", F.floor(F.col(at) / width_us))
    before = Window.partitionBy(*keys, "__stretch").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumns({k: F.sum(v).over(before) for k, v in values.items()})
    totals = df.groupBy(*keys, "__stretch").agg(*(F.sum(v).alias(f"__all_{k}") for k, v in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "__stretch", *(F.sum(f"__all_{k}").over(earlier).alias(f"__from_{k}") for k in values))
    both = inside.join(carried, [*keys, "__stretch"], "left")
    return both.withColumns({k: F.coalesce(k, F.lit(0)) + F.coalesce(f"__from_{k}", F.lit(0)) for k in values}).drop("__stretch", *(f"__from_{k}" for k in values))
