"""Scans that keep their place: keyset scans by time and key, and confirmed ranges of blocks by chain.

As in a stream's checkpoint, what a batch will read is written down before it is read, and that it is done, afterwards.
A run that ended in between reads exactly the same range again under the same number, whatever has come since, so a
sink that remembers batch numbers (``versioned.VersionedTable``) has every row once.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scans import confirmed_bounds, incremental_scan

Sink = Callable[[DataFrame, int], object]


class Log:
    """Numbered JSON files, each put there by one rename."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def last(self) -> tuple[int, dict] | None:
        fs, folder = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        numbers = [int(n) for s in (fs.listStatus(folder) if fs.exists(folder) else []) if (n := s.getPath().getName()).isdigit()]
        if not numbers:
            return None
        data = fs.open(self._path(str(max(numbers))))
        try:
            return max(numbers), json.loads(bytes(data.readAllBytes()).decode())
        finally:
            data.close()

    def put(self, number: int, value: dict) -> None:
        fs, draft, final = self._fs(), self._path(f".{number}.draft"), self._path(str(number))
        out = fs.create(draft, True)
        try:
            out.write(json.dumps(value, sort_keys=True).encode())
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"{self.root}/{number} is there already: another run reads from this cursor")
        if number > 1:  # the one before stays, for a look back
            fs.delete(self._path(str(number - 2)), False)


class Cursor:
    """``plan(after)`` tells the next range from the end of the last, or None if there is nothing; ``read(range)`` its rows."""

    def __init__(self, spark: SparkSession, root: str):
        self.planned, self.done = Log(spark, f"{root}/planned"), Log(spark, f"{root}/done")

    def run(self, plan: Callable[[dict | None], dict | None], read: Callable[[dict], DataFrame], sink: Sink) -> int | None:
        """One batch; its number, or None if there was nothing to read."""
        planned, done = self.planned.last(), self.done.last()
        if planned and (done is None or planned[0] > done[0]):
            number, range_ = planned  # a run ended before it was done
        else:
            range_ = plan(planned[1] if planned else None)
            if range_ is None:
                return None
            number = planned[0] + 1 if planned else 0
            self.planned.put(number, range_)
        sink(read(range_), number)
        self.done.put(number, {})
        return number


def keyset(cursor: Cursor, df: DataFrame, ts: str, key: str, sink: Sink, limit: int | None = None) -> int | None:
    """The rows after the last batch's end, by ``(ts, key)``; at most ``limit`` of them, the first ones."""

    def bounds(r: dict) -> DataFrame:
        start, end = r["after"], r["end"]
        rows = incremental_scan(df, ts, key, datetime.datetime.fromisoformat(start[0]), start[1]) if start else df
        at = F.lit(datetime.datetime.fromisoformat(end[0]))
        return rows.where((F.col(ts) <= at) & ((F.col(ts) < at) | (F.col(key) <= F.lit(end[1]))))

    def plan(last: dict | None) -> dict | None:
        after = last and last["end"]
        rows = incremental_scan(df, ts, key, datetime.datetime.fromisoformat(after[0]), after[1]) if after else df.where(F.col(ts).isNotNull() & F.col(key).isNotNull())
        rows = rows if limit is None else rows.orderBy(ts, key).limit(limit)
        end = rows.agg(F.max(F.struct(ts, key))).first()[0]
        return None if end is None else {"after": after, "end": [end[0].isoformat(), end[1]]}

    return cursor.run(plan, bounds, sink)


def confirmed(cursor: Cursor, events: DataFrame, depth: int, sink: Sink, lookback: int = 100) -> int | None:
    """Events of the blocks that have become ``depth`` deep since the last batch, by chain (one bound for each)."""

    def plan(last: dict | None) -> dict | None:
        ends = {} if last is None else {c: end for c, (_, end) in last["chains"].items()}
        cursors = events.sparkSession.createDataFrame(list(ends.items()), "chain string, cursor long")
        rows = confirmed_bounds(events, cursors, depth, lookback).collect()  # a row for each chain
        chains = {c: [end + 1, end] for c, end in ends.items()} | {r["chain"]: [r["start"], r["safe"]] for r in rows if r["safe"] >= r["start"]}
        return {"chains": chains} if any(a <= b for a, b in chains.values()) else None

    def read(r: dict) -> DataFrame:
        bounds = events.sparkSession.createDataFrame([(c, a, b) for c, (a, b) in r["chains"].items()], "chain string, start long, safe long")
        return events.join(F.broadcast(bounds), "chain").where("block_number BETWEEN start AND safe").drop("start", "safe")

    return cursor.run(plan, read, sink)
