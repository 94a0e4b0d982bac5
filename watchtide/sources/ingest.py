"""Ingest batches whose metrics are counted while they run, and the records of what failed."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Characters of a payload that a failure record keeps.
EXCERPT = 500


@dataclass
class BatchMetrics:
    batch_id: str
    stream_id: str
    started_at: datetime.datetime
    ended_at: datetime.datetime
    rows_ingested: int
    rows_deduped: int
    rows_failed: int
    status: str
    error_summary: str | None

    def as_dict(self) -> dict:
        return asdict(self)


def ingest(rows: DataFrame, keys: list[str], write: Callable[[DataFrame], None], batch_id: str, stream_id: str, error: str = "parse_error", kinds: int = 5) -> BatchMetrics:
    """Write the first row of each key, and tell what went by.

    Rows are counted as they pass, before and after the repeats are dropped, in the job that writes them; there is no
    second scan. Rows with an ``error`` aren't written. ``status`` is ``completed``, ``partial`` if any row failed, or
    ``failed`` if the batch did, which then has no numbers; ``error_summary`` names the smallest ``kinds`` errors or the batch's own."""
    came, left = Observation(), Observation()
    failed = F.col(error).isNotNull()
    seen = rows.observe(came, F.count("*").alias("n"), F.count(F.when(failed, 1)).alias("failed"), F.array_sort(F.collect_set(F.substring(error, 1, 80))).alias("errors"))
    once = seen.where(~failed).dropDuplicates(keys).observe(left, F.count("*").alias("n"))
    started = datetime.datetime.now(datetime.UTC)
    try:
        write(once)
    except Exception as e:  # noqa: BLE001  whatever the sink does
        return BatchMetrics(batch_id, stream_id, started, datetime.datetime.now(datetime.UTC), 0, 0, 0, "failed", str(e).split("\n")[0][:EXCERPT])
    n, bad, out = came.get["n"], came.get["failed"], left.get["n"]
    errors = list(came.get["errors"])[:kinds]
    return BatchMetrics(batch_id, stream_id, started, datetime.datetime.now(datetime.UTC), out, n - bad - out, bad, "partial" if bad else "completed", "; ".join(errors) or None)


#: Kinds of failures that another try may mend; what can't be parsed now can't be later.
RETRYABLE = ("timeout", "connection", "storage")


def failures(rows: DataFrame, payload: Column, error: str = "parse_error", kind: Column | None = None) -> DataFrame:
    """A record for each failed row: ``stream_id, source_id, source_type, event_type`` as far as they are there,
    ``payload_excerpt, error_kind, error_message, retryable, observed_at``."""
    kind = F.lit("parse") if kind is None else F.coalesce(kind, F.lit("parse"))
    own = [c for c in ("event_id", "stream_id", "source_id", "source_type", "event_type", "observed_at") if c in rows.columns]
    bad = rows.where(F.col(error).isNotNull())
    return bad.select(*own, F.substring(payload, 1, EXCERPT).alias("payload_excerpt"), kind.alias("error_kind"), F.col(error).alias("error_message"), F.lower(kind).isin(*RETRYABLE).alias("retryable"))
