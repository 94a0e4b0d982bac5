"""The latest row of each subject (source, market) as of every row, whatever subjects there are.

Rows stream in order of time in stretches, each with the stretch before it to look back on, so that a busy key is
spread over many tasks. A task remembers one row for each subject it has met in the stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .asof import micros

#: Rows times subjects that are worked on at once.
CELLS = 1 << 21


def bucketed(df: DataFrame, width_ms: int) -> DataFrame:
    """Each row in its own stretch of time (``__own``) and, to be looked back on, in the next: windows by key and
    ``__bucket`` then reach back ``width_ms`` at least, and one busy key is spread over many tasks."""
    at = F.floor(micros(F.col("observed_at")) / (width_ms * 1000))
    places = F.array(F.struct(at.alias("__bucket"), F.lit(True).alias("__own")), F.struct((at + 1).alias("__bucket"), F.lit(False).alias("__own")))
    return df.select("*", F.inline(places))


def latest_rows(codes: np.ndarray, subjects: int) -> np.ndarray:
    """For each row and subject, the last row so far with that subject, or -1."""
    out = np.full((len(codes), subjects), -1, np.int32)
    some = np.flatnonzero(codes >= 0)
    out[some, codes[some]] = some
    return np.maximum.accumulate(out, axis=0)


def latest_of_each(df: DataFrame, keys: tuple[str, ...], subject: Column, value: Column, out: str, width_ms: int, asked: Column | None = None, lapse: tuple[str, str, str] | None = None) -> DataFrame:
    """Add ``out``: the ``value`` of the newest row of each ``subject`` among the key's rows up to the row, in order of
    ``observed_at`` and ``event_id``. Values older than ``width_ms`` may be missing; a row without subject has no value for others.
    Rows for which ``asked`` isn't true get null. ``lapse`` names a column of whole numbers and two fields of the value: as long
    as the row's number is less than the first field (null: always), the second one, which is large, isn't given but null."""
    segment = [*keys, "__bucket"]
    rows = bucketed(df.withColumns({"__subject": subject.cast("string"), "__value": value, "__asked": F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))}), width_ms)
    rows = rows.repartition(*segment).sortWithinPartitions(*segment, "observed_at", "event_id")
    kept = [f for f in rows.schema.fields if f.name not in ("__subject", "__value", "__asked", "__bucket", "__own")]
    kind = rows.schema["__value"].dataType
    if lapse:  # what isn't given is null
        kind = T.StructType([T.StructField(f.name, f.dataType) for f in kind])
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(kind))])
    names = [f.name for f in schema.fields]

    def given(value: pa.Array, cells: np.ndarray, now: np.ndarray | None) -> pa.Array:
        if lapse is None:
            return value.take(pa.array(cells))
        parts = dict(zip((f.name for f in value.type), value.flatten(), strict=True))
        until = parts[lapse[1]].fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        places = pa.array(cells, mask=now < until[cells])
        return pa.StructArray.from_arrays([p.take(places if n == lapse[2] else pa.array(cells)) for n, p in parts.items()], names=list(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, subjects, values = None, None, None  # the latest row of each subject of the segment

        def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal subjects, values
            subject, value = batch.column("__subject"), batch.column("__value")
            if subjects is not None and len(subjects):
                subject, value = pa.concat_arrays([subjects, subject]), pa.concat_arrays([values, value])
            before = len(subject) - batch.num_rows
            coded = subject.dictionary_encode()
            found = latest_rows(coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), len(coded.dictionary))
            newest = pa.array(found[-1][found[-1] >= 0])
            subjects, values = subject.take(newest), value.take(newest)
            own = batch.column("__own").to_numpy(zero_copy_only=False)
            want = own & batch.column("__asked").to_numpy(zero_copy_only=False)
            cells = found[before:][own]
            held = (cells >= 0) & want[own][:, None]
            sizes = held.sum(axis=1)
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), mask=np.r_[~want[own], False])
            now = np.repeat(batch.column(lapse[0]).to_numpy(zero_copy_only=False)[own], sizes) if lapse else None
            lists = pa.ListArray.from_arrays(offsets, given(value, cells[held], now))
            return pa.RecordBatch.from_arrays([*(batch.column(n).filter(pa.array(own)) for n in names[:-1]), lists], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            changed = np.zeros(batch.num_rows, bool)
            for k in segment:
                c = batch.column(k)
                changed[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).fill_null(True).to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.flatnonzero(changed)].tolist()
            for i, (a, b) in enumerate(zip(starts, [*starts[1:], batch.num_rows], strict=True)):
                now = tuple(batch.column(k)[a].as_py() for k in segment)
                if i or now != at:
                    at, subjects, values = now, None, None
                step = max(1, CELLS // (1024 + len(subjects if subjects is not None else ())))
                while a < b:
                    yield piece(batch.slice(a, min(step, b - a)))
                    a += step

    return rows.mapInArrow(run, schema)
