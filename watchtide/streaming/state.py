"""Stateful twins on Spark's state API: values, lists and maps with timers in RocksDB.

Each processor keeps what its step needs in states of their own: the peg's few numbers as a value, a chain's blocks and
keys as maps of which only what changes is written. With ``late``, rows are held in a list until the watermark has
passed them; an event-time timer takes them out, in order of time and id, whatever micro-batch brought them. A key that
has held nothing and said nothing for ``ttl`` loses its state.

A micro-batch may hold all of a key's history. Its rows are put in order and worked through piece by piece, so that a task
needs memory for a piece and the key's state, not for the key's rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import chain, detectors, drawdown, hysteresis
from ..operators.finality import DEFAULT_DEPTH, own_depth
from .ordered import in_order

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_BOUNDED = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"


def with_rocksdb(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB, which the state API needs. All stores of an executor share
    one limit of memory, unless that is set otherwise; else each partition has its own, empty ones too."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    if spark.conf.get(_BOUNDED, None) is None:
        spark.conf.set(_BOUNDED, "true")


class Ordered(StatefulProcessor):
    """Calls ``step(state, key, rows)`` with ordered rows, piece by piece: by micro-batch, or with ``late`` as far as the watermark has
    come. ``load`` gives the key's state before the first piece, ``save`` takes it after the last."""

    def __init__(self, row_schema: str, names: list[str], order: list[str], out: list[str], late: bool):
        self.row_schema, self.names, self.order, self.out, self.late = row_schema, names, order, out, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.late:
            self.held = handle.getListState("held", self.row_schema)
        self.states(handle)

    def states(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def load(self):
        raise NotImplementedError

    def step(self, state, key: tuple, rows: pd.DataFrame) -> list[tuple]:
        raise NotImplementedError

    def save(self, state) -> None:
        raise NotImplementedError

    def _stepped(self, key: tuple, frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for rows in in_order(frames, self.order):
            state = self.load() if state is None else state
            yield pd.DataFrame(self.step(state, key, rows), columns=self.out)
        if state is not None:
            self.save(state)

    def _ready(self, rows: pd.DataFrame, mark: int) -> pd.DataFrame:
        """Hold back what is after the watermark, and wake up when it has passed the first of it."""
        ready = rows["now"] // 1000 <= mark
        rest = rows[~ready].sort_values("now")
        self.held.clear()
        if len(rest):
            self.held.put([tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in rest[self.names].itertuples(index=False)])
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(int(rest["now"].iloc[0]) // 1000, mark) + 1)
        return rows[ready]

    def _held(self) -> list[pd.DataFrame]:
        rows = list(self.held.get()) if self.held.exists() else []
        return [pd.DataFrame(rows, columns=self.names)] if rows else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        frames = (x[self.names] for x in rows)
        yield from self._stepped(key, [self._ready(pd.concat([*self._held(), *frames]), timerValues.getCurrentWatermarkInMs())] if self.late else frames)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        if held:
            yield from self._stepped(key, [self._ready(held[0], timerValues.getCurrentWatermarkInMs())])

    def close(self) -> None:
        pass


class PegProcessor(Ordered):
    """Hysteresis of one market: its state is one value."""

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("peg", "started long, cooldown long, rank int, floor double, lower int, below int")

    saved = ("started", "cooldown", "rank", "floor", "lower", "below")

    def load(self) -> dict:
        return dict(zip(self.saved, self.value.get(), strict=True)) if self.value.exists() else detectors.peg_start()

    def save(self, state: dict) -> None:
        self.value.update(tuple(state[n] for n in self.saved))

    def step(self, state: dict, key: tuple, rows: pd.DataFrame) -> list[tuple]:
        columns = [rows[c].to_numpy() for c in ("now", "breach", "rank", "divergence", "has_quotes", "floor")]
        got = hysteresis.runs(*columns, rows[list(hysteresis.SETTINGS)].to_numpy(), state)
        event, divergence = rows["event_id"].to_numpy(), columns[3]
        return [(*key, int(event[i]), t, int(k), float(divergence[i])) for i, t, k in got]


class FinalityProcessor(Ordered):
    """A chain's blocks and keys as maps; what is further below the head than ``horizon`` is forgotten."""

    horizon: int | None = None

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "head long")
        self.blocks = handle.getMapState("blocks", "block long", "hash string, keys array<string>, pending boolean")
        self.status = handle.getMapState("status", "key string", "status string")

    def load(self) -> dict:
        s = chain.new_state()
        if self.head.exists():
            s["head"] = self.head.get()[0]
        self.was = {k[0]: (v[0], tuple(v[1]), v[2]) for k, v in self.blocks.iterator()}
        s["blocks"] = {b: {"hash": h, "keys": list(keys)} for b, (h, keys, _) in self.was.items()}
        s["pending"] = sorted(b for b, v in self.was.items() if v[2])
        self.said = {k[0]: v[0] for k, v in self.status.iterator()}
        s["status"] = dict(self.said)
        return s

    def step(self, state: dict, key: tuple, rows: pd.DataFrame) -> list[tuple]:
        hashes = rows["block_hash"].astype(object).where(rows["block_hash"].notna(), None)
        events = zip(rows["event_id"].tolist(), rows["block_number"].tolist(), hashes.tolist(), rows["event_key"].tolist(), rows["depth"].tolist(), strict=True)
        out = chain.finality_step(state, key[0], events, self.horizon)
        return [(c, e, k, st, None if o is None else float(o)) for c, e, k, st, o in out]

    def save(self, state: dict) -> None:
        waiting = set(state["pending"])
        now = {b: (v["hash"], tuple(v["keys"]), b in waiting) for b, v in state["blocks"].items()}
        for kept, before, after in ((self.blocks, self.was, now), (self.status, self.said, state["status"])):
            for k in before.keys() - after.keys():
                kept.removeKey((k,))
            for k, v in after.items():
                if before.get(k) != v:
                    kept.updateValue((k,), (v[0], list(v[1]), v[2]) if isinstance(v, tuple) else (v,))
        self.head.update((state["head"],))


class DrawdownProcessor(Ordered):
    """Breaches of one subject's rules. Its state is the samples that can still be a peak: none of them has a higher
    one after it, and none is older than the longest window."""

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "at array<bigint>, value array<double>")

    def load(self) -> drawdown.RunningPeaks:
        held = drawdown.RunningPeaks()
        if self.kept.exists():
            at, value = self.kept.get()
            held.at, held.value = np.array(at, np.int64), np.array(value, float)
        return held

    def save(self, state: drawdown.RunningPeaks) -> None:
        self.kept.update((state.at.tolist(), state.value.tolist()))

    def step(self, state: drawdown.RunningPeaks, key: tuple, rows: pd.DataFrame) -> list[tuple]:
        now, tvl = rows["now"].to_numpy().astype(np.int64), rows["tvl_usd"].to_numpy().astype(float)
        rules = [json.loads(x) for x in rows["rules"]]
        widths = [[r[f"{w}_minutes"] * 60_000_000 for r in mine for w in drawdown.WINDOWS] for mine in rules]
        peaks = state.peaks(now, tvl, np.repeat(np.arange(len(rows)), [len(w) for w in widths]), np.array([x for w in widths for x in w], np.int64))
        longest = max(x for w in widths for x in w)
        late = state.at >= now[-1] - longest
        state.at, state.value = state.at[late], state.value[late]
        out, k = [], 0
        for event, value, mine in zip(rows["event_id"], tvl.tolist(), rules, strict=True):
            for r in mine:
                fast, slow, velocity = ((p - value) / p * 100 for p in peaks[k : k + 3].tolist())
                k += 3
                if value >= r["min_tvl_floor_usd"] and (velocity >= r["velocity_critical_pct"] or fast >= r["fast_drop_pct"] or slow >= r["slow_drop_pct"]):
                    out.append((*key, int(event), r["rule_id"], fast, slow, velocity))
        return out


def _run(rows: DataFrame, keys: list[str], processor: Ordered, schema: str, late: str | None) -> DataFrame:
    if late:
        rows = rows.withColumn("__at", F.timestamp_micros("now")).withWatermark("__at", late)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "EventTime" if late else "None")


def _schema(rows: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)


def peg_transitions(evaluations: DataFrame, late: str | None = None) -> DataFrame:
    """``detectors.peg_transitions`` over a stream of evaluations."""
    names = ["event_id", "now", "breach", "rank", "divergence", "has_quotes", "floor", *hysteresis.SETTINGS]
    rows = evaluations.select(*hysteresis.KEY, *names)
    out = [x.split()[0] for x in detectors.PEG_SCHEMA.split(", ")]
    return _run(rows, hysteresis.KEY, PegProcessor(_schema(rows, names), names, ["now", "event_id"], out, bool(late)), detectors.PEG_SCHEMA, late)


def finality(events: DataFrame, depths: dict[str, int] | None = None, default: int = DEFAULT_DEPTH, horizon: int | None = 4096, late: str | None = None) -> DataFrame:
    """``finality.finality`` over a stream, in order of arrival within what the watermark lets through."""
    names = ["event_id", "block_number", "block_hash", "event_key", "depth", *(["now"] if late else [])]
    at = F.unix_micros(F.col("observed_at").cast("timestamp")) if "observed_at" in events.columns else F.col("event_id")
    rows = events.select("chain", "event_id", "block_number", "block_hash", "event_key", own_depth(events, depths, default).alias("depth"), at.alias("now")).select("chain", *names)
    schema = chain.FINALITY_SCHEMA.replace("orphaned_from long", "orphaned_from double")
    processor = FinalityProcessor(_schema(rows, names), names, ["event_id"], [x.split()[0] for x in schema.split(", ")], bool(late))
    processor.horizon = horizon
    return _run(rows, ["chain"], processor, schema, late)


BREACH_SCHEMA = "tenant_id string, subject_key string, event_id long, rule_id string, fast_drop double, slow_drop double, velocity_drop double"


def drawdown_breaches(samples: DataFrame, rules: DataFrame, late: str | None = None) -> DataFrame:
    """Breaches of the tenants' drawdown rules (a static table) over a stream of samples, as ``drawdown.detections`` finds them."""
    rows = drawdown.in_scope(drawdown.real(samples), rules)
    rows = rows.select("tenant_id", "subject_key", "event_id", F.col("at").alias("now"), "tvl_usd", F.to_json("rules").alias("rules"))
    names = ["event_id", "now", "tvl_usd", "rules"]
    processor = DrawdownProcessor(_schema(rows, names), names, ["now", "event_id"], [x.split()[0] for x in BREACH_SCHEMA.split(", ")], bool(late))
    return _run(rows, ["tenant_id", "subject_key"], processor, BREACH_SCHEMA, late)
