"""Hysteresis of peg deviation, in stretches of time side by side.

Within a stretch, evaluations are taken together as runs of one kind (no quotes; no breach; a breach of one severity), and what a
run does to the state follows from where in it a time, a number of evaluations or a divergence is reached.

Every stretch is first worked through as if nothing had happened before it. Where the state at the end of the
stretch before is another one, the stretch is worked through again from that, until all fit. States forget quickly: an
open incident only knows its severity, its floor and two short counts, a closed one at most two times, and whether
those still matter can be told. So a few rounds do, and none holds a market's whole history in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

KEY = ["tenant_id", "market_key"]
SETTINGS = ("sustained_window_ms", "cooldown_sec", "deescalation_blocks", "resolution_blocks")
#: Least length of a stretch, and evaluations that a market should have in one on average.
STRETCH_US, STRETCH_ROWS = 24 * 3600 * 1_000_000, 1 << 16
_STATE = {"started": "long", "cooldown": "long", "rank": "int", "floor": "double", "lower": "int", "below": "int"}
_FRESH = {"started": None, "cooldown": None, "rank": 0, "floor": None, "lower": 0, "below": 0}


def runs(now: np.ndarray, breach: np.ndarray, rank: np.ndarray, divergence: np.ndarray, quotes: np.ndarray, floor: np.ndarray, settings: np.ndarray, s: dict) -> list[tuple[int, str, int]]:
    """``(row, transition, severity rank)`` of ordered evaluations of one market, run by run; ``s`` is changed."""
    out: list[tuple[int, str, int]] = []
    kind = np.where(quotes, np.where(breach, rank.astype(np.int64), 0), -1)
    new = np.r_[True, (kind[1:] != kind[:-1]) | (settings[1:] != settings[:-1]).any(axis=1)] if len(kind) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    for a, b in zip(starts.tolist(), np.r_[starts[1:], len(kind)].tolist(), strict=True):
        sustained, cool, down, ends = (int(x) for x in settings[a])
        k = int(kind[a])
        if k < 0:
            s.update(_FRESH)
            continue
        if k == 0 and not breach[a]:
            s["started"], s["lower"] = None, 0
            if not s["rank"]:
                continue
            low = divergence[a:b] < s["floor"]
            # how many rows below the floor stand together, up to each row
            i = np.arange(b - a)
            last = np.maximum.accumulate(np.where(low, -1, i))
            count = np.where(last < 0, i + 1 + s["below"], i - last)
            done = np.flatnonzero(low & (count >= ends))
            if not len(done):
                s["below"] = int(count[-1]) if low[-1] else 0
                continue
            at = a + int(done[0])
            out.append((at, "resolve", s["rank"]))
            s.update(rank=0, floor=None, below=0, cooldown=int(now[at]) + cool * 1_000_000)
            continue
        s["below"] = 0
        at = a
        if not s["rank"]:
            s["started"] = int(now[a]) if s["started"] is None else s["started"]
            due = max(s["started"] + sustained * 1000, s["cooldown"] if s["cooldown"] is not None else -(1 << 62))
            at = a + int(np.searchsorted(now[a:b], due, "left"))
            if at == b:
                continue
            out.append((at, "trigger", k))
            s.update(rank=k, floor=float(floor[at]), lower=0, cooldown=int(now[at]) + cool * 1_000_000)
        elif k > s["rank"]:
            out.append((a, "escalate", k))
            s.update(rank=k, lower=0)
        elif k < s["rank"]:
            need = max(down - s["lower"], 1)
            if need > b - a:
                s["lower"] += b - a
                continue
            out.append((a + need - 1, "deescalate", k))
            s.update(rank=k, lower=0)
        else:
            s["lower"] = 0
    return out


def _worked(rows: DataFrame, round_: int) -> DataFrame:
    """Transitions of stretches, and a row for each with its state at the end (``transition`` null)."""
    key = [*KEY, "__stretch"]
    schema = "tenant_id string, market_key string, __stretch long, event_id long, transition string, severity_rank int, divergence double, first long, " + ", ".join(f"{k} {v}" for k, v in _STATE.items())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, s, first = None, {}, 0

        def end() -> list[tuple]:
            return [(*at, None, None, None, None, first, *(s[k] for k in _STATE))] if at else []

        def frame(out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(out, columns=names).astype({k: "Int64" for k in ("event_id", "severity_rank", "started", "cooldown", "rank", "lower", "below", "first")})

        for pdf in batches:
            out = []
            ids = pdf[key].to_numpy()
            changed = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)]) if len(pdf) else []
            for a, b in zip(changed, [*changed[1:], len(pdf)], strict=True):
                part = pdf.iloc[a:b]
                if at != tuple(ids[a]):
                    out += end()
                    r = part.iloc[0]
                    at, first = tuple(ids[a]), int(r["now"])
                    s = {k: None if pd.isna(r[f"in_{k}"]) else (float if v == "double" else int)(r[f"in_{k}"]) for k, v in _STATE.items()}
                got = runs(*(part[c].to_numpy() for c in ("now", "breach", "rank", "divergence", "has_quotes", "floor")), part[list(SETTINGS)].to_numpy(), s)
                event, divergence = part["event_id"].to_numpy(), part["divergence"].to_numpy()
                out += [(*at, int(event[i]), t, k, float(divergence[i]), None, *[None] * len(_STATE)) for i, t, k in got]
            yield frame(out)
        yield frame(end())

    return written(rows.repartition(*key).sortWithinPartitions(*key, "now", "event_id").mapInPandas(run, schema), f"round{round_}")


def stretch_length(rows: DataFrame) -> int:
    """Long enough for ``STRETCH_ROWS`` evaluations of a market of average traffic."""
    first, last, n, markets = rows.agg(F.min("now"), F.max("now"), F.count("*"), F.approx_count_distinct(F.struct(*KEY))).first()
    return STRETCH_US if not n else max(STRETCH_US, (last - first + 1) * markets * STRETCH_ROWS // n)


def transitions(evaluations: DataFrame, width_us: int | None = None) -> DataFrame:
    """``tenant_id, market_key, event_id, transition, severity_rank, divergence`` of all markets. The length of a stretch
    follows from the evaluations if it isn't given."""
    columns = [*KEY, "event_id", "now", "breach", "rank", "divergence", "has_quotes", "floor", *SETTINGS]
    rows = written(evaluations.select(*columns), "evaluations")
    rows = rows.withColumn("__stretch", F.floor(F.col("now") / (width_us or stretch_length(rows))))
    stretch = [*KEY, "__stretch"]
    fresh = {f"in_{k}": F.lit(v).cast(_STATE[k]) for k, v in _FRESH.items()}
    done = [_worked(rows.withColumns(fresh), 0)]
    begun = done[0].where("transition IS NULL").select(*stretch, *(v.alias(k) for k, v in fresh.items()), F.lit(0).alias("round"))
    while True:
        # the last state of each stretch, and from what it came
        last = reduce(DataFrame.unionByName, (d.where("transition IS NULL").select(*stretch, "first", *_STATE, F.lit(i).alias("round")) for i, d in enumerate(done)))
        states = begun.join(last, [*stretch, "round"])
        before = Window.partitionBy(*KEY).orderBy("__stretch")
        seen = states.select(*stretch, "round", *fresh, "first", F.lag(F.struct(*_STATE)).over(before).alias("s"))
        open_ = F.coalesce(F.col("s.rank"), F.lit(0)) > 0
        # an open incident needs no times, a closed one no counts, and a cooldown that is over is none
        wanted = {
            "started": F.when(~open_, F.col("s.started")), "cooldown": F.when(~open_ & (F.col("s.cooldown") > F.col("first")), F.col("s.cooldown")), "rank": F.coalesce("s.rank", F.lit(0)), "floor": F.when(open_, F.col("s.floor")),
            "lower": F.when(open_, F.col("s.lower")).otherwise(0), "below": F.when(open_, F.col("s.below")).otherwise(0),
        }
        fits = reduce(lambda x, y: x & y, (wanted[k].cast(_STATE[k]).eqNullSafe(F.col(f"in_{k}")) for k in _STATE))
        compared = written(seen.select(*stretch, "round", *(F.when(fits, F.col(f"in_{k}")).otherwise(wanted[k]).cast(_STATE[k]).alias(f"in_{k}") for k in _STATE), (~fits).alias("again")), "compared")
        again = compared.where("again").drop("again", "round")
        if not again.head(1):
            break
        done.append(_worked(rows.join(again, stretch), len(done)))
        begun = compared.select(*stretch, *fresh, F.when(F.col("again"), len(done) - 1).otherwise(F.col("round")).alias("round"))
    found = reduce(DataFrame.unionByName, (d.where("transition IS NOT NULL").withColumn("round", F.lit(i)) for i, d in enumerate(done)))
    return found.join(begun.select(*stretch, "round"), [*stretch, "round"]).select(*KEY, "event_id", "transition", "severity_rank", "divergence")
