"""Tenants' own rules from a table.

A rule is a conjunction of tests ``attribute op value`` on an event's attributes. Rules are compiled by what they test first:
rules of one numeric test stand in order of their thresholds with the least rule so far, so that one search finds the
first that an event's value passes, however many there are; rules of several tests look at the events that pass their
first, which is a stretch of the events in order of that attribute. Of rules with the same tests only the first can
win, so Spark groups a tenant's rules by their tests beforehand, with their number: however many rules there are, what
is broadcast and tried are different sets of tests.

These are broadcast in blocks of ``BLOCK``; with several blocks, the first match of each is taken, and the first of
those wins. A test on an attribute that an event lacks isn't passed. A numeric test on a text that is no number is a
fault of that rule on that event, which gives an error row and leaves other rules alone.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rules that are broadcast together.
BLOCK = 100_000
NUMERIC, TEXTUAL = (">=", ">", "<=", "<"), ("=", "!=")
RESULT = "tenant_id string, event_id long, rule_order long, rule_id string, severity string, error string, n_rules long"


class TenantRules:
    """The rules ``(order, id, severity, tests)`` of one tenant; a test is ``(attribute, op, value)``. A fifth entry says for
    how many rules with the same tests it stands (1 without)."""

    def __init__(self, rules: list[tuple]):
        counted = sorted((*r, 1)[:5] for r in rules)
        self.rules, self.counts = [r[:4] for r in counted], [r[4] for r in counted]
        self.single: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}
        self.several: list[int] = []
        self.always: list[int] = []
        self.numeric: dict[str, list[int]] = defaultdict(list)  # rules with a numeric test of an attribute
        self.broken: dict[int, str] = {}
        by_test = defaultdict(list)
        for k, (_, _, _, tests) in enumerate(self.rules):
            fault = next((f"bad test of {a}: {op} {v}" for a, op, v in tests if op not in NUMERIC + TEXTUAL or op in NUMERIC and _number(v) is None), None)
            if fault:
                self.broken[k] = fault
                continue
            for a in {a for a, op, _ in tests if op in NUMERIC}:
                self.numeric[a].append(k)
            if not tests:
                self.always.append(k)
            elif len(tests) == 1 and tests[0][1] in NUMERIC:
                by_test[tests[0][:2]].append((_number(tests[0][2]), k))
            else:
                self.several.append(k)
        for (a, op), found in by_test.items():
            found.sort(reverse=op in ("<=", "<"))
            # an event that passes a threshold passes all easier ones, which stand before it
            self.single[a, op] = np.array([t for t, _ in found]), np.minimum.accumulate([k for _, k in found])

    def first(self, events: list[dict[str, str]]) -> tuple[np.ndarray, list[tuple[int, str, int, int]]]:
        """The place of the first rule that each event passes (-1: none), and faults ``(event, attribute, first rule, rules)``."""
        n, none = len(events), len(self.rules)
        best = np.full(n, min(self.always, default=none))
        names = {a for a, _ in self.single} | {a for k in self.several for a, _, _ in self.rules[k][3]}
        raw = {a: [e.get(a) for e in events] for a in names}
        number, faults = {}, []
        for a in {a for a in names if a in self.numeric}:
            values = [_number(x) if x is not None else math.nan for x in raw[a]]
            faults += [(i, a, self.numeric[a][0], sum(self.counts[k] for k in self.numeric[a])) for i, v in enumerate(values) if v is None]
            number[a] = np.array([math.nan if v is None else v for v in values])
        for (a, op), (thresholds, least) in self.single.items():
            x = number[a]
            if op in (">=", ">"):
                passed = np.searchsorted(thresholds, x, "right" if op == ">=" else "left")
            else:
                passed = np.searchsorted(-thresholds, -x, "right" if op == "<=" else "left")
            passed[np.isnan(x)] = 0
            some = passed > 0
            best[some] = np.minimum(best[some], least[passed[some] - 1])
        order = {a: np.argsort(x, kind="stable") for a, x in number.items()}  # nan last
        for k in self.several:
            tests = sorted(self.rules[k][3], key=lambda t: t[1] not in NUMERIC)
            a, op, v = tests[0]
            if op in NUMERIC:
                x = number[a][order[a]]
                end, t = int(np.searchsorted(x, np.inf, "right")), _number(v)
                low = {">=": np.searchsorted(x[:end], t, "left"), ">": np.searchsorted(x[:end], t, "right")}.get(op, 0)
                high = {"<=": np.searchsorted(x[:end], t, "right"), "<": np.searchsorted(x[:end], t, "left")}.get(op, end)
                left, rest = order[a][low:high], tests[1:]
            else:
                left, rest = np.arange(n), tests
            left = left[best[left] > k]
            for a, op, v in rest:
                if not len(left):
                    break
                if op in NUMERIC:
                    x, t = number[a][left], _number(v)
                    left = left[{">=": x >= t, ">": x > t, "<=": x <= t, "<": x < t}[op]]
                else:
                    left = left[[raw[a][i] is not None and (raw[a][i] == v) == (op == "=") for i in left.tolist()]]
            best[left] = k
        return np.where(best == none, -1, best), faults


def _number(text: str) -> float | None:
    try:
        x = float(text)
    except (TypeError, ValueError):
        return None
    return None if math.isnan(x) else x


def first_matches(events: DataFrame, rules: DataFrame, block: int = BLOCK) -> DataFrame:
    """The first of its tenant's rules that each event passes, and error rows.

    ``events``: ``tenant_id, event_id, attributes`` (map of texts); ``rules``: ``tenant_id, rule_order, rule_id, severity, tests``
    (array of ``attribute, op, value``, texts). Rows with ``error`` name the first of ``n_rules`` rules that a text which is no number
    kept from being tried; a rule that can't be compiled has one error row without event."""
    every = rules.select("tenant_id", F.col("rule_order").cast("long").alias("rule_order"), "rule_id", "severity", "tests", F.coalesce(F.to_json("tests"), F.lit("[]")).alias("key"))
    first = F.min(F.struct("rule_order", "rule_id", "severity", "tests")).alias("r")
    rules = written(every.groupBy("tenant_id", "key").agg(first, F.count("*").alias("n")).select("tenant_id", "key", "r.*", "n"), "rules")
    n = rules.count()
    blocks = -(-n // block)
    spark, out, faulty = events.sparkSession, None, []
    for b in range(blocks):
        part = rules if blocks == 1 else rules.where(F.pmod(F.xxhash64("tenant_id", "key"), F.lit(blocks)) == b)
        by_tenant, keys = defaultdict(list), {}
        for r in part.toLocalIterator():
            by_tenant[r["tenant_id"]].append((r["rule_order"], r["rule_id"], r["severity"], [(t["attribute"], t["op"], t["value"]) for t in r["tests"] or ()], r["n"]))
            keys[r["tenant_id"], r["rule_order"], r["rule_id"]] = r["key"]
        compiled = {t: TenantRules(x) for t, x in by_tenant.items()}
        faulty += [(t, keys[t, c.rules[k][0], c.rules[k][1]], fault) for t, c in compiled.items() for k, fault in c.broken.items()]
        shared = spark.sparkContext.broadcast(compiled)

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, of_tenant = [], defaultdict(list)
                tenants, ids, attributes = (batch.column(c).to_pylist() for c in range(3))
                for i, t in enumerate(tenants):
                    of_tenant[t].append(i)
                for t, places in of_tenant.items():
                    c = shared.value.get(t)
                    if c is None:
                        continue
                    found, faults = c.first([dict(attributes[i] or ()) for i in places])
                    rows += [(t, ids[i], *c.rules[k][:3], None, None) for i, k in zip(places, found.tolist(), strict=True) if k >= 0]
                    rows += [(t, ids[places[i]], *c.rules[k][:3], f"{a} is not a number", m) for i, a, k, m in faults]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

        got = events.select("tenant_id", F.col("event_id").cast("long").alias("event_id"), "attributes").mapInArrow(match, RESULT)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], RESULT)
    if blocks > 1:
        what = F.min(F.struct("rule_order", "rule_id", "severity")).alias("r")
        hits = out.where("error IS NULL").groupBy("tenant_id", "event_id").agg(what).select("tenant_id", "event_id", "r.*", F.lit(None).cast("string").alias("error"), F.lit(None).cast("long").alias("n_rules"))
        errors = out.where("error IS NOT NULL").groupBy("tenant_id", "event_id", "error").agg(what, F.sum("n_rules").alias("n_rules")).select("tenant_id", "event_id", "r.*", "error", "n_rules")
        out = hits.unionByName(errors)
    if faulty:
        broken = spark.createDataFrame(faulty, "tenant_id string, key string, error string")
        found = every.withColumn("t", F.coalesce("tenant_id", F.lit(""))).join(broken.select(F.coalesce("tenant_id", F.lit("")).alias("t"), "key", "error"), ["t", "key"])
        out = out.unionByName(found.select("tenant_id", F.lit(None).cast("long").alias("event_id"), "rule_order", "rule_id", "severity", "error", F.lit(1).cast("long").alias("n_rules")))
    return out
