"""Detectors: peg deviation, drawdown, flash loans, tenant rules, and their registry.

Event time takes the place of the clock: ``now`` is an event's own time, so a replay gives the same result.
Everything that can be told from windows is; what is left are small folds over rows that carry only the
numbers that the fold needs. The fold functions are plain and shared with the streaming twins.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.severity import band, rank
from ..sources.shared import written
from . import hysteresis
from .asof import micros
from .drawdown import peaks
from .quotes import consensus, setting

RANKS = {"medium": 3, "high": 4, "critical": 5}


class Pattern(Protocol):
    """A detector: a name, and a function from events and rules to detections."""

    name: str

    def detect(self, events: DataFrame, rules: DataFrame) -> DataFrame: ...


def detect_all(patterns: Iterable[tuple[Pattern, DataFrame, DataFrame]], failed: list[tuple[str, str]] | None = None, isolated: bool = False) -> DataFrame:
    """All detections of several patterns, with their ``pattern_id``.

    A pattern that can't be planned is left out, and its name and error are put into ``failed``; without that list it is an
    error. With ``isolated``, each pattern also runs on its own and its detections are stored first, so that one that
    fails on some row while it runs is left out in the same way and the others stand."""
    out = []
    for p, events, rules in patterns:
        try:
            found = p.detect(events, rules).withColumn("pattern_id", F.lit(p.name))
            out.append(written(found, "detections") if isolated else found)
        except Exception as e:  # noqa: BLE001  whatever the plug-in does
            if failed is None:
                raise
            failed.append((p.name, str(e)))
    if not out:
        raise ValueError("no pattern could be planned")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


# Peg deviation


#: Bands of severity by context (fixed values).
ISOLATED = {"medium": 0.5, "high": 1.0, "critical": 5.0}
SYSTEMIC = {"medium": 0.01, "high": 0.25, "critical": 0.25}
#: Settings that the fold needs of each evaluation, with their defaults.
_FOLDED = {"sustained_window_ms": 60_000, "cooldown_sec": 300, "deescalation_blocks": 5, "resolution_blocks": 30}


def _bands(policy: dict, context: str, default: dict) -> list[Column]:
    got = policy.get(f"severity_bands_{context}")
    if got is None:
        got = policy.get("severity_bands") if context == "isolated" else None
    if isinstance(got, Column):
        return [F.coalesce(got[k], F.lit(v)) for k, v in default.items()]
    return [F.lit((got or default)[k]) for k in default]


def peg_evaluations(quotes: DataFrame, policy: dict | DataFrame, with_markets: bool = False) -> DataFrame:
    """One evaluation per valid quote: breach, severity rank, divergence, context, trigger floor, whether any source was
    eligible, confidence, and what the fold needs of the policy.

    ``policy`` is one for all, or the table of the tenants' policies by market (``configs.peg_policies``): quotes of
    other markets then have no evaluation."""
    width_ms = None
    if isinstance(policy, DataFrame):
        width_ms = policy.agg(F.max(F.greatest("stale_timeout_ms", F.coalesce(F.array_max(F.transform(F.map_values("overrides"), lambda x: x["stale_timeout_ms"])), F.lit(0))))).first()[0]
        width_ms = 1 + (width_ms or 0)
        quotes = quotes.join(policy, ["tenant_id", "market_key"])
        policy = {c: F.col(c) for c in policy.columns if c not in ("tenant_id", "market_key")}
    rows = consensus(quotes, policy, with_markets, width_ms)
    in_context = lambda one, all_: F.when(F.col("context") == "systemic", one).otherwise(all_)
    severity = band(F.col("divergence"), *map(in_context, _bands(policy, "systemic", SYSTEMIC), _bands(policy, "isolated", ISOLATED)))
    oracle = F.col("oracle_confirmed") | ~setting(policy, "oracle_confirmation", False)
    breach = F.col("has_quorum") & (F.col("divergence") >= F.col("floor")) & severity.isNotNull() & oracle
    return rows.select(
        "tenant_id", "market_key", "event_id", micros(F.col("observed_at")).alias("now"), F.coalesce(breach, F.lit(False)).alias("breach"), F.coalesce(rank(severity), F.lit(0)).alias("rank"),
        "divergence", (F.col("n_sources") > 0).alias("has_quotes"), "floor", "context", "confidence", *(setting(policy, k, v).cast("long").alias(k) for k, v in _FOLDED.items()),
    )


def peg_start() -> dict:
    return {"started": None, "cooldown": None, "rank": 0, "floor": None, "lower": 0, "below": 0}


def peg_step(s: dict, now: int, breach: bool, severity: int, divergence: float, has_quotes: bool, policy: dict, floor: float | None = None) -> tuple[str, int] | None:
    """One evaluation: changes the state and returns ``(transition, severity rank)``, or None. ``floor`` is the
    evaluation's trigger floor; the one at which an incident began is also the one below which it resolves."""
    if not has_quotes:
        s.update(peg_start())
        return None
    cooldown = policy.get("cooldown_sec", 300) * 1_000_000
    if not breach:
        s["started"], s["lower"] = None, 0
        if not s["rank"]:
            return None
        s["below"] = s["below"] + 1 if divergence < s["floor"] else 0
        if s["below"] < policy.get("resolution_blocks", 30):
            return None
        was = s["rank"]
        s.update(rank=0, floor=None, below=0, cooldown=now + cooldown)
        return "resolve", was
    s["below"] = 0
    if s["started"] is None:
        s["started"] = now
    if not s["rank"]:
        waited = now - s["started"] >= policy.get("sustained_window_ms", 60_000) * 1000
        if not waited or (s["cooldown"] is not None and s["cooldown"] > now):
            return None
        s.update(rank=severity, floor=policy.get("isolated_floor_pct", 0.5) if floor is None else floor, lower=0, cooldown=now + cooldown)
        return "trigger", severity
    if severity > s["rank"]:
        s.update(rank=severity, lower=0)
        return "escalate", severity
    if severity < s["rank"]:
        s["lower"] += 1
        if s["lower"] < policy.get("deescalation_blocks", 5):
            return None
        s.update(rank=severity, lower=0)
        return "deescalate", severity
    s["lower"] = 0
    return None


PEG_SCHEMA = "tenant_id string, market_key string, event_id long, transition string, severity_rank int, divergence double"


def with_policy(evaluations: DataFrame, policy: dict | None) -> DataFrame:
    return evaluations.withColumns({k: F.lit(policy.get(k, v)).cast("long") for k, v in _FOLDED.items()}) if policy else evaluations


def peg_fold(state: dict, row) -> tuple[str, int] | None:
    """``peg_step`` on an evaluation."""
    policy = {k: int(getattr(row, k)) for k in _FOLDED}
    return peg_step(state, int(row.now), bool(row.breach), int(row.rank), float(row.divergence), bool(row.has_quotes), policy, float(row.floor))


def peg_transitions(evaluations: DataFrame, policy: dict | None = None, width_us: int | None = None) -> DataFrame:
    """Triggers, escalations, de-escalations and resolutions of each tenant's market, in stretches of time side by side
    (``hysteresis``). ``policy`` replaces what the evaluations say of the fold's settings."""
    return hysteresis.transitions(with_policy(evaluations, policy), width_us)


# Drawdown


WINDOWS = ("fast", "slow", "velocity")


def drawdowns(samples: DataFrame, rule: dict, key: tuple[str, ...] = ("tenant_id", "protocol_id", "chain_slug")) -> DataFrame:
    """Peak-to-current drawdowns in per cent over the rule's trailing windows: ``fast, slow, velocity``. One pass of range
    maxima answers all windows, in stretches of time as long as the longest, so that no subject has to be sorted in one
    task. Samples of the same time are all part of each other's windows: a time's largest value stands for all of them."""
    value = F.coalesce(F.when(F.isnan("tvl_usd"), float("inf")).otherwise(F.col("tvl_usd")), F.lit(float("-inf")))
    out = samples.withColumn("__at", micros(F.col("observed_at"))).withColumn("__top", F.max(value).over(Window.partitionBy(*key, "__at")))
    widths = [rule[f"{n}_minutes"] * 60_000_000 for n in WINDOWS]
    out = peaks(out, list(key), "__at", [], "__top", F.lit(max(widths)), F.array(*map(F.lit, widths)))
    for i, name in enumerate(WINDOWS):
        peak = F.get("peaks", F.lit(i))
        out = out.withColumn(f"{name}_drop", F.when(peak > 0, (peak - F.col("tvl_usd")) / peak * 100).otherwise(0.0))
    return out.drop("__at", "__top", "peaks")


# Flash loans


def flash_candidates(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Chain events that pass a rule's thresholds, for every rule of the tenant."""
    passed = (F.col("loan_amount_usd") >= F.col("min_loan_usd")) & (F.col("profit_usd") >= F.col("min_profit_usd"))
    return events.where("source_type = 'evm_chain' AND loan_amount_usd IS NOT NULL").join(rules, "tenant_id").where(passed)


FLASH_SCHEMA = "tenant_id string, event_id long, rule_id string, attacker_address string, severity string"


def flash_step(cooldowns: dict, now: int, options: list[tuple[str, str, int]]) -> str | None:
    """Of the rules that an event passes, in order, the first that isn't cooling down fires."""
    for rule_id, attacker, seconds in options:
        if cooldowns.get((rule_id, attacker), now) <= now:
            cooldowns[rule_id, attacker] = now + seconds * 1_000_000
            return rule_id
    return None


def flash_detections(events: DataFrame, rules: DataFrame) -> DataFrame:
    """The first rule of each event that isn't cooling down. A cooldown belongs to a rule and an attacker, and
    all of an event's rules are about one attacker, so attackers are folded apart, their events streaming through in order of time."""
    ready = flash_candidates(events, rules).select("tenant_id", "attacker_address", "event_id", micros(F.col("observed_at")).alias("now"), "rule_order", "rule_id", "cooldown_sec")

    def fold(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        at, cooldowns = None, {}
        for pdf in batches:
            out = []
            for tenant, attacker, event, now, options in zip(*(pdf[c] for c in ("tenant_id", "attacker_address", "event_id", "now", "options")), strict=True):
                if at != (tenant, attacker):
                    at, cooldowns = (tenant, attacker), {}
                fired = flash_step(cooldowns, int(now), [(o["rule_id"], attacker, int(o["cooldown_sec"])) for o in options])
                if fired:
                    out.append((tenant, event, fired, attacker, "high"))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FLASH_SCHEMA.split(", ")])

    # an event's rules, in order, are one row: at most as many as the tenant has
    key = ["tenant_id", "attacker_address"]
    options = F.array_sort(F.collect_list(F.struct("rule_order", "rule_id", "cooldown_sec")))
    rows = ready.groupBy(*key, "event_id", "now").agg(options.alias("options"))
    return rows.repartition(*key).sortWithinPartitions(*key, "now", "event_id").mapInPandas(fold, FLASH_SCHEMA)


# Tenant rules


def rule_detections(events: DataFrame, rules: list[dict]) -> DataFrame:
    """Tenant rules as Spark SQL conditions with parameters (``{name}`` in the text); the first match of each
    event wins, in the rules' order. A condition that can't be analysed only disables its own rule, and one that has no value
    for an event (a division by zero, a text that is no number) isn't passed by it: conditions are tenants' texts, so they are
    analysed without ANSI errors, which would end the job for all."""
    spark, ansi = events.sparkSession, "spark.sql.ansi.enabled"
    strict = spark.conf.get(ansi)
    spark.conf.set(ansi, "false")
    try:
        return _rule_hits(events, rules)
    finally:
        spark.conf.set(ansi, strict)


def _rule_hits(events: DataFrame, rules: list[dict]) -> DataFrame:
    hits = F.lit(None).cast("struct<rule_id:string,severity:string>")
    for r in reversed(rules):
        text = r["condition"]
        for k, v in r.get("params", {}).items():
            text = text.replace(f"{{{k}}}", repr(v))
        try:
            events.where(text).schema  # noqa: B018  analysed here, so that a bad rule stays alone
        except Exception:  # noqa: BLE001, S112
            continue
        mine = (F.col("tenant_id") == r["tenant_id"]) & F.expr(text)
        hits = F.when(mine, F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"))).otherwise(hits)
    return events.withColumn("hit", hits).where("hit IS NOT NULL").select(*events.columns, "hit.rule_id", "hit.severity")
