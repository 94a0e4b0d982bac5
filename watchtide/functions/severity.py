"""Severities, divergence, risk scores, recommended actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From least to most severe; ranks start at 1 (fixed values).
SEVERITIES = ("info", "low", "medium", "high", "critical")
#: Scores by severity of the drawdown and the tenant-rule patterns, and points of the risk score (fixed values).
DRAWDOWN_SCORE = {"critical": 95.0, "high": 80.0, "medium": 60.0, "low": 30.0, "info": 10.0}
RULE_SCORE = {"critical": 95.0, "high": 80.0, "medium": 60.0, "low": 35.0, "info": 10.0}
RISK_POINTS = {"critical": 40.0, "high": 30.0, "medium": 20.0, "low": 10.0, "info": 0.0}
#: Chain ids and their slugs (fixed values).
CHAINS = {1: "ethereum", 10: "optimism", 56: "bsc", 137: "polygon", 8453: "base", 42161: "arbitrum", 43114: "avalanche"}
#: Other names of chains (fixed values).
CHAIN_ALIASES = {"mainnet": "ethereum", "bnb": "bsc"}
#: Actions to recommend by severity (fixed values).
PEG_ACTIONS = {
    "critical": (
        "Immediate Rebalance: move all affected stablecoin positions to safe assets (ETH, BTC, or actively pegged stablecoins)",
        "Exit all positions in the affected stablecoin immediately to prevent further capital erosion",
        "Withdraw to Owner wallet: transfer funds to a secure wallet outside the affected protocol",
    ),
    "high": (
        "Partial Exit: reduce stablecoin exposure by 50% to limit downside risk",
        "Rebalance to ETH or other correlated assets to maintain market exposure",
        "Hold and Monitor: set a recovery price alert at the peg target threshold",
    ),
    "medium": (
        "Hold and Monitor: depeg is within manageable range, no immediate action required",
        "Rebalance to maintain target stablecoin allocation if exposure exceeds risk tolerance",
    ),
}
DRAWDOWN_ACTIONS = {
    "critical": (
        "Activate incident playbook and halt high-risk protocol interactions.",
        "Escalate to on-call and communicate exposure impact immediately.",
        "Verify protocol pause controls and liquidity withdrawal options.",
    ),
    "high": (
        "Increase monitoring cadence and review wallet/protocol exposure.",
        "Prepare partial de-risk actions for affected markets.",
    ),
}
DRAWDOWN_OTHERWISE = ("Monitor trend and keep incident timeline updated.",)


def choose(x: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(x == k, F.lit(v)).otherwise(out)
    return out


def rank(severity: Column) -> Column:
    """0 for none or an unknown name."""
    return choose(F.lower(severity), {s: i + 1 for i, s in enumerate(SEVERITIES)}, 0)


def parse(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin(*SEVERITIES), t)


def band(divergence: Column, medium: Column, high: Column, critical: Column) -> Column:
    return F.when(divergence >= critical, "critical").when(divergence >= high, "high").when(divergence >= medium, "medium")


def divergence_pct(price: Column, peg: Column) -> Column:
    return F.when(peg != 0, F.abs(price - peg) / peg * 100.0)


def chain_slug(chain_id: Column) -> Column:
    return choose(chain_id, CHAINS)


def chain_name(slug: Column) -> Column:
    """The slug of a chain under any of its names; ``unknown`` for others."""
    name = F.lower(F.trim(slug))
    name = F.coalesce(choose(name, CHAIN_ALIASES), name)
    return F.when(name.isin(*CHAINS.values()), name).otherwise("unknown")


def chain_id(slug: Column) -> Column:
    return choose(chain_name(slug), {v: k for k, v in CHAINS.items()}).cast("bigint")


def _texts(severity: Column, table: dict, otherwise: tuple = ()) -> Column:
    as_array = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    out = as_array(otherwise)
    for k, v in table.items():
        out = F.when(severity == k, as_array(v)).otherwise(out)
    return out


def peg_actions(severity: Column) -> Column:
    return _texts(severity, PEG_ACTIONS)


def drawdown_actions(severity: Column) -> Column:
    return _texts(severity, DRAWDOWN_ACTIONS, DRAWDOWN_OTHERWISE)


#: Texts of a risk score (fixed values): rationale, feature, detail.
_BASELINE = {k: (f"{k.capitalize()} severity baseline +{int(v)}", f"severity_{k}", f"{k.capitalize()} severity baseline") for k, v in RISK_POINTS.items() if v}
_RULES_TEXT = ("Triggered rules present +20", "triggered_rules")
_SIGNAL_TEXT = ("Oracle divergence triggered +25", "oracle_divergence")
_TRACE_TEXT = ("Flash loan in trace summary +15", "trace_flash_loan", "trace enrichment indicates flash loan")


def risk_score(severity: Column, rules: Column, signals: Column, traced: Column) -> Column:
    """``struct<score, confidence, rationale, attribution>``: severity points, 20 with any rule, 25 for each oracle
    divergence, 15 with a trace; at most 100. ``signals`` is an array of ``struct<type, value, label>``; an attribution is
    ``struct<feature, contribution, detail>``."""
    part = lambda text, feature, points, detail: F.struct(text.alias("text"), feature.alias("feature"), F.lit(float(points)).alias("contribution"), detail.alias("detail"))
    none = F.lit(None).cast("struct<text:string,feature:string,contribution:double,detail:string>")
    base = none
    for k, (text, feature, detail) in _BASELINE.items():
        base = F.when(severity == k, part(F.lit(text), F.lit(feature), RISK_POINTS[k], F.lit(detail))).otherwise(base)
    n_rules = F.coalesce(F.size(rules), F.lit(0))
    ruled = F.when(n_rules > 0, part(F.lit(_RULES_TEXT[0]), F.lit(_RULES_TEXT[1]), 20, F.concat(n_rules.cast("string"), F.lit(" rule(s) triggered"))))
    said = lambda s: F.coalesce(s["label"], F.concat(F.lit("divergence value: "), F.format_string("%.4f", s["value"])))
    diverging = F.filter(F.coalesce(signals, F.array().cast("array<struct<type:string,value:double,label:string>>")), lambda s: s["type"] == "oracle_divergence")
    signalled = F.transform(diverging, lambda s: part(F.lit(_SIGNAL_TEXT[0]), F.lit(_SIGNAL_TEXT[1]), 25, said(s)))
    trace = F.when(F.coalesce(traced, F.lit(False)), part(*map(F.lit, _TRACE_TEXT[:2]), 15, F.lit(_TRACE_TEXT[2])))
    parts = F.concat(F.array_compact(F.array(base, ruled)), signalled, F.array_compact(F.array(trace)))
    score = F.least(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["contribution"]), F.lit(100.0))
    rationale = F.transform(parts, lambda x: x["text"])
    attribution = F.transform(parts, lambda x: F.struct(x["feature"].alias("feature"), x["contribution"].alias("contribution"), x["detail"].alias("detail")))
    return F.struct(score.alias("score"), F.least(F.lit(0.6) + score / 250.0, F.lit(0.99)).alias("confidence"), rationale.alias("rationale"), attribution.alias("attribution"))
