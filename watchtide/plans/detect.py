"""Queries of the detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors as ops
from ..operators import drawdown
from ..operators.rules import first_matches
from ..sources.configs import flash_rules, peg_policies, tvl_rules
from .quotes import POLICY
from .registry import query, view
from .tables import FLASH_RULES_SQL, PEG_POLICIES_SQL, TVL_RULES_SQL, enabled

PEG = POLICY | {"sustained_window_ms": 3_600_000, "cooldown_sec": 7200, "deescalation_blocks": 2, "resolution_blocks": 3}
TVL = {"fast_drop_pct": 20.0, "slow_drop_pct": 35.0, "velocity_critical_pct": 15.0, "fast_minutes": 600, "slow_minutes": 3600, "velocity_minutes": 120, "concurrent_minutes": 300, "min_tvl_floor_usd": 20e6}
_DROPS = """
d AS (SELECT *, CASE WHEN max(tvl_usd) OVER f > 0 THEN (max(tvl_usd) OVER f - tvl_usd) / max(tvl_usd) OVER f * 100 ELSE 0 END AS fast_drop,
        (max(tvl_usd) OVER s - tvl_usd) / max(tvl_usd) OVER s * 100 AS slow_drop, (max(tvl_usd) OVER v - tvl_usd) / max(tvl_usd) OVER v * 100 AS velocity_drop FROM tvl_samples WINDOW
  f AS (PARTITION BY tenant_id, protocol_id, chain_slug ORDER BY observed_at RANGE BETWEEN INTERVAL 600 MINUTE PRECEDING AND CURRENT ROW),
  s AS (PARTITION BY tenant_id, protocol_id, chain_slug ORDER BY observed_at RANGE BETWEEN INTERVAL 3600 MINUTE PRECEDING AND CURRENT ROW),
  v AS (PARTITION BY tenant_id, protocol_id, chain_slug ORDER BY observed_at RANGE BETWEEN INTERVAL 120 MINUTE PRECEDING AND CURRENT ROW))"""
_TRANSITION = "CASE WHEN prev_severity IS NULL THEN 'trigger' WHEN severity = 'critical' AND prev_severity = 'high' THEN 'escalate' WHEN fall >= prev_fall + 1.0 OR context <> prev_context THEN 'update' END"


@query("g1_drawdowns", f"WITH {_DROPS} SELECT event_id, round(fast_drop, 6)::DOUBLE AS fast_drop, round(slow_drop, 6) AS slow_drop, round(velocity_drop, 6) AS velocity_drop FROM d")
def drawdowns(spark, sf_dir):
    return ops.drawdowns(view(spark, sf_dir, "tvl_samples"), TVL).select("event_id", *(F.round(f"{n}_drop", 6).alias(f"{n}_drop") for n in ("fast", "slow", "velocity")))


_IN_SCOPE = """r.tenant_id = s.tenant_id AND r.protocol_id = lower(s.protocol_id) AND r.chain_slug = lower(s.chain_slug) AND (r.market_id IS NULL OR r.market_id = lower(s.market_id))"""
_SUBJECT = "PARTITION BY tenant_id, rule_order, rule_id, subject_key ORDER BY observed_at, event_id"
_peak = lambda n: f"(SELECT max(x.tvl_usd) FROM s x WHERE x.tenant_id = s.tenant_id AND x.rule_order = s.rule_order AND x.subject_key = s.subject_key AND x.observed_at >= s.observed_at - to_minutes(s.{n}_minutes) AND (x.observed_at, x.event_id) <= (s.observed_at, s.event_id))"
#: Breaches of the tenants' rules, as the pattern's rules say (k): samples by rule and subject, peaks, breaches, contagion.
_BREACHES = f"""
rules AS ({TVL_RULES_SQL}),
s AS (SELECT s.event_id, s.observed_at, s.tvl_usd, lower(s.protocol_id) || ':' || lower(s.chain_slug) AS protocol_key, CASE WHEN r.market_id IS NULL THEN 'protocol' ELSE 'market' END AS subject_type,
        concat_ws(':', lower(s.protocol_id), lower(s.chain_slug), r.market_id) AS subject_key, r.* FROM tvl_samples s JOIN rules r ON {_IN_SCOPE} WHERE s.tvl_usd > 0),
d AS (SELECT s.*, {", ".join(f"({_peak(n)} - tvl_usd) / {_peak(n)} * 100 AS {n}_drop" for n in ("fast", "slow", "velocity"))} FROM s),
b AS (SELECT *, tvl_usd >= min_tvl_floor_usd AND (velocity_drop >= velocity_critical_pct OR fast_drop >= fast_drop_pct OR slow_drop >= slow_drop_pct) AS breach, greatest(fast_drop, slow_drop, velocity_drop) AS fall FROM d),
c AS (SELECT a.*, contagion_enabled AND EXISTS (SELECT 1 FROM b x WHERE x.tenant_id = a.tenant_id AND x.protocol_key <> a.protocol_key AND x.breach AND x.observed_at >= a.observed_at - to_minutes(a.concurrent_minutes) AND (x.observed_at, x.event_id) < (a.observed_at, a.event_id)) AS systemic FROM b a),
g AS (SELECT *, CASE WHEN breach THEN CASE WHEN velocity_drop >= velocity_critical_pct OR systemic THEN 'critical' ELSE 'high' END END AS severity, CASE WHEN breach THEN CASE WHEN systemic THEN 'systemic' ELSE 'isolated' END END AS context FROM c),
h AS (SELECT *, last_value(severity IGNORE NULLS) OVER p AS prev_severity, coalesce(last_value(context IGNORE NULLS) OVER p, 'isolated') AS prev_context, coalesce(lag(fall) OVER ({_SUBJECT}), 0) AS prev_fall FROM g WINDOW p AS ({_SUBJECT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, {_TRANSITION} AS transition FROM h WHERE breach)"""


def _drawdowns(spark, sf_dir):
    return drawdown.detections(view(spark, sf_dir, "tvl_samples"), tvl_rules(enabled(spark, sf_dir, "tvl_drop", "tvl_samples")))


@query("k2_tvl_drawdown", f"WITH {_BREACHES} SELECT event_id, rule_id, subject_type, subject_key, severity, context, round(fall, 6)::DOUBLE AS drop_pct, transition FROM k")
def tvl(spark, sf_dir):
    """Drawdown breaches by the tenants' rules, with severity, contagion and transition."""
    return _drawdowns(spark, sf_dir).select("event_id", "rule_id", "subject_type", "subject_key", "severity", "context", F.round("drop", 6).alias("drop_pct"), "transition")


@query("k3_pause_updates", f"""WITH {_BREACHES},
u AS (SELECT r.tenant_id, r.rule_order, r.rule_id, concat_ws(':', lower(s.protocol_id), lower(s.chain_slug), r.market_id) AS subject_key, s.observed_at, s.event_id, s.paused, NULL AS severity, NULL AS context FROM pause_events s JOIN rules r ON {_IN_SCOPE}
      UNION ALL SELECT tenant_id, rule_order, rule_id, subject_key, observed_at, event_id, NULL, severity, context FROM k),
l AS (SELECT *, last_value(severity IGNORE NULLS) OVER w AS s, last_value(context IGNORE NULLS) OVER w AS c FROM u WINDOW w AS ({_SUBJECT} ROWS UNBOUNDED PRECEDING))
SELECT event_id, rule_id, subject_key, paused, s AS severity, c AS context FROM l WHERE paused IS NOT NULL AND s IS NOT NULL""")
def pauses(spark, sf_dir):
    """Pauses while a tenant's rule has an incident open (K3)."""
    rules = tvl_rules(enabled(spark, sf_dir, "tvl_drop", "pause_events"))
    return drawdown.pause_updates(view(spark, sf_dir, "pause_events"), rules, _drawdowns(spark, sf_dir)).select("event_id", "rule_id", "subject_key", "paused", "severity", "context")


@query("h2_highest_severity", f"""WITH {_BREACHES},
o AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, event_id ORDER BY CASE severity WHEN 'critical' THEN 5 ELSE 4 END DESC, rule_order, subject_type DESC) AS nth FROM k WHERE transition IS NOT NULL)
SELECT tenant_id, event_id, rule_id, subject_key, severity, transition FROM o WHERE nth = 1""")
def highest(spark, sf_dir):
    """Of several rules' detections of one event, the one with the highest severity; ties keep the first rule."""
    return drawdown.highest(_drawdowns(spark, sf_dir)).select("tenant_id", "event_id", "rule_id", "subject_key", "severity", "transition")


def flash_of_tenants(spark, sf_dir):
    return flash_rules(enabled(spark, sf_dir, "flash_loan", "flash_events"))


_PASSED = f"flash_events f JOIN ({FLASH_RULES_SQL}) r ON f.tenant_id = r.tenant_id WHERE source_type = 'evm_chain' AND loan_amount_usd >= min_loan_usd AND profit_usd >= min_profit_usd"


@query("d5_flash_thresholds", f"SELECT event_id, rule_id FROM {_PASSED}")
def flash_thresholds(spark, sf_dir):
    return ops.flash_candidates(view(spark, sf_dir, "flash_events"), flash_of_tenants(spark, sf_dir)).select("event_id", "rule_id")


#: A tenant has two rules at most here, the first and another: each with its id and cooldown, or null if the event doesn't pass it.
_FLASH_SQL = f"""
WITH RECURSIVE c AS (SELECT f.tenant_id, attacker_address, event_id, epoch_us(observed_at) AS now, max(CASE WHEN rule_order = 0 THEN rule_id END) AS p0, max(CASE WHEN rule_order > 0 THEN rule_id END) AS p1,
         max(CASE WHEN rule_order = 0 THEN cooldown_sec END) * 1000000 AS d0, max(CASE WHEN rule_order > 0 THEN cooldown_sec END) * 1000000 AS d1 FROM {_PASSED} GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, attacker_address ORDER BY now, event_id) AS k FROM c),
fold AS (
  SELECT tenant_id, attacker_address, k, event_id, coalesce(p0, p1) AS fired, CASE WHEN p0 IS NOT NULL THEN now + d0 ELSE 0 END AS c0, CASE WHEN p0 IS NULL THEN now + d1 ELSE 0 END AS c1 FROM n WHERE k = 1
  UNION ALL
  SELECT n.tenant_id, n.attacker_address, n.k, n.event_id, CASE WHEN p0 IS NOT NULL AND c0 <= now THEN p0 WHEN p1 IS NOT NULL AND c1 <= now THEN p1 END,
         CASE WHEN p0 IS NOT NULL AND c0 <= now THEN now + d0 ELSE c0 END, CASE WHEN NOT (p0 IS NOT NULL AND c0 <= now) AND p1 IS NOT NULL AND c1 <= now THEN now + d1 ELSE c1 END
  FROM fold f JOIN n ON n.tenant_id = f.tenant_id AND n.attacker_address = f.attacker_address AND n.k = f.k + 1)
SELECT event_id, fired AS rule_id FROM fold WHERE fired IS NOT NULL"""


@query("k4_flash_loans", _FLASH_SQL)
def flash(spark, sf_dir):
    """Flash-loan detections by the tenants' rules with cooldowns; the first rule that passes wins (K4, H3, A3)."""
    return ops.flash_detections(view(spark, sf_dir, "flash_events"), flash_of_tenants(spark, sf_dir)).select("event_id", "rule_id")


#: What the peg fold sees of each quote, by the tenants' policies.
_EVALUATIONS = f"""
pol AS ({PEG_POLICIES_SQL}),
good AS (SELECT q.*, p.* EXCLUDE (tenant_id, market_key) FROM quotes q JOIN pol p ON q.tenant_id = p.tenant_id AND q.market_key = p.market_key WHERE price > 0),
newest AS (
  SELECT e.event_id, e.observed_at AS now, e.market_key AS own_market, q.*, row_number() OVER (PARTITION BY e.event_id, q.market_key, q.source_id ORDER BY q.observed_at DESC, q.qid DESC) AS nth
  FROM good e JOIN (SELECT * EXCLUDE (event_id), event_id AS qid FROM good) q ON e.tenant_id = q.tenant_id AND (q.observed_at, q.qid) <= (e.observed_at, e.event_id) AND q.observed_at >= e.observed_at - INTERVAL 43200001 MILLISECOND),
live AS (
  SELECT *, coalesce(CAST(overrides->source_id->>'$.weight' AS DOUBLE), 1.0) AS weight FROM newest
  WHERE nth = 1 AND coalesce(CAST(overrides->source_id->>'$.enabled' AS BOOLEAN), true) AND (epoch_us(now) - epoch_us(observed_at)) // 1000 <= coalesce(CAST(overrides->source_id->>'$.stale_timeout_ms' AS BIGINT), stale_timeout_ms)
    AND CASE source_type WHEN 'cex_websocket' THEN cex_whitelist IS NULL OR list_contains(list_transform(cex_whitelist, lambda x: lower(x)), source_id) WHEN 'dex_api' THEN include_dex ELSE true END),
weighed AS (SELECT *, sum(weight) OVER (PARTITION BY event_id, market_key ORDER BY price, weight, source_id ROWS UNBOUNDED PRECEDING) AS run, sum(weight) OVER (PARTITION BY event_id, market_key) AS total FROM live),
medians AS (
  SELECT event_id, market_key, any_value(own_market) AS own_market, count(*) AS n, bool_or(source_type = 'oracle_api') AS has_oracle, min(price) FILTER (run >= total / 2) AS median,
         abs(min(price) FILTER (run >= total / 2) - any_value(peg_target)) / any_value(peg_target) * 100 AS divergence FROM weighed GROUP BY event_id, market_key),
others AS (SELECT m.event_id, count(*) FILTER (m.divergence >= e.systemic_floor_pct) AS n_diverging FROM medians m JOIN good e USING (event_id) GROUP BY m.event_id),
snap AS (
  SELECT e.*, coalesce(m.n, 0) AS n, coalesce(m.divergence, abs(peg_target - peg_target)) AS d, coalesce(o.n_diverging, 0) AS n_diverging FROM good e LEFT JOIN medians m ON m.event_id = e.event_id AND m.market_key = e.market_key LEFT JOIN others o ON o.event_id = e.event_id),
placed AS (SELECT *, contagion_detection AND n_diverging >= 2 AS systemic, coalesce(len(list_filter(json_keys(overrides), lambda k: (overrides->k->>'$.enabled') <> 'false')), 0) AS named FROM snap),
judged AS (
  SELECT *, CASE WHEN systemic THEN systemic_floor_pct ELSE isolated_floor_pct END AS floor_pct,
         CASE WHEN d >= CASE WHEN systemic THEN sys_critical ELSE iso_critical END THEN 5 WHEN d >= CASE WHEN systemic THEN sys_high ELSE iso_high END THEN 4 WHEN d >= CASE WHEN systemic THEN sys_medium ELSE iso_medium END THEN 3 ELSE 0 END AS sev FROM placed),
confirmed AS (SELECT j.event_id, bool_or(abs(l.price - j.peg_target) / j.peg_target * 100 >= j.floor_pct) AS oracle FROM judged j JOIN live l ON l.event_id = j.event_id AND l.market_key = j.market_key AND l.source_type = 'oracle_api' GROUP BY j.event_id),
n AS (
  SELECT tenant_id, market_key, event_id, epoch_us(observed_at) AS now, n > 0 AS quotes, d, sev, floor_pct, systemic, sustained_window_ms * 1000 AS sustained, cooldown_sec * 1000000 AS cool, deescalation_blocks AS down, resolution_blocks AS ends,
         n >= min_sources AND n / (CASE WHEN named > 0 THEN named ELSE min_sources END)::DOUBLE >= quorum_pct AND d >= floor_pct AND sev > 0 AND (NOT oracle_confirmation OR coalesce(oracle, false)) AS breach,
         row_number() OVER (PARTITION BY tenant_id, market_key ORDER BY observed_at, event_id) AS k
  FROM judged LEFT JOIN confirmed USING (event_id))"""


def evaluations_of(spark, sf_dir):
    return ops.peg_evaluations(view(spark, sf_dir, "quotes"), peg_policies(enabled(spark, sf_dir, "dpeg", "quotes")), with_markets=True)


@query("k1_evaluations", f"WITH {_EVALUATIONS} SELECT event_id, breach, CAST(sev AS INTEGER) AS rank, CASE WHEN systemic THEN 'systemic' ELSE 'isolated' END AS context, floor_pct AS floor, quotes AS has_quotes FROM n")
def evaluations(spark, sf_dir):
    """What the peg fold sees of each quote, by the tenants' policies."""
    return evaluations_of(spark, sf_dir).select("event_id", "breach", "rank", "context", "floor", "has_quotes")


_PEG_SQL = f"""
WITH RECURSIVE {_EVALUATIONS},
fold AS (
  SELECT tenant_id, market_key, 0::BIGINT AS k, 0::BIGINT AS event_id, NULL::BIGINT AS started, -1::BIGINT AS cooldown, 0 AS rank, 0::DOUBLE AS floor, 0 AS lower_n, 0 AS below, NULL::VARCHAR AS transition, 0 AS out_rank, 0::DOUBLE AS d FROM (SELECT DISTINCT tenant_id, market_key FROM n)
  UNION ALL
  SELECT tenant_id, market_key, k, event_id, CASE WHEN breach THEN start2 END,
         CASE WHEN NOT quotes THEN -1 WHEN t IN ('trigger', 'resolve') THEN now + cool ELSE cooldown END,
         CASE WHEN NOT quotes OR t = 'resolve' THEN 0 WHEN t IN ('trigger', 'escalate', 'deescalate') THEN sev ELSE rank END,
         CASE WHEN t = 'trigger' THEN floor_pct ELSE floor END,
         CASE WHEN breach AND rank > 0 AND sev < rank AND coalesce(t, '') <> 'deescalate' THEN lower_n + 1 ELSE 0 END,
         CASE WHEN NOT quotes OR breach OR t = 'resolve' OR rank = 0 THEN 0 WHEN d < floor THEN below + 1 ELSE 0 END,
         t, CASE WHEN t = 'resolve' THEN rank ELSE sev END, d
  FROM (SELECT n.*, f.cooldown, f.rank, f.floor, f.lower_n, f.below, coalesce(f.started, n.now) AS start2,
               CASE WHEN NOT n.quotes THEN NULL
                    WHEN n.breach AND f.rank = 0 AND n.now - coalesce(f.started, n.now) >= n.sustained AND NOT f.cooldown > n.now THEN 'trigger'
                    WHEN n.breach AND f.rank > 0 AND n.sev > f.rank THEN 'escalate'
                    WHEN n.breach AND f.rank > 0 AND n.sev < f.rank AND f.lower_n + 1 >= n.down THEN 'deescalate'
                    WHEN NOT n.breach AND f.rank > 0 AND n.d < f.floor AND f.below + 1 >= n.ends THEN 'resolve' END AS t
        FROM fold f JOIN n ON n.tenant_id = f.tenant_id AND n.market_key = f.market_key AND n.k = f.k + 1))
SELECT tenant_id, market_key, event_id, transition, CAST(out_rank AS INTEGER) AS severity_rank, round(d, 6) AS divergence FROM fold WHERE transition IS NOT NULL"""


@query("k1_peg_deviation", _PEG_SQL)
def peg(spark, sf_dir):
    """Peg-deviation transitions by the tenants' policies: consensus and context by windows, hysteresis by a fold."""
    return ops.peg_transitions(evaluations_of(spark, sf_dir)).withColumn("divergence", F.round("divergence", 6))


_LABEL = "CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '7' END"


@query("k5_tenant_rules", f"""
WITH ev AS (SELECT tenant_id, event_id, loan_amount_usd AS loan, profit_usd AS profit, source_type AS source, {_LABEL} AS label FROM flash_events),
t AS (SELECT tenant_id, rule_order, rule_id, severity, unnest(from_json(tests, '[{{"attribute":"VARCHAR","op":"VARCHAR","value":"VARCHAR"}}]')) AS x FROM tenant_rules),
tried AS (SELECT e.tenant_id, e.event_id, t.rule_order, t.rule_id, t.severity, x.op, x.value, e.source, x.attribute, CASE x.attribute WHEN 'loan' THEN loan WHEN 'profit' THEN profit WHEN 'label' THEN TRY_CAST(label AS DOUBLE) END AS v, TRY_CAST(x.value AS DOUBLE) AS n FROM ev e JOIN t ON e.tenant_id = t.tenant_id),
passed AS (SELECT tenant_id, event_id, rule_order, rule_id, severity, bool_and(coalesce(CASE op WHEN '>=' THEN v >= n WHEN '>' THEN v > n WHEN '<=' THEN v <= n WHEN '<' THEN v < n WHEN '=' THEN source = value ELSE source <> value END, false)) AS ok FROM tried GROUP BY ALL),
labelled AS (SELECT tenant_id, arg_min(rule_id, rule_order) AS rule_id, arg_min(severity, rule_order) AS severity, count(DISTINCT rule_id) AS n_rules FROM t WHERE x.attribute = 'label' GROUP BY tenant_id)
SELECT event_id, arg_min(rule_id, rule_order) AS rule_id, arg_min(severity, rule_order) AS severity, NULL AS error, NULL::BIGINT AS n_rules FROM passed WHERE ok GROUP BY tenant_id, event_id
UNION ALL SELECT event_id, rule_id, severity, 'label is not a number', n_rules FROM ev JOIN labelled USING (tenant_id) WHERE label = 'n/a'""")
def tenant_rules(spark, sf_dir):
    """The tenants' own rules from a table: the first that each event passes, and faults of rules on single events (K5, L2)."""
    e = view(spark, sf_dir, "flash_events")
    attributes = F.create_map(*(x for k, c in (("loan", F.col("loan_amount_usd").cast("string")), ("profit", F.col("profit_usd").cast("string")), ("source", F.col("source_type")), ("label", F.expr(_LABEL))) for x in (F.lit(k), c)))
    rules = view(spark, sf_dir, "tenant_rules").withColumn("tests", F.from_json("tests", "array<struct<attribute:string,op:string,value:string>>"))
    return first_matches(e.select("tenant_id", "event_id", attributes.alias("attributes")), rules).select("event_id", "rule_id", "severity", "error", "n_rules")


#: A share of the loan is asked for as a product, which also holds for loans of zero.
_CONDITIONS = [
    {"tenant_id": "tenant-0", "rule_id": "big", "severity": "high", "condition": "loan_amount_usd >= {least}", "params": {"least": 500000.0}},
    {"tenant_id": "tenant-0", "rule_id": "broken", "severity": "high", "condition": "no_such_column > 1"},
    {"tenant_id": "tenant-0", "rule_id": "profit", "severity": "medium", "condition": "profit_usd >= {share} * loan_amount_usd AND event_id % 2 = 0", "params": {"share": 0.005}},
    {"tenant_id": "tenant-2", "rule_id": "any", "severity": "low", "condition": "source_type = 'evm_chain'"},
]


@query("l2_rule_conditions", """SELECT event_id, rule_id, severity FROM (SELECT event_id, CASE WHEN tenant_id = 'tenant-0' AND loan_amount_usd >= 500000 THEN 'big' WHEN tenant_id = 'tenant-0' AND profit_usd / loan_amount_usd >= 0.005 AND event_id % 2 = 0 THEN 'profit' WHEN tenant_id = 'tenant-2' AND source_type = 'evm_chain' THEN 'any' END AS rule_id FROM flash_events)
JOIN (VALUES ('big', 'high'), ('profit', 'medium'), ('any', 'low')) s(rule_id, severity) USING (rule_id)""")
def rule_conditions(spark, sf_dir):
    """Rules as SQL conditions with parameters, for what tests on attributes can't say (L1, L2)."""
    return ops.rule_detections(view(spark, sf_dir, "flash_events"), _CONDITIONS).select("event_id", "rule_id", "severity")


_DRAWDOWN_SQL = f"WITH {_BREACHES} SELECT * FROM k WHERE transition IS NOT NULL"


@query("l1_detect_all", f"""SELECT 'dpeg' AS pattern_id, CAST(count(*) AS BIGINT) AS n, NULL AS error FROM ({_PEG_SQL}) UNION ALL SELECT 'tvl_drop', count(*), NULL FROM ({_DRAWDOWN_SQL})
UNION ALL SELECT 'flash_loan', count(*), NULL FROM ({_FLASH_SQL}) UNION ALL SELECT 'broken', 0, 'failed'""")
def registry(spark, sf_dir):
    """The registry runs every pattern by the tenants' rules and unites their detections; one fails while it runs (L1)."""

    class Peg:
        name = "dpeg"

        def detect(self, events, rules):
            return ops.peg_transitions(ops.peg_evaluations(events, rules, with_markets=True)).select("event_id")

    class Drawdown:
        name = "tvl_drop"

        def detect(self, events, rules):
            return drawdown.detections(events, rules).where("transition IS NOT NULL").select("event_id", "rule_id")

    class Flash:
        name = "flash_loan"

        def detect(self, events, rules):
            return ops.flash_detections(events, rules).select("event_id", "rule_id")

    class Broken:
        name = "broken"

        def detect(self, events, rules):
            return events.select(F.when(F.col("event_id") >= 0, F.raise_error(F.lit("a fault of this rule"))).cast("long").alias("event_id"))

    events, failed = (lambda n: view(spark, sf_dir, n)), []
    found = ops.detect_all([(Peg(), events("quotes"), peg_policies(enabled(spark, sf_dir, "dpeg", "quotes"))), (Drawdown(), events("tvl_samples"), tvl_rules(enabled(spark, sf_dir, "tvl_drop", "tvl_samples"))), (Broken(), events("quotes"), None), (Flash(), events("flash_events"), flash_of_tenants(spark, sf_dir))], failed, isolated=True)
    errors = spark.createDataFrame([(name, 0, "failed") for name, _ in failed], "pattern_id string, n long, error string")
    return found.groupBy("pattern_id").agg(F.count("*").alias("n")).withColumn("error", F.lit(None).cast("string")).unionByName(errors)


@query("e2_rule_scope", f"SELECT event_id, rule_id FROM tvl_samples s JOIN ({TVL_RULES_SQL}) r ON {_IN_SCOPE}")
def rule_scope(spark, sf_dir):
    """Samples with the tenant's rules whose scope they match."""
    rules = tvl_rules(enabled(spark, sf_dir, "tvl_drop", "tvl_samples"))
    return drawdown.in_scope(view(spark, sf_dir, "tvl_samples"), rules).select("event_id", F.explode("rules.rule_id").alias("rule_id"))


@query("e1_tenant_policies", f"SELECT q.event_id, p.min_sources, p.peg_target, p.stale_timeout_ms FROM quotes q JOIN ({PEG_POLICIES_SQL}) p USING (tenant_id, market_key)")
def tenant_policies(spark, sf_dir):
    """Quotes joined to their tenant's policy of the market."""
    policies = peg_policies(enabled(spark, sf_dir, "dpeg", "quotes")).select("tenant_id", "market_key", "min_sources", "peg_target", "stale_timeout_ms")
    return view(spark, sf_dir, "quotes").join(policies, ["tenant_id", "market_key"]).select("event_id", "min_sources", "peg_target", "stale_timeout_ms")
