"""Queries of what alerts leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alert_records as ops
from .registry import query, view

_EVENTS = """e AS (SELECT *, CASE incident_transition WHEN 'trigger' THEN 'triggered' WHEN 'resolve' THEN 'resolved' WHEN 'retract' THEN 'retracted' ELSE 'active' END AS to_status FROM alert_details),
s AS (SELECT *, CAST(coalesce(sum(CASE WHEN to_status IN ('resolved', 'retracted') THEN 1 ELSE 0 END) OVER (PARTITION BY tenant_id, pattern_id, subject_key, chain_slug ORDER BY created_at, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seq FROM e),
i AS (SELECT *, sha256(concat_ws('|', tenant_id, pattern_id, 'market', subject_key, coalesce(chain_slug, ''), seq)) AS incident_id,
      coalesce(lag(to_status) OVER (PARTITION BY tenant_id, pattern_id, subject_key, chain_slug, seq ORDER BY created_at, arrival), to_status) AS from_status FROM s)"""


def _events(spark, sf_dir):
    parts = F.create_map(F.lit("source_agreement"), F.col("arrival").cast("long") % 101, F.lit("oracle_confirmation"), F.col("arrival").cast("long") % 2 * 100)
    return ops.incident_events(view(spark, sf_dir, "alert_details"), parts)


@query("k10_incident_events", f"""WITH {_EVENTS} SELECT incident_id, detection_id, incident_transition AS event_type, from_status, to_status, classification, score, round(confidence, 6) AS confidence, arrival % 101 AS agreement,
'{{"pattern_id":"' || pattern_id || '","severity":"' || severity || '","event_key":' || coalesce('"' || event_key || '"', 'null') || ',"classification":' || coalesce('"' || classification || '"', 'null')
  || ',"breakdown":{{"source_agreement":' || (arrival % 101) || ',"oracle_confirmation":' || (arrival % 2 * 100) || '}}}}' AS payload FROM i""")
def incident_events(spark, sf_dir):
    """Each detection as an event of its incident, with the snapshot of its context."""
    return _events(spark, sf_dir).select("incident_id", "detection_id", "event_type", "from_status", "to_status", "classification", "score", F.round("confidence", 6).alias("confidence"), F.col("breakdown")["source_agreement"].alias("agreement"), "payload")


@query("k10_incident_states", f"""WITH {_EVENTS} SELECT incident_id, arg_max(to_status, (created_at, arrival)) AS status, arg_max(severity, (created_at, arrival)) AS current_severity, strftime(min(created_at), '%Y-%m-%d') AS opened, strftime(max(created_at), '%Y-%m-%d') AS updated,
strftime(max(CASE WHEN to_status IN ('resolved', 'retracted') THEN created_at END), '%Y-%m-%d') AS closed, count(*) AS events FROM i GROUP BY incident_id""")
def incident_states(spark, sf_dir):
    """Incidents as their events leave them."""
    day = lambda c: F.date_format(f"{c}_at", "yyyy-MM-dd").alias(c)
    return ops.incident_states(_events(spark, sf_dir)).select("incident_id", "status", "current_severity", day("opened"), day("updated"), day("closed"), "events")


_SUMMARY = """p AS (SELECT tenant_id, asset_symbol, count(*) AS n, CAST(sum(CAST(quantity AS DECIMAL(24, 6))) AS DOUBLE) AS q, CAST(sum(CAST(valuation_usd AS DECIMAL(24, 6))) AS DOUBLE) AS v FROM positions WHERE enabled GROUP BY ALL),
x AS (SELECT d.detection_id, d.asset_symbol, d.score, coalesce(p.n, 0) AS entities, CASE arrival % 4 WHEN 1 THEN p.q * 0.985::DOUBLE WHEN 2 THEN p.q * 1.25::DOUBLE ELSE p.v END AS capital FROM alert_details d LEFT JOIN p ON d.tenant_id = p.tenant_id AND d.asset_symbol = p.asset_symbol)"""


@query("k15_exposure_summary", f"""WITH {_SUMMARY} SELECT detection_id, entities, CASE WHEN entities > 0 THEN asset_symbol END AS asset_symbol, capital AS capital_at_risk, capital * 0.05::DOUBLE AS loss_5, capital * 0.1::DOUBLE AS loss_10, capital * (score / 100) AS savings FROM x""")
def exposure_summary(spark, sf_dir):
    """What each detection puts at risk, from positions that are added up by tenant and asset first."""
    got = ops.exposure_summary(view(spark, sf_dir, "alert_details"), view(spark, sf_dir, "positions"))
    return got.select("detection_id", "entities", *(F.col("exposure_summary")[c].alias(c) for c in ("asset_symbol", "capital_at_risk", "loss_5", "loss_10", "savings")))


_OUTCOMES = """n AS (SELECT d.*, max_alerts_per_month AS most, row_number() OVER (PARTITION BY d.tenant_id, date_trunc('month', created_at) ORDER BY created_at, arrival) - 1 AS prior FROM alert_details d LEFT JOIN quota_limits q ON d.tenant_id = q.tenant_id),
h AS (SELECT *, coalesce(severity <> 'critical' AND lifecycle_state IN ('provisional', 'confirmed') AND most >= 0 AND prior >= most, false) AS held FROM n),
u AS (SELECT *, CAST(coalesce(sum(CASE WHEN held THEN 0 ELSE 1 END) OVER (PARTITION BY tenant_id, date_trunc('month', created_at) ORDER BY created_at, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM h),
o AS (SELECT detection_id, tenant_id, created_at, CASE WHEN held THEN 'suppressed' ELSE lifecycle_state END AS lifecycle_state, CASE WHEN held THEN 'monthly_alert_quota_exceeded' END AS suppression_reason, CASE WHEN held THEN most END AS quota_limit, CASE WHEN held THEN used END AS quota_used,
      CASE WHEN held THEN 'alert_suppressed_quota' ELSE 'alert_fired' END AS usage_type, CASE WHEN coalesce(protocol LIKE 'market:%', false) OR coalesce(event_key LIKE 'dpeg:%', false) THEN 'dpeg' ELSE 'generic' END AS alert_type,
      CAST(CASE chain_slug WHEN 'ethereum' THEN 1 WHEN 'base' THEN 8453 END AS BIGINT) AS chain_id FROM u)"""


@query("k12_quota_outcomes", f"WITH {_OUTCOMES} SELECT * EXCLUDE (tenant_id, created_at) FROM o")
def quota_outcomes(spark, sf_dir):
    """Alerts as they are sent or held back by the tenants' quotas."""
    got = ops.dispatch_outcomes(view(spark, sf_dir, "alert_details"), view(spark, sf_dir, "quota_limits"))
    return got.select("detection_id", "lifecycle_state", "suppression_reason", "quota_limit", "quota_used", "usage_type", "alert_type", "chain_id")


@query("f10_usage_by_kind", f"WITH {_OUTCOMES} SELECT tenant_id, strftime(created_at, '%Y-%m') AS month, usage_type, alert_type, chain_id, count(*) AS quantity FROM o GROUP BY ALL")
def usage_by_kind(spark, sf_dir):
    """Usage that the alerts' outcomes count, by month."""
    return ops.usage_totals(ops.dispatch_outcomes(view(spark, sf_dir, "alert_details"), view(spark, sf_dir, "quota_limits")))
