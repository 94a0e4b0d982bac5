"""What alerts leave behind: events and snapshots of their incidents, the incidents' state, exposure, suppression, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .asof import micros
from .lifecycle import STRETCH_US, incident_lifecycle, quota
from .stretches import running_sum

#: Chain ids by name (fixed values).
CHAIN_IDS = {"ethereum": 1, "arbitrum": 42161, "optimism": 10, "base": 8453, "polygon": 137, "avalanche": 43114, "bsc": 56}


def incident_events(log: DataFrame, breakdown: Column, width_us: int = STRETCH_US) -> DataFrame:
    """One row for each detection of ``log``, added to its incident: what happened, the incident's status before and
    after, a JSON payload, and the snapshot of the context (classification, score, confidence; its payload has the parts).

    ``breakdown`` is a map of the confidence's parts. The first event of an incident has its own status as the one
    before. A null transition is a trigger; fields that are null stay in the payload as null."""
    rows = incident_lifecycle(log, width_us).withColumn("breakdown", breakdown)
    keep_nulls = {"ignoreNullFields": "false"}
    payload = F.to_json(F.struct("pattern_id", "severity", "event_key", "classification", "breakdown"), keep_nulls)
    return rows.select(
        "incident_id", "detection_id", F.coalesce("incident_transition", F.lit("trigger")).alias("event_type"), F.col("from_state").alias("from_status"), F.col("to_state").alias("to_status"),
        payload.alias("payload"), "severity", "classification", "score", "confidence", "breakdown", F.col("created_at").alias("event_at"), "arrival",
    )


def incident_states(events: DataFrame) -> DataFrame:
    """The incidents as their events leave them: status and severity of the last one, when the first and the last came, when it
    was closed (null if it is open), and how many came. One aggregation with partial results; ties by ``arrival``."""
    place = F.struct("event_at", "arrival")
    closing = F.col("to_status").isin("resolved", "retracted")
    last = F.max_by(F.struct("to_status", "severity"), place)
    got = events.groupBy("incident_id").agg(last.alias("last"), F.min("event_at").alias("opened_at"), F.max("event_at").alias("updated_at"), F.max(F.when(closing, F.col("event_at"))).alias("closed_at"), F.count("*").alias("events"))
    return got.select("incident_id", F.col("last.to_status").alias("status"), F.col("last.severity").alias("current_severity"), "opened_at", "updated_at", "closed_at", "events")


def exposure_summary(alerts: DataFrame, positions: DataFrame) -> DataFrame:
    """Alerts with ``entities`` (how many of the tenant's enabled positions they touch) and ``exposure_summary``: asset,
    capital at risk, losses of 5 and 10 per cent, savings; null where nothing is touched.

    The asset is the base of the subject's market; the price, if it is positive, is the ``weighted_median_price`` of
    the JSON ``context``; else positions count by their valuation. All these sums are linear in the positions, so
    positions are added up by tenant and asset first (exactly, as decimals), and each alert meets one row, not every position.
    The rows of single entities are ``lifecycle.exposure``."""
    exact = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("decimal(24,6)")).cast("double").alias(f"__{c}")
    held = positions.where("enabled AND tenant_id IS NOT NULL").groupBy("tenant_id", F.col("asset_symbol").alias("__asset")).agg(F.count("*").alias("__n"), exact("quantity"), exact("valuation_usd"))
    asset = F.element_at(F.split(F.element_at(F.split("subject_key", ":"), -1), "/"), 1)
    price = F.coalesce(F.get_json_object("context", "$.weighted_median_price").cast("double"), F.lit(0.0))
    rows = alerts.withColumn("__asset", F.nullif(asset, F.lit(""))).withColumn("__price", price).join(held, ["tenant_id", "__asset"], "left")
    capital = F.when(F.col("__price") > 0, F.col("__quantity") * F.col("__price")).otherwise(F.col("__valuation_usd"))
    rows = rows.withColumn("__capital", capital)
    share = F.greatest(F.col("score") / 100, F.lit(0.0))
    parts = {"asset_symbol": F.col("__asset"), "capital_at_risk": F.col("__capital"), "loss_5": F.col("__capital") * 0.05, "loss_10": F.col("__capital") * 0.10, "savings": F.col("__capital") * share}
    summary = F.when(F.col("__n") > 0, F.struct(*(c.alias(n) for n, c in parts.items())))
    return rows.select(*(F.col(f"`{c}`") for c in alerts.columns), F.coalesce("__n", F.lit(0)).alias("entities"), summary.alias("exposure_summary"))


def dispatch_outcomes(alerts: DataFrame, quotas: DataFrame, default_tenant: str = "default", width_us: int = STRETCH_US) -> DataFrame:
    """Alerts as they are sent or held back by their tenant's row in ``quotas`` (``max_alerts_per_month``; null, negative or no
    row: no limit), and the usage that is counted for them.

    Only what fires counts against the quota. Critical alerts, and those neither provisional nor confirmed, always fire,
    beyond the quota too. An alert without tenant is the default tenant's. A suppressed alert's state is ``suppressed``, with the reason, the limit and what was used by then.
    ``created_at`` and ``arrival`` give the order; a tenant's month is worked through in stretches of time."""
    limits = quotas.where("tenant_id IS NOT NULL").groupBy("tenant_id").agg(F.max("max_alerts_per_month").cast("bigint").alias("__limit"))
    own = [c for c in alerts.columns if c not in ("suppressed", "prior")]
    alerts = alerts.select(*own).withColumn("tenant_id", F.coalesce("tenant_id", F.lit(default_tenant)))
    rows = quota(alerts.join(limits, "tenant_id", "left"), F.col("__limit")).withColumns({"__at": micros(F.col("created_at")), "__month": F.date_trunc("month", "created_at")})
    rows = running_sum(written(rows.drop("prior", "month"), "outcomes"), ["tenant_id", "__month"], "__at", ["arrival"], {"__used": F.when(F.col("suppressed"), 0).otherwise(1).cast("long")}, width_us)
    held = lambda c: F.when(F.col("suppressed"), c)
    kind = F.when(F.coalesce(F.col("event_key").startswith("dpeg:"), F.lit(False)) | F.coalesce(F.col("protocol").startswith("market:"), F.lit(False)), "dpeg").otherwise("generic")
    chain = F.coalesce(*(F.when(F.lower("chain_slug") == name, F.lit(i).cast("bigint")) for name, i in CHAIN_IDS.items()))
    return rows.select(
        *(F.col(f"`{c}`") for c in own if c != "lifecycle_state"), F.when(F.col("suppressed"), "suppressed").otherwise(F.col("lifecycle_state")).alias("lifecycle_state"),
        held(F.lit("monthly_alert_quota_exceeded")).alias("suppression_reason"), held(F.col("__limit")).alias("quota_limit"), held(F.col("__used")).alias("quota_used"),
        F.when(F.col("suppressed"), "alert_suppressed_quota").otherwise("alert_fired").alias("usage_type"), kind.alias("alert_type"), chain.alias("chain_id"),
    )


def usage_totals(outcomes: DataFrame) -> DataFrame:
    """Usage by tenant, month, kind of usage, kind of alert and chain."""
    month = F.date_format("created_at", "yyyy-MM").alias("month")
    return outcomes.groupBy("tenant_id", month, "usage_type", "alert_type", "chain_id").agg(F.count("*").alias("quantity"))
