"""Alerts, incidents, exposure, quotas, dead letters, history and governance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .asof import micros
from .stretches import last_before, running_sum

TERMINAL = ("resolved", "retracted", "closed", "cancelled")
INCIDENT_KEY = ("tenant_id", "pattern_id", "subject_type", "subject_key", "chain_slug")


def alertable(detections: DataFrame) -> DataFrame:
    """Detections with an event key and at least one rule."""
    return detections.where("coalesce(event_key, '') != '' AND n_rules > 0")


#: The channels of every alert (fixed values).
ALERT_ROUTES = ("webhook", "slack", "telegram", "discord")


def alerts_from(detections: DataFrame, default_tenant: str = "default") -> DataFrame:
    """Alerts of the detections that call for one, with all that the detection says: score, confidence, actions, rules, transaction
    and block. The event key is the key for duplicates, the lifecycle is the detection's own, finality is
    open."""
    d = alertable(detections)
    own = [c for c in ("event_key", "subject_type", "subject_key", "pattern_id", "chain_slug", "protocol", "severity", "risk_score", "confidence", "rule_ids", "actions_recommended", "tx_hash", "block_number", "created_at", "arrival") if c in d.columns]
    return d.select(
        "detection_id",
        F.sha2(F.concat_ws("|", "detection_id", "event_key"), 256).alias("alert_id"),
        F.coalesce(F.nullif(F.trim("tenant_id"), F.lit("")), F.lit(default_tenant)).alias("alert_tenant"),
        F.col("event_key").alias("dedup_key"),
        F.col("lifecycle_state"),
        F.lit("tentative").alias("finality_status"),
        F.array(*map(F.lit, ALERT_ROUTES)).alias("routes"),
        *own,
    )


#: Stretches of time in which a key's rows are put in order.
STRETCH_US = 7 * 86_400 * 1_000_000


def incident_lifecycle(log: DataFrame, width_us: int = STRETCH_US) -> DataFrame:
    """Attach detections to incidents: an incident's number is the count of terminal transitions of its key
    before. Status and previous status follow from the transition; null transitions are triggers. Rows are ordered by
    ``created_at`` and ``arrival``, in stretches of time, so that a key with a long history is no single task."""
    t = F.coalesce("incident_transition", F.lit("trigger"))
    status = F.when(t == "trigger", "triggered").when(t == "resolve", "resolved").when(t == "retract", "retracted").otherwise("active")
    own = [c for c in log.columns if c != "incident_seq"]
    rows = log.select(*own, status.alias("to_state"), micros(F.col("created_at")).alias("__at"), *(F.coalesce(F.col(c), F.lit("")).alias(f"__{c}") for c in INCIDENT_KEY))
    rows, key, order = written(rows, "incidents"), [f"__{c}" for c in INCIDENT_KEY], ["arrival"]
    over = F.col("to_state").isin("resolved", "retracted")
    rows = written(last_before(rows, key, "__at", order, {"__last": F.col("to_state")}, width_us), "incidents")
    rows = running_sum(rows, key, "__at", order, {"incident_seq": F.when(over, 1).otherwise(0).cast("long")}, width_us)
    before = F.when(~F.col("__last").isin("resolved", "retracted"), F.col("__last"))
    rows = rows.withColumn("from_state", F.coalesce(before, F.col("to_state")))
    return rows.withColumn("incident_id", F.sha2(F.concat_ws("|", *key, F.col("incident_seq").cast("string")), 256)).drop("__at", "__last", *key)


def quota(alerts: DataFrame, limit, month: str = "created_at") -> DataFrame:
    """Suppression by the tenant's monthly quota: critical alerts and other lifecycle states always pass.

    The position in the month is a running count per tenant and month, split by day first: a busy tenant's
    month is counted by day with partial sums, and rows are numbered within their day."""
    day = F.to_date(month)
    by_day = alerts.groupBy("tenant_id", F.date_trunc("month", month).alias("month"), day.alias("day")).agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("tenant_id", "month").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_day.withColumn("before", F.coalesce(earlier, F.lit(0))).select("tenant_id", "day", "before")
    rows = alerts.withColumn("day", day).join(starts, ["tenant_id", "day"])
    prior = F.col("before") + F.row_number().over(Window.partitionBy("tenant_id", "day").orderBy(month, "arrival")) - 1
    limit = F.lit(limit).cast("bigint")
    stop = (F.col("severity") != "critical") & F.col("lifecycle_state").isin("provisional", "confirmed") & limit.isNotNull() & (limit >= 0) & (prior >= limit)
    return rows.withColumn("prior", prior).withColumn("suppressed", F.coalesce(stop, F.lit(False))).drop("before", "day")


#: Pairs of an alert and a position that one share of a busy key makes, and alerts that are worked out together, about.
PAIRS_A_SHARE, ALERTS_A_ROW = 8_000_000, 1_000
EXPOSURE_KEY = ("tenant_id", "asset_symbol")


def exposure(alerts: DataFrame, positions: DataFrame, places: int | None = None, a_share: int = PAIRS_A_SHARE) -> DataFrame:
    """Positions that an alert touches: capital, losses of 5 and 10 per cent, slippage (at most 100), savings (by the
    whole divergence), and liquidity, which is at risk in critical alerts; capital, losses and savings rounded to ``places``, if given.

    The result has a row for each pair. Alerts of the same price, divergence and severity are worked out and rounded together
    and then told apart. A tenant and asset with many pairs are cut into shares, so that no task makes all pairs of a busy key."""
    alerts, positions = in_shares(alerts.where("subject_type = 'market'"), positions.where("enabled"), a_share)
    # a merge from the positions' side holds one position's rows at a time; from the other, those of a thousand alerts with all positions
    rows = _exposed(positions.hint("merge").join(alerts, "share").select(*(f"share.{c}" for c in EXPOSURE_KEY), "*").drop("share"))
    if places is not None:
        rows = rows.withColumns({c: F.round(c, places) for c in ("capital", "loss_5", "loss_10", "savings")})
    return rows.select("*", F.inline("__own")).drop("__own")


def in_shares(alerts: DataFrame, positions: DataFrame, a_share: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of ``exposure`` by ``share``: alerts that are alike as one row (a thousand at most, about), positions as they are.

    A key's shares are a grid: each has a part of the alerts and a part of the positions, about as many of both, so that a row
    goes to a row or column of the grid and not to all shares."""
    keys, same = list(EXPOSURE_KEY), ["severity", "price", "divergence"]
    own, held = [c for c in alerts.columns if c not in (*keys, *same)], [c for c in positions.columns if c not in keys]
    alike = alerts.groupBy(*keys, *same).agg(F.count("*").alias("__n"))
    n = alike.groupBy(*keys).agg(F.sum("__n").alias("__alerts")).join(positions.groupBy(*keys).agg(F.count("*").alias("__positions")), keys)
    n = n.withColumn("__shares", F.ceil(F.col("__alerts") * F.col("__positions") / a_share))
    n = n.withColumn("__down", F.least("__shares", F.ceil(F.sqrt(F.col("__shares") * F.col("__positions") / F.col("__alerts")))))  # parts of the positions
    n = written(n.select(*keys, "__down", F.ceil(F.col("__shares") / F.col("__down")).alias("__across")), "shares")  # and of the alerts
    parts = 2 * (n.agg(F.sum(F.col("__down") * F.col("__across"))).first()[0] or 1)  # small rows on both sides: by their size it would be one; some shares meet by chance
    rows = alike.select(*(F.col(c).alias(f"__{c}") for c in (*keys, *same)), F.ceil(F.col("__n") / ALERTS_A_ROW).alias("__rows"))
    alerts = alerts.join(rows, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*keys, *same)]).withColumn("__row", F.pmod(F.xxhash64("alert_id"), "__rows"))
    alerts = alerts.groupBy(*keys, *same, "__row").agg(F.collect_list(F.struct(*own)).alias("__own")).join(n, keys)
    shares = lambda many, nth: F.explode(F.expr(f"transform(sequence(0L, {many} - 1), x -> struct({', '.join(keys)}, {nth} AS nth))"))
    alerts = alerts.withColumn("__part", F.pmod(F.xxhash64(*same, "__row"), "__across")).withColumn("share", shares("__down", "__part * __down + x"))
    positions = positions.join(n, keys).withColumn("__part", F.pmod(F.xxhash64(*held), "__down")).withColumn("share", shares("__across", "x * __down + __part"))
    return tuple(x.drop(*keys, "__row", "__part", "__down", "__across").repartition(parts, "share") for x in (alerts, positions))


def _exposed(rows: DataFrame) -> DataFrame:
    capital = F.when(F.col("price") > 0, F.col("quantity") * F.col("price")).otherwise(F.col("valuation_usd"))
    rows = rows.withColumn("capital", capital).withColumn("slippage", F.least("divergence", F.lit(100.0)))
    liquidity = F.when(F.col("severity") == "critical", "at_risk").otherwise("degraded")
    savings = F.col("capital") * F.greatest(F.col("divergence") / 100, F.lit(0.0))
    return rows.select("*", (F.col("capital") * 0.05).alias("loss_5"), (F.col("capital") * 0.10).alias("loss_10"), savings.alias("savings"), liquidity.alias("liquidity"))


def exposure_totals(alerts: DataFrame, positions: DataFrame) -> DataFrame:
    """Sums of ``exposure`` by alert. They are linear in the positions, so positions are added up by tenant and asset
    first (exactly, as decimals), and each alert meets one row, not every position."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(24,6)")).cast("double").alias(c)
    held = positions.where("enabled").groupBy("tenant_id", "asset_symbol").agg(F.count("*").alias("n"), exact("quantity"), exact("valuation_usd"))
    rows = _exposed(alerts.where("subject_type = 'market'").join(held, ["tenant_id", "asset_symbol"]))
    return rows.groupBy("alert_id").agg(F.sum("n").alias("entities"), *(F.sum(c).alias(c) for c in ("capital", "loss_5", "loss_10", "savings")))


def active_incident(detections: DataFrame, incidents: DataFrame) -> DataFrame:
    """The newest incident with the same (null-safe) key that isn't over, for each detection."""
    open_ = incidents.where(~F.col("status").isin(*TERMINAL)).select(*(F.col(c).alias(f"i_{c}") for c in INCIDENT_KEY), "incident_id", F.struct("created_at", "arrival").alias("age"))
    newest = open_.groupBy(*(f"i_{c}" for c in INCIDENT_KEY)).agg(F.max_by("incident_id", "age").alias("incident_id"))
    match = [F.col(c).eqNullSafe(F.col(f"i_{c}")) for c in INCIDENT_KEY]
    return detections.join(newest, match, "left").drop(*(f"i_{c}" for c in INCIDENT_KEY))


def finality_to_alerts(updates: DataFrame, alerts: DataFrame) -> DataFrame:
    """Finality updates applied to the newest alert of their event, where the state changes."""
    newest = alerts.groupBy("event_key").agg(F.max_by(F.struct("alert_id", "lifecycle_state"), F.struct("created_at", "arrival")).alias("a"))
    state = F.when(F.col("status") == "confirmed", "confirmed").otherwise("retracted")
    rows = updates.where("status IN ('confirmed', 'retracted')").join(newest, "event_key").withColumn("new_state", state).where("new_state != a.lifecycle_state")
    confirmed = F.col("new_state") == "confirmed"
    return rows.select("event_key", "a.alert_id", "new_state", F.when(confirmed, "finalized").otherwise("tentative").alias("finality"), F.when(confirmed, "active").otherwise("retracted").alias("alert_status"), (~confirmed).alias("close_incident"))


def dead_letters(failures: DataFrame, delivered: DataFrame, most: int = 3) -> DataFrame:
    """Entries that failed since they were last delivered: count, permanent from ``most`` failures on."""
    open_ = failures.join(delivered, ["stream", "entry_id"], "left").where("delivered_at IS NULL OR failed_at > delivered_at")
    rows = open_.groupBy("stream", "entry_id").agg(F.count("*").alias("failures"), F.max("failed_at").alias("last_failed"), F.max_by("error", F.struct("failed_at", "event_id")).alias("last_error"))
    return rows.withColumn("status", F.when(F.col("failures") >= most, "permanent").otherwise("retryable"))


def case_events(incidents: DataFrame, alerts: DataFrame, detections: DataFrame, steps: DataFrame) -> DataFrame:
    """One timeline of four tables: the first row of each source row stays; scenario steps are updated."""
    cols = ["source_table", "source_pk", "case_id", "event_type", "event_time", "ordering"]
    rows = incidents.select(cols).unionByName(alerts.select(cols)).unionByName(detections.select(cols)).unionByName(steps.select(cols))
    best = F.when(F.col("source_table") == "scenario", -F.col("ordering")).otherwise(F.col("ordering"))
    w = Window.partitionBy("source_table", "source_pk").orderBy(best)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def reconcile(desired: DataFrame, running: DataFrame, key: str = "stream_id") -> DataFrame:
    """Start, stop, restart or keep: two configurations compared by the digest of all their columns."""
    digest = lambda df, name: df.select(key, F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(df.columns))), 256).alias(name))
    both = digest(desired, "want").join(digest(running, "have"), key, "full")
    action = F.when(F.col("have").isNull(), "start").when(F.col("want").isNull(), "stop").when(F.col("want") != F.col("have"), "restart").otherwise("keep")
    return both.select(key, action.alias("action"))


def _grams(text: Column) -> Column:
    """All runs of one to three characters."""
    n = F.length(text)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(text, i, k))).otherwise(F.array().cast("array<string>")))))


def missing_streams(desired: DataFrame, streams: DataFrame, targets: DataFrame) -> DataFrame:
    """Streams to insert, one row for each of their targets: ``desired`` rows of ``source_id, endpoint_override`` whose source has
    a stream, but no enabled one with the same endpoint (nulls are equal). They are clones of the source's first
    stream, and have its enabled targets."""
    have = streams.where("enabled").select(F.col("source_id").alias("sid"), F.col("endpoint_override").alias("e"))
    lack = desired.join(streams.select("source_id"), "source_id", "left_semi").join(have, (F.col("source_id") == F.col("sid")) & F.col("endpoint_override").eqNullSafe(F.col("e")), "left_anti")
    model = streams.groupBy("source_id").agg(F.min(F.struct("stream_id", "parser_name", "market_key")).alias("model"))
    mapped = targets.where("enabled").select(F.col("stream_id").alias("of"), "tenant_id")
    rows = lack.join(model, "source_id").join(mapped, F.col("model.stream_id") == F.col("of"), "left")
    return rows.select(F.concat(F.lit("test-"), "source_id").alias("stream_id"), "source_id", "endpoint_override", "model.parser_name", "model.market_key", "tenant_id")


def matched_records(scenarios: DataFrame, records: DataFrame) -> DataFrame:
    """Scenarios and records that contain one of their tokens anywhere, once each.

    A token that holds another one of its scenario is left out, as the shorter one finds its records. The longest part of a
    token without white space lies inside one word of every record that contains the token. So the distinct words of all
    records are looked up by the part's first characters, and only records with a word that holds the part are
    searched for tokens of several parts; tokens of one part are found by then. Words that hold a part, and what is to be
    searched, are written down, so that Spark knows how few they are before it joins them with all words and texts."""
    some = F.filter("tokens", lambda t: t.isNotNull() & t.rlike(r"\S"))
    least = F.filter(some, lambda t: ~F.exists(some, lambda u: (u != t) & F.contains(t, u)))
    tokens = scenarios.select("scenario_id", F.explode(least).alias("token")).distinct()
    parts = F.filter(F.split("token", r"\s+"), lambda p: p != "")
    tokens = tokens.withColumn("several", F.size(parts) > 1).withColumn("part", F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"])
    has = records.select("record_id", F.explode(F.array_distinct(F.split(F.lower("haystack"), r"\s+"))).alias("word")).where("word != ''")
    looked_up = has.select("word").distinct().select("word", F.explode(_grams(F.col("word"))).alias("gram"))
    wanted = tokens.select("part").distinct().withColumn("gram", F.substring("part", 1, 3))
    held = written(looked_up.join(wanted, "gram").where(F.contains(F.col("word"), F.col("part"))).select("word", "part"), "held")
    found = written(has.join(held, "word").select("record_id", "part").distinct(), "matched")
    sure = found.join(tokens.where("not several"), "part").select("scenario_id", "record_id")
    searches = written(found.join(tokens.where("several"), "part").select("scenario_id", "record_id", "token"), "searches")
    searched = records.join(searches, "record_id").where(F.contains(F.lower("haystack"), F.col("token"))).select("scenario_id", "record_id")
    return sure.unionByName(searched).distinct()


def by_period(rows: DataFrame, ts: str, hours: int, out: str) -> DataFrame:
    """Add ``out``: how many periods of so many hours before the newest row (a single row, which is broadcast) the row lies
    back. Period 0 reaches from the newest row back to that many hours before it, both ends included; each other one begins
    where the period after it ends."""
    newest = F.broadcast(rows.agg(F.max(micros(F.col(ts))).alias("__newest")))
    back = F.ceil((F.col("__newest") - micros(F.col(ts))) / (hours * 3_600_000_000)) - 1
    return rows.where(F.col(ts).isNotNull()).join(newest).withColumn(out, F.greatest(back, F.lit(0)).cast("long")).drop("__newest")


def timeline(events: DataFrame, key: str, at: str, order: list[str], width_us: int = STRETCH_US) -> DataFrame:
    """Add ``position``: the row's place among the key's, from 1, in order of time; in stretches of time."""
    rows = written(events.withColumn("__at", micros(F.col(at))), "timeline")
    return running_sum(rows, [key], "__at", order, {"position": F.lit(1).cast("long")}, width_us).withColumn("position", F.col("position") + 1).drop("__at")


def replay_catalog(scenarios: DataFrame, events: DataFrame) -> DataFrame:
    """One row per scenario: sorted distinct tags, distinct source feeds, numbers of steps and of expected alerts, and the time
    of the first and last step. The steps themselves are rows, see ``timeline``."""
    line = events.groupBy("scenario_id").agg(F.array_sort(F.collect_set("source")).alias("feeds"), F.count("*").alias("steps"), F.count(F.when(F.col("event_type") == "alert", 1)).alias("expected_alerts"), F.min("event_time").alias("first_at"), F.max("event_time").alias("last_at"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return scenarios.join(line, "scenario_id", "left").select("scenario_id", F.array_sort(F.array_distinct("tags")).alias("tags"), F.coalesce("feeds", F.array().cast("array<string>")).alias("feeds"), zero("steps"), zero("expected_alerts"), "first_at", "last_at")


def feature_vectors(rows: DataFrame, key: str, numbers: dict[str, str], labels: dict[str, str]) -> DataFrame:
    """Features of each row as two maps (name to column): numbers as doubles, labels as texts; nulls are left out."""
    entries = lambda names, kind: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(n).alias("k"), F.col(c).cast(kind).alias("v")) for n, c in names.items())), lambda e: e["v"].isNotNull()))
    return rows.select(key, entries(numbers, "double").alias("numbers"), entries(labels, "string").alias("labels"))


# Source sharing


def latest_consents(consents: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("status", "consent_id"), F.struct("changed_at", "consent_id"))
    return consents.groupBy("offer_id", "tenant_id").agg(newest.alias("x"), F.max("changed_at").alias("changed_at")).select("offer_id", "tenant_id", F.col("x.status").alias("status"), "changed_at")


def desired_targets(consents: DataFrame, offers: DataFrame, streams: DataFrame) -> DataFrame:
    """Stream targets that follow from consents: an active one enables, leaving active disables."""
    now = latest_consents(consents).join(offers.where("status = 'active'").select("offer_id", "source_id"), "offer_id")
    return now.join(streams.select("stream_id", "source_id"), "source_id").groupBy("stream_id", "tenant_id").agg(F.max(F.col("status") == "active").alias("enabled"))


def missing_targets(wanted: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets that consents enable and that don't exist yet."""
    return wanted.where("enabled").select("stream_id", "tenant_id").join(targets.select("stream_id", "tenant_id"), ["stream_id", "tenant_id"], "left_anti")


def promotions(consents: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers with as many active subscribers as their threshold, as outbox rows."""
    active = latest_consents(consents).where("status = 'active'").groupBy("offer_id").agg(F.count_distinct("tenant_id").alias("subscribers"))
    rows = offers.where("status = 'active'").join(active, "offer_id").where("subscribers >= promote_at")
    return rows.select("offer_id", "source_id", "subscribers", F.lit("promote_to_global").alias("action"), F.sha2(F.concat_ws("|", F.lit("promote"), "offer_id"), 256).alias("outbox_id"))


def consent_violations(consents: DataFrame, offers: DataFrame) -> DataFrame:
    rows = consents.join(offers.select("offer_id", "owner_tenant_id", F.col("status").alias("offer_status")), "offer_id", "left")
    reason = F.when(F.col("owner_tenant_id").isNull(), "unknown_offer").when(F.col("owner_tenant_id") == F.col("tenant_id"), "own_offer").when((F.col("status") == "active") & (F.col("offer_status") != "active"), "offer_not_active")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL")


def status_changes(consents: DataFrame) -> DataFrame:
    """Audit rows: a consent whose status differs from the one before."""
    w = Window.partitionBy("offer_id", "tenant_id").orderBy("changed_at", "consent_id")
    return consents.withColumn("old_status", F.lag("status").over(w)).where("old_status IS NULL OR old_status != status")
