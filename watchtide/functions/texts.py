"""Names, slugs, case types and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitise_protocol(name: Column) -> Column:
    """Lower case; every character other than a-z, 0-9 becomes ``_``."""
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]", "_")


def slugify(text: Column) -> Column:
    """Runs of other characters become one ``-``, none at the ends; ``scenario`` if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(slug != "", slug).otherwise("scenario")


def case_type(text: Column, dpeg_is_market: bool = False) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    market = "depeg|market|stress|liquidity" + ("|dpeg" if dpeg_is_market else "")
    return F.when(t.rlike("flash|oracle|exploit|loan"), "exploit").when(t.rlike(market), "market_stress").otherwise("anomaly")


def tokens(texts: Column) -> Column:
    """Of an array of texts: the whole lower-case texts and their alphanumeric segments longer than 2,
    sorted and distinct."""
    low = F.filter(F.transform(texts, lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (t != ""))
    parts = F.flatten(F.transform(low, lambda t: F.split(t, "[^a-z0-9]+")))
    return F.array_sort(F.array_distinct(F.concat(low, F.filter(parts, lambda p: F.length(p) > 2))))


def supported_patterns(incident_class: Column, explicit: Column | None = None) -> Column:
    """The patterns that a scenario names itself, if any; otherwise by its class (fixed values)."""
    c = F.lower(incident_class)
    by_class = (
        F.when(F.contains(c, F.lit("depeg")), F.array(F.lit("dpeg")))
        .when(F.contains(c, F.lit("oracle")), F.array(F.lit("oracle_manipulation"), F.lit("flash_loan")))
        .when(c.rlike("flash|exploit"), F.array(F.lit("flash_loan")))
        .otherwise(F.array(F.lit("anomaly")))
    )
    return by_class if explicit is None else F.when(F.size(explicit) > 0, explicit).otherwise(by_class)


def step_event_type(incident_class: Column, event_type: Column) -> Column:
    """The type that a scenario's step names itself; otherwise by the scenario's class (fixed values)."""
    return F.coalesce(event_type, F.when(F.contains(F.lower(incident_class), F.lit("flash")), "flash_loan_candidate").otherwise("oracle_update"))
