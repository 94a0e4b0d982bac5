"""Keys, checksums and identifiers. All are digests of natural keys, so that a second run agrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dedup_key(provider: Column, source: Column, stream: Column, event_id: Column, *others: Column) -> Column:
    """``provider:source:stream:event_id`` if the event has an id, else a digest over all fields."""
    digest = F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in (provider, source, stream, *others))), 256)
    return F.when(event_id.isNotNull() & (event_id != ""), F.concat_ws(":", provider, source, stream, event_id)).otherwise(digest)


def error_key(provider: Column, source: Column, stream: Column, payload: Column, error: Column) -> Column:
    return F.concat(F.lit("error:"), F.sha2(F.concat_ws("|", provider, source, stream, F.coalesce(payload, F.lit("")), error), 256))


def event_digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def stable_checksum(struct: Column, short: bool = False) -> Column:
    """sha256 of the struct's JSON text (give its fields in sorted order); ``short``: 16 digits."""
    digest = F.sha2(F.to_json(struct), 256)
    return F.substring(digest, 1, 16) if short else digest


def incident_key(chain: Column, protocol: Column, block: Column, rules: Column) -> Column:
    """``incident:chain:protocol:block``; null without rules."""
    return F.when(F.size(F.coalesce(rules, F.array().cast("array<string>"))) > 0, F.concat_ws(":", F.lit("incident"), chain, protocol, block.cast("string")))
