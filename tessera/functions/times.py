"""Dates and times: parsing what feeds write, and rules of age. ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(text: Column) -> Column:
    """ISO 8601; a zone is honoured, its lack means the session's zone (UTC); else null."""
    return text.try_cast("timestamp")


def parse_rfc822(text: Column) -> Column:
    """The date of RSS items; the weekday is not looked at."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},[ ]*", ""), r" (GMT|UT|UTC|Z)$", " +0000")
    zoned = F.regexp_replace(F.regexp_replace(bare, " (EST)$", " -0500"), " (EDT)$", " -0400")
    return F.coalesce(F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm Z")))


def parse_any(text: Column) -> Column:
    """ISO, RFC 822, "Month d, yyyy", "d Month yyyy", MM/dd/yyyy, in this order; else null."""
    plain = F.regexp_replace(F.trim(text), r"(?i)\bSept\b", "Sep")
    tries = [F.try_to_timestamp(plain, F.lit(p)) for p in ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "MM/dd/yyyy")]
    return F.coalesce(plain.try_cast("timestamp"), parse_rfc822(plain), *tries)


def parse_epoch(text: Column) -> Column:
    return F.timestamp_seconds(text.try_cast("bigint"))


def age_days(at: Column, now: Column) -> Column:
    """Whole days, never negative; null for no time."""
    return F.when(at.isNotNull(), F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400)).cast("int"))


def is_future(at: Column, now: Column, hours: int = 24) -> Column:
    """Beyond now and a tolerance; no time counts as not."""
    return F.coalesce(F.unix_timestamp(at) > F.unix_timestamp(now) + hours * 3600, F.lit(False))


def is_stale(at: Column, now: Column, days: int) -> Column:
    """Older than so many days; 0 switches the rule off; no time counts as not."""
    return F.lit(False) if days == 0 else F.coalesce(F.unix_timestamp(at) < F.unix_timestamp(now) - days * 86400, F.lit(False))
