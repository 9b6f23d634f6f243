"""Timestamps, ISO text and duration strings."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_SECONDS = {"m": 60, "h": 3600, "d": 86400, "w": 604800}
_SHORT = re.compile(r"(\d+)\s*([mhdw])", re.IGNORECASE)
_ISO = re.compile(
    r"P(?=\w)(?:(?P<w>\d+)W|(?:(?P<d>\d+)D)?"
    r"(?:T(?=\d)(?:(?P<h>\d+)H)?(?:(?P<m>\d+)M)?(?:(?P<s>\d+(?:\.\d+)?)S)?)?)",
    re.IGNORECASE,
)
MAX_DURATION = timedelta(days=36_500)


def parse_duration(text: str) -> timedelta:
    """``30m``/``24h``/``7d``/``1w`` or ISO ``PT1H30M``; months are ambiguous."""
    raw = text.strip()
    try:
        short = _SHORT.fullmatch(raw)
        if short:
            span = timedelta(seconds=int(short[1]) * _UNIT_SECONDS[short[2].lower()])
        else:
            iso = _ISO.fullmatch(raw)
            if not iso or not any(iso.groupdict().values()):
                raise ValueError(f"not a duration: {text!r}")
            part = {k: float(v) for k, v in iso.groupdict().items() if v}
            span = timedelta(
                weeks=part.get("w", 0),
                days=part.get("d", 0),
                hours=part.get("h", 0),
                minutes=part.get("m", 0),
                seconds=part.get("s", 0),
            )
    except OverflowError as exc:
        raise ValueError(f"duration too large: {text!r}") from exc
    if span.days > MAX_DURATION.days:
        raise ValueError(f"duration too large: {text!r}")
    return span


def as_utc(moment: datetime) -> datetime:
    """Naive moments are UTC."""
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)


def epoch_ns(moment: datetime) -> int:
    """Exact nanoseconds since the epoch, no float step."""
    delta = as_utc(moment) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return ((delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds) * 1000


def ts_literal(moment: datetime) -> Column:
    return F.timestamp_micros(F.lit(epoch_ns(moment) // 1000))


def ns_to_timestamp(ts_ns: Column) -> Column:
    """Microsecond timestamp of a nanosecond count (null outside the range)."""
    micros = F.floor(ts_ns.cast("decimal(20,0)") / F.lit(1000).cast("decimal(20,0)"))
    return F.timestamp_micros(micros.cast("bigint"))


def iso_micros(ts: Column) -> Column:
    """``2024-01-01T00:00:07.179575Z``; whole seconds drop the fraction."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fine = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(fine)


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
