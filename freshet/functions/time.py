"""Time literals and texts."""

from __future__ import annotations

import re
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = re.compile(r"(\d{4})(?:[-/](\d{1,2})(?:[-/](\d{1,2})(?:[T.](\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,3}))?)?)?)?)?)?(Z?)$")


def parse_ms(text: str, zone: str = "UTC") -> int:
    """Milliseconds of an ISO (2024-07-11T09:15:10.010) or legacy (2024/07/11.09:15:10) time; any end may be left out."""
    m = _ISO.match(text)
    if not m:
        raise ValueError(f"not a time: {text}")
    y, mo, d, h, mi, s, frac, z = m.groups()
    tz = timezone.utc if z else ZoneInfo(zone)
    t = datetime(int(y), int(mo or 1), int(d or 1), int(h or 0), int(mi or 0), int(s or 0), tzinfo=tz)
    return int(t.timestamp()) * 1000 + int((frac or "0").ljust(3, "0"))


def parse_window(text: str, zone: str = "UTC") -> tuple[int, int]:
    """`from-to` of legacy times or `from/to` of ISO ones; an open end is far away."""
    for sep in ("/", "-"):
        parts = text.split(sep)
        if len(parts) == 2:
            a, b = parts
            return (parse_ms(a, zone) if a else 0), (parse_ms(b, zone) if b else 2**62)
    half = len(text) // 2
    if len(text) % 2 and text[half] in "-/":
        return parse_ms(text[:half], zone), parse_ms(text[half + 1 :], zone)
    return parse_ms(text, zone), 2**62


def iso(ms: Column) -> Column:
    """2024-03-01 12:00:00.123 in the session's zone; unset times as zeros of a date."""
    return F.when(F.coalesce(ms, F.lit(0)) == 0, F.lit("0000-00-00 00:00:00.000")).otherwise(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS"))


def duration_text(ms: Column) -> Column:
    """`    HH:MM:SS.mmm`, from a day on `NNd HH:MM:SS.mmm`."""
    day, rest = F.floor(ms / 86_400_000), F.pmod(ms, F.lit(86_400_000))
    clock = F.format_string("%02d:%02d:%02d.%03d", F.floor(rest / 3_600_000), F.floor(rest / 60_000) % 60, F.floor(rest / 1000) % 60, rest % 1000)
    return F.when(day == 0, F.concat(F.lit("    "), clock)).otherwise(F.concat(F.format_string("%2dd ", day), clock))
