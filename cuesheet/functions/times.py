"""Time stamps.  Times are whole milliseconds; texts are formatted and parsed here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(c: Column, by: int) -> Column:
    return F.floor(c / F.lit(by)) if by == 1 else F.floor((c - F.pmod(c, F.lit(by))) / F.lit(by)).cast("bigint")


def srt_time(ms: Column) -> Column:
    t = F.greatest(ms, F.lit(0)).cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d,%03d", _div(t, 3_600_000), _div(t % 3_600_000, 60_000), _div(t % 60_000, 1000), t % 1000
    )


def centiseconds(ms: Column) -> Column:
    """Rounded half to even, as the text formats expect."""
    t = F.greatest(ms, F.lit(0)).cast("bigint")
    low, whole = t % 10, _div(t, 10)
    up = (low > 5) | ((low == 5) & (whole % 2 == 1))
    return whole + F.when(up, F.lit(1)).otherwise(F.lit(0))


GREATEST_SECONDS = 9.0e12  # in milliseconds still a whole double


def ass_time(ms: Column) -> Column:
    cs = centiseconds(ms)
    return F.format_string(
        "%d:%02d:%02d.%02d", _div(cs, 360_000), _div(cs % 360_000, 6_000), _div(cs % 6_000, 100), cs % 100
    )


def seconds_text(ms: Column) -> Column:
    """Seconds with two decimals."""
    cs = centiseconds(ms)
    return F.format_string("%d.%02d", _div(cs, 100), cs % 100)


def seconds(ms: Column) -> Column:
    return ms.cast("double") / F.lit(1000.0)


def millis(sec: Column) -> Column:
    """Seconds to milliseconds, rounded once on ingest; null beyond what a double holds exactly."""
    whole = sec.cast("double")
    return F.when(F.abs(whole) <= GREATEST_SECONDS, F.floor(whole * 1000.0 + 0.5).cast("bigint"))


def _clock(c: Column, mark: str, unit: int) -> Column:
    """``h:m:s<mark>fraction``; the fraction is a whole number of 1/unit seconds.  Bad text -> null."""
    number = r"\s*([+-]?\d+)\s*"
    pattern = f"^{number}:{number}:{number}{mark}{number}$"
    part = [F.regexp_extract(c, pattern, i).try_cast("decimal(24,0)") for i in range(1, 5)]
    ms = part[0] * 3_600_000 + part[1] * 60_000 + part[2] * 1000 + part[3] * (1000 // unit)
    return F.when(c.rlike(pattern), ms.try_cast("bigint"))


def parse_srt_time(c: Column) -> Column:
    return _clock(c, ",", 1000)


def parse_ass_time(c: Column) -> Column:
    return _clock(c, r"\.", 100)


def round2(x: Column) -> Column:
    """Two decimals, by the formula shared with the SQL checks."""
    return F.floor(x * 100 + F.lit(0.5)) / F.lit(100.0)


def round_to(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(x * scale + F.lit(0.5)) / F.lit(scale)
