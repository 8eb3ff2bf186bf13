"""Time scales as column expressions: MJD (UTC), UNIX, GPS seconds, GPS week and seconds of week, calendar strings.

A modified Julian date in a double holds an instant of our days to about 0.6 microseconds, so an instant near a full second
may fall on its other side; what is asked of a timestamp (calendar_text, gps_from_timestamp) does not go through one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIX_MJD = 40587.0
GPS_MJD = 44244.0
GPS_UNIX = 315964800
DAY = 86400.0
MJD_RANGE = (15079.0, 88127.0)

# Days (MJD, UTC) from which GPS time is ahead of UTC by so many leap seconds.
LEAP_SECONDS = [
    (44239, 0), (44786, 1), (45151, 2), (45516, 3), (46247, 4), (47161, 5), (47892, 6), (48257, 7), (48804, 8), (49169, 9),
    (49534, 10), (50083, 11), (50630, 12), (51179, 13), (53736, 14), (54832, 15), (56109, 16), (57204, 17), (57754, 18),
]


def leap_seconds(mjd: Column) -> Column:
    """Leap seconds between GPS time and UTC on a day; a chain of literals, so a scan needs no join."""
    out = F.lit(0)
    for day, n in LEAP_SECONDS:
        out = F.when(mjd >= day, F.lit(n)).otherwise(out)
    return out.cast("double")


def mjd_from_timestamp(t: Column) -> Column:
    return F.unix_micros(t) / F.lit(8.64e10) + UNIX_MJD


def day_from_timestamp(t: Column) -> Column:
    """The whole day of an instant: its MJD, if rounded up to a midnight, would be that of the next."""
    return F.floor(F.unix_micros(t) / F.lit(8.64e10)) + UNIX_MJD


def timestamp_from_mjd(mjd: Column) -> Column:
    return F.timestamp_micros(F.round((mjd - UNIX_MJD) * 8.64e10).cast("bigint"))


def mjd_from_unix(s: Column) -> Column:
    return s / DAY + UNIX_MJD


def unix_from_mjd(mjd: Column) -> Column:
    return (mjd - UNIX_MJD) * DAY


def mjd_from_gps(s: Column) -> Column:
    """From seconds since 1980-01-06 in GPS time; the leap seconds are those of the GPS day."""
    gps = s / DAY + GPS_MJD
    return gps - leap_seconds(gps) / DAY


def gps_from_mjd(mjd: Column) -> Column:
    return (mjd - GPS_MJD) * DAY + leap_seconds(mjd)


def gps_from_timestamp(t: Column) -> Column:
    return F.unix_micros(t) / F.lit(1e6) - GPS_UNIX + leap_seconds(day_from_timestamp(t))


def week_from_gps(s: Column) -> Column:
    return F.floor(s / 604800.0).cast("int")


def sow_from_gps(s: Column) -> Column:
    return s - week_from_gps(s) * 604800.0


def mjd_from_week_sow(week: Column, sow: Column) -> Column:
    return mjd_from_gps(week * 604800.0 + sow)


def week_from_mjd(mjd: Column) -> Column:
    return week_from_gps(gps_from_mjd(mjd))


def sow_from_mjd(mjd: Column) -> Column:
    return sow_from_gps(gps_from_mjd(mjd))


def mjd_from_utc(text: Column) -> Column:
    """From a date, or a date and a time with a fraction; anything else, or a field out of range, is null."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T](\d{1,2}):(\d{1,2}):(\d{1,2}(?:\.\d*)?))?\s*$", i)
    y, m, d = (part(i).try_cast("int") for i in (1, 2, 3))
    hh, mm = (F.coalesce(part(i).try_cast("int"), F.lit(0)) for i in (4, 5))
    ss = F.coalesce(part(6).try_cast("double"), F.lit(0.0))
    a = F.floor((14 - m) / 12)
    yy, mo = y + 4800 - a, m + 12 * a - 3
    jdn = d + F.floor((153 * mo + 2) / 5) + 365 * yy + F.floor(yy / 4) - F.floor(yy / 100) + F.floor(yy / 400) - 32045
    ok = y.between(1900, 2100) & m.between(1, 12) & d.between(1, 31) & (hh < 24) & (mm < 60) & (ss < 61)
    return F.when(ok, (jdn - 2400001).cast("double") + (hh * 3600 + mm * 60 + ss) / DAY)


def calendar_text(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSS")


def utc_string(mjd: Column) -> Column:
    return calendar_text(timestamp_from_mjd(mjd))


def day_of_year(mjd: Column) -> Column:
    return F.dayofyear(timestamp_from_mjd(mjd))


def parse_time(fmt: str, fields: list[Column]) -> Column:
    """MJD from the time fields of a text line, by the name of the format."""
    if fmt == "gps_total_seconds":
        return mjd_from_gps(fields[0].try_cast("double"))
    if fmt == "gps_week_sow":
        return mjd_from_week_sow(fields[0].try_cast("double"), fields[1].try_cast("double"))
    if fmt == "mjd":
        return fields[0].try_cast("double")
    if fmt in ("unix", "index"):
        return mjd_from_unix(fields[0].try_cast("double"))
    if fmt == "utc":
        return mjd_from_utc(F.concat_ws(" ", *fields))
    from cadenza.schema import ConfigError

    raise ConfigError(f"unknown time format {fmt!r}")
