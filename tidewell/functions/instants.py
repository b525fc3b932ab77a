"""Column functions that parse written moments without Python workers.

A written moment is folded to ASCII and matched against the families of PATTERNS. Each match yields a struct of the
local fields, how the day and month may be read, and what the value says about its zone.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + " 　"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + "  "
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d{1,9})?)?(?: ?([AaPp][Mm]))?"
_ZONE = r"(?: ?(Z|[+-]\d{2}:?\d{2}|[A-Z]{2,5}|[A-Z][A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+))?"
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

YEAR_FIRST = rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:(?:T| ){_CLOCK}{_ZONE})?$"
YEAR_LAST = rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:(?:T| ){_CLOCK}{_ZONE})?$"
MAIL = rf"^(?:[A-Za-z]{{3}}, ?)?(\d{{1,2}}) ([A-Za-z]{{3}}) (\d{{4}}) {_CLOCK}{_ZONE}$"
C_TIME = r"^[A-Za-z]{3} ([A-Za-z]{3}) {1,2}(\d{1,2}) (\d{1,2}):(\d{2}):(\d{2})(?: ([A-Z]{2,5}))? (\d{4})$"
HAN = r"^(\d{4})年(\d{1,2})月(\d{1,2})日 ?(?:(凌晨|早上|上午|中午|下午|晚上)? ?(\d{1,2})[时時点點:](\d{1,2})?(?:[分:](\d{1,2})?秒?)?)?$"
NUMBER = r"^(\d{8}|\d{10}|\d{13})$"


def fold(value: Column) -> Column:
    """ASCII width, single inner blanks, no outer white space."""
    return F.trim(F.regexp_replace(F.translate(value, _WIDE, _NARROW), r"[ \t\r\n]+", " "))


def _part(value: Column, pattern: str, k: int) -> Column:
    got = F.regexp_extract(value, pattern, k)
    return F.when(got != "", got)


def _int(value: Column, pattern: str, k: int) -> Column:
    return _part(value, pattern, k).try_cast("int")


def _month(name: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(name)).cast("int")
    return F.when(at > 0, at)


def _hour(hour: Column, half: Column) -> Column:
    """Hour of the day by a 12-hour mark; null where the mark doesn't fit."""
    late = F.lower(half).isin("pm", "下午", "晚上", "中午")
    twelve = F.when((hour >= 1) & (hour <= 12), F.when(late, hour % 12 + 12).otherwise(hour % 12))
    han = F.when((hour >= 0) & (hour <= 23), F.when(late & (hour < 12), hour + 12).when(~late & (hour == 12), 0).otherwise(hour))
    return F.when(half.isNull(), hour).when(F.lower(half).isin("am", "pm"), twelve).otherwise(han)


def written(value: Column) -> Column:
    """struct<family, year, a, b, hour, minute, second, dated, zone, epoch> of a folded value; family null: no match.

    a and b are month and day, save in the families `last` and `short`, where the numbers stand in the order a, b, year.
    dated: the value is a date alone. epoch: whole seconds since 1970 of a bare number.
    """
    v = value

    def fields(family: str | Column, y, a, b, h, mi, s, zone, dated, epoch=None) -> Column:
        null = F.lit(None)
        cast = lambda c, t: (null if c is None else c).cast(t)
        return F.struct(
            (F.lit(family) if isinstance(family, str) else family).alias("family"), *(cast(c, "int").alias(n) for c, n in ((y, "year"), (a, "a"), (b, "b"), (h, "hour"), (mi, "minute"), (s, "second"))),
            F.coalesce(dated, F.lit(False)).alias("dated"), cast(zone, "string").alias("zone"), cast(epoch, "long").alias("epoch"),
        )

    def clocked(family: str | Column, p: str, y: int, a: int, b: int, first: int, month_name: bool = False) -> Column:
        h, half = _int(v, p, first), _part(v, p, first + 3)
        month = _month(_part(v, p, a)) if month_name else _int(v, p, a)
        return fields(family, _int(v, p, y), month, _int(v, p, b), _hour(h, half), _int(v, p, first + 1), F.coalesce(_int(v, p, first + 2), F.lit(0)), _part(v, p, first + 4), h.isNull())

    c_time = fields("ctime", _int(v, C_TIME, 7), _month(_part(v, C_TIME, 1)), _int(v, C_TIME, 2), _int(v, C_TIME, 3), _int(v, C_TIME, 4), _int(v, C_TIME, 5), _part(v, C_TIME, 6), F.lit(False))
    h = _int(v, HAN, 5)
    han = fields("han", _int(v, HAN, 1), _int(v, HAN, 2), _int(v, HAN, 3), _hour(h, _part(v, HAN, 4)), F.coalesce(_int(v, HAN, 6), F.lit(0)), F.coalesce(_int(v, HAN, 7), F.lit(0)), None, h.isNull())
    day = fields("day", F.substring(v, 1, 4).try_cast("int"), F.substring(v, 5, 2).try_cast("int"), F.substring(v, 7, 2).try_cast("int"), None, None, None, None, F.lit(True))
    number = v.try_cast("long")
    return (
        F.when(v.rlike(YEAR_FIRST), clocked("first", YEAR_FIRST, 1, 3, 4, 5))
        .when(v.rlike(YEAR_LAST), clocked(F.when(F.length(_part(v, YEAR_LAST, 4)) == 2, "short").otherwise("last"), YEAR_LAST, 4, 1, 3, 5))
        .when(v.rlike(MAIL), clocked("mail", MAIL, 3, 2, 1, 4, month_name=True))
        .when(v.rlike(C_TIME), c_time)
        .when(v.rlike(HAN), han)
        .when(v.rlike(NUMBER) & (F.length(v) == 8), day)
        .when(v.rlike(NUMBER), fields("epoch", *[None] * 7, F.lit(False), F.when(F.length(v) == 13, F.floor(number / 1000)).otherwise(number)))
    )


def is_date(y: Column, m: Column, d: Column) -> Column:
    """Whether the numbers name a day of the proleptic Gregorian calendar."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.coalesce((y >= 1) & (y <= 9999) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= length), F.lit(False))


def day_number(y: Column, m: Column, d: Column) -> Column:
    """yyyymmdd of a day of the calendar, else null."""
    return F.when(is_date(y, m, d), y * 10000 + m * 100 + d)


def readings(w: dict[str, Column]) -> dict[str, Column]:
    """The day that each order of its numbers gives a written moment, as yyyymmdd; null where the order gives none.

    Two-digit years are of 1970 to 2069. Eight digits have their year at the end only where it can't stand at the front.
    """
    y, a, b, family = w["year"], w["a"], w["b"], w["family"]
    full = lambda c: F.when(family == "short", F.when(c < 70, c + 2000).otherwise(c + 1900)).otherwise(c)
    loose = family.isin("last", "short")
    tail, lead, second = a * 100 + b, (y / 100).cast("int"), y % 100
    front = day_number(y, a, b)
    back = (family == "day") & front.isNull() & tail.between(1900, 2100)
    return {
        "ymd": F.when(family == "short", day_number(full(a), b, y)).when(~loose, front),
        "dmy": F.when(loose, day_number(full(y), b, a)).when(back, day_number(tail, second, lead)),
        "mdy": F.when(loose, day_number(full(y), a, b)).when(back, day_number(tail, lead, second)),
    }


def local_second(y: Column, m: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """Seconds since 1970 of local fields, as if they were UTC; null for impossible fields."""
    clock = F.coalesce((h >= 0) & (h <= 23) & (mi >= 0) & (mi <= 59) & (s >= 0) & (s <= 59), F.lit(False))
    inside = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce(c, F.lit(lo))))
    days = F.unix_date(F.make_date(inside(y, 1, 9999), inside(m, 1, 12), F.lit(1))).cast("long") + d - 1
    return F.when(is_date(y, m, d) & clock, days * 86400 + h.cast("long") * 3600 + mi * 60 + s)


def offset_of(zone: Column) -> Column:
    """Seconds of a written offset (Z, GMT, UTC, +hh:mm, +hhmm); null for others and beyond 18 hours."""
    p = r"^([+-])(\d{2}):?(\d{2})$"
    hours, minutes = _int(zone, p, 2), _int(zone, p, 3)
    size = F.when((hours * 60 + minutes <= 18 * 60) & (minutes < 60), (hours * 60 + minutes) * 60)
    return F.when(zone.isin("Z", "GMT", "UTC"), 0).otherwise(F.when(F.regexp_extract(zone, p, 1) == "-", -size).otherwise(size))


def in_zone(local: Column, zone: Column) -> tuple[Column, Column, Column]:
    """(UTC second, whether the local second is skipped, whether it is repeated) of a local second in a known zone.

    A skipped second moves on by the gap, a repeated one is the earlier of the two.
    """
    at = F.timestamp_seconds(local)
    utc = F.to_utc_timestamp(at, zone)
    back = F.unix_seconds(F.from_utc_timestamp(utc, zone))
    first = F.unix_seconds(utc)
    again = [F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(first + d), zone)) == local for d in (1200, 1800, 3600, 5400, 7200, -1200, -1800, -3600, -5400, -7200)]
    twice = again[0]
    for a in again[1:]:
        twice = twice | a
    return first, back != local, twice


@lru_cache(maxsize=1)
def zone_names() -> tuple[str, ...]:
    """Place names of the time zone database."""
    import zoneinfo

    return tuple(sorted(z for z in zoneinfo.available_timezones() if "/" in z and not z.startswith(("Etc/", "SystemV/", "US/Pacific-New"))))


@lru_cache(maxsize=1)
def zone_abbreviations() -> tuple[tuple[str, str, int], ...]:
    """(zone, abbreviation, offset in seconds) in force at some time from 1990 to 2037; by rule from the database."""
    import zoneinfo
    from datetime import datetime, timezone

    moments = [datetime(y, m, 15, tzinfo=timezone.utc) for y in range(1990, 2038) for m in (1, 4, 7, 10)]
    rows = set()
    for name in zone_names():
        zone = zoneinfo.ZoneInfo(name)
        for t in moments:
            local = t.astimezone(zone)
            short = local.tzname()
            if short and short.isalpha():
                rows.add((name, short, int(local.utcoffset().total_seconds())))
    return tuple(sorted(rows))
