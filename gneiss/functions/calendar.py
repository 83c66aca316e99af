"""Calendars as column arithmetic: Julian days, model calendars, time units, DRS periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days before each month in a year of 365 and of 366 days.
BEFORE = {365: (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334), 366: (0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335)}
YEAR_DAYS = {"360_day": 360, "noleap": 365, "365_day": 365, "all_leap": 366, "366_day": 366}
#: Days in a unit of time.
UNIT_DAYS = {"day": 1.0, "hour": 1 / 24, "minute": 1 / 1440, "second": 1 / 86400}


def julian_day(date: Column) -> Column:
    """The Julian day number of a Gregorian date (its day began at noon before)."""
    return F.datediff(date.cast("date"), F.lit("1970-01-01").cast("date")) + 2440588


def from_julian_day(day: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (day - 2440588).cast("int"))


def model_day(year: Column, month: Column, day: Column, calendar: str) -> Column:
    """Days since 0000-01-01 in a calendar of equal years."""
    n = YEAR_DAYS[calendar]
    before = (month - 1) * 30 if n == 360 else F.element_at(F.array(*[F.lit(b) for b in BEFORE[n]]), month.cast("int"))
    return (year * n + before + day - 1).cast("long")


def model_date(number: Column, calendar: str) -> Column:
    """(year, month, day) of a model day; the inverse of ``model_day``."""
    n = YEAR_DAYS[calendar]
    year, rest = F.floor(number / n), F.pmod(number, F.lit(n))
    if n == 360:
        month = F.floor(rest / 30) + 1
        day = rest % 30 + 1
    else:
        starts = F.array(*[F.lit(b) for b in BEFORE[n]])
        month = F.size(F.filter(starts, lambda b: b <= rest)).cast("long")
        day = rest - F.element_at(starts, month.cast("int")) + 1
    return F.struct(year.cast("long").alias("year"), month.cast("long").alias("month"), day.cast("long").alias("day"))


def add_model_months(number: Column, months: Column, calendar: str) -> Column:
    """A model day some months later; a day past the month's end is its last."""
    d = model_date(number, calendar)
    m = d["year"] * 12 + d["month"] - 1 + months
    year, month = F.floor(m / 12), F.pmod(m, F.lit(12)) + 1
    first = model_day(year, month, F.lit(1), calendar)
    next_ = model_day(F.floor((m + 1) / 12), F.pmod(m + 1, F.lit(12)) + 1, F.lit(1), calendar)
    return F.least(first + d["day"] - 1, next_ - 1)


UNITS = r"^\s*([A-Za-z]+?)s?\s+since\s+([0-9]{1,4})-([0-9]{1,2})-([0-9]{1,2})(?:[T ]\s*([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:\.[0-9]*)?)?)?\s*(?:Z|UTC|([+-][0-9]{1,2})(?::?([0-9]{2}))?)?\s*$"


def parsed_units(units: Column) -> Column:
    """(unit, reference timestamp) of ``<unit>s since <date> [<time>] [<zone>]``; null where the grammar does not fit. The reference is in UTC: an offset is
    taken off. The text is matched once, its parts are cut out of what the match gives."""
    matched = F.split(F.regexp_replace(units, UNITS, "|$1|$2|$3|$4|$5|$6|$7|$8|$9"), r"\|")
    whole = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))

    def read(p):
        part = lambda k: F.get(p, F.lit(k))
        pad = lambda c, n: F.lpad(F.when(c == "", "0").otherwise(c), n, "0")
        date = F.concat_ws("-", pad(part(2), 4), pad(part(3), 2), pad(part(4), 2))
        time = F.concat_ws(":", pad(part(5), 2), pad(part(6), 2), pad(part(7), 2))
        minutes = whole(part(8)) * 60 + F.when(F.startswith(part(8), F.lit("-")), -1).otherwise(1) * whole(part(9))
        local = F.try_to_timestamp(F.concat_ws(" ", date, time))
        at = F.when(minutes == 0, local).otherwise(F.timestamp_micros(F.unix_micros(local) - minutes.cast("long") * 60_000_000))
        return F.when((F.size(p) == 10) & (part(0) == ""), F.struct(F.lower(part(1)).alias("unit"), at.alias("reference")))

    return F.transform(F.array(matched), read)[0]


def since(time: Column, reference: Column, unit: str) -> Column:
    """Units between two timestamps."""
    return (F.unix_micros(time) - F.unix_micros(reference)) / F.lit(86400e6 * UNIT_DAYS[unit])


def absolute_date(value: Column) -> Column:
    """A timestamp from YYYYMMDD.f, f the fraction of the day; to the millisecond."""
    whole = F.floor(value).cast("long")
    day = F.unix_micros(F.try_to_timestamp(F.lpad(whole.cast("string"), 8, "0"), F.lit("yyyyMMdd")))
    return F.timestamp_micros((day + F.round((value - whole) * 86400000) * 1000).cast("long"))


def decimal_year(date: Column) -> Column:
    year = F.year(date)
    first = F.make_date(year, F.lit(1), F.lit(1))
    return year + F.datediff(date.cast("date"), first) / F.datediff(F.make_date(year + 1, F.lit(1), F.lit(1)), first)


def drs_instant(digits: Column, end: bool) -> Column:
    """The first instant of YYYY[MM[DD[hh[mm[ss]]]]], or with ``end`` the first instant after it."""
    n = F.length(digits)
    full = F.rpad(F.concat(digits, F.when(n == 4, "0101").when(n == 6, "01").otherwise("")), 14, "0")
    at = F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss"))
    if not end:
        return at
    return (
        F.when(n == 4, at + F.expr("interval 1 year")).when(n == 6, at + F.expr("interval 1 month")).when(n == 8, at + F.expr("interval 1 day"))
        .when(n == 10, at + F.expr("interval 1 hour")).when(n == 12, at + F.expr("interval 1 minute")).otherwise(at + F.expr("interval 1 second"))
    )


def iso_format(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


def seconds_of(text: Column) -> Column:
    """Seconds of hh:mm:ss, hh:mm or hh."""
    p = F.split(text, ":")
    part = lambda i: F.coalesce(F.get(p, F.lit(i)).try_cast("double"), F.lit(0.0))
    return part(0) * 3600 + part(1) * 60 + part(2)


def calendar_day(year: Column, month: Column, day: Column, calendar: str) -> Column:
    """The Julian day number of a date in the ``julian``, ``proleptic_gregorian`` or mixed ``standard`` calendar, in which the day after
    1582-10-04 (Julian) is 1582-10-15 (Gregorian). Years count through 0 and below."""
    # years begin in March, so that a leap day is the last of its year
    late = F.floor((F.lit(14) - month) / 12)
    y, m = (year + 4800 - late).cast("long"), (month + 12 * late - 3).cast("long")
    base = day + F.floor((153 * m + 2) / 5) + 365 * y + F.floor(y / 4)
    julian, gregorian = (base - 32083).cast("long"), (base - F.floor(y / 100) + F.floor(y / 400) - 32045).cast("long")
    if calendar in ("standard", "gregorian"):
        return F.when(year * 10000 + month * 100 + day >= 15821015, gregorian).otherwise(julian)
    return {"julian": julian, "proleptic_gregorian": gregorian}[calendar]


#: Fixed value: the Julian day number of 1582-10-15, the first Gregorian date of the mixed calendar.
CHANGE = 2299161


def calendar_date(number: Column, calendar: str) -> Column:
    """(year, month, day) of a Julian day number; the inverse of ``calendar_day``."""
    n = number.cast("long")
    # centuries of the Gregorian calendar add days that its common ones lack
    a = n + 32044
    b = F.floor((4 * a + 3) / 146097)
    gregorian = (F.struct(b.alias("b"), (a - F.floor(146097 * b / 4)).alias("c")))
    julian = F.struct(F.lit(0).cast("long").alias("b"), (n + 32082).alias("c"))
    if calendar in ("standard", "gregorian"):
        part = F.when(n >= CHANGE, gregorian).otherwise(julian)
    else:
        part = {"julian": julian, "proleptic_gregorian": gregorian}[calendar]
    d = F.floor((4 * part["c"] + 3) / 1461)
    e = part["c"] - F.floor(1461 * d / 4)
    m = F.floor((5 * e + 2) / 153)
    return F.struct(
        (100 * part["b"] + d - 4800 + F.floor(m / 10)).cast("long").alias("year"), (m + 3 - 12 * F.floor(m / 10)).cast("long").alias("month"), (e - F.floor((153 * m + 2) / 5) + 1).cast("long").alias("day")
    )


def custom_day(year: Column, month: Column, day: Column, lengths: list[int]) -> Column:
    """Days since 0000-01-01 in a calendar whose months have these ``lengths`` in every year."""
    before = [sum(lengths[:k]) for k in range(len(lengths))]
    return (year * sum(lengths) + F.element_at(F.array(*[F.lit(b) for b in before]), month.cast("int")) + day - 1).cast("long")


def custom_date(number: Column, lengths: list[int]) -> Column:
    """(year, month, day) of a day of ``custom_day``."""
    total, starts = sum(lengths), F.array(*[F.lit(sum(lengths[:k])) for k in range(len(lengths))])
    rest = F.pmod(number, F.lit(total))
    month = F.size(F.filter(starts, lambda b: b <= rest))
    return F.struct(F.floor(number / total).cast("long").alias("year"), month.cast("long").alias("month"), (rest - F.element_at(starts, month) + 1).cast("long").alias("day"))


def model_seconds(year: Column, month: Column, day: Column, second: Column, calendar: str) -> Column:
    """Seconds since 0000-01-01 00:00 of a date and a second of its day in a calendar of equal years."""
    return model_day(year, month, day, calendar) * 86400 + second.cast("long")


def add_model_time(number: Column, calendar: str, years: Column | int = 0, months: Column | int = 0, days: Column | int = 0, seconds: Column | int = 0) -> Column:
    """Model seconds some years, months, days and seconds later: years and months first, where a day past the month's end is its last."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    day = add_model_months(F.floor(number / 86400), col(years) * 12 + col(months), calendar)
    return (day + col(days)) * 86400 + F.pmod(number, F.lit(86400)) + col(seconds)


def model_time(number: Column, calendar: str) -> Column:
    """(year, month, day, second) of model seconds."""
    d = model_date(F.floor(number / 86400), calendar)
    return F.struct(d["year"].alias("year"), d["month"].alias("month"), d["day"].alias("day"), F.pmod(number, F.lit(86400)).cast("long").alias("second"))
