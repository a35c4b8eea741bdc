"""Clock times, weekdays, dates and validity windows as column expressions. Times are minutes since midnight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.functions.binding import let, spaced, strip
from slotwise.functions.text import deaccent

GRANULARITY = 30
#: Weekday names (Spanish and English, without accents), month names and the months of validity labels.
WEEKDAYS = {"monday": 1, "lunes": 1, "tuesday": 2, "martes": 2, "wednesday": 3, "miercoles": 3, "thursday": 4, "jueves": 4, "friday": 5, "viernes": 5}
MONTHS = {"january": 1, "enero": 1, "february": 2, "febrero": 2}
TERM_START, TERM_END = "2026-09-07", "2027-01-08"
VALIDITY_MONTHS = {"sep": "2026-09-01", "oct": "2026-10-01", "nov": "2026-11-01", "dic": "2026-12-01", "dec": "2026-12-01", "ene": "2027-01-01", "jan": "2027-01-01"}
EXAM_YEAR, EXAM_MONTH = 2027, 1



def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _group(c: Column, pattern: str, k: int) -> Column:
    """The k-th group, null where the pattern does not match or the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def to_min(hour: Column, minute: Column) -> Column:
    return hour * 60 + minute


def fmt_min(minutes: Column) -> Column:
    """HH:MM."""
    return F.format_string("%02d:%02d", F.floor(minutes / 60), F.pmod(minutes, F.lit(60)))


def fmt_range(start: Column, end: Column, assumed: Column) -> Column:
    """HH:MM–HH:MM, with ~ before an assumed end."""
    return F.concat(fmt_min(start), F.lit("–"), F.when(F.coalesce(assumed, F.lit(False)), "~").otherwise(""), fmt_min(end))


#: Notations of a time.
_TWELVE = spaced(r"(?i)^(\d{1,2})[:.](\d{2})\s*([ap])\.?m?\.?$")
_CLOCK = spaced(r"^(\d{1,2})[:.](\d{2})\s*(?:h\.?)?$")
_HOUR = spaced(r"^(\d{1,2})\s*h\.?$")


def parse_time(text: Column) -> Column:
    """Minutes of ``7:00 PM``, ``7.00 p.m.``, ``9:00``, ``9:00 h.`` or ``18h``; null for anything else. Ranges are not checked."""
    number = lambda s, p, k: _group(s, p, k).cast("int")

    def read(s: Column) -> Column:
        half = number(s, _TWELVE, 1) % 12 + F.when(F.lower(_group(s, _TWELVE, 3)) == "p", 12).otherwise(0)
        return F.when(s.rlike(_TWELVE), to_min(half, number(s, _TWELVE, 2))).when(s.rlike(_CLOCK), to_min(number(s, _CLOCK, 1), number(s, _CLOCK, 2))).when(s.rlike(_HOUR), number(s, _HOUR, 1) * 60)

    return let(strip(text), read)


#: Notations of a range of times.
_POINT = r"(\d{1,2}(?:[:.]\d{2})?\s*(?:[ap]\.?m?\.?)?)"
_RANGE = spaced(rf"(?i)^{_POINT}\s*(?:-|–|—|to)\s*{_POINT}\s*(?:h\.?)?$")


def parse_time_range(text: Column) -> Column:
    """struct(start_min, end_min) of two times; null if it is none or does not run forward. A bare hour is on the hour."""

    def read(s: Column) -> Column:
        points = F.transform(F.array(_group(s, _RANGE, 1), _group(s, _RANGE, 2)), lambda p: F.coalesce(parse_time(p), parse_time(F.concat(p, F.lit(":00")))))
        return let(points, lambda p: F.when(F.get(p, F.lit(1)) > F.get(p, F.lit(0)), F.struct(F.get(p, F.lit(0)).alias("start_min"), F.get(p, F.lit(1)).alias("end_min"))))

    return let(strip(text), read)


def parse_time_input(text: Column) -> Column:
    """Minutes of a typed HH:MM, with hours to 23 and minutes to 59."""
    p = r"^(\d{1,2}):(\d{2})$"
    h, m = (_group(strip(text), p, k).cast("int") for k in (1, 2))
    return F.when((h <= 23) & (m <= 59), to_min(h, m))


def on_grid(minutes: Column) -> Column:
    """Whether a time is on the half hour."""
    return F.pmod(minutes, F.lit(GRANULARITY)) == 0


def assert_granularity(minutes: Column, where: Column) -> Column:
    """The time itself; the query fails where it is off the grid."""
    return F.when(on_grid(minutes) | minutes.isNull(), minutes).otherwise(F.raise_error(F.concat(where, F.lit(": "), fmt_min(minutes), F.lit(" is not on a 30-minute boundary"))).cast("int"))


def parse_weekday(text: Column) -> Column:
    """1 (Monday) to 5, from a Spanish or English name; null otherwise."""
    return _lookup(WEEKDAYS, F.regexp_replace(deaccent(F.lower(strip(text))), "[^a-z]", ""))


def weekday_of(date: Column) -> Column:
    """1 (Monday) to 7."""
    return F.weekday(date) + 1


def parse_exam_date(text: Column, month: int = EXAM_MONTH, year: int = EXAM_YEAR) -> Column:
    """The date of ``12-January`` or of ``MONDAY 12``; a weekday that the date does not have gives null."""
    s = strip(text)
    day_first, name_first = spaced(r"^(\d{1,2})\s*[-\s]\s*([A-Za-z]+)$"), spaced(r"^([A-Za-zÀ-ÿ]+)\s+(\d{1,2})$")
    date = lambda m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", F.lit(year), m, d), "yyyy-MM-dd")
    named = date(_lookup(MONTHS, F.lower(_group(s, day_first, 2))), _group(s, day_first, 1).cast("int"))
    checked = date(F.lit(month), _group(s, name_first, 2).cast("int"))
    return F.when(s.rlike(day_first), named).when(s.rlike(name_first) & (weekday_of(checked) == parse_weekday(_group(s, name_first, 1))), checked)


def resolve_validity(label: Column) -> Column:
    """struct(from, to) of ``Weeks 1-7`` (of the term, no later than its end) or ``sep-oct``; null otherwise."""
    s = F.lower(strip(label))
    weeks, months = spaced(r"^weeks?\s+(\d{1,2})\s*-\s*(\d{1,2})$"), spaced(r"^([a-z]{3})\s*-\s*([a-z]{3})$")
    start = F.lit(TERM_START).cast("date")
    a, b = (_group(s, weeks, k).cast("int") for k in (1, 2))
    first, last = (_lookup(VALIDITY_MONTHS, _group(s, months, k)).cast("date") for k in (1, 2))
    by_week = F.struct(F.date_add(start, (a - 1) * 7).alias("from"), F.least(F.date_add(start, b * 7 - 1), F.lit(TERM_END).cast("date")).alias("to"))
    by_month = F.struct(first.alias("from"), F.last_day(last).alias("to"))
    return F.when(s.rlike(weeks), by_week).when(s.rlike(months) & first.isNotNull() & last.isNotNull(), by_month)


def ranges_overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Whether two closed windows meet; a window without bounds is always."""
    return a_from.isNull() | b_from.isNull() | ((a_from <= b_to) & (b_from <= a_to))


def weekdays_between(first: Column, last: Column) -> Column:
    """The dates from Monday to Friday between two dates, both included."""
    return F.filter(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>")), lambda d: F.weekday(d) < 5)


def fmt_date(date: Column) -> Column:
    """``Mon 11 Jan``."""
    return F.date_format(date, "E d MMM")
