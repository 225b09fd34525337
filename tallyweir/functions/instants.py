"""Instants and days written in many notations, as Column expressions.

One anchored pattern splits a text into its parts in a single pass; the parts
are then checked and assembled by built-in functions. Nothing leaves the JVM.
"""

from __future__ import annotations

import zoneinfo
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = "\u0001"
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_WEEKDAY = r"(?:(?:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?:day)?\.?,?\s+)?"
_DATE = (
    r"(?:(\d{4})([-/.])(\d{1,2})\2(\d{1,2})"  # 1 year, 2 mark, 3 month, 4 day
    r"|(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})"  # 5 month, 6 day, 7 year
    rf"|{_MONTH}\.?\s+(\d{{1,2}}),?\s+(\d{{4}})"  # 8 month, 9 day, 10 year
    rf"|(\d{{1,2}})[-\s]{_MONTH}\.?,?[-\s](\d{{4}}|\d{{2}})"  # 11 day, 12 month, 13 year
    r"|(\d{4})(\d{2})(\d{2}))"  # 14 year, 15 month, 16 day
)
_CLOCK = r"(?:(?:t|,?\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([ap]\.?m\.?(?![a-z]))?)?"  # 17-21
_BASIC = r"^(\d{4})(\d{2})(\d{2})[Tt ](\d{2})(\d{2})(\d{2})"
_ZONE = (
    r"\s*(z|utc|gmt|est|edt|et|(?:(?:utc|gmt)?\s?[+-]\d{1,2}(?::?\d{2})?)|\[?[a-z]+(?:/[a-z0-9_+\-]+)+\]?)?"  # 22
    r"(?:\[[a-z]+(?:/[a-z0-9_+\-]+)*\])?"
)
_PATTERN = rf"(?i)^{_WEEKDAY}{_DATE}{_CLOCK}{_ZONE}$"
_GROUPS = 22
_CLEAN = r"^[\s ]+|[\s ]+$"

#: Abbreviations with one offset all year, and those that name New York.
FIXED_OFFSETS = {"z": "UTC", "utc": "UTC", "gmt": "UTC", "est": "-05:00", "edt": "-04:00"}
NEW_YORK = ("et", "us/eastern", "america/new_york")


@cache
def _regions() -> tuple[str, ...]:
    """Region names of the time-zone database."""
    return tuple(sorted(n for n in zoneinfo.available_timezones() | {"US/Eastern"} if "/" in n))


def trimmed(raw: Column) -> Column:
    """Without surrounding blanks; NULL where nothing is left."""
    text = F.regexp_replace(raw, _CLEAN, "")
    return F.when(text != "", text)


class _Parts:
    """The parts of a text already split by the pattern into ``arr``."""

    def __init__(self, arr: Column):
        self.arr = arr

    def text(self, n: int) -> Column:
        got = F.get(self.arr, F.lit(n))
        return F.when(got != "", got)

    def number(self, *groups: int) -> Column:
        return F.coalesce(*[self.text(g) for g in groups]).cast("int")

    def month(self, *groups: int) -> Column:
        name = F.substring(F.lower(F.coalesce(*[self.text(g) for g in groups])), 1, 3)
        return F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), name).cast("int")


def split_text(text: Column) -> Column:
    """array<string> of the pattern's groups behind a leading mark; one element
    where the text has no known notation."""
    marks = _MARK.join(f"${i}" for i in range(1, _GROUPS + 1))
    plain = F.regexp_replace(F.regexp_replace(text, _MARK, " "), _BASIC, "$1-$2-$3T$4:$5:$6")
    return F.split(F.regexp_replace(plain, _PATTERN, _MARK + marks + _MARK), _MARK)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def zone_id(zone: Column) -> Column:
    """Zone id for Spark of a named zone or offset; NULL where there is none such."""

    def offset_id(offset: Column) -> Column:
        digits = F.regexp_replace(F.substring(offset, 2, 9), ":", "")
        padded = F.when(F.length(digits) <= 2, F.concat(F.lpad(digits, 2, "0"), F.lit("00"))).otherwise(F.lpad(digits, 4, "0"))
        return _let(padded, lambda d: F.when(
            (F.substring(d, 3, 2) <= "59") & ((F.substring(d, 1, 2) < "18") | (d == "1800")),
            F.concat(F.substring(offset, 1, 1), F.substring(d, 1, 2), F.lit(":"), F.substring(d, 3, 2)),
        ))

    def named(plain: Column) -> Column:
        z = F.lower(plain)
        out = F.when(z == "z", F.lit(FIXED_OFFSETS["z"]))
        for name, value in FIXED_OFFSETS.items():
            out = out.when(z == name, F.lit(value))
        offset = F.regexp_replace(z, r"^(utc|gmt)(?=[+-])", "")
        out = out.when(z.isin(*NEW_YORK), F.lit("America/New_York"))
        out = out.when(offset.rlike(r"^[+-]\d{1,2}(:?\d{2})?$"), _let(offset, offset_id))
        return out.when(plain.isin(*_regions()), plain)

    return _let(F.regexp_replace(zone, r"[\[\]\s]", ""), named)


def _zone_of(zone: Column, default: Column) -> Column:
    """Zone id of what the text names; the default where it names none."""
    return F.when(zone.isNull(), default).otherwise(zone_id(zone))


def _clock(p: _Parts) -> tuple[Column, Column, Column, Column]:
    """Hour on a 24-hour clock, minute, second with fraction, and validity."""
    hour, minute, second = p.number(17), p.number(18), F.coalesce(p.number(19), F.lit(0))
    half = F.lower(F.substring(p.text(21), 1, 1))
    hour24 = F.when(half.isNull(), hour).when(half == "p", hour % 12 + 12).otherwise(hour % 12)
    micros = F.rpad(F.substring(F.coalesce(p.text(20), F.lit("0")), 1, 6), 6, "0")
    seconds = F.concat(second.cast("string"), F.lit("."), micros).cast("decimal(8,6)")
    good = (hour24 <= 23) & (minute <= 59) & (second <= 59) & (half.isNull() | hour.between(1, 12))
    return hour24, minute, seconds, good


def _ymd(p: _Parts) -> Column:
    """struct y, m, d of the numbers written; two-digit years are 20xx."""
    year = F.coalesce(*[p.text(g) for g in (1, 7, 10, 13, 14)])
    full = year.cast("int") + F.when(F.length(year) == 2, 2000).otherwise(0)
    month, day = F.coalesce(p.number(3, 5, 15), p.month(8, 12)), p.number(4, 6, 9, 11, 16)
    return F.struct(full.alias("y"), month.alias("m"), day.alias("d"))


def _instant(p: _Parts, default: Column) -> Column:
    def at(ymd: Column) -> Column:
        hour, minute, seconds, good = _clock(p)
        ts = F.try_make_timestamp(ymd["y"], ymd["m"], ymd["d"], hour, minute, seconds, _zone_of(p.text(22), default))
        return F.when(good & (ymd["y"] >= 1), ts)

    return _let(_ymd(p), at)


def instant_of(text: Column, zone: Column | None = None) -> Column:
    """The instant a trimmed text denotes; NULL where it denotes none.

    Text without a zone is read in ``zone``, a zone id, UTC where none is given. A bare number of 10 or 13 digits counts seconds
    or milliseconds since 1970, one of 14 digits is a clock time. A local time
    that occurs twice is the first; one that is skipped takes the offset before
    the change.
    """
    zone = F.lit("UTC") if zone is None else zone
    at14 = [F.substring(text, a, k).try_cast("int") for a, k in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2))]
    clock14 = F.when(
        (at14[3] <= 23) & (at14[4] <= 59) & (at14[5] <= 59),
        F.try_make_timestamp(*at14[:5], at14[5].cast("decimal(8,6)"), zone),
    )
    return (
        F.when(text.rlike(r"^\d{10}$"), F.timestamp_seconds(text.try_cast("bigint")))
        .when(text.rlike(r"^\d{13}$"), F.timestamp_millis(text.try_cast("bigint")))
        .when(text.rlike(r"^\d{14}$"), clock14)
        .otherwise(_let(split_text(text), lambda parts: F.when(F.get(parts, F.lit(17)) != "", _instant(_Parts(parts), zone))))
    )


def day_of(text: Column, zone: Column | None = None) -> Column:
    """The calendar day a trimmed text denotes; NULL where it denotes none.

    Text that names a zone or offset is the day in ``zone`` (a zone id, New York
    where none is given) at that instant, midnight where it has no time of day;
    other text is the day written.
    """
    home = F.lit("America/New_York") if zone is None else zone

    def in_parts(parts: Column) -> Column:
        p = _Parts(parts)
        zero, nought = F.lit(0), F.lit(0).cast("decimal(8,6)")
        has_clock = p.text(17).isNotNull()

        def from_ymd(ymd: Column) -> Column:
            year, month, day = ymd["y"], ymd["m"], ymd["d"]
            hour, minute, seconds, good = _clock(p)
            at = F.try_make_timestamp(
                year, month, day, F.when(has_clock, hour).otherwise(zero), F.when(has_clock, minute).otherwise(zero),
                F.when(has_clock, seconds).otherwise(nought), _zone_of(p.text(22), F.lit("UTC")),
            )
            written = F.to_date(F.try_make_timestamp(year, month, day, zero, zero, nought, F.lit("UTC")))
            zoned = F.to_date(F.from_utc_timestamp(at, home))
            return F.when((year >= 1) & (~has_clock | good), F.when(p.text(22).isNotNull(), zoned).otherwise(written))

        return F.when(F.size(parts) > 1, _let(_ymd(p), from_ymd))

    at14 = [F.substring(text, a, k).try_cast("int") for a, k in ((1, 4), (5, 2), (7, 2))]
    clock14 = F.to_date(F.try_make_timestamp(*at14, F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"), F.lit("UTC")))
    return F.when(text.rlike(r"^\d{14}$"), clock14).otherwise(_let(split_text(text), in_parts))


def instant_text(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSSSSZ`` (session in UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parse_instant(raw: Column) -> Column:
    """Instant of a raw text, for use where no dictionary is kept."""
    return _let(trimmed(raw), lambda text: instant_of(text))


def parse_day(raw: Column) -> Column:
    """Day of a raw text, for use where no dictionary is kept."""
    return _let(trimmed(raw), lambda text: day_of(text))
