"""Strict cascade of anchored timestamp formats, and the resolution of local times to UTC.

``match_timestamp`` runs in Python workers (one anchored pattern per family, chosen by the first
character); ``with_utc`` is pure Catalyst: zones come from a lookup column, a repeated local time
(clocks set back) and a skipped one (clocks set forward) are told apart by converting back.
"""

from __future__ import annotations

import re
from datetime import date
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a matched timestamp is anchored: to UTC, to the source's zone, or to the zone and an unstated year.
ABSOLUTE, LOCAL, NO_YEAR = 1, 2, 3

# Month names (English, German, Spanish, French, Italian, Portuguese) by their first letters.
MONTHS = {
    "jan": 1, "january": 1, "januar": 1, "jän": 1, "ene": 1, "enero": 1, "janv": 1, "gen": 1,
    "feb": 2, "february": 2, "februar": 2, "febrero": 2, "fev": 2, "fév": 2, "févr": 2,
    "mar": 3, "march": 3, "mär": 3, "märz": 3, "mrz": 3, "marzo": 3, "mars": 3,
    "apr": 4, "april": 4, "abr": 4, "abril": 4, "avr": 4,
    "may": 5, "mai": 5, "mayo": 5, "mag": 5, "maio": 5,
    "jun": 6, "june": 6, "juni": 6, "junio": 6, "juin": 6, "giu": 6,
    "jul": 7, "july": 7, "juli": 7, "julio": 7, "juil": 7, "lug": 7,
    "aug": 8, "august": 8, "ago": 8, "agosto": 8, "août": 8,
    "sep": 9, "sept": 9, "september": 9, "septiembre": 9, "set": 9,
    "oct": 10, "october": 10, "okt": 10, "oktober": 10, "octubre": 10, "ott": 10, "out": 10,
    "nov": 11, "november": 11, "noviembre": 11,
    "dec": 12, "december": 12, "dez": 12, "dezember": 12, "dic": 12, "diciembre": 12, "déc": 12,
}

# Zone abbreviations and their offsets in minutes.
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "PKT": 300, "ICT": 420, "WIB": 420, "SGT": 480, "HKT": 480, "AWST": 480,
    "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "SAST": 120,
    "BRT": -180, "ART": -180, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_ABBR = "|".join(sorted(ZONES, key=len, reverse=True))
_OFF = rf"(?:\s?(?P<off>(?:{_ABBR})(?![A-Za-z0-9])|[+-]\d\d:?\d\d(?!\d)))?"
_HMS = r"(?P<H>\d\d):(?P<M>\d\d)(?::(?P<S>\d\d)(?:[.,](?P<f>\d{1,9}))?)?(?![\d:])"
_MON = r"(?P<b>[^\W\d_]{3,10})\.?"
_NUMERIC = re.compile(
    rf"(?P<y>\d{{4}})(?P<sep>[-/])(?P<m>\d\d)(?P=sep)(?P<d>\d\d)[T ]{_HMS}{_OFF}"
    rf"|(?P<cy>\d{{4}})(?P<cm>\d\d)(?P<cd>\d\d)[T-](?P<cH>\d\d)(?P<cM>\d\d)(?P<cS>\d\d)(?:[.,](?P<cf>\d{{1,9}}))?(?P<cz>Z)?(?!\w)"
    r"|(?P<e>\d{19}|\d{16}|\d{13}|\d{10}(?:\.\d{1,9})?)(?![\w.:-])"
)
_DAY_FIRST = re.compile(
    rf"(?P<d>\d\d)(?P<sep>[./-])(?P<m>\d\d)(?P=sep)(?P<y>\d{{4}}) {_HMS}(?: ?(?P<p>[AaPp][Mm])\b)?{_OFF}"
    rf"|(?P<d2>\d{{1,2}})(?P<s2>[-/ ]){_MON}(?P=s2)(?P<y2>\d{{4}})[: ](?P<H2>\d\d):(?P<M2>\d\d)(?::(?P<S2>\d\d)(?:[.,](?P<f2>\d{{1,9}}))?)?(?![\d:])"
    rf"(?:\s?(?P<off2>(?:{_ABBR})(?![A-Za-z0-9])|[+-]\d\d:?\d\d(?!\d)))?"
)
_NAMED = re.compile(
    rf"(?:[^\W\d_]{{2,10}}\.?, )(?P<d>\d{{1,2}}) {_MON} (?P<y>\d{{4}}) {_HMS}{_OFF}"
    rf"|(?P<b3>[^\W\d_]{{3,4}})\.? {{1,2}}(?P<d3>\d{{1,2}}) (?P<H3>\d\d):(?P<M3>\d\d):(?P<S3>\d\d)(?:[.,](?P<f3>\d{{1,9}}))?(?![\d:])"
)


@lru_cache(1 << 16)
def _midnight(y: int, m: int, d: int) -> int | None:
    try:
        return (date(y, m, d).toordinal() - 719163) * 86_400_000_000
    except ValueError:
        return None


def _clock(h: str, mi: str, s: str | None, f: str | None) -> int | None:
    hh, mm, ss = int(h), int(mi), int(s) if s else 0
    if hh > 23 or mm > 59 or ss > 59:
        return None
    return ((hh * 60 + mm) * 60 + ss) * 1_000_000 + (int(f[:6].ljust(6, "0")) if f else 0)


def _made(y: int, m: int | None, d: int, clock: int | None, off: str | None) -> tuple[int, int | None]:
    day = _midnight(y, m, d) if m else None
    if day is None or clock is None:
        return LOCAL, None
    if off is None:
        return LOCAL, day + clock
    minutes = ZONES.get(off)
    if minutes is None:
        digits = off[1:].replace(":", "")
        if int(digits[2:]) > 59 or int(digits[:2]) > 18:
            return ABSOLUTE, None
        minutes = (int(digits[:2]) * 60 + int(digits[2:])) * (-1 if off[0] == "-" else 1)
    return ABSOLUTE, day + clock - minutes * 60_000_000


def match_timestamp(text: str, at: int = 0) -> tuple[int, int, int | None] | None:
    """The timestamp that starts at ``at``: (end, kind, microseconds), or None if none starts there.

    Microseconds count from 1970 in UTC (ABSOLUTE), in the source's zone (LOCAL), or within the leap year 2000
    (NO_YEAR); None where the shape is a timestamp's but the date or clock is impossible. Digits finer than a
    microsecond are cut off, missing ones are zero.
    """
    c = text[at : at + 1]
    if c.isdigit():
        if m := _NUMERIC.match(text, at):
            if m["y"]:
                return m.end(), *_made(int(m["y"]), int(m["m"]), int(m["d"]), _clock(m["H"], m["M"], m["S"], m["f"]), m["off"])
            if m["cy"]:
                return m.end(), *_made(int(m["cy"]), int(m["cm"]), int(m["cd"]), _clock(m["cH"], m["cM"], m["cS"], m["cf"]), m["cz"])
            whole, _, part = m["e"].partition(".")
            n = len(whole)
            us = int(whole) * 10 ** (16 - n) if n <= 16 else int(whole) // 1000
            return m.end(), ABSOLUTE, us + (int(part[:6].ljust(6, "0")) if part else 0)
        if m := _DAY_FIRST.match(text, at):
            if m["d"]:
                d, mo, clock = int(m["d"]), int(m["m"]), _clock(m["H"], m["M"], m["S"], m["f"])
                if m["p"]:
                    d, mo = mo, d
                    h = int(m["H"])
                    clock = None if clock is None or not 1 <= h <= 12 else clock + ((h % 12 + (12 if m["p"][0] in "pP" else 0)) - h) * 3_600_000_000
                return m.end(), *_made(int(m["y"]), mo, d, clock, m["off"])
            if mo := MONTHS.get(m["b"].lower()):
                return m.end(), *_made(int(m["y2"]), mo, int(m["d2"]), _clock(m["H2"], m["M2"], m["S2"], m["f2"]), m["off2"])
        return None
    if c.isalpha() and (m := _NAMED.match(text, at)):
        if m["d"]:
            if mo := MONTHS.get(m["b"].lower()):
                return m.end(), *_made(int(m["y"]), mo, int(m["d"]), _clock(m["H"], m["M"], m["S"], m["f"]), m["off"])
        elif mo := MONTHS.get(m["b3"].lower()):
            _, us = _made(2000, mo, int(m["d3"]), _clock(m["H3"], m["M3"], m["S3"], m["f3"]), None)
            return m.end(), NO_YEAR, us
    return None


def with_year(us: Column, first_day: Column) -> Column:
    """Microseconds within the year 2000 moved to the first such date that isn't before ``first_day`` (a date); null without one."""
    day = F.timestamp_micros(us)
    m, d, y = F.month(day), F.dayofmonth(day), F.year(first_day)
    key = m * 100 + d
    start = y + F.when(key < F.month(first_day) * 100 + F.dayofmonth(first_day), 1).otherwise(0)
    # 29 February: up to the next leap year.
    leap = lambda x: ((x % 4 == 0) & (x % 100 != 0)) | (x % 400 == 0)
    first_leap = F.coalesce(*[F.when(leap(start + i), start + i) for i in range(9)])
    year = F.when(key == 229, first_leap).otherwise(start)
    return F.unix_date(F.make_date(year, m, d)).cast("long") * 86_400_000_000 + F.pmod(us, F.lit(86_400_000_000))


def with_local(df: DataFrame, kind: str, us: str, zone: str, first_day: str) -> DataFrame:
    """Adds ``local_us``, the stated time with its year, and ``utc``: the zone it is stated in, a null or unknown one being UTC."""
    from zoneinfo import available_timezones

    known = F.col(zone).isin(sorted(available_timezones())) & (F.col(kind) != ABSOLUTE)
    year = with_year(F.col(us), F.to_date(F.try_to_timestamp(F.col(first_day), F.lit("yyyy-MM-dd"))))
    return df.withColumns({"local_us": F.when(F.col(kind) == NO_YEAR, year).otherwise(F.col(us)), "utc_zone": F.when(known, F.col(zone)).otherwise("UTC")})


def with_utc(df: DataFrame) -> DataFrame:
    """From ``local_us`` and ``utc_zone``: ``early_us``, the instant in UTC, and ``late_us``, the later one if the local time occurs twice (else null).

    A local time that the clocks skipped is moved on by the gap, as clocks do. Clocks go back by an hour nearly everywhere,
    by half an hour in a few places. Best on stored columns: each is used several times.
    """
    first = F.to_utc_timestamp(F.timestamp_micros("local_us"), F.col("utc_zone"))
    back = lambda h: F.unix_micros(F.from_utc_timestamp(first + F.expr(h), F.col("utc_zone"))) == F.col("local_us")
    hours = ("INTERVAL 60 MINUTES", "INTERVAL 30 MINUTES")
    late = F.when(F.col("utc_zone") != "UTC", F.coalesce(*[F.when(back(h), F.unix_micros(first + F.expr(h))) for h in hours]))
    return df.withColumns({"early_us": F.when(F.col("utc_zone") == "UTC", F.col("local_us")).otherwise(F.unix_micros(first)), "late_us": late})


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column; one without a zone is read as UTC, whatever the session's zone."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(c)
    clock = (F.hour(c) * 60 + F.minute(c)).cast("long") * 60_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + clock
