"""Timestamps in mixed notations and zones, brought to one instant in UTC (problem 5).

The text is taken apart by JVM expressions only. What carries an offset or a known abbreviation is shifted by it. What
carries neither is a local time of its relay's zone: it meets the zone-offset intervals of that zone in an as-of join
(equal zone and year, local time within the interval). Two matching intervals mean an ambiguous time and the earlier
instant is taken; none means that the time does not exist there; one gives the offset directly.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalwork.operators.joins import small_side_join

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
SECOND = 1_000_000
DAY = 86_400 * SECOND

_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([ap])\.?m\.?)?"
_ZONE = r"(?: ?(.*))?"
#: Shape -> pattern, and the numbers of the groups of year, month, day, hour, minute, second, fraction, half of day, zone.
SHAPES = {
    "iso": (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:t| ){_CLOCK}{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    "basic": (r"^(\d{4})(\d{2})(\d{2})t(\d{2}):?(\d{2}):?(\d{2})?(?:[.,](\d{1,9}))?( [ap]m)?(?: ?(.*))?$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    "day_month": (rf"^(\d{{1,2}})[ -]{_MONTH},?[ -](\d{{4}}|\d{{2}}),? {_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    "month_day": (rf"^{_MONTH} (\d{{1,2}}),? (\d{{4}}|\d{{2}}),? {_CLOCK}{_ZONE}$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    "ctime": (rf"^{_MONTH} (\d{{1,2}}) {_CLOCK}(?: (.*?))? (\d{{4}})$", (9, 1, 2, 3, 4, 5, 6, 7, 8)),
    "slashed": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}),? {_CLOCK}{_ZONE}$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    "dotted": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}),? {_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
}
_OFFSET = r"^(?:gmt|utc|ut)? ?([+-])(\d{1,2}):?(\d{2})?(?: ?\(.*\))?$"
_ABBREVIATION = r"^\(?([a-z]{1,6})\)?$"


def zone_intervals(zones: DataFrame, first_year: int = 1970, last_year: int = 2099) -> DataFrame:
    """Rows (tz, year, from_us, to_us, offset_us): local times in [from_us, to_us) of that year have that offset.

    `zones` has the column tz. An interval is repeated for every local year it touches, which makes the as-of join an
    equality join with a residual range. Zones that the zone database does not know, and nulls, give no rows.
    """
    epoch = dt.datetime(1970, 1, 1)

    def changes(zone: ZoneInfo) -> list[tuple[int, int]]:
        offset = lambda s: int(dt.datetime.fromtimestamp(s, zone).utcoffset().total_seconds())
        at, end = int((dt.datetime(first_year, 1, 1) - epoch).total_seconds()) - 86_400, int((dt.datetime(last_year + 1, 1, 1) - epoch).total_seconds()) + 86_400
        found, step = [(at, offset(at))], 7 * 86_400
        while at < end:
            if offset(at + step) != found[-1][1]:
                low, high = at, at + step
                while high - low > 1:
                    middle = (low + high) // 2
                    low, high = (middle, high) if offset(middle) == found[-1][1] else (low, middle)
                found.append((high, offset(high)))
                at = high
            else:
                at += step
        return [*found, (end, 0)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tz in batch["tz"]:
                try:
                    points = changes(ZoneInfo(tz))
                except (KeyError, ValueError, TypeError, OSError):
                    continue
                for (start, offset), (end, _) in zip(points, points[1:]):
                    low, high = start + offset, end + offset
                    for year in range((epoch + dt.timedelta(seconds=low)).year, (epoch + dt.timedelta(seconds=high - 1)).year + 1):
                        out.append((tz, year, low * SECOND, high * SECOND, offset * SECOND))
            yield pd.DataFrame(out, columns=["tz", "year", "from_us", "to_us", "offset_us"])

    return zones.select("tz").distinct().mapInPandas(run, "tz string, year int, from_us bigint, to_us bigint, offset_us bigint")


PARTS = ("shape", "y", "mo", "d", "h", "mi", "s", "frac", "half", "zone")


def _parts(text: Column) -> Column:
    """Array of the parts of a date text (PARTS), null where no shape matches; each shape is taken apart by one replacement."""
    canon = [F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "\x01".join([shape, *(f"${g}" for g in groups)]))) for shape, (pattern, groups) in SHAPES.items()]
    return F.split(F.coalesce(*canon), "\x01", len(PARTS))


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with more columns that are computed once: a one-row generator, which neither filters nor projections are moved through."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _local_micros(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, us: Column) -> Column:
    """Micros since 1970 of a wall clock, or null if there is no such date or time."""
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", y, mo, d), "yyyy-MM-dd")
    ok = mo.between(1, 12) & d.between(1, 31) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 59)
    return F.when(ok, F.unix_date(date).cast("long") * DAY + (h.cast("long") * 3600 + mi.cast("long") * 60 + s.cast("long")) * SECOND + us)


def instants(rows: DataFrame, relays: DataFrame, abbreviations: DataFrame, key: str = "email_index", text: str = "date", relay: str = "relay", epoch_years: tuple[int, int] = (2007, 2008)) -> DataFrame:
    """(key, utc_micros) for each row whose text names an instant.

    Rows: any columns beside the three named ones are ignored. relays: relay, tz, date_order; abbreviations: abbrev,
    offset_minutes; both may repeat rows (one per relay or abbreviation is kept). Nulls, blanks, junk, dates without a
    time of day, impossible dates and times, local times that their zone skips, unknown abbreviations, and local times
    without a known relay give no row. Empty tables give an empty result. A repeated input row repeats its result.
    """
    zones = relays.select(F.col("relay").alias("_relay"), "tz", F.lower(F.trim("date_order")).alias("_order")).where("_relay is not null").groupBy("_relay").agg(F.min("tz").alias("_tz"), F.min("_order").alias("_order"))
    names = abbreviations.select(F.lower(F.trim("abbrev")).alias("_abbrev"), (F.col("offset_minutes").cast("long") * 60 * SECOND).alias("_abbrev_us")).where("_abbrev is not null and _abbrev_us is not null").groupBy("_abbrev").agg(F.min("_abbrev_us").alias("_abbrev_us"))

    clean = F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " "))
    clean = F.regexp_replace(clean, r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? ", "")
    base = rows.select(F.col(key).alias("_key"), clean.alias("_t"), F.col(relay).alias("_relay")).where("_t is not null and _t rlike '[0-9]'")

    # bare numbers: the unit is the one that puts them between the given years
    low, high = (int(dt.datetime(y, 1, 1, tzinfo=dt.timezone.utc).timestamp()) for y in (epoch_years[0], epoch_years[1] + 1))
    whole, frac = F.regexp_extract("_t", r"^(\d{9,19})(?:\.\d+)?$", 1).try_cast("decimal(20,0)"), F.regexp_extract("_t", r"^\d+\.(\d+)$", 1)
    number = F.col("_t").rlike(r"^\d{9,19}(\.\d+)?$")
    units = []
    for power in (0, 3, 6, 9):  # seconds, milli-, micro-, nanoseconds
        inside = (whole >= F.lit(low * 10**power).cast("decimal(20,0)")) & (whole < F.lit(high * 10**power).cast("decimal(20,0)"))
        full = (F.concat(whole.cast("string"), F.rpad(frac, 9, "0"))).cast("decimal(38,0)")  # nine digits more than the unit
        units.append(F.when(inside, F.floor(full * F.lit(10**6).cast("decimal(7,0)") / F.lit(10 ** (power + 9)).cast("decimal(19,0)")).cast("long")))
    base = _once(base, {"_unix": F.when(number, F.coalesce(*units)), "_p": F.when(~number, _parts(F.col("_t")))}).drop("_t")

    p = lambda n: F.col("_p")[PARTS.index(n)]
    dated = small_side_join(base.where("_p is not null or _unix is not null"), zones, ["_relay"], "left")
    month = F.when(p("mo").rlike("^[a-z]"), F.array_position(F.array(*map(F.lit, MONTHS)), p("mo"))).otherwise(p("mo").try_cast("int")).cast("int")
    month_first = F.col("_order") == "mdy"
    swap = (p("shape") == "slashed") & ~month_first
    known_order = (p("shape") != "slashed") | F.col("_order").isin("mdy", "dmy")
    hour = p("h").try_cast("int")
    hour = F.when(p("half") == "", hour).when(hour.between(1, 12), hour % 12 + F.when(p("half").contains("p"), 12).otherwise(0))
    year = p("y").try_cast("int") + F.when(F.length(p("y")) == 2, 2000).otherwise(0)
    day = p("d").try_cast("int")
    zero = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    us = F.substring(F.rpad(p("frac"), 9, "0"), 1, 6).cast("long")
    zone = F.trim(p("zone"))
    sign, hours, minutes = (F.regexp_extract("_zone", _OFFSET, i) for i in (1, 2, 3))
    offset = F.when(F.col("_zone").rlike(_OFFSET), F.struct(sign.alias("sign"), hours.cast("int").alias("h"), zero(minutes).alias("m")))
    timed = _once(dated, {"_zone": zone, "_us": us, "_y": year, "_m": month, "_d": day, "_h": hour, "_mi": p("mi").try_cast("int"), "_s": zero(p("s")), "_swap": swap, "_ok": known_order})
    timed = _once(timed, {
        "_off": offset, "_abbrev": F.regexp_extract("_zone", _ABBREVIATION, 1),
        "_local": F.when(F.col("_ok"), _local_micros(F.col("_y"), F.when(F.col("_swap"), F.col("_d")).otherwise(F.col("_m")), F.when(F.col("_swap"), F.col("_m")).otherwise(F.col("_d")), *map(F.col, ("_h", "_mi", "_s", "_us")))),
    })
    timed = timed.where("_local is not null or _unix is not null").select(
        "_key", "_unix", "_local", "_abbrev",
        F.when(F.col("_zone") == "", F.col("_tz")).alias("_tz"),
        F.year(F.date_from_unix_date(F.floor(F.col("_local") / DAY).cast("int"))).alias("_year"),
        F.when((F.col("_off.h") <= 18) & (F.col("_off.m") < 60), (F.col("_off.h") * 3600 + F.col("_off.m") * 60).cast("long") * SECOND * F.when(F.col("_off.sign") == "-", -1).otherwise(1)).alias("_off_us"),
    )
    intervals = zone_intervals(zones.select(F.col("_tz").alias("tz"))).withColumnsRenamed({"tz": "_tz", "year": "_year"})
    intervals = intervals.groupBy("_tz", "_year").agg(F.collect_list(F.struct("from_us", "to_us", "offset_us")).alias("_spans"))  # a few per zone and year
    met = small_side_join(small_side_join(timed, names, ["_abbrev"], "left"), intervals, ["_tz", "_year"], "left")
    fits = F.filter("_spans", lambda x: (x.from_us <= F.col("_local")) & (F.col("_local") < x.to_us))
    relayed = F.array_max(F.transform(fits, lambda x: x.offset_us))  # the larger offset is the earlier instant
    utc = F.coalesce(F.col("_unix"), F.col("_local") - F.coalesce("_off_us", "_abbrev_us", relayed))
    return met.select(F.col("_key").alias(key), utc.alias("utc_micros")).where("utc_micros is not null")
