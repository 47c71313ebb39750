"""Date and time functions over texts of the form yyyy-MM-dd HH:mm:ss."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE = "yyyy-MM-dd HH:mm:ss"
DEFAULT_ZONE = "America/Chicago"

# The zone of each city.
CITY_ZONES = {"memphis": "America/Chicago", "nashville": "America/Chicago", "birmingham": "America/Chicago", "denver": "America/Denver", "tampa": "America/New_York"}

# The forms that dates of venue pages take.
VENUE_FORMS = (SHAPE, "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "d MMMM yyyy")


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _time(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(c, F.lit(SHAPE)))


def shown(t: Column) -> Column:
    return F.date_format(t, SHAPE)


def guess_timezone(city: Column) -> Column:
    zones = F.create_map(*[F.lit(x) for pair in CITY_ZONES.items() for x in pair])
    return F.coalesce(F.try_element_at(zones, F.coalesce(city, F.lit(""))), F.lit(DEFAULT_ZONE))


def known_zone(zone: Column) -> Column:
    """The zone where it is a known one, else the default."""
    names = sorted(z for z in zoneinfo.available_timezones() if z == "UTC" or z.split("/")[0] in ("Africa", "America", "Antarctica", "Asia", "Atlantic", "Australia", "Europe", "Indian", "Pacific", "Etc"))
    return F.when(zone.isin(names), zone).otherwise(F.lit(DEFAULT_ZONE))


def resolve_times(events: DataFrame, fallback: str = "") -> DataFrame:
    """events with start_utc, start_local, end_utc, end_local and timezone filled, each from the others.

    Without a start the start date counts, as local time; without an end the end date, else two hours after
    the start. Texts that are no time stay as they are; all columns other than all_day are expected."""
    utc = lambda c: F.coalesce(shown(F.to_utc_timestamp(_time(c), F.col("timezone"))), c)
    local = lambda c: F.coalesce(shown(F.from_utc_timestamp(_time(c), F.col("timezone"))), c)
    sl, su, el, eu = (F.col(c) for c in ("start_local", "start_utc", "end_local", "end_utc"))
    out = events.withColumns({c: _text(F.col(c)) for c in ("start_local", "start_utc", "end_local", "end_utc")} | {"timezone": known_zone(F.col("timezone"))})
    date = F.when(F.coalesce("start_date", F.lit("")) == "", F.lit(fallback)).otherwise(F.col("start_date"))
    out = out.withColumns({
        "start_local": F.when((sl == "") & (su == ""), F.trim(date)).otherwise(sl),
        "end_local": F.when((el == "") & (eu == ""), _text(F.col("end_date"))).otherwise(el),
    })
    out = out.withColumns({"start_utc": F.when((sl != "") & (su == ""), utc(sl)).otherwise(su), "start_local": F.when((su != "") & (sl == ""), local(su)).otherwise(sl)})
    later = F.coalesce(shown(_time(sl) + F.expr("interval 2 hours")), sl)
    out = out.withColumn("end_local", F.when((el == "") & (eu == ""), later).otherwise(el))
    return out.withColumns({"end_utc": F.when((el != "") & (eu == ""), utc(el)).otherwise(eu), "end_local": F.when((eu != "") & (el == ""), local(eu)).otherwise(el)})


def parse_offset_datetime(instant: Column, date: Column, time: Column, zone: Column) -> Column:
    """A struct (utc, local): of the instant with its offset, else of local date and time in zone; empty texts for neither."""
    known = F.when(instant.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), instant.try_cast("timestamp"))
    there = _time(F.concat_ws(" ", date, F.substring(F.coalesce(time, F.lit("00:00:00")), 1, 8)))
    utc = F.coalesce(known, F.to_utc_timestamp(there, zone))
    local = F.when(known.isNotNull(), F.from_utc_timestamp(known, zone)).otherwise(there)
    return F.struct(F.coalesce(shown(utc), F.lit("")).alias("utc"), F.coalesce(shown(local), F.lit("")).alias("local"))


def normalize_datetime(raw: Column) -> Column:
    """Seconds since 1970, ISO texts (the offset is dropped) and bare dates in one form; others give an empty text."""
    t = F.replace(_text(raw), F.lit("Z"), F.lit("+00:00"))
    part = lambda pattern, n: F.regexp_extract(t, pattern, n)
    iso, day = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2})?", r"(\d{4}-\d{2}-\d{2})"
    return (
        F.when(t.rlike(r"^\d{9,11}(\.\d+)?$"), shown(F.timestamp_seconds(t.try_cast("double").cast("long"))))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"), t)
        .when(t.rlike(iso), F.concat(part(iso, 1), F.lit(" "), part(iso, 2), F.when(part(iso, 3) == "", F.lit(":00")).otherwise(part(iso, 3))))
        .when(t.rlike(day), F.concat(part(day, 1), F.lit(" 00:00:00")))
        .otherwise(F.lit(""))
    )


def infer_year(month: Column, as_of: str) -> Column:
    """The year of a month named without one: the next, if the month has passed by as_of."""
    return F.lit(int(as_of[:4])) + (month < int(as_of[5:7])).cast("int")


def venue_date(raw: Column) -> Column:
    """The date in one of the known forms, else an ISO date within the text, else null."""
    t = _text(raw)
    tries = [F.try_to_timestamp(t, F.lit(form)).cast("date") for form in VENUE_FORMS]
    return F.coalesce(*tries, F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date"))


def dates_close(a: Column, b: Column, days: int = 2) -> Column:
    """Whether two dates lie within so many days; false if one is missing."""
    return F.coalesce(F.abs(F.datediff(a.try_cast("date"), b.try_cast("date"))) <= days, F.lit(False))
