"""Dates and times: parsing the shops' formats, calendar attributes, bands."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def buddhist_datetime(c: Column) -> Column:
    """dd/mm/yyyy hh:mm of the Buddhist era as a local timestamp."""
    pattern = r"^([0-9]{2})/([0-9]{2})/([0-9]{4}) ([0-9]{2}):([0-9]{2})$"
    day, month, year, hour, minute = (F.regexp_extract(c, pattern, k).try_cast("int") for k in range(1, 6))
    return F.when(c.rlike(pattern), F.try_make_timestamp(year - 543, month, day, hour, minute, F.lit(0).cast("decimal(16,6)")))


def date_and_time(date: Column, time: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", F.substring(date.cast("string"), 1, 10), time), F.lit("yyyy-MM-dd HH:mm"))


def utc_timestamp(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))


def date_key(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("int")


def month_of_key(key: Column) -> Column:
    return F.floor(key / 100).cast("int") % 100


def week_of_month(c: Column) -> Column:
    return F.floor((F.dayofmonth(c) - 1) / 7).cast("int") + 1


def band(c: Column, bands: Iterable[tuple[str, int, int]], left_open: bool = False) -> Column:
    """The name of the band that holds c, else null; bands are closed, or open on the left."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(list(bands)):
        out = F.when(((c > low) if left_open else (c >= low)) & (c <= high), name).otherwise(out)
    return out


def day_type(holiday: Column, weekend: Column) -> Column:
    return F.when(holiday, "holiday").when(weekend, "weekend").otherwise("weekday")


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
