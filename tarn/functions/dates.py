"""Times as texts. Text orders them and stays as written; what people read is local time of the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(ts: Column) -> Column:
    """The instant, null for what isn't one."""
    return F.try_to_timestamp(ts)


def unix(ts: Column) -> Column:
    """Whole seconds since 1970, null for what isn't a time."""
    return F.floor(parsed(ts).cast("double"))


def local_date(ts: Column) -> Column:
    """The local calendar day; the first ten characters of what isn't a time."""
    return F.coalesce(F.date_format(parsed(ts), "yyyy-MM-dd"), F.substring(ts, 1, 10))


def local_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(parsed(ts), "yyyy-MM-dd HH:mm xxx"), ts)


def short(ts: Column) -> Column:
    return F.coalesce(F.date_format(parsed(ts), "yyyy-MM-dd HH:mm"), F.replace(F.substring(ts, 1, 16), F.lit("T"), F.lit(" ")))


def span(start: Column, end: Column) -> Column:
    """``2026-04-03..04-08``: the end's year goes where it repeats the start's."""
    cut = F.when(F.substring(start, 1, 4) == F.substring(end, 1, 4), F.substring(end, F.lit(6), F.length(end))).otherwise(end)
    return F.when((start == "") | (end == "") | (start == end), start).otherwise(F.concat(start, F.lit(".."), cut))


def seconds_since(then: Column, now: Column) -> Column:
    """Never below 0."""
    return F.greatest(F.lit(0).cast("long"), F.floor(now.cast("double")) - F.floor(then.cast("double")))
