"""Day arithmetic, with "now" always passed in."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartlens import constants as C


def day(as_of: dt.date) -> Column:
    return F.lit(as_of).cast("date")


def calendar_days(as_of: dt.date, since: str) -> Column:
    """Number of midnights between ``since`` and ``as_of``."""
    return F.datediff(day(as_of), F.to_date(since))


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour days between two times, whatever clock changes the session zone has."""
    return F.extract(F.lit("DAY"), end - start).cast("long")


def whole_cycle(predicted_days: Column) -> Column:
    """Predicted days, at least 1, cut to whole days."""
    return F.greatest(predicted_days, F.lit(1.0)).cast("int")


def next_due(last_purchase: Column, cycle: Column, as_of: dt.date) -> Column:
    """First cycle end not before ``as_of``; an overdue date rolls on by whole cycles."""
    today = day(as_of)
    due = F.date_add(F.to_date(last_purchase), cycle)
    elapsed = elapsed_days(last_purchase, today.cast("timestamp_ntz")).cast("int")
    return F.when(due >= today, due).otherwise(F.date_add(today, cycle - elapsed % cycle))


def due_within(due: str, as_of: dt.date, days_ahead: int) -> Column:
    """Due from ``as_of`` to ``days_ahead`` days later, both ends included."""
    return F.col(due).between(day(as_of), F.date_add(day(as_of), days_ahead))


def reminder_text(name: str, due: str) -> Column:
    return F.format_string(
        C.REMINDER_MESSAGE, F.col(name), F.date_format(F.col(due), "yyyy-MM-dd")
    )
