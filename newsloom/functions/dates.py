"""Date and time columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The day part of a front-page address, and the accepted article time
# (year-month-dayThour:minute, nothing after the minutes), and the time as stored text.
DAY_PATH = "yyyy/MM/dd"
ARTICLE_TIME = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}$"

STORED_TIME = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"


def day(moment: Column) -> Column:
    return F.to_date(moment)


def week(moment: Column) -> Column:
    """The Monday of the week."""
    return F.to_date(F.date_trunc("week", moment))


def day_path(date: Column) -> Column:
    return F.date_format(date, DAY_PATH)


def stored_time(text: Column) -> Column:
    """Times as tables of text keep them (year-month-day hour:minute:second); null when the form or the date is wrong."""
    return F.when(text.rlike(STORED_TIME), text).try_cast("timestamp_ntz")


def article_time(text: Column) -> Column:
    """Strict parse to a timestamp without zone; null when the form or the date is wrong."""
    return F.when(text.rlike(ARTICLE_TIME), text).try_cast("timestamp_ntz")
