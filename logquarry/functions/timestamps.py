"""Wall-clock timestamps without a zone, read from the formats the logs use."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timestamp shapes.
ISO_ANYWHERE = r"\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2}"
SYSLOG_ANYWHERE = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2} \d{2}:\d{2}:\d{2}"
PARAMETER_FORMATS = ("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M")


def iso_ntz(text: Column) -> Column:
    """`YYYY-MM-DD hh:mm:ss` with `/` or `T` allowed; null when the date does not exist."""
    return F.translate(text, "/T", "- ").try_cast("timestamp_ntz")


def formatted_ntz(text: Column, layout: str) -> Column:
    return F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz")


def line_timestamp(text: Column, year: int | Column) -> Column:
    """First ISO-like stamp in a line, else a yearless syslog stamp placed in `year`."""
    year = F.lit(year) if isinstance(year, int) else year
    iso = F.regexp_extract(text, ISO_ANYWHERE, 0)
    sys = F.regexp_extract(text, SYSLOG_ANYWHERE, 0)
    yearless = F.concat_ws(" ", year.cast("string"), F.regexp_replace(sys, r"\s+", " "))
    return F.coalesce(
        F.when(iso != "", iso_ntz(iso)),
        F.when(sys != "", formatted_ntz(yearless, "yyyy MMM d HH:mm:ss")),
    )


def agent_timestamp(date: Column, clock: Column) -> Column:
    """Endpoint-agent stamp `MM/dd/yyyy` or `MM/dd/yy`; two-digit years from 69 on belong to the last century.

    The parts are put in ISO order and cast, so no session time zone takes part.
    """
    short = F.substring(date, 7, 4)
    century = F.when(short >= "69", "19").otherwise("20")
    year = F.when(F.length(date) == 8, F.concat(century, short)).otherwise(short)
    iso = F.concat(year, F.lit("-"), F.substring(date, 1, 2), F.lit("-"), F.substring(date, 4, 2), F.lit(" "), clock)
    return iso.try_cast("timestamp_ntz")


def parse_time_parameter(text: str | None) -> datetime | None:
    """RFC 3339, seconds or minutes; empty or unreadable is an open bound."""
    for layout in PARAMETER_FORMATS if text else ():
        try:
            stamp = datetime.strptime(text, layout)
            return stamp.astimezone(timezone.utc).replace(tzinfo=None) if stamp.tzinfo else stamp
        except ValueError:
            continue
    return None
