"""Rotated endpoint-agent service logs in age order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.text import base_name
from logquarry.operators.agent import EVENT_LOG

# Service logs and their rotation number.
SERVICE_LOGS = r"^pangps.*\.log$"
ROTATION = r"\.(\d+)\.log$"

PLACE = ("newness", "entry_ord", "line_no")


def age(base: Column) -> Column:
    """Rotation number of a service log; the live log and the event log are 0."""
    rotated = F.regexp_extract(base, ROTATION, 1).try_cast("int")
    return F.when(base.rlike(SERVICE_LOGS), F.coalesce(rotated, F.lit(0))).otherwise(0)


def service_lines(lines: DataFrame) -> DataFrame:
    """Lines of the service and event logs, oldest rotation first by (newness, entry_ord, line_no)."""
    base = base_name(F.col("path"))
    rows = lines.where(base.rlike(SERVICE_LOGS) | (base == EVENT_LOG))
    return rows.select("file_id", (-age(base)).alias("newness"), "entry_ord", "line_no", "path", F.rtrim("text", F.lit("\r")).alias("text"))


def place() -> Column:
    return F.struct(*PLACE)
