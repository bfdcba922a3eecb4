"""Raw log lines to timestamped, labelled entries; time filtering and paging."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.text import MARK, computed, extract, first_case, groups, trimmed, unix
from logquarry.functions.timestamps import agent_timestamp, iso_ntz, line_timestamp
from logquarry.operators.ordered import by_lines

# Headers, sections and the three endpoint-agent line formats.
BLOCK_HEADER = r"^(\d{4}[-/]\d{2}[-/]\d{2} \d{2}:\d{2}:\d{2})(?:\.\d+)?\s+[-+]\d{4}\s+---\s+(\S+)"
LEADING_STAMP = r"^(\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2})"
CPU_GROUP_SECTION = r"^:CPU load sampling by group:"
CPU_LOAD_SECTION = r"^:CPU load \(%\) during last (\d+) seconds:"
RESOURCE_SECTION = r"^:Resource utilization \(%\) during last (\d+) seconds:"
SUB_SECTION = r"^:([A-Za-z][A-Za-z0-9 _-]*):\z"
EVENT_LINE = r"^(\d{2}/\d{2}/\d{4}) (\d{2}:\d{2}:\d{2}):(\d{3})\s*\[([A-Za-z]+)\s*\]:\s?(.*)$"
TRACE_LINE = (
    r"^\s*\(P(\d+)-T(\d+)\)([A-Za-z]+)\s*\(\s*(\d+)\):\s*(\d{2}/\d{2}/\d{2}) (\d{2}:\d{2}:\d{2}):(\d{3})\s?(.*)$"
)
PORTAL_LINE = (
    r"^\s*\(P(\d+)-T(\d+)\)([A-Za-z]+)\s*(\d{2}/\d{2}/\d{2}) (\d{2}:\d{2}:\d{2}):(\d{3})\s*\(\s*(\d+)\):\s?(.*)$"
)
EMBEDDED_ENTRY = r"(?<=.)(\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}:\d{3}\s*\[)"
SNIFF_LINES = 20

FILE = ("file_id", "entry_ord", "path")


def in_range(ts: Column, start: datetime | None, end: datetime | None, no_stamp: bool) -> Column:
    """Inclusive bounds, None is open; `no_stamp` decides for rows without a timestamp."""
    kept = F.lit(True)
    if start is not None:
        kept = kept & (ts >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        kept = kept & (ts <= F.lit(end).cast("timestamp_ntz"))
    return F.when(ts.isNull(), F.lit(no_stamp)).otherwise(kept)


def structure_monitor(lines: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Monitor-log entries: the block or section is the label, timestamps carry over to following lines."""
    text = F.rtrim(F.col("text"), F.lit("\r"))
    clean = trimmed(text)
    header = F.when(clean.contains("---"), extract(clean, BLOCK_HEADER, 1))
    stamp = F.when(header.isNotNull(), iso_ntz(header)).otherwise(iso_ntz(extract(clean, LEADING_STAMP)))

    def label(name: Column, resource: bool) -> Column:
        return F.struct(F.col("line_no").alias("at"), name.alias("name"), F.lit(resource).alias("resource"))

    labels = first_case(
        [
            (header.isNotNull(), label(extract(clean, BLOCK_HEADER, 2), False)),
            (clean.rlike(CPU_GROUP_SECTION), label(F.lit("cpu_by_group"), False)),
            (clean.rlike(CPU_LOAD_SECTION), label(F.concat(F.lit("CPU "), extract(clean, CPU_LOAD_SECTION), F.lit("s")), False)),
            (
                clean.rlike(RESOURCE_SECTION),
                label(F.concat(F.lit("resource "), extract(clean, RESOURCE_SECTION), F.lit("s")), True),
            ),
        ]
    )
    name = extract(clean, SUB_SECTION)
    sub = F.when(name.isNotNull(), F.struct(F.col("line_no").alias("at"), F.concat(F.lit(":"), name).alias("name")))
    marked = lines.select(
        *FILE, "line_no", text.alias("msg"), computed(stamp.alias("_stamp"), labels.alias("_label"), sub.alias("_sub"))
    )
    rows = by_lines(marked).carry({"ts": "_stamp", "block": "_label", "part": "_sub"}).rows()
    inside = F.col("block.resource") & (F.col("part.at") > F.col("block.at"))
    named = F.coalesce(F.col("block.name"), F.lit(""))
    rows = rows.where(in_range(F.col("ts"), start, end, start is None))
    return rows.select(
        *FILE,
        F.coalesce(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.lit("")).alias("ts_text"),
        "ts",
        F.when(inside, F.concat(named, F.lit(" "), F.col("part.name"))).otherwise(named).alias("label"),
        "msg",
        F.col("line_no").alias("line"),
        F.lit(0).alias("part_no"),
    )


def split_embedded(lines: DataFrame) -> DataFrame:
    """A second entry start inside a line begins a new row with the same line number."""
    parts = F.split(F.regexp_replace(F.rtrim("text", F.lit("\r")), unix(EMBEDDED_ENTRY), f"{MARK}$1"), MARK, -1)
    return lines.select(*[c for c in lines.columns if c != "text"], F.posexplode(parts).alias("part_no", "text"))


def is_agent_line(text: Column) -> Column:
    return text.rlike(unix(EVENT_LINE)) | text.rlike(unix(TRACE_LINE)) | text.rlike(unix(PORTAL_LINE))


def agent_entry(text: Column) -> Column:
    """(ts, millis, label, msg) of an endpoint-agent line in any of its formats, null for other lines."""
    event, trace, portal = groups(text, EVENT_LINE, 5), groups(text, TRACE_LINE, 8), groups(text, PORTAL_LINE, 8)

    def entry(date: Column, clock: Column, millis: Column, label: Column, msg: Column) -> Column:
        return F.struct(
            agent_timestamp(date, clock).alias("ts"), millis.alias("millis"), label.alias("label"), msg.alias("msg")
        )

    def thread(g: Column) -> Column:
        return F.concat(F.lit("P"), g[0], F.lit("-T"), g[1], F.lit(" "), g[7])

    return first_case(
        [
            (event.isNotNull(), entry(event[0], event[1], event[2], event[3], event[4])),
            (trace.isNotNull(), entry(trace[4], trace[5], trace[6], trace[2], thread(trace))),
            (portal.isNotNull(), entry(portal[3], portal[4], portal[5], portal[2], thread(portal))),
        ]
    )


def structure_agent(lines: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Endpoint-agent entries; lines in no known format continue the entry above them."""
    order = ("line_no", "part_no")
    rows = split_embedded(lines).select(*FILE, *order, "text", computed(agent_entry(F.col("text")).alias("own")))
    rows = rows.where(F.col("own").isNotNull() | (trimmed(F.col("text")) != ""))
    stamp = F.when(F.col("own.ts").isNotNull(), F.struct("own.ts", "own.millis"))
    rows = rows.select(*FILE, *order, "text", "own", stamp.alias("_stamp"), F.col("own.label").alias("_label"))
    rows = by_lines(rows, order=order).carry({"stamp": "_stamp", "label": "_label"}).rows()
    ts = F.col("stamp.ts")
    rows = rows.where(in_range(ts, start, end, start is None and end is None))
    full = F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.col("stamp.millis"))
    return rows.select(
        *FILE,
        F.coalesce(full, F.lit("")).alias("ts_text"),
        ts.alias("ts"),
        F.coalesce("label", F.lit("")).alias("label"),
        F.coalesce("own.msg", "text").alias("msg"),
        F.col("line_no").alias("line"),
        "part_no",
    )


def agent_files(lines: DataFrame) -> DataFrame:
    """Files of which at least half of the first non-blank lines are endpoint-agent lines."""
    head = lines.where((F.col("line_no") <= SNIFF_LINES) & (trimmed(F.col("text")) != ""))
    counted = head.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(is_agent_line(F.rtrim("text", F.lit("\r")))).alias("matched"),
    )
    return counted.where(F.col("matched") * 2 >= F.col("checked")).select(*FILE)


def structure(lines: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Entries of every file in the format its first lines show."""
    agent = agent_files(lines)
    return structure_agent(lines.join(agent, list(FILE), "left_semi"), start, end).unionByName(
        structure_monitor(lines.join(agent, list(FILE), "left_anti"), start, end)
    )


def page(entries: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of every file's entries with the file's total; a limit of 0 or less returns all."""
    ranked = by_lines(entries, order=("line", "part_no"), line="line").positions("entry_no", "total").rows()
    kept = F.col("entry_no") > max(offset, 0)
    if limit > 0:
        kept = kept & (F.col("entry_no") <= max(offset, 0) + limit)
    return ranked.where(kept)


def filter_lines(lines: DataFrame, year: int, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Lines inside a time range; a line without a timestamp belongs to the last one above it."""
    stamped = lines.withColumn("_stamp", line_timestamp(F.col("text"), year))
    rows = by_lines(stamped).carry({"ts": "_stamp"}).rows().drop("_stamp")
    return rows.where(in_range(F.col("ts"), start, end, start is None))


def entry_at(entries: DataFrame, line: int) -> DataFrame:
    """Per file the first entry on the line, or the last one above it."""
    kept = entries.where(F.col("line") <= line)
    exact = F.min_by(F.struct("line", "part_no", "label", "msg"), F.when(F.col("line") == line, F.col("part_no")))
    above = F.max_by(F.struct("line", "part_no", "label", "msg"), F.struct("line", "part_no"))
    return kept.groupBy(*FILE).agg(F.coalesce(exact, above).alias("_e")).select(*FILE, "_e.*")
