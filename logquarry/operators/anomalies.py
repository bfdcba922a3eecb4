"""Recurring log events and counter breaches, grouped by label and clustered in time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.matching import Condition, line_test
from logquarry.functions.text import any_case, first_case, fold, groups, rows_where, trim_zeros, trimmed, unix
from logquarry.functions.timestamps import iso_ntz
from logquarry.operators.ordered import CHUNK, by_range, median_by_position, settle

# Line shape, noise, known events, template replacements, severities, thresholds.
SYSTEM_LOG_FILE = r"show_log_system.*\.txt$"
SYSTEM_LOG_LINE = r"^(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+)\s+\S+\s+\d+\s+(.*)$"
NOISE = (
    r"^successfully connect(ed)? to (address|server|host)\b",
    r"^successfully (resolved|downloaded|updated|sent)\b",
)
KNOWN_EVENTS = (
    (
        "Device Telemetry Send Failure",
        r"(device telemetry|_dt_|dt_\d).*(fail|error|unable|couldn.t)|fail.*(send|upload).*(_dt_|telemetry)",
    ),
    ("Device Telemetry Error", r"device telemetry"),
    ("LACP Down", r"lacp.*(down|fail|timeout|expired)"),
    ("LACP Up", r"lacp.*(up|established)"),
    (
        "HA Failover",
        r"\bha\b.*(failover|failed over|state changed|link (down|monitor) failure|state.*(active|passive|suspended))",
    ),
    ("BFD Session Down", r"bfd.*(down|timeout|expired|session.*down)"),
    ("OSPF Neighbor Down", r"ospf.*(neighbor|adjacency).*(down|dead|lost|fail)"),
    ("BGP Peer Down", r"bgp.*(peer|neighbor).*(down|reset|fail|lost)"),
    ("IPSec/VPN Tunnel Down", r"(ipsec|vpn|tunnel).*(down|fail|disconnect|negotiation failed)"),
    ("Route Flap", r"route.*(flap|withdraw|removed)"),
    ("Interface Link Down", r"\binterface\b.*\blink\b.*\bdown\b"),
    ("Interface Link Up", r"\binterface\b.*\blink\b.*\bup\b"),
    ("Dataplane/Management CPU High", r"(dataplane|management).*cpu.*(high|resource)"),
    ("Session Table Full", r"session (table|resource).*(full|exhaust)"),
    ("Content Update Failure", r"(content|wildfire|antivirus).*(upgrade|update).*(fail|error|couldn.t connect)"),
    ("Certificate Expiring/Expired", r"certificate.*expir"),
    ("License Issue", r"license.*(expir|invalid|fail)"),
)
# A text matching a known event contains one of its words; testing them first is cheaper than the pattern.
EVENT_WORDS = {
    "Device Telemetry Send Failure": ("TELEMETRY", "DT_",),
    "Device Telemetry Error": ("TELEMETRY",),
    "LACP Down": ("LACP",),
    "LACP Up": ("LACP",),
    "HA Failover": ("HA",),
    "BFD Session Down": ("BFD",),
    "OSPF Neighbor Down": ("OSPF",),
    "BGP Peer Down": ("BGP",),
    "IPSec/VPN Tunnel Down": ("IPSEC", "VPN", "TUNNEL",),
    "Route Flap": ("ROUTE",),
    "Interface Link Down": ("INTERFACE",),
    "Interface Link Up": ("INTERFACE",),
    "Dataplane/Management CPU High": ("CPU",),
    "Session Table Full": ("SESSION",),
    "Content Update Failure": ("CONTENT", "WILDFIRE", "ANTIVIRUS",),
    "Certificate Expiring/Expired": ("CERTIFICATE",),
    "License Issue": ("LICENSE",),
}
TEMPLATE_STEPS = (
    (r"(?iu)conn id:\s*\S+", "conn id: <id>"),
    (r"'[^']*'", "'<file>'"),
    (r"\S+\.tgz\b", "<file>"),
    (r"(ethernet|ae)\d+(/\d+)?(\.\d+)?", "<iface>"),
    (r"[0-9a-fA-F]{2}(:[0-9a-fA-F]{2}){5}", "<mac>"),
    (r"\d{1,3}(\.\d{1,3}){3}(/\d{1,2})?", "<ip>"),
    (r"(?iu)port:?\s*\d+", "port: <port>"),
    (r"\d+", "<n>"),
)
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "informational": 1, "info": 1}
LOAD_BANDS = ((5.0, "critical", "above 5"), (2.5, "critical", "above 2.5"))
IOWAIT_BANDS = ((5.0, "critical", "above 5"), (2.0, "high", "above 2"))
CPU_BANDS = ((80.0, "critical", "above 80%"),)
PROCESS_BANDS = ((85.0, "high", "above 85%"),)
QUEUE_NAME = r"^(mp|dp)__netstat_detail__(.+)_(recv_q|send_q)$"
QUEUE_MIN_SAMPLES = 5
QUEUE_HIGH_BYTES = 100000
TIES = ("entry_ord", "line_no", "emit_ord")
CLUSTER_STEPS = ((12 * 3600, 30 * 60), (6 * 3600, 15 * 60), (2 * 3600, 10 * 60), (45 * 60, 5 * 60))


def severity_rank(severity: Column) -> Column:
    return first_case([(F.lower(severity) == n, F.lit(v)) for n, v in SEVERITY_RANK.items()], F.lit(0))


def parse_system_log(lines: DataFrame) -> DataFrame:
    """System-log lines as (ts, severity, subtype, description); other lines and bad dates are dropped."""
    line = F.rtrim(F.col("text"), F.lit("\r"))
    part = groups(line, SYSTEM_LOG_LINE, 4)
    rest = [c for c in lines.columns if c != "text"]
    stamp = iso_ntz(F.regexp_replace(part[0], r"\s+", " "))
    events = lines.select(
        *rest,
        rows_where(
            part.isNotNull(),
            stamp.alias("ts"),
            F.lower(part[1]).alias("severity"),
            F.lower(part[2]).alias("subtype"),
            trimmed(part[3]).alias("description"),
        ),
    )
    return events.where(F.col("ts").isNotNull())


def is_noise(description: Column) -> Column:
    return description.rlike(any_case("|".join(f"(?:{p})" for p in NOISE)))


def template(description: Column) -> Column:
    """Description with identifiers replaced by placeholders."""
    for pattern, replacement in TEMPLATE_STEPS:
        description = F.regexp_replace(description, unix(pattern), replacement)
    return trimmed(description)


def event_label(description: Column) -> Column:
    """First known event that matches, else the template."""
    folded = fold(description)

    def known(name: str, pattern: str) -> Column:
        worth = F.lit(False)
        for word in EVENT_WORDS[name]:
            worth = worth | folded.contains(word.lower())
        return worth & description.rlike(any_case(pattern))

    return first_case([(known(n, p), F.lit(n)) for n, p in KNOWN_EVENTS], template(description))


def log_occurrences(lines: DataFrame) -> DataFrame:
    """One labelled row per system-log event that is not noise."""
    events = parse_system_log(lines).where(~is_noise(F.col("description")))
    return events.withColumn("label", event_label(F.col("description")))


def group_occurrences(
    occurrences: DataFrame, order: tuple[str, ...] = ("entry_ord", "line_no"), keys: tuple[str, ...] = ("file_id",)
) -> DataFrame:
    """One row per label: count, worst severity, first subtype and sample, first and last time.

    The occurrences stay a flat table; a label can hold any number of them.
    """
    rank = severity_rank(F.col("severity"))
    place = F.struct(*order)
    worst = F.min_by("severity", F.struct((-rank).alias("rank"), *order))
    return occurrences.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("count"),
        worst.alias("severity"),
        F.min_by("subtype", place).alias("subtype"),
        F.min_by("description", place).alias("sample"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def sort_groups(groups: DataFrame) -> DataFrame:
    return groups.orderBy(severity_rank(F.col("severity")).desc(), F.col("count").desc(), "label")


def merge_groups(log_groups: DataFrame, counter_groups: DataFrame) -> DataFrame:
    """Both sources together; equal labels of different sources stay apart."""
    return log_groups.withColumn("source", F.lit("log")).unionByName(
        counter_groups.withColumn("source", F.lit("counter"))
    )


def search_groups(
    groups: DataFrame, occurrences: DataFrame, condition: Condition, keys: tuple[str, ...] = ("file_id",)
) -> DataFrame:
    """Groups whose label, subtype, severity, sample or any occurrence text satisfies the condition.

    Each term becomes one flag per group, so no group's texts are ever joined together.
    """
    terms = {t: f"_t{i}" for i, t in enumerate(condition.terms())}
    flags = occurrences.groupBy(*keys, "label").agg(
        *[F.max(line_test(t, F.col("description"))).alias(n) for t, n in terms.items()]
    )
    head = F.concat_ws("   ", "label", "subtype", "severity", "sample")

    def test(t: Condition) -> Column:
        return F.coalesce(F.col(terms[t]), F.lit(False)) | line_test(t, head)

    joined = groups.join(flags, [*keys, "label"], "left")
    return joined.where(condition.column(test)).select(*groups.columns)


def _band(value: Column, bands: tuple, pick: int) -> Column:
    """Severity, suffix or level of the highest band the value exceeds."""
    return first_case([(value > band[0], F.lit(band[pick])) for band in bands])


def _breach_rules() -> list[tuple]:
    """(name pattern, subtype, bands, label, description), tried in this order."""
    name, value = F.col("name"), trim_zeros(F.col("value"))

    def rule(pattern, subtype, bands, label, text):
        groups = [F.regexp_extract(name, pattern, g + 1) for g in range(pattern.replace(r"\(", "").count("("))]
        suffix, level = _band(F.col("value"), bands, 2), trim_zeros(_band(F.col("value"), bands, 0))
        return pattern, subtype, bands, F.concat(*label(groups, suffix)), F.concat(*text(groups, level), F.lit(" — "), name)

    lit = F.lit
    process = (
        lambda g, s: (g[0], lit(" process "), g[1], lit(" cpu "), s),
        lambda g, _: (g[1], lit(" (pid "), g[2], lit(") cpu "), value, lit("%")),
    )
    return [
        rule(
            r"^(mp|dp)__cpu_load_avg__i_(1|5|15)$",
            "cpu",
            LOAD_BANDS,
            lambda g, s: (g[0], lit(" cpu "), g[1], lit(" min load "), s),
            lambda g, v: (g[0], lit(" "), g[1], lit("-minute load average "), value, lit(" (threshold "), v, lit(")")),
        ),
        rule(
            r"^(mp|dp)__top__cpu__iowait_pct$",
            "cpu",
            IOWAIT_BANDS,
            lambda g, s: (g[0], lit(" cpu iowait "), s),
            lambda g, v: (g[0], lit(" iowait "), value, lit("% (threshold "), v, lit("%)")),
        ),
        rule(
            r"^(mp|dp)__cpu__last_3m_(avg|max)_pct$",
            "cpu",
            CPU_BANDS,
            lambda g, s: (g[0], lit(" cpu "), g[1], lit(" "), s),
            lambda g, _: (g[0], lit(" CPU "), g[1], lit(" "), value, lit("%")),
        ),
        rule(
            r"^(mp|dp)__cpu__(\d+)_(avg|max)$",
            "cpu",
            CPU_BANDS,
            lambda g, s: (g[0], lit(" cpu core "), g[2], lit(" "), s),
            lambda g, _: (g[0], lit(" core "), g[1], lit(" "), g[2], lit(" "), value, lit("%")),
        ),
        rule(r"^(mp|dp)__processes__(.+)_(\d+)_cpu$", "process", PROCESS_BANDS, *process),
        rule(r"^(mp|dp)__topprocess__(.+)_(\d+)__cpu$", "process", PROCESS_BANDS, *process),
    ]


def band_breaches(counters: DataFrame) -> DataFrame:
    """Samples above a threshold of their counter family, each in its highest band only."""
    lowest, found = [], []
    for pattern, subtype, bands, label, text in _breach_rules():
        hit = F.col("name").rlike(pattern)
        row = F.struct(
            label.alias("label"),
            _band(F.col("value"), bands, 1).alias("severity"),
            F.lit(subtype).alias("subtype"),
            text.alias("description"),
        )
        lowest.append((hit, F.lit(min(b[0] for b in bands))))
        found.append((hit, row))
    return counters.where(F.col("value") > first_case(lowest)).select("*", first_case(found).alias("_b")).select(*counters.columns, "_b.*")


def growing_queues(counters: DataFrame, ties: tuple[str, ...] = ("entry_ord", "line_no", "emit_ord")) -> DataFrame:
    """Samples of socket queues whose last third has a higher median than the first third."""
    keys = ("file_id", "name")
    queues = counters.where(F.col("name").rlike(QUEUE_NAME)).select(*keys, "ts", *ties, "value")
    ranked = by_range(queues, keys, ("ts", *ties)).positions("rn", "n").rows()
    ranked = settle(ranked.where(F.col("n") >= QUEUE_MIN_SAMPLES))
    third = F.greatest(F.floor(F.col("n") / 3), F.lit(1))
    first = median_by_position(ranked.where(F.col("rn") <= third), keys, "value", ("rn",), "first_median")
    last = median_by_position(ranked.where(F.col("rn") > F.col("n") - third), keys, "value", ("rn",), "last_median")
    final = ranked.where(F.col("rn") == F.col("n")).select(*keys, F.col("value").alias("final"))
    trend = first.join(last, list(keys)).join(final, list(keys))
    trend = trend.where((F.col("last_median") > F.col("first_median")) & (F.col("final") > 0))

    def part(group: int) -> Column:
        return F.regexp_extract("name", QUEUE_NAME, group)

    socket = F.concat(part(2), F.lit(" "), part(3))
    grew = [F.lit(" grew from "), trim_zeros(F.col("first_median")), F.lit(" to "), trim_zeros(F.col("last_median"))]
    rising = queues.join(trend, list(keys)).where(F.col("value") > F.col("first_median"))
    return rising.select(
        *queues.columns,
        "first_median",
        "last_median",
        F.concat(part(1), F.lit(" netstat "), socket, F.lit(" increasing")).alias("label"),
        F.when(F.col("last_median") >= QUEUE_HIGH_BYTES, "high").otherwise("medium").alias("severity"),
        F.lit("netstat").alias("subtype"),
        F.concat(socket, *grew, F.lit(" bytes — "), "name").alias("description"),
    )


def counter_occurrences(counters: DataFrame) -> DataFrame:
    """Band breaches and growing queues in one flat table."""
    columns = ("file_id", "name", "ts", *TIES, "value", "label", "severity", "subtype", "description")
    return band_breaches(counters).select(*columns).unionByName(growing_queues(counters).select(*columns))


def counter_groups(counters: DataFrame) -> DataFrame:
    """Counter anomalies per label; the first sample is the earliest by (ts, name) and place in the log."""
    return group_occurrences(counter_occurrences(counters), order=("ts", "name", *TIES))


def cluster_width(span_seconds: Column) -> Column:
    """Cluster width in seconds for a time span; 0 keeps exact timestamps."""
    return first_case([(span_seconds > above, F.lit(step)) for above, step in CLUSTER_STEPS], F.lit(0))


def _micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zoneless timestamp."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def _owned(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], pd.DataFrame]]:
    """Runs of rows of one key and chunk, as far as batches hold them together."""
    for batch in batches:
        if len(batch):
            owner = (batch["key"] != batch["key"].shift()) | (batch["chunk"] != batch["chunk"].shift())
            cuts = [*np.flatnonzero(owner.to_numpy()), len(batch)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                yield (batch["key"].iat[at], int(batch["chunk"].iat[at])), batch.iloc[at:end]


def _chunk_jumps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per key and chunk the events that may be its first anchor, and the last anchor that follows from each.

    An anchor of an earlier chunk lies before this chunk's first event, so the first anchor here is among the events
    less than a width after that event, or the one behind them.
    """
    held: list[np.ndarray] = []
    own, width = None, 1

    def ended() -> pd.DataFrame:
        times = np.concatenate(held)
        jump = np.searchsorted(times, times + width)
        last = np.where(jump < len(times), jump, np.arange(len(times)))
        while not np.array_equal(last, last[last]):
            last = last[last]
        heads = min(int(np.searchsorted(times, times[0] + width)) + 1, len(times))
        return pd.DataFrame({"key": [own[0]], "chunk": [own[1]], "width_us": [width], "heads": [times[:heads]], "lasts": [times[last[:heads]]]})

    for owner, rows in _owned(batches):
        if owner != own:
            if own is not None:
                yield ended()
            held, own, width = [], owner, max(int(rows["width_us"].iat[0]), 1)
        held.append(rows["us"].to_numpy())
    if own is not None:
        yield ended()


def _chunk_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per key and chunk the anchor that holds at its start, from the jumps of the chunks in order."""
    own, anchor = None, None
    for batch in batches:
        entries = []
        for key, width, heads, lasts in zip(batch["key"], batch["width_us"], batch["heads"], batch["lasts"], strict=True):
            if key != own:
                own, anchor = key, None
            entries.append(anchor)
            at = 0 if anchor is None else int(np.searchsorted(heads, anchor + width))
            anchor = int(lasts[at]) if at < len(heads) else anchor
        yield batch[["key", "chunk"]].assign(entry=pd.array(entries, "Int64"))


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The anchor of every event of rows sorted by key, chunk and time; the state is one anchor."""
    own, anchor = None, 0
    for owner, rows in _owned(batches):
        times, width = rows["us"].to_numpy(), max(int(rows["width_us"].iat[0]), 1)
        if owner != own:
            own, entry = owner, rows["entry"].iat[0]
            anchor = int(times[0]) if pd.isna(entry) else int(entry)
        anchors, at = np.empty(len(rows), "int64"), 0
        while at < len(rows):
            if times[at] - anchor >= width:
                anchor = int(times[at])
            end = int(np.searchsorted(times, anchor + width))
            anchors[at:end] = anchor
            at = end
        yield rows.drop(columns="entry").assign(anchor=anchors)


def time_clusters(occurrences: DataFrame, keys: tuple[str, ...] = ("file_id", "label")) -> DataFrame:
    """Greedy clusters per key: a cluster holds the events less than one width after its first event.

    Events are first counted per distinct timestamp. Which events are first ones follows from the jumps to the first
    event at least a width later: each chunk of a range partitioning tells where its possible first anchors lead,
    these jumps are followed from chunk to chunk, and every chunk is clustered from the anchor at its start. So a key
    without gaps is spread like any other.
    """
    spans = occurrences.groupBy(*keys).agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    width = cluster_width(F.timestamp_diff("MICROSECOND", F.col("_lo"), F.col("_hi")) / 1e6)
    spans = spans.select(*keys, (width.cast("long") * 1000000).alias("width_us"))
    counts = occurrences.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("n"))
    timed = counts.join(spans, list(keys)).withColumn("us", _micros(F.col("ts")))
    chunk = F.col(CHUNK).cast("long").alias("chunk")
    rows = by_range(timed, keys, ("us",)).df.select(*keys, F.to_json(F.struct(*keys)).alias("key"), chunk, "us", "width_us", "n")
    by_chunk = ("key", "chunk")
    jumps = rows.select(*by_chunk, "us", "width_us").repartition(*by_chunk).sortWithinPartitions(*by_chunk, "us")
    jumps = jumps.mapInPandas(_chunk_jumps, "key string, chunk long, width_us long, heads array<long>, lasts array<long>")
    entries = jumps.repartition("key").sortWithinPartitions(*by_chunk).mapInPandas(_chunk_entries, "key string, chunk long, entry long")
    entered = rows.join(entries, list(by_chunk)).repartition(*by_chunk).sortWithinPartitions(*by_chunk, "us")
    found = entered.mapInPandas(_anchors, entered.drop("entry").schema.add("anchor", "long"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (
        found.groupBy(*keys, "anchor")
        .agg(F.sum("n").alias("count"), F.max("us").alias("_last"))
        .select(
            *keys,
            F.timestamp_add("MICROSECOND", F.col("anchor"), epoch).alias("ts"),
            F.timestamp_add("MICROSECOND", F.col("_last"), epoch).alias("last_ts"),
            "count",
        )
    )


def nearest_cluster(clusters: DataFrame, at: Column, keys: tuple[str, ...] = ("file_id", "label")) -> DataFrame:
    """Per key the cluster closest in time to `at`; the earlier one wins a tie."""
    distance = F.abs(F.timestamp_diff("MICROSECOND", F.col("ts"), at))
    best = F.min_by(F.struct("ts", "last_ts", "count"), F.struct(distance, F.col("ts")))
    return clusters.groupBy(*keys).agg(best.alias("_c")).select(*keys, "_c.*")
