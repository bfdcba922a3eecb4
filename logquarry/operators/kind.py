"""What kind of archive it is, from the paths of its entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.text import first_case, normal_path

# Marker paths and labels.
FIREWALL_MARKERS = (
    r"(?i)(^|/)opt/pancfg/",
    r"(?i)(^|/)tmp/cli/",
    r"(?i)(^|/)(dp\d*-monitor|mp-monitor)\.log",
    r"(?i)(^|/)var/log/pan/",
    r"(?i)(^|/)opt/panlogs/",
    r"(?i)(^|/)mergesp\.xml$",
    r"(?i)(^|/)running-config\.xml$",
)
AGENT_MARKERS = (
    r"(?i)(^|/)PanGPS\.log",
    r"(?i)(^|/)PanGPA\.log",
    r"(?i)(^|/)pan_gp_event\.log",
    r"(?i)(^|/)PanGpHip(Mp)?\.log",
    r"(?i)(^|/)PanNExt\.log",
    r"(?i)(^|/)PanGPUI\.log",
    r"(?i)(^|/)HipReport(Success)?\.xml$",
    r"(?i)(^|/)\.GlobalProtect/",
    r"(?i)(^|/)GlobalProtect/.*\.log",
)
LABELS = {"firewall": "Firewall tech-support", "gp-agent": "GlobalProtect agent"}
UNKNOWN_LABEL = "Unrecognised archive"
FIREWALL_PASS_KINDS = ("firewall", "unknown")
AGENT_PASS_KINDS = ("gp-agent",)


def _first_hits(patterns: Sequence[str]) -> Column:
    """First entry that matches each pattern, as sorted (entry_ord, path) pairs."""
    hits = [
        F.min(F.when(F.col("path").rlike(p), F.struct("entry_ord", F.lit(i).alias("pattern"), "path")))
        for i, p in enumerate(patterns)
    ]
    return F.array_sort(F.array_compact(F.array(*hits)))


def detect_kind(entries: DataFrame, max_bundle_entries: int | None = None) -> DataFrame:
    """Kind, marker paths and number of distinct markers of every archive.

    Any firewall marker decides; the agent count is only reported without one. Archives without
    markers count as agent bundles when they are mostly logs and, if a limit is named, not larger than it.
    """
    rows = entries.select("file_id", "entry_ord", normal_path(F.col("path")).alias("path")).where(F.col("path") != "")
    base = F.lower(F.substring_index("path", "/", -1))
    is_log = base.endswith(".log") | base.contains(".log.")
    facts = rows.groupBy("file_id").agg(
        _first_hits(FIREWALL_MARKERS).alias("firewall"),
        _first_hits(AGENT_MARKERS).alias("agent"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_log).alias("logs"),
    )
    bundle = (F.col("logs") >= 2) & (F.col("logs") * 2 >= F.col("n"))
    if max_bundle_entries is not None:
        bundle = bundle & (F.col("n") <= max_bundle_entries)
    plain = (F.size("firewall") == 0) & (F.size("agent") == 0) & bundle
    # the log paths of one archive, which one task has listed
    named = rows.where(F.lower("path").contains(".log")).join(facts.where(plain).select("file_id"), "file_id", "left_semi")
    named = named.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("entry_ord", "path"))).alias("shown"))
    joined = facts.withColumn("plain", plain).join(named, "file_id", "left")

    def paths(column: str) -> Column:
        return F.array_distinct(F.transform(column, lambda h: h["path"]))

    firewall, agent = F.size("firewall") > 0, F.size("agent") > 0
    shown = F.transform("shown", lambda h: h["path"])
    markers = F.when(firewall, paths("firewall")).when(agent, paths("agent")).when(F.col("plain"), shown)
    return joined.select(
        "file_id",
        F.when(firewall, "firewall").when(agent | F.col("plain"), "gp-agent").otherwise("unknown").alias("kind"),
        F.coalesce(markers, F.array().cast("array<string>")).alias("kind_markers"),
        F.size("firewall").alias("firewall_hits"),
        F.when(firewall, F.lit(None)).otherwise(F.size("agent")).alias("agent_hits"),
    )


def kind_label(kind: Column) -> Column:
    return first_case([(kind == k, F.lit(v)) for k, v in LABELS.items()], F.lit(UNKNOWN_LABEL))


def for_kinds(rows: DataFrame, kinds: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Rows of the archives whose kind is wanted, before a pass reads them."""
    return rows.join(kinds.where(F.col("kind").isin(*wanted)).select("file_id"), "file_id", "left_semi")
