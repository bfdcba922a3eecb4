"""Application traffic: names from content files, latest volumes, shares and ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions.text import first_case

# Content files by preference, entry shapes, counter names, measures.
CONTENT_TIERS = (
    ("curcontent", r"(?i)(^|/)updates/curcontent/.*global\.xml$"),
    ("oldcontent", r"(?i)(^|/)updates/oldcontent/.*global\.xml$"),
    ("content", r"(?i)(^|/)(updates|content)/.*global\.xml$"),
)
NAME_FIRST = r"<entry\s+name=\"([^\"]+)\"\s+id=\"(\d+)\""
ID_FIRST = r"<entry\s+id=\"(\d+)\"\s+name=\"([^\"]+)\""
APP_COUNTER = r"^(mp|dp)__appstats__vsys([^_]+)_(.+)_(sessions|packets|bytes|app_changed|threats)$"
MEASURES = ("sessions", "packets", "bytes", "app_changed", "threats")


def content_tier(path: Column) -> Column:
    return first_case([(path.rlike(p), F.lit(i)) for i, (_, p) in enumerate(CONTENT_TIERS)])


def content_source(path: Column) -> Column:
    return first_case([(path.rlike(p), F.lit(n)) for n, p in CONTENT_TIERS[:2]], F.lit("content"))


def app_names(lines: DataFrame) -> DataFrame:
    """(file_id, app_id, name) from the best content tier of each archive; the first name of an id counts."""
    rows = lines.withColumn("tier", content_tier(F.col("path"))).where(F.col("tier").isNotNull())
    rows = rows.where(F.col("text").contains("<entry") & F.col("text").contains("id="))

    def pairs(pattern: str, name: int, app_id: int, rank: int) -> Column:
        found = F.arrays_zip(
            F.regexp_extract_all("text", F.lit(pattern), name).alias("name"),
            F.regexp_extract_all("text", F.lit(pattern), app_id).alias("id"),
        )
        return F.transform(
            found,
            lambda p, i: F.struct(p["id"].try_cast("int").alias("app_id"), p["name"].alias("name"), F.lit(rank).alias("rank"), i.alias("i")),
        )

    both = F.concat(pairs(NAME_FIRST, 1, 2, 0), pairs(ID_FIRST, 2, 1, 1))
    rows = rows.select("file_id", "tier", "entry_ord", "line_no", F.inline(both)).where(F.col("app_id").isNotNull())
    place = F.struct("tier", "entry_ord", "line_no", "rank", "i")
    first = rows.groupBy("file_id", "app_id").agg(F.min_by(F.struct("tier", "name"), place).alias("first"))
    best = lines.where(content_tier(F.col("path")).isNotNull()).groupBy("file_id")
    best = best.agg(F.min(content_tier(F.col("path"))).alias("tier"))
    return first.select("file_id", "app_id", "first.*").join(best, ["file_id", "tier"], "left_semi").drop("tier")


def label_apps(rows: DataFrame, names: DataFrame, keys: Sequence[str] = ("file_id", "app_id")) -> DataFrame:
    """Name of every application id, `app-<id>` when it has none."""
    known = names.where(F.col("name") != "").select(*keys, F.col("name").alias("_known"))
    labelled = rows.join(known, list(keys), "left")
    return labelled.withColumn("app", F.coalesce("_known", F.concat(F.lit("app-"), F.col(keys[-1])))).drop("_known")


def from_series(counters: DataFrame, plane: str) -> DataFrame:
    """Newest sample of every measure per (vsys, application)."""

    def part(group: int) -> Column:
        return F.regexp_extract("name", APP_COUNTER, group)

    rows = counters.where(F.col("name").rlike(APP_COUNTER) & (part(1) == plane)).select(
        "file_id", F.lit(plane).alias("plane"), part(2).alias("vsys"), part(3).alias("app"), part(4).alias("metric"),
        "value", F.struct("ts", "entry_ord", "line_no", "emit_ord").alias("place"),
    )
    newest = [
        F.coalesce(
            F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, F.col("place"))),
            F.lit(0.0),
        ).alias(m)
        for m in MEASURES
    ]
    return rows.groupBy("file_id", "plane", "vsys", "app").agg(*newest)


def totals(stats: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    return stats.groupBy(*keys).agg(*[F.sum(m).alias(f"total_{m}") for m in MEASURES if m in stats.columns])


def with_shares(stats: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Shares of the archive's totals in percent and per-session ratios; 0 where a denominator is not positive.

    Totals are aggregated with partial sums and joined back, so one large archive is not one window.
    """
    measures = [m for m in MEASURES if m in stats.columns]
    sums = totals(stats, keys)

    def over(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.try_divide(a, b)).otherwise(0.0)

    joined = stats.join(sums, list(keys))
    return joined.select(
        *stats.columns,
        *[(over(F.col(m), F.col(f"total_{m}")) * 100).alias(f"{m}_pct") for m in measures],
        over(F.col("packets"), F.col("sessions")).alias("packets_per_session"),
        over(F.col("bytes"), F.col("sessions")).alias("bytes_per_session"),
        over(F.col("bytes"), F.col("packets")).alias("avg_packet_size"),
    )


def preferred(series_stats: DataFrame, cli_stats: DataFrame) -> DataFrame:
    """Series rows of an archive if it has any, else its command-line snapshot."""
    snapshot = cli_stats.join(series_stats.select("file_id").distinct(), "file_id", "left_anti")
    return series_stats.withColumn("source", F.lit("series")).unionByName(
        snapshot.withColumn("source", F.lit("cli")), allowMissingColumns=True
    )


def table(stats: DataFrame, contains: str = "", sort: str = "bytes", descending: bool = True) -> DataFrame:
    """Rows whose application name contains a text, sorted by one column."""
    rows = stats.where(F.lower("app").contains(contains.lower())) if contains else stats
    return rows.orderBy(F.col(sort).desc() if descending else F.col(sort).asc(), "file_id", "vsys", "app")


def vsys_list(stats: DataFrame, order: Sequence[str] = ("vsys",)) -> DataFrame:
    """Distinct virtual systems of an archive in first-seen order."""
    seen = stats.groupBy("file_id", "vsys").agg(F.min(F.struct(*order)).alias("first"))
    window = Window.partitionBy("file_id").orderBy("first", "vsys")
    return seen.select("file_id", "vsys", F.row_number().over(window).alias("ord"))
