"""Counter queries: catalogue, lookup, selection, deltas, rates, alignment and nearest samples."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.text import any_case, valid_regex
from logquarry.operators.ordered import Ordered, by_range

KEYS = ("file_id", "name")
TIES = ("entry_ord", "line_no", "emit_ord")


def catalogue(counters: DataFrame) -> DataFrame:
    """Count, minimum and maximum per counter."""
    return counters.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("points"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def lookup(catalog: DataFrame, pattern: str = "", op: str | None = None, x: float = 0.0) -> DataFrame:
    """Catalogue rows whose name matches and whose value range can satisfy `value op x`.

    A pattern whose only special character is `*` treats it as `.*`.
    """
    low, high = F.col("min"), F.col("max")
    ranges: dict[str | None, Column] = {
        None: F.lit(True),
        ">": high > x,
        ">=": high >= x,
        "<": low < x,
        "<=": low <= x,
        "=": (low <= x) & (high >= x),
        "==": (low <= x) & (high >= x),
        "!=": ~((low == x) & (high == x)),
    }
    if not re.search(r"[.\[\]()+?^$|{}\\]", pattern):
        pattern = pattern.replace("*", ".*")
    named = F.col("name").rlike(any_case(valid_regex(pattern))) if pattern else F.lit(True)
    return catalog.where(named & ranges[op])


def lookup_page(found: DataFrame, limit: int) -> DataFrame:
    """First page of a lookup in name order."""
    return found.orderBy("name", "file_id").limit(limit)


def select_series(
    counters: DataFrame, names: Sequence[str], start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Samples of the named counters inside an inclusive range; a name without samples yields one empty row."""
    kept = F.col("name").isin(list(names))
    if start is not None:
        kept = kept & (F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        kept = kept & (F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    found = counters.where(kept)
    wanted = counters.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    empty = wanted.join(found.select("name").distinct(), "name", "left_anti")
    return found.unionByName(empty, allowMissingColumns=True)


def in_order(counters: DataFrame, ties: Sequence[str] = TIES) -> Ordered:
    """Samples of every counter in time order, cut so that one long series spans many tasks."""
    return by_range(counters, KEYS, ("ts", *ties))


def differences(counters: DataFrame, ties: Sequence[str] = TIES) -> DataFrame:
    """Delta and per-second rate against the previous sample; the first sample of a series is dropped."""
    rows = in_order(counters, ties).shift({"_ts": "ts", "_value": "value"}).rows().where(F.col("_ts").isNotNull())
    delta = F.col("value") - F.col("_value")
    seconds = F.timestamp_diff("MICROSECOND", F.col("_ts"), F.col("ts")) / 1e6
    return rows.select(
        *counters.columns,
        delta.alias("delta"),
        F.when(seconds > 0, delta / seconds).otherwise(0.0).alias("rate"),
    )


def align(counters: DataFrame, names: Sequence[str], ties: Sequence[str] = TIES) -> DataFrame:
    """One row per timestamp with a column per name; the last of several samples at one timestamp wins."""
    place = F.struct(*ties)
    cells = [
        F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, place)).alias(n)
        for n in dict.fromkeys(names)
    ]
    return counters.where(F.col("name").isin(list(names))).groupBy("file_id", "ts").agg(*cells)


def nearest_samples(counters: DataFrame, probes: DataFrame, ties: Sequence[str] = TIES) -> DataFrame:
    """Sample nearest in time to each probe (file_id, name, probe_id, ts); the earlier sample wins a tie.

    Samples and probes share one time order; the sample before and the sample after are carried to the
    probe, so neither side is repeated per match.
    """
    sample = F.struct("ts", "value")
    both = counters.select(
        *KEYS, "ts", F.lit(1).alias("side"), *ties, sample.alias("sample"), F.lit(None).cast("string").alias("probe_id")
    ).unionByName(
        probes.select(*KEYS, "ts", F.lit(0).alias("side"), F.col("probe_id").cast("string").alias("probe_id")),
        allowMissingColumns=True,
    )
    both = both.fillna(0, subset=list(ties))
    rows = by_range(both, KEYS, ("ts", "side", *ties)).carry(above={"before": "sample"}, next={"after": "sample"})
    found = rows.rows().where(F.col("side") == 0)

    def away(name: str) -> Column:
        return F.abs(F.timestamp_diff("MICROSECOND", F.col(f"{name}.ts"), F.col("ts")))

    takes_before = F.col("after").isNull() | (F.col("before").isNotNull() & (away("before") <= away("after")))
    best = F.when(takes_before, F.col("before")).otherwise(F.col("after"))
    return found.select(
        *KEYS, "probe_id", "ts", best["ts"].alias("sample_ts"), best["value"].alias("value")
    ).where(F.col("sample_ts").isNotNull())


def latest(counters: DataFrame, ties: Sequence[str] = TIES) -> DataFrame:
    """Last sample of every counter."""
    last = F.max_by(F.struct("ts", "value"), F.struct("ts", *ties)).alias("_last")
    return counters.groupBy(*KEYS).agg(last).select(*KEYS, "_last.*")


def merge_marks(marks: DataFrame, keys: Sequence[str] = ("ts", "name"), order: str = "ord") -> DataFrame:
    """First mark of every (timestamp, name)."""
    rest = [c for c in marks.columns if c not in keys]
    return marks.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_m")).select(*keys, "_m.*")
