"""Out-of-memory events, available-memory trend, growth suspects and the findings drawn from them.

All tables are keyed by (file_id, plane) or (file_id, plane, process); no step looks at one archive at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions.text import any_case, as_gb, computed, first_case, trim_zeros, trimmed
from logquarry.functions.timestamps import line_timestamp
from logquarry.operators.ordered import Ordered, by_lines, by_range, median_by_position, settle

# Line shapes, counter names, units and thresholds.
INVOKED = r"([\w./-]+)\s+invoked\s+oom-killer"
KILLED = r"(?:out of memory:\s*)?kill(?:ed)?\s+process\s+(\d+)\s+\(([^)]+)\)"
SCORE = r"score\s+(\d+)"
KERNEL_LOG_FILE = r"(?i)(dmesg|messages|kern|syslog|show_log_system|_log_|\.log)"
MARKER_WORDS = ("oom", "out of memory", "kill process", "killed process")
AVAILABLE = (("__memorydetail__memavailable", 1.0), ("__memory__mem_available", 1.0), ("__top__avail_mem", 1024.0))
TOTAL = (("__memorydetail__memtotal", 1.0), ("__memory__mem_total", 1.0), ("__top__mem_total", 1024.0))
RESIDENT = r"^(mp|dp)__processes__(.+)_(\d+)_res_swap$"
SLAB_SIZE = r"^(mp|dp)__slabinfo__(.+)_totalactsize$"
KERNEL_SERIES = {
    "__memorydetail__sunreclaim": "Unreclaimable slab (SUnreclaim)",
    "__memorydetail__slab": "Slab total",
}
RESTART_FRACTION = 0.5
MIN_SUSPECT_PCT = 5.0
USER_SPACE_EXPLAINS_PCT = 50.0
LARGE_DROP_KB = 2 * 1024 * 1024
CONFIG_FILE = r"(?i)(^|/)mergesp\.xml$"
CONFIG_WARN_BYTES = 26 << 20
LOW_MEMORY_KB = 9 * 1024 * 1024
FINDING_RANK = {"critical": 4, "high": 3, "medium": 2}

PLANE = ("file_id", "plane")
TIES = ("entry_ord", "line_no", "emit_ord")


def kernel_lines(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Lines of files that may hold kernel messages."""
    files = entries.where(F.col("path").rlike(KERNEL_LOG_FILE) & (F.col("size") > 0))
    return lines.join(files.select("file_id", "entry_ord"), ["file_id", "entry_ord"], "left_semi")


def oom_events(lines: DataFrame, year: int) -> DataFrame:
    """Invocations paired with the kill line that follows them; unpaired lines of either kind stand alone."""
    text = F.rtrim(F.col("text"), F.lit("\r"))
    low = F.lower(text)
    worth = low.contains(MARKER_WORDS[0])
    for word in MARKER_WORDS[1:]:
        worth = worth | low.contains(word)
    kind = first_case([(text.rlike(any_case(INVOKED)), F.lit("invoke")), (text.rlike(any_case(KILLED)), F.lit("kill"))])
    score = F.regexp_extract(text, any_case(SCORE), 1)
    event = F.struct(
        kind.alias("kind"),
        line_timestamp(text, year).alias("ts"),
        F.regexp_extract(text, any_case(INVOKED), 1).alias("invoked_by"),
        F.regexp_extract(text, any_case(KILLED), 1).alias("killed_pid"),
        F.regexp_extract(text, any_case(KILLED), 2).alias("killed"),
        F.when(score != "", score).alias("score"),
        trimmed(text).alias("raw"),
    )
    marked = lines.select("file_id", "path", "entry_ord", "line_no", computed(F.when(worth, event).alias("e")))
    marked = marked.where(F.col("e.kind").isNotNull())
    rows = by_lines(marked).shift({"before": "e"}, {"next": "e"}).rows()
    paired = F.coalesce(F.col("before.kind") == "invoke", F.lit(False))
    waiting = F.coalesce(F.col("next.kind") == "kill", F.lit(False))
    rows = rows.where((F.col("e.kind") == "kill") | ~waiting)
    is_kill = F.col("e.kind") == "kill"
    pair = is_kill & paired

    def opening(name: str) -> Column:
        return F.when(pair, F.col(f"before.{name}")).otherwise(F.col(f"e.{name}"))

    return rows.select(
        "file_id",
        F.col("path").alias("source"),
        "entry_ord",
        "line_no",
        F.coalesce(opening("ts"), F.col("e.ts")).alias("ts"),
        F.when(~is_kill | pair, opening("invoked_by")).alias("invoked_by"),
        F.when(is_kill, F.col("e.killed")).alias("killed"),
        F.when(is_kill, F.col("e.killed_pid")).alias("killed_pid"),
        F.when(is_kill, F.col("e.score")).alias("score"),
        opening("raw").alias("raw"),
    )


def first_oom(events: DataFrame) -> DataFrame:
    """Number of events and the earliest one per archive; events without a timestamp come first."""
    place = F.struct(F.coalesce("ts", F.lit("0001-01-01").cast("timestamp_ntz")).alias("ts"), "entry_ord", "line_no")
    first = F.min_by(F.struct("ts", "invoked_by", "killed", "killed_pid"), place)
    return events.groupBy("file_id").agg(F.count(F.lit(1)).alias("ooms"), first.alias("first"))


def _plane_of(candidates: Sequence[tuple[str, float]]) -> tuple[Column, Column, Column]:
    """(rank, unit factor, plane) of a counter that is one of the candidate series."""
    name = F.col("name")
    rank = first_case([(name.rlike(f"^(mp|dp){s}$"), F.lit(i)) for i, (s, _) in enumerate(candidates)])
    unit = first_case([(name.endswith(s), F.lit(u)) for s, u in candidates])
    return rank, unit, F.substring("name", 1, 2)


def available_trend(counters: DataFrame, ties: Sequence[str] = TIES) -> DataFrame:
    """Start, end, minimum and decline of the best available-memory series of each plane, in kB."""
    rank, unit, plane = _plane_of(AVAILABLE)
    rows = counters.select("*", rank.alias("rank"), unit.alias("unit"), plane.alias("plane")).where(F.col("rank").isNotNull())
    place, kb = F.struct("ts", *ties), F.col("value") * F.col("unit")
    series = rows.groupBy(*PLANE, "rank", F.col("name").alias("counter")).agg(
        F.min_by(kb, place).alias("start_kb"),
        F.max_by(kb, place).alias("end_kb"),
        F.min(kb).alias("min_kb"),
        F.min("ts").alias("from_ts"),
        F.max("ts").alias("to_ts"),
        F.count(F.lit(1)).alias("points"),
    )
    kept = [c for c in series.columns if c not in (*PLANE, "rank")]
    best = series.where(F.col("points") >= 2).groupBy(*PLANE).agg(F.min_by(F.struct(*kept), "rank").alias("t"))
    return best.select(*PLANE, "t.*").select(
        "*",
        (F.col("start_kb") - F.col("end_kb")).alias("drop_kb"),
        (F.timestamp_diff("SECOND", F.col("from_ts"), F.col("to_ts")) / 86400).alias("span_days"),
    )


PROCESS = (*PLANE, "process")


def resident_samples(counters: DataFrame, ties: Sequence[str] = TIES) -> DataFrame:
    """Resident-memory samples of every process, the series of all its pids in one timeline."""
    rows = counters.where(F.col("name").rlike(RESIDENT))
    part = [F.regexp_extract("name", RESIDENT, g) for g in (1, 2, 3)]
    return rows.select(
        "file_id", part[0].alias("plane"), part[1].alias("process"), part[2].alias("pid"), "name", "ts", "value", *ties
    )


def restarts(samples: DataFrame, ties: Sequence[str] = TIES) -> Ordered:
    """Samples in time order with their position, marked where the pid changes or the value halves."""
    rows = by_range(samples, PROCESS, ("ts", *ties, "pid")).positions("rn", "n")
    rows = rows.shift({"_pid": "pid", "_value": "value"})
    halved = (F.col("_value") > 0) & (F.col("value") < F.col("_value") * RESTART_FRACTION)
    restart = F.col("_value").isNotNull() & ((F.col("pid") != F.col("_pid")) | halved)
    return rows._with(rows.df.withColumn("restart", F.coalesce(restart, F.lit(False))).drop("_pid", "_value"))


def process_growth(counters: DataFrame, trend: DataFrame, ties: Sequence[str] = TIES) -> DataFrame:
    """Memory growth of every process that grew, and its share of the available-memory decline."""
    rows = settle(restarts(resident_samples(counters, ties), ties).rows())
    stats = rows.groupBy(*PROCESS).agg(
        F.min_by("value", "rn").alias("start_kb"),
        F.max_by("value", "rn").alias("end_kb"),
        F.max("value").alias("peak_kb"),
        F.max(F.when(F.col("restart"), F.col("rn"))).alias("last_restart"),
        F.max("n").alias("points"),
    )
    stats = stats.where(F.col("points") >= 2)
    names = rows.select(*PROCESS, "name", "pid").distinct().groupBy(*PROCESS).agg(
        F.min("name").alias("counter"), F.countDistinct("pid").alias("pids")
    )
    after = rows.join(stats.select(*PROCESS, "last_restart").where(F.col("last_restart").isNotNull()), list(PROCESS))
    after = after.where(F.col("rn") >= F.col("last_restart"))
    post = median_by_position(after, PROCESS, "value", ("rn",), "post_restart_kb")
    joined = stats.join(names, list(PROCESS)).join(post, list(PROCESS), "left")
    joined = joined.join(trend.select(*PLANE, "drop_kb"), list(PLANE), "left")
    restarted = F.col("last_restart").isNotNull()
    post_kb = F.when(restarted, F.col("post_restart_kb")).otherwise(0.0)
    reclaimed = F.when(restarted, F.col("peak_kb") - F.col("post_restart_kb")).otherwise(0.0)
    net = F.col("end_kb") - F.col("start_kb")
    growth = F.when(restarted, F.greatest(net, F.col("peak_kb") - F.col("start_kb"), reclaimed)).otherwise(net)
    grown = joined.select(
        *PROCESS,
        "counter",
        "pids",
        "start_kb",
        "end_kb",
        "peak_kb",
        growth.alias("growth_kb"),
        _share(growth).alias("pct_of_drop"),
        restarted.alias("restarted"),
        post_kb.alias("post_restart_kb"),
        reclaimed.alias("reclaimed_kb"),
        "drop_kb",
    )
    return settle(grown.where(F.col("growth_kb") > 0))


def _share(growth: Column) -> Column:
    return F.when(F.col("drop_kb") > 0, F.try_divide(growth, F.col("drop_kb")) * 100).otherwise(0.0)


def duplicates(counters: DataFrame, growth: DataFrame, ties: Sequence[str] = TIES) -> DataFrame:
    """Growing processes with two different pids at one second."""
    samples = resident_samples(counters, ties)
    second = F.date_trunc("second", "ts")
    both = samples.groupBy(*PROCESS, second.alias("second")).agg(F.min("pid").alias("lo"), F.max("pid").alias("hi"))
    found = both.where(F.col("lo") != F.col("hi")).select(*PROCESS).distinct()
    return found.join(growth.where(F.col("pids") > 1).select(*PROCESS), list(PROCESS), "left_semi")


def suspects(growth: DataFrame, limit: int | None = None) -> DataFrame:
    """Growths of each plane ranked by size, the first ones only if a limit is named; small shares are skipped unless the process restarted."""
    small = (F.col("drop_kb") > 0) & (F.col("pct_of_drop") < MIN_SUSPECT_PCT) & ~F.col("restarted")
    window = Window.partitionBy(*PLANE).orderBy(F.col("growth_kb").desc(), "process")
    kept = growth.where(~F.coalesce(small, F.lit(False)))
    ranked = kept.withColumn("rank", F.row_number().over(window))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def explained(growth: DataFrame, trend: DataFrame) -> DataFrame:
    """Share of the decline that all growing processes account for; it can exceed 100."""
    total = growth.groupBy(*PLANE).agg(F.sum("growth_kb").alias("growth_kb"))
    rows = trend.select(*PLANE, "drop_kb").join(total, list(PLANE), "left")
    return rows.select(*PLANE, "drop_kb", _share(F.coalesce("growth_kb", F.lit(0.0))).alias("explained_pct"))


def kernel_growth(counters: DataFrame, trend: DataFrame, ties: Sequence[str] = TIES) -> DataFrame:
    """Growth of the kernel's slab series, slab caches scaled from bytes to kB."""
    name = F.col("name")
    known = first_case([(name.rlike(f"^(mp|dp){s}$"), F.lit(label)) for s, label in KERNEL_SERIES.items()])
    cache = F.when(name.rlike(SLAB_SIZE), F.concat(F.lit("slab cache "), F.regexp_extract(name, SLAB_SIZE, 2)))
    unit = F.when(name.rlike(SLAB_SIZE), 1 / 1024.0).otherwise(1.0)
    rows = counters.select("*", F.coalesce(known, cache).alias("label"), unit.alias("unit"), F.substring("name", 1, 2).alias("plane"))
    place, kb = F.struct("ts", *ties), F.col("value") * F.col("unit")
    ends = rows.where(F.col("label").isNotNull()).groupBy(*PLANE, "label", F.col("name").alias("counter")).agg(
        F.min_by(kb, place).alias("start_kb"), F.max_by(kb, place).alias("end_kb"), F.count(F.lit(1)).alias("points")
    )
    ends = ends.where((F.col("points") >= 2) & (F.col("end_kb") > F.col("start_kb")))
    growth = F.col("end_kb") - F.col("start_kb")
    joined = ends.join(trend.select(*PLANE, "drop_kb"), list(PLANE), "left")
    return joined.select(
        *PLANE, "label", "counter", "start_kb", "end_kb", F.col("end_kb").alias("peak_kb"),
        growth.alias("growth_kb"), _share(growth).alias("pct_of_drop"),
    )


def kernel_likely(explained_rows: DataFrame, kernel: DataFrame) -> DataFrame:
    """Planes whose decline is mostly unexplained by processes while a kernel series grew."""
    open_drop = (F.col("drop_kb") > 0) & (F.col("explained_pct") < USER_SPACE_EXPLAINS_PCT)
    return explained_rows.where(open_drop).join(kernel.select(*PLANE).distinct(), list(PLANE), "left_semi")


def findings(
    planes: DataFrame,
    events: DataFrame,
    trend: DataFrame,
    growth: DataFrame,
    kernel: DataFrame,
    repeated: DataFrame,
) -> DataFrame:
    """Rule findings as (file_id, plane, severity, title, detail, ord); `planes` lists the (file_id, plane) pairs.

    Without a trend only the out-of-memory findings and the missing-trend note apply.
    """
    lit, concat = F.lit, F.concat

    def rule(rows: DataFrame, order: int, severity: Column, title: Column, detail: Column, tie: Column | None = None) -> DataFrame:
        place = F.struct(lit(order).alias("rule"), (lit("") if tie is None else tie).cast("string").alias("tie"))
        return rows.select(*PLANE, severity.alias("severity"), title.alias("title"), detail.alias("detail"), place.alias("ord"))

    oom = planes.join(first_oom(events), "file_id")
    victim = concat(
        lit("; kernel killed "),
        "first.killed",
        F.coalesce(concat(lit(" (pid "), "first.killed_pid", lit(")")), lit("")),
    )
    oom_detail = concat(
        lit("The OOM killer ran "), "ooms", lit(" time(s). First event"),
        F.coalesce(concat(lit(" at "), F.date_format("first.ts", "yyyy-MM-dd HH:mm:ss")), lit("")),
        F.coalesce(concat(lit("; allocation requested by "), "first.invoked_by"), lit("")),
        F.coalesce(victim, lit("")),
        lit(". Neither process is necessarily the cause: one merely asked for memory next, the other was chosen by score."),
    )
    counted = explained(growth, trend).drop("drop_kb")
    known = planes.join(trend, list(PLANE))
    top = suspects(growth)
    largest = top.where(F.col("rank") == 1).join(counted, list(PLANE))
    leading = kernel.groupBy(*PLANE).agg(F.max_by(F.struct("label", "growth_kb", "counter"), F.struct("growth_kb", "counter")).alias("k"))
    likely = kernel_likely(explained(growth, trend), kernel).join(leading, list(PLANE))
    drop = F.col("drop_kb")
    rules = [
        rule(oom, 0, lit("critical"), lit("OOM killer invoked"), oom_detail),
        rule(
            oom.where(F.col("ooms") > 1), 1, lit("info"), lit("Multiple OOMs in the window"),
            lit("Later events usually follow from the first one; investigate the first."),
        ),
        rule(
            planes.join(trend, list(PLANE), "left_anti"), 2, lit("info"), lit("No available-memory trend"),
            concat(lit("None of "), F.concat_ws(", ", *[concat("plane", lit(s)) for s, _ in AVAILABLE]), lit(" had enough samples.")),
        ),
        rule(
            known.where(drop > 0), 3, F.when(drop > LARGE_DROP_KB, "high").otherwise("medium"),
            concat(lit("Available memory declined by "), as_gb(drop)),
            concat(
                lit("From "), as_gb(F.col("start_kb")), lit(" to "), as_gb(F.col("end_kb")), lit(" over "),
                trim_zeros(F.col("span_days")), lit(" day(s), low point "), as_gb(F.col("min_kb")),
                lit(". Read from "), "counter", lit(" (available, not free, memory)."),
            ),
        ),
        rule(
            known.where(drop <= 0), 4, lit("info"), lit("Available memory stable"),
            concat(lit("No net decline ("), as_gb(F.col("start_kb")), lit(" to "), as_gb(F.col("end_kb")), lit("), read from "), "counter", lit(".")),
        ),
        rule(
            largest, 5, lit("high"), concat(lit("Largest user-space growth: "), "process"),
            concat(
                "process", lit(" grew "), as_gb(F.col("growth_kb")), lit(" ("), trim_zeros(F.col("pct_of_drop")),
                lit("% of the decline). All processes together explain "), trim_zeros(F.col("explained_pct")), lit("% of it."),
            ),
        ),
        rule(
            likely, 6, lit("high"), lit("Kernel memory growth suspected"),
            concat(
                lit("Processes account for only "), trim_zeros(F.col("explained_pct")), lit("% of the decline. Largest kernel growth: "),
                "k.label", lit(" +"), as_gb(F.col("k.growth_kb")), lit(" ("), "k.counter", lit(")."),
            ),
        ),
        rule(
            repeated.join(trend, list(PLANE), "left_semi"), 7, lit("medium"), concat(lit("Multiple instances of "), "process"),
            concat("process", lit(" appears under more than one pid at the same time.")), F.col("process"),
        ),
        rule(
            top.where("restarted").join(trend, list(PLANE), "left_semi"), 8, lit("medium"),
            concat("process", lit(" appears to have restarted")),
            lit("Its resident memory fell sharply or its pid changed, which often ends a leak."), F.format_string("%02d", "rank"),
        ),
    ]
    merged = rules[0]
    for more in rules[1:]:
        merged = merged.unionByName(more)
    return merged


def sort_findings(rows: DataFrame) -> DataFrame:
    rank = first_case([(F.col("severity") == s, F.lit(r)) for s, r in FINDING_RANK.items()], F.lit(1))
    return rows.orderBy("file_id", "plane", rank.desc(), "ord")


def config_size_risk(planes: DataFrame, entries: DataFrame, counters: DataFrame, ties: Sequence[str] = TIES) -> DataFrame:
    """Size of the merged configuration against the device's memory."""
    size = entries.where(F.col("path").rlike(CONFIG_FILE)).groupBy("file_id").agg(F.max("size").alias("size"))
    rank, unit, plane = _plane_of(TOTAL)
    rows = counters.select("*", rank.alias("rank"), unit.alias("unit"), plane.alias("plane")).where(F.col("rank").isNotNull())
    firsts = rows.groupBy(*PLANE, "rank").agg(F.min_by(F.col("value") * F.col("unit"), F.struct("ts", *ties)).alias("kb"))
    # The first two candidates stop at the first one present; the last one only replaces a missing or zero total.
    picked = firsts.groupBy(*PLANE).agg(
        F.min_by("kb", F.when(F.col("rank") < 2, F.col("rank"))).alias("own"),
        F.max(F.when(F.col("rank") == 2, F.col("kb"))).alias("top"),
    )
    total = F.coalesce(F.when(F.col("own") != 0, F.col("own")), F.col("top"))
    joined = planes.join(picked.select(*PLANE, total.alias("total_kb")), list(PLANE), "left").join(size, "file_id", "left")
    low = F.coalesce((F.col("total_kb") > 0) & (F.col("total_kb") < LOW_MEMORY_KB), F.lit(False))
    large = F.col("size") > CONFIG_WARN_BYTES
    megabytes = trim_zeros(F.col("size") / 1024 / 1024)
    detail = F.concat(
        F.lit("mergesp.xml is "), megabytes, F.lit(" MB."),
        F.when(large, F.lit(" That is above the 26 MB mark.")).otherwise(F.lit("")),
        F.when(large & low, F.concat(F.lit(" This device has only "), as_gb(F.col("total_kb")), F.lit(" of RAM."))).otherwise(F.lit("")),
    )
    rows = joined.where(F.col("size").isNotNull() | low)
    return rows.select(
        *PLANE,
        F.when(large & low, "high").when(large, "medium").otherwise("info").alias("severity"),
        F.when(F.col("size").isNotNull(), "Config size").otherwise("Low-memory device").alias("title"),
        F.coalesce(detail, F.concat(F.lit("Total RAM is "), as_gb(F.col("total_kb")), F.lit("; mergesp.xml was not present."))).alias("detail"),
    )


def overlay_series(trend: DataFrame, top: DataFrame, counters: DataFrame) -> DataFrame:
    """Names to plot, numbered: the trend counter, then every pid series of the suspects in `top` by their rank."""
    names = resident_samples(counters).select(*PROCESS, "name").distinct()
    chosen = names.join(top.select(*PROCESS, "rank"), list(PROCESS))
    rows = trend.select(*PLANE, F.col("counter").alias("name"), F.lit(0).alias("rank")).unionByName(chosen.select(*PLANE, "name", "rank"))
    window = Window.partitionBy(*PLANE).orderBy("rank", "name")
    return rows.withColumn("ord", F.row_number().over(window)).select(*PLANE, "ord", "name")
