"""Counter samples from monitor logs: one pass that turns every recognised line into named values.

Block headers are carried forward over whole files in chunks of lines. Everything below that is
state of one block (one sample printed by the device), so the remaining windows are keyed by block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions.text import (
    computed,
    extract,
    fields,
    first_case,
    groups,
    number_or_zero,
    sanitise,
    trimmed,
    unix,
)
from logquarry.functions.timestamps import iso_ntz
from logquarry.operators.ordered import by_lines, settle
from logquarry.operators.structure import BLOCK_HEADER

# File name, sections, row shapes, column names and labels.
MONITOR_FILE = r"(?:^|/)(dp|mp)-monitor\.log(?:\.\d+)?$"
MIN_ELAPSED_SECONDS = 120.0
SECTIONS = (
    ("gc", r"^:Global counters:"),
    ("", r"^:Total counters shown:"),
    ("cpu15m", r"^:CPU load \(%\) during last 15 minutes:"),
    ("cache", r"^:Cache-Type\b"),
    ("pertask", r"^:\s*Per pan-task counter statistics"),
    ("mempool", r"^:Mem-Pool-Type\b"),
    ("softpool", r"^:Software Pools\b"),
    ("powpool", r"Pow Atomic Memory Pools"),
    ("sharedpool", r"^:User\s+Quota\b"),
    ("procus_func", r"^:func\s+max-us"),
    ("procus_group", r"^:group\s+max-us"),
    ("procusd", r"^:(\S+)\s+\((func|group)\)\s*$"),
    ("ru", r"^:Resource utilization \(%\) during last 15 minutes:"),
    ("si", r"^:Number of sessions supported"),
    ("vmpow", r"^:pow parameters:"),
)
ELAPSED = r"^:Elapsed time since last sampling:\s+([\d.]+)\s+seconds"
GLOBAL_COUNTER = r"^:([a-z][a-z0-9_]*)\s+(\d+)\s+(-?\d+)\s*$"
CORE_HEADER = r"^:core((?:\s+\d+)+)\s*$"
VALUE_ROW = r"^:((?:\s+\d+)+)\s*$"
CACHE_ROW = r"^:([A-Za-z][A-Za-z0-9_]*)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\S+)\s*$"
TASK_HEADER = r"^:Counter Name((?:\s+\d+)+)\s+Total\s*$"
TASK_ROW = r"^:([a-z][a-z0-9_]*)((?:\s+\d+)+)\s*$"
CPU_AVERAGE = r"^(\d+)\s+(\d+)\s*$"
LOAD_AVERAGE = r"^([\d.]+)\s+([\d.]+)\s+([\d.]+)"
INTERFACE = r"^\d+:\s+([A-Za-z0-9._@-]+):"
DIRECTION = r"^(RX|TX):\s+([a-z][a-z /]*)$"
NUMBERS_ONLY = r"^[\d\s]+$"
MEMORY_ROW = r"^Mem\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)"
SWAP_ROW = r"^Swap\s+(\d+)\s+(\d+)\s+(\d+)"
APP_VSYS = r"^:Vsys:\s*(\S+)"
APP_ROW = r"^:(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*$"
MEMORY_DETAIL = r"^([A-Za-z_()][A-Za-z0-9_()]*):\s+(-?\d+)(?:\s+kB)?\s*$"
SLAB_ROW = r"^(\S+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*:"
RECEIVER_LINE = r"^([A-Za-z][A-Za-z0-9 ()/_-]*?):\s+([\d.]+)(?:/sec)?\s*$"
SOCKET_PROGRAM = r"^(\d+)/([\w.-]+)"
STATS_SECTION = r"^([A-Za-z][A-Za-z0-9]*):$"
STATS_LABEL_FIRST = r"^(.+?):\s+(-?\d+)\s*$"
STATS_NUMBER_FIRST = r"^(-?\d+)\s+(.+?)\s*$"
FILESYSTEM_ROW = r"^(\S+)\s+(\d+)\s+(\d+)\s*$"
NAMED_ROW = r"^:([A-Za-z][A-Za-z0-9_]*)\s+(.+)$"
TIMING_ROW = r"^:([a-z][a-z0-9_]*)\s+(.+)$"
SOFT_POOL_ROW = r"^:\[\s*\d+\]\s+(.+?)\s+\(\s*\d+\):\s+(\d+)/(\d+)"
POW_POOL_ROW = r"^:?\s*\[\s*\d+\]\s+(.+?)\s+:\s+(\d+)/(\d+)"
TIMING_DETAIL_ROW = r"^:\s+(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)"
RESOURCE_LABEL = r"^:(.+?)\s+\((average|maximum)\):"
RESOURCE_ROW = r"^:\s+(\d+(?:\s+\d+)*)\s*$"
DISCARD_TIMEOUTS = r"TCP:\s*(\d+)\s*secs.*UDP:\s*(\d+).*SCTP:\s*(\d+).*other IP protocols:\s*(\d+)"
FIRST_NUMBER = r"-?\d+(?:\.\d+)?"
UPTIME = r"up\s+(.+?),\s+\d+\s+users?"
USERS = r",\s+(\d+)\s+users?"
TOP_LOAD = r"load average:\s*([\d.]+),\s*([\d.]+),\s*([\d.]+)"
THREAD = r"^:thread (\d+)"
THREAD_VALUE = r"^:thread (\d+) (rcv_tot|deq|null|submit|desubmit|sel to|sel ok|pow_wait) (\d+)"
IO_WQE = r"^:io: wqe alloc (\d+) wqe null (\d+)"
INFLIGHT_WQE = r"^:Total inflight wqe (\d+)"
USED_WQE = r"^:used wqe (\d+) total wqe (\d+)\s+(\d+)% used"
RECEIVE_THRESHOLD = r"^:rcv_thresh\s*:\s*(\d+)"
CACHE_COLUMNS = ("max_entries", "cur_entries", "max_alloc", "cur_sz_b", "insert_failure")
MEMORY_COLUMNS = ("mem_free", "mem_min", "mem_total", "mem_available")
SWAP_COLUMNS = ("swap_free", "swap_min", "swap_total")
APP_METRICS = ("sessions", "packets", "bytes", "app_changed", "threats")
MEM_POOL_COLUMNS = (
    "max_sz_kb", "threshold", "min_sz_kb", "cur_sz_b", "max_alloc",
    "cur_alloc", "total_alloc", "fail_thresh", "fail_nomem", "local_reuse",
)
SHARED_POOL_COLUMNS = (
    "quota", "threshold", "min_alloc", "cur_alloc", "max_alloc",
    "total_alloc", "fail_thresh", "fail_nomem", "local_reuse",
)
TIMING_COLUMNS = (
    "max_us", "avg_us", "count", "total_us", "ac_max_us", "ac_avg_us", "ac_count", "ac_total_us",
)
TIMING_DETAIL_COLUMNS = ("avg_ticks", "avg_us", "count", "total_us")
TOTALS_COLUMNS = ("cpu_pct", "fds", "virt_mem", "res_mem", "res_mem_sub_lazy")
PROCESS_COLUMNS = ("cpu", "fds_open", "virt_mem", "res_swap")
RESOURCE_NAMES = {
    "session": "session", "packet buffer": "pktbuf", "packet descriptor": "pktdesc", "sw tags descriptor": "swtags",
}
TOP_TASKS = {
    "total": "tasks_total", "running": "tasks_running", "sleeping": "tasks_sleeping",
    "stopped": "tasks_stopped", "zombie": "tasks_zombie",
}
TOP_CPU = {
    "us": "cpu__user_pct", "sy": "cpu__system_pct", "ni": "cpu__nice_pct", "id": "cpu__idle_pct",
    "wa": "cpu__iowait_pct", "hi": "cpu__hinterrupt_pct", "si": "cpu__sinterrupt_pct", "st": "cpu__st_pct",
}
TOP_MEMORY = {"total": "mem_total", "free": "mem_free", "used": "mem_used", "buff/cache": "mem_buffcache"}
TOP_SWAP = {"total": "swap_total", "free": "swap_free", "used": "swap_used", "avail": "avail_mem"}
SESSION_LABELS = {
    "Number of sessions supported": "sessions_supported",
    "Number of allocated sessions": "sessions_allocated",
    "Number of active TCP sessions": "sessions_tcp",
    "Number of active UDP sessions": "sessions_udp",
    "Number of active ICMP sessions": "sessions_icmp",
    "Number of active GTPc sessions": "sessions_gtpc",
    "Number of active HTTP2-5gc sessions": "sessions_http2_5gc",
    "Number of active GTPu sessions": "sessions_gtpu",
    "Number of pending GTPu sessions": "sessions_pending_gtpu",
    "Number of active BCAST sessions": "sessions_bcast",
    "Number of active MCAST sessions": "sessions_mcast",
    "Number of active predict sessions": "sessions_predict",
    "Number of active SCTP sessions": "sessions_sctp",
    "Number of active SCTP associations": "associations_sctp",
    "Number of active PFCP sessions": "sessions_pfcp",
    "Number of active IMSI sessions": "sessions_imsi",
    "Session table utilization": "session_table_utelization_pct",
    "Number of sessions created since bootup": "sesscrsboot",
    "Packet rate": "pktrate",
    "Throughput": "throughput_kbps",
    "New connection establish rate": "newconn",
    "TCP default timeout": "timeout_tcp_default",
    "TCP session timeout before SYN-ACK received": "timeout_tcp_before_syn_ack",
    "TCP session timeout before 3-way handshaking": "timeout_tcp_before_3way",
    "TCP half-closed session timeout": "timeout_tcp_half_closed",
    "TCP session timeout in TIME_WAIT": "timeout_tcp_time_wait",
    "TCP session delayed ack timeout": "timeout_tcp_delayed_ack",
    "TCP session timeout for unverified RST": "timeout_tcp_unverified_rst",
    "UDP default timeout": "timeout_udp_default",
    "ICMP default timeout": "timeout_icmp_default",
    "SCTP default timeout": "timeout_sctp_default",
    "SCTP timeout before INIT-ACK received": "timeout_sctp_before_init_ack",
    "SCTP timeout before COOKIE received": "timeout_sctp_before_cookie",
    "SCTP timeout before SHUTDOWN received": "timeout_sctp_before_shutdown",
    "5GC delete timeout": "timeout_5gc_delete",
    "other IP default timeout": "timeout_other_ip_default",
    "Captive Portal session timeout": "timeout_captive_portal",
    "Session accelerated aging": "accel_aging",
    "Accelerated aging threshold": "accel_aging_threshold_pct",
    "Scaling factor": "accel_aging_scaling_factor",
    "TCP - reject non-SYN first packet": "setup_reject_non_syn_first",
    "Hardware session offloading": "hw_offload",
    "Software Cut Through": "setup_sw_cut_through",
    "Run-to-completion mode": "setup_run_to_completion",
    "Tunnel acceleration": "setup_tunnel_accel",
    "IPv6 firewalling": "setup_ipv6_firewalling",
    "Strict TCP/IP checksum": "setup_strict_tcpip_checksum",
    "Strict TCP RST sequence": "setup_strict_tcp_rst_seq",
    "Reject TCP small initial window": "setup_reject_tcp_small_initial_window",
    "Reject TCP SYN with different seq/options": "setup_reject_tcp_syn_diff_seq",
    "Teardown session if forward zone changes": "setup_teardown_on_fwd_zone_change",
    "Do not refresh discard sessions": "setup_no_refresh_discard",
    "ICMP Unreachable Packet Rate": "setup_icmp_unreachable_rate",
    "Timeout to determine application trickling": "trickling_timeout",
    "Resource utilization threshold to start scan": "trickling_ru_threshold_pct",
    "Scan scaling factor over regular aging": "trickling_scan_scaling_factor",
    "Pcap token bucket rate": "pcap_token_bucket_rate",
    "Max pending queued mcast packets per session": "max_pending_mcast_pkts",
}

OWN_FORMAT = (
    "cpu", "ifconfig", "memory", "memory_detail", "slabinfo", "logrcvr_statistics", "netstat_detail",
    "netstat_stats", "processes", "filesystem", "top", "panio_infreq",
)

FILE = ("file_id", "entry_ord", "path")
BLOCK = (*FILE, "block_at")
#: Values stay text until they are one column, read as numbers once in `_long`.
SAMPLE = "array<struct<name:string,text:string,minutes:int>>"


def _clean() -> Column:
    return F.col("clean")


def _is(pattern: str) -> Column:
    return _clean().rlike(unix(pattern))


def _part(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(_clean(), unix(pattern), group)


def _value(pattern: str, group: int) -> Column:
    return number_or_zero(_part(pattern, group))


def _name(*parts: str | Column) -> Column:
    return F.concat(F.col("plane"), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _sample(name: Column, value: Column, minutes: Column | int = 0) -> Column:
    back = F.lit(minutes) if isinstance(minutes, int) else minutes.cast("int")
    return F.struct(name.alias("name"), value.cast("string").alias("text"), back.alias("minutes"))


def _columns(base: Column, pattern: str, names: Sequence[str], first_group: int, joint: str = "_") -> Column:
    """One sample per named group of a row pattern."""
    return F.array(
        *[_sample(F.concat(base, F.lit(joint + n)), _part(pattern, first_group + i)) for i, n in enumerate(names)]
    )


def _positional(base: Column, values: Column, names: Sequence[str]) -> Column:
    """One sample per value present, up to the number of names."""
    known = F.array(*[F.lit(n) for n in names])
    return F.transform(
        F.slice(values, 1, len(names)), lambda v, i: _sample(F.concat(base, F.lit("_"), F.get(known, i)), v)
    )


def blocks(lines: DataFrame, monitor_file: str = MONITOR_FILE) -> DataFrame:
    """Lines of the monitor logs below a header, with plane, block name, header line and timestamp."""
    lines = lines.where(F.col("path").rlike(monitor_file))
    marked = lines.select(
        *FILE,
        "line_no",
        F.regexp_extract("path", monitor_file, 1).alias("plane"),
        trimmed(F.col("text")).alias("clean"),
    )
    header = F.when(_clean().contains("---"), extract(_clean(), BLOCK_HEADER, 1))
    block = F.struct(F.col("line_no").alias("at"), extract(_clean(), BLOCK_HEADER, 2).alias("name"))
    marked = marked.select(
        "*", computed(F.when(header.isNotNull(), block).alias("_block"), F.when(header.isNotNull(), iso_ntz(header)).alias("_ts"))
    )
    # `carry` reads its rows twice: settled, the lines are built and read once
    rows = by_lines(settle(marked)).carry({"block": "_block", "ts": "_ts"}).rows()
    return rows.where(F.col("ts").isNotNull() & (F.col("line_no") > F.col("block.at"))).select(
        *FILE, "line_no", "plane", "clean", "ts", F.col("block.at").alias("block_at"), F.col("block.name").alias("block")
    )


def _at(condition: Column, **payload: Column) -> Column:
    return F.when(condition, F.struct(F.col("line_no").alias("at"), *[c.alias(n) for n, c in payload.items()]))


def _two_digits(ids: Column) -> Column:
    """Core numbers as names print them.

    A projection with a lambda is compiled by itself, in methods short enough for the JIT. As a part of a whole stage, or
    inside a generator, the patterns of a line would be one long method, or not be compiled at all.
    """
    return F.transform(ids, lambda core_id: F.format_string("%02d", core_id.cast("int")))


def _states(rows: DataFrame) -> DataFrame:
    """State of the block in front of each line: section, table headers and consumed rows."""
    window = Window.partitionBy(*BLOCK).orderBy("line_no")
    upto, above = window.rowsBetween(Window.unboundedPreceding, 0), window.rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("block").isin(*OWN_FORMAT)

    def among(block: str) -> Column:
        return F.col("block") == block

    may_start = _clean().startswith(":") | _clean().contains("Pow Atomic Memory Pools")
    mode = F.when(~own & may_start, first_case([(_is(p), F.lit(m)) for m, p in SECTIONS]))
    detail = dict(SECTIONS)["procusd"]
    resource = trimmed(_part(RESOURCE_LABEL))
    known = F.create_map(*[F.lit(x) for pair in RESOURCE_NAMES.items() for x in pair])
    suffix = F.when(_part(RESOURCE_LABEL, 2) == "maximum", F.lit("_max")).otherwise(F.lit("_avg"))
    label = F.concat(F.coalesce(F.try_element_at(known, resource), sanitise(resource)), suffix)
    marks = {
        "section": _at(mode.isNotNull(), mode=mode, name=sanitise(_part(detail)), kind=_part(detail, 2)),
        "core": _at(_clean().startswith(":core") & _is(CORE_HEADER), ids=_two_digits(fields(_part(CORE_HEADER)))),
        "task": _at(_clean().startswith(":Counter") & _is(TASK_HEADER), ids=_two_digits(fields(_part(TASK_HEADER)))),
        "iface": _at(among("ifconfig") & _is(INTERFACE), name=sanitise(F.substring_index(_part(INTERFACE), "@", 1))),
        "rxtx": _at(among("ifconfig") & _is(DIRECTION), way=F.lower(_part(DIRECTION)), names=fields(_part(DIRECTION, 2))),
        "stats": _at(among("netstat_stats") & _is(STATS_SECTION), name=sanitise(_part(STATS_SECTION))),
        "res": _at(_clean().startswith(":") & _clean().contains("):") & _is(RESOURCE_LABEL), name=label),
        "thread": _at(_clean().startswith(":thread") & _is(THREAD), id=_part(THREAD).cast("int")),
    }
    rows = rows.select("*", *[c.alias(f"_{n}") for n, c in marks.items()])
    rows = rows.select(
        *[c for c in rows.columns if not c.startswith("_")],
        *[F.last(f"_{n}", ignorenulls=True).over(upto).alias(n) for n in marks],
        F.lag(_clean().startswith("Load Avg")).over(window).alias("after_load"),
        F.max(F.when(among("ifconfig") & _is(NUMBERS_ONLY), F.col("line_no"))).over(above).alias("numbers_at"),
        F.max(F.when(_clean().startswith(":") & _is(RESOURCE_ROW), F.col("line_no"))).over(above).alias("resource_at"),
    )
    mode, start = F.col("section.mode"), F.col("section.at")
    core_row = (mode == "cpu15m") & (F.col("core.at") > start) & _is(VALUE_ROW)
    core_row = core_row & (F.size(fields(_part(VALUE_ROW))) == 2 * F.size("core.ids"))
    elapsed = F.struct(start, (-F.col("line_no")).alias("line"), _value(ELAPSED, 1).alias("seconds"))
    average = among("cpu") & ~F.coalesce("after_load", F.lit(False)) & _is(CPU_AVERAGE)
    last_line = among("logrcvr_statistics") & (sanitise(_part(RECEIVER_LINE)) == "total_mb")
    rows = rows.select(
        "*",
        core_row.alias("core_row"),
        F.max(F.when((mode == "gc") & _is(ELAPSED), elapsed)).over(upto).alias("elapsed"),
        F.min(F.when(average, F.col("line_no"))).over(upto).alias("average_at"),
        F.min(F.when(last_line, F.col("line_no"))).over(upto).alias("total_at"),
        F.sum(core_row.cast("int")).over(upto).alias("core_rows"),
    )
    first = F.struct(F.col("core.at").alias("at"), (-F.col("core_rows")).alias("rows"))
    return rows.select("*", F.max(F.when(F.col("core_row"), first)).over(upto).alias("core_first"))


def _size_bytes(text: Column) -> Column:
    """`top` size: k, m, g and t scale by 1024, a bare number is KiB."""
    unit = F.lower(F.right(text, F.lit(1)))
    power = first_case([(unit == u, F.lit(1024.0**p)) for p, u in ((2, "m"), (3, "g"), (4, "t"))], F.lit(1024.0))
    return number_or_zero(F.regexp_replace(text, "[kKmMgGtT]$", "")) * power


def _clock_seconds(text: Column) -> Column:
    return F.aggregate(F.split(text, ":"), F.lit(0.0), lambda total, part: total * 60 + number_or_zero(part))


def _uptime_minutes(text: Column) -> Column:
    def count(pattern: str, group: int = 1) -> Column:
        return F.coalesce(F.regexp_extract(text, pattern, group).try_cast("int"), F.lit(0))

    clock = F.when(text.rlike(r"\d+:\d+"), count(r"(\d+):(\d+)") * 60 + count(r"(\d+):(\d+)", 2))
    return count(r"(\d+)\s+day") * 1440 + clock.otherwise(count(r"(\d+)\s+min"))


def _word_values(names: dict[str, str]) -> Column:
    """Samples for `number word` pairs; the last of several equal words wins."""

    def last(word: str) -> Column:
        return _part(r"^(?:.*[^\d.])?([\d.]+)\s+" + word + "(?![A-Za-z/])")

    return F.array_compact(F.array(*[F.when(last(w) != "", _sample(_name("__top__", n), last(w))) for w, n in names.items()]))


def _block_rows() -> list[tuple[Column, Column]]:
    """(condition, samples) of the blocks that have their own line format."""
    f = F.col("words")
    block, start = F.col("block"), F.col("block_at")
    load = F.col("after_load") & _is(LOAD_AVERAGE) & ~_clean().startswith("Load Avg")
    average = F.col("line_no") == F.col("average_at")
    values = F.split(_clean(), r"\s+")
    traffic = _name("__ifconfig__", F.col("iface.name"), F.lit("_"), F.col("rxtx.way"), F.lit("_"))
    rxtx = (F.col("rxtx.at") > F.col("iface.at")) & (F.col("iface.name") != "") & _is(NUMBERS_ONLY)
    rxtx = rxtx & (F.col("rxtx.at") > F.coalesce("numbers_at", start)) & (F.size(values) == F.size("rxtx.names"))
    slab = _name("__slabinfo__", sanitise(_part(SLAB_ROW)))
    slab_row = _is(SLAB_ROW) & ~_clean().startswith("#") & ~_clean().startswith("slabinfo")
    receiver = sanitise(_part(RECEIVER_LINE))
    receiver_row = _is(RECEIVER_LINE) & (receiver != "traffic_logs_written")
    receiver_row = receiver_row & (F.col("line_no") <= F.coalesce("total_at", "line_no"))
    stats = _name("__nsstats__", F.col("stats.name"), F.lit("__"))
    has_stats = F.col("stats").isNotNull() & ~_is(STATS_SECTION)
    totals = _clean().startswith("Totals") & (F.size(f) >= 6)
    count = F.regexp_extract(_clean(), FIRST_NUMBER, 0)
    process = _name("__processes__", sanitise(f[0]), F.lit("_"), F.get(f, 1))
    process_row = (F.size(f) >= 6) & F.get(f, 1).rlike(r"^\d+$")
    lazy = F.when(F.size(f) >= 8, F.array(_sample(F.concat(process, F.lit("_res_swap_sub_lazy")), F.element_at(f, -1))))
    mount = F.when(_part(FILESYSTEM_ROW) == "/", F.lit("root")).otherwise(sanitise(_part(FILESYSTEM_ROW)))
    top = _name("__topprocess__", sanitise(F.get(f, 11)), F.lit("_"), F.get(f, 0), F.lit("__"))

    def top_value(name: str, value: Column) -> Column:
        return _sample(F.concat(top, F.lit(name)), value)

    def column(i: int) -> Column:
        return F.get(f, i)

    uptime = _part(UPTIME)
    top_line = F.array_compact(
        F.array(
            F.when(uptime != "", _sample(_name("__top__uptime_minutes"), _uptime_minutes(uptime))),
            F.when(_is(USERS), _sample(_name("__top__user_sess"), _part(USERS))),
            *[
                F.when(_is(TOP_LOAD), _sample(_name(f"__top__load_avg_{n}"), _part(TOP_LOAD, i + 1)))
                for i, n in enumerate((1, 5, 15))
            ],
        )
    )
    active = _value(SLAB_ROW, 2)
    return [
        ((block == "cpu") & load, F.array(*[_sample(_name(f"__cpu_load_avg__i_{n}"), _part(LOAD_AVERAGE, i + 1)) for i, n in enumerate((1, 5, 15))])),
        ((block == "cpu") & average, F.array(*[_sample(_name(f"__cpu__last_3m_{n}_pct"), _part(CPU_AVERAGE, i + 1)) for i, n in enumerate(("avg", "max"))])),
        ((block == "ifconfig") & rxtx, F.transform(F.arrays_zip(F.col("rxtx.names").alias("n"), values.alias("v")), lambda p: _sample(F.concat(traffic, sanitise(p["n"])), p["v"]))),
        ((block == "memory") & _is(MEMORY_ROW), _columns(_name("__memory__"), MEMORY_ROW, MEMORY_COLUMNS, 1, "")),
        ((block == "memory") & _is(SWAP_ROW), _columns(_name("__memory__"), SWAP_ROW, SWAP_COLUMNS, 1, "")),
        ((block == "memory_detail") & _is(MEMORY_DETAIL), F.array(_sample(_name("__memorydetail__", sanitise(_part(MEMORY_DETAIL))), _part(MEMORY_DETAIL, 2)))),
        ((block == "slabinfo") & slab_row, F.concat(_columns(slab, SLAB_ROW, ("activeobjs", "numobjs", "objsize"), 2), F.array(_sample(F.concat(slab, F.lit("_totalactsize")), active * _value(SLAB_ROW, 4))))),
        ((block == "logrcvr_statistics") & receiver_row, F.array(_sample(_name("__logreceiver_statistics__", receiver), _part(RECEIVER_LINE, 2)))),
        ((block == "netstat_stats") & has_stats & _is(STATS_LABEL_FIRST), F.array(_sample(F.concat(stats, sanitise(_part(STATS_LABEL_FIRST))), _part(STATS_LABEL_FIRST, 2)))),
        ((block == "netstat_stats") & has_stats & _is(STATS_NUMBER_FIRST), F.array(_sample(F.concat(stats, sanitise(_part(STATS_NUMBER_FIRST, 2))), _part(STATS_NUMBER_FIRST, 1)))),
        ((block == "processes") & _clean().startswith("Total num processes"), F.array_compact(F.array(F.when(count != "", _sample(_name("__total__processes"), count))))),
        ((block == "processes") & totals, _positional(_name("__total_"), F.slice(f, 2, 5), TOTALS_COLUMNS)),
        ((block == "processes") & process_row, F.concat(_positional(process, F.slice(f, 3, 4), PROCESS_COLUMNS), F.coalesce(lazy, F.array().cast(SAMPLE)))),
        ((block == "filesystem") & _is(FILESYSTEM_ROW), _columns(_name("__filesystem__", mount), FILESYSTEM_ROW, ("pct", "used_kb"), 2)),
        (
            (block == "top") & (F.size(f) >= 12) & f[0].rlike(r"^\d+$"),
            F.array(
                top_value("cpu", column(8)),
                top_value("mem_pct", column(9)),
                top_value("nice", column(3)),
                top_value("virt_mem", _size_bytes(F.get(f, 4))),
                top_value("res_mem", _size_bytes(F.get(f, 5))),
                top_value("shr_mem", _size_bytes(F.get(f, 6))),
                top_value("time", _clock_seconds(F.get(f, 10))),
            ),
        ),
        ((block == "top") & _clean().startswith("top -"), top_line),
        ((block == "top") & _clean().startswith("Tasks:"), _word_values(TOP_TASKS)),
        ((block == "top") & _clean().startswith("%Cpu"), _word_values(TOP_CPU)),
        ((block == "top") & _clean().startswith("MiB Mem"), _word_values(TOP_MEMORY)),
        ((block == "top") & _clean().startswith("MiB Swap"), _word_values(TOP_SWAP)),
    ]


def _session_rows() -> Column:
    """Session-info line: yes/no values become 1 and -1, others their first number."""
    body = trimmed(F.regexp_replace(_clean(), "^:", ""))
    known = F.create_map(*[F.lit(x) for pair in SESSION_LABELS.items() for x in pair])
    suffix = F.try_element_at(known, trimmed(F.substring_index(body, ":", 1)))
    text = F.regexp_extract(body, r"(?s)^[^:]*:(.*)$", 1)
    first = F.regexp_extract(text, FIRST_NUMBER, 0)
    value = first_case(
        [
            (text.contains("True"), F.lit("1")),
            (text.contains("False"), F.lit("-1")),
            (first != "", first),
        ]
    )
    discard = [f"__si__timeout_discard_{n}" for n in ("tcp", "udp", "sctp", "other_ip")]
    several = F.array(*[_sample(_name(n), _part(DISCARD_TIMEOUTS, i + 1)) for i, n in enumerate(discard)])
    single = F.when(body.contains(":") & suffix.isNotNull() & value.isNotNull(), F.array(_sample(_name("__si__", suffix), value)))
    return F.when(_is(DISCARD_TIMEOUTS), several).otherwise(single)


def _section_rows() -> list[tuple[Column, Column]]:
    """(condition, samples) of the sections inside the remaining blocks."""
    start, line = F.col("section.at"), F.col("line_no")

    def inside(mode: str) -> Column:
        return (F.col("section.mode") == mode) & (line > start)

    kept = (F.col("elapsed.at") == start) & (F.col("elapsed.seconds") >= MIN_ELAPSED_SECONDS)
    row = fields(_part(VALUE_ROW))
    minutes = F.col("core_rows") + F.col("core_first.rows")
    core = F.flatten(
        F.transform(
            F.col("core.ids"),
            lambda core_id, i: F.array(
                *[
                    _sample(
                        _name("__cpu__", core_id, F.lit(f"_{kind}")),
                        F.get(row, 2 * i + offset),
                        minutes,
                    )
                    for offset, kind in enumerate(("avg", "max"))
                ]
            ),
        )
    )
    task_values = fields(_part(TASK_ROW, 2))
    task_row = (F.col("task.at") > start) & _is(TASK_ROW) & (F.size(task_values) == F.size("task.ids") + 1)
    task = F.transform(
        F.col("task.ids"),
        lambda core_id, i: _sample(
            _name("__gc", core_id, F.lit("__"), _part(TASK_ROW)),
            F.get(task_values, i),
        ),
    )

    def pool(kind: str, pattern: str) -> Column:
        base, free, total = _name(f"__pool__{kind}__", sanitise(_part(pattern))), _value(pattern, 2), _value(pattern, 3)
        share = F.when(total != 0, _sample(F.concat(base, F.lit("_pct")), F.try_divide(free, total)))
        return F.array_compact(F.array(_sample(base, free), share))

    def named(prefix: str, pattern: str, names: Sequence[str]) -> Column:
        return _positional(_name(prefix, sanitise(_part(pattern))), fields(_part(pattern, 2)), names)

    def leading(prefix: str, names: Sequence[str]) -> Column:
        """Of `12(0)` the part in front of the parenthesis."""
        values = F.transform(fields(_part(NAMED_ROW, 2)), lambda v: F.substring_index(v, "(", 1))
        return _positional(_name(prefix, sanitise(_part(NAMED_ROW))), values, names)

    timing = _name("__procusd__", F.col("section.kind"), F.lit("__"), F.col("section.name"), F.lit("_c"), _part(TIMING_DETAIL_ROW))
    resource_row = (F.col("res.at") > F.greatest(start, F.coalesce("resource_at", start))) & _is(RESOURCE_ROW)
    resource = F.transform(
        fields(_part(RESOURCE_ROW)), lambda v, i: _sample(_name("__ru__", F.col("res.name")), v, i)
    )
    thread_id = F.when(F.col("thread.at") > start, F.col("thread.id")).otherwise(F.lit(0))
    thread = _name("__vmpow__thread", F.format_string("%02d", thread_id), F.lit("__"))
    thread_field = F.replace(_part(THREAD_VALUE, 2), F.lit(" "), F.lit("_"))
    return [
        (inside("gc") & kept & _is(GLOBAL_COUNTER), F.array(_sample(_name("__gc__", _part(GLOBAL_COUNTER)), _part(GLOBAL_COUNTER, 2)))),
        (inside("cpu15m") & F.col("core_row"), core),
        (inside("cache") & _is(CACHE_ROW), _columns(_name("__ct__", sanitise(_part(CACHE_ROW))), CACHE_ROW, CACHE_COLUMNS, 2)),
        (inside("pertask") & task_row, task),
        (inside("mempool") & _is(NAMED_ROW), leading("__pool__mempool__", MEM_POOL_COLUMNS)),
        (inside("sharedpool") & _is(NAMED_ROW), leading("__pool__sharedpool__", SHARED_POOL_COLUMNS)),
        (inside("softpool") & _is(SOFT_POOL_ROW), pool("softpool", SOFT_POOL_ROW)),
        (inside("powpool") & _is(POW_POOL_ROW), pool("powpool", POW_POOL_ROW)),
        (inside("procus_func") & _is(TIMING_ROW), named("__procus__func__", TIMING_ROW, TIMING_COLUMNS)),
        (inside("procus_group") & _is(TIMING_ROW), named("__procus__group__", TIMING_ROW, TIMING_COLUMNS)),
        (inside("procusd") & _is(TIMING_DETAIL_ROW) & (F.col("section.name") != ""), _columns(timing, TIMING_DETAIL_ROW, TIMING_DETAIL_COLUMNS, 2)),
        (inside("ru") & resource_row, resource),
        ((F.col("section.mode") == "si") & (line >= start), _session_rows()),
        (inside("vmpow") & _is(THREAD_VALUE), F.array(_sample(F.concat(thread, thread_field), _part(THREAD_VALUE, 3)))),
        (inside("vmpow") & _is(IO_WQE), F.array(*[_sample(F.concat(thread, F.lit(f"io_wqe_{n}")), _part(IO_WQE, i + 1)) for i, n in enumerate(("alloc", "null"))])),
        (inside("vmpow") & _is(INFLIGHT_WQE), F.array(_sample(_name("__vmpow__total_inflight_wqe"), _part(INFLIGHT_WQE, 1)))),
        (inside("vmpow") & _is(USED_WQE), F.array(*[_sample(_name(f"__vmpow__used_wqe{n}"), _part(USED_WQE, i + 1)) for i, n in enumerate(("", "_total", "_pct"))])),
        (inside("vmpow") & _is(RECEIVE_THRESHOLD), F.array(_sample(_name("__vmpow__rcv_thresh"), _part(RECEIVE_THRESHOLD, 1)))),
    ]


def _long(rows: DataFrame, samples: Column) -> DataFrame:
    # a column first: a generator with a lambda in it would be interpreted; no filter is inferred from a coalesced one
    built = rows.select("file_id", "entry_ord", "line_no", "ts", samples.alias("_samples"))
    each = F.posexplode(F.coalesce("_samples", F.array().cast(SAMPLE)))
    exploded = built.select("file_id", "entry_ord", "line_no", "ts", each.alias("emit_ord", "s"))
    ts = F.timestamp_add("MINUTE", -F.col("s.minutes"), F.col("ts"))
    value = number_or_zero(F.col("s.text")).alias("value")
    return exploded.select("file_id", "s.name", ts.alias("ts"), value, "entry_ord", "line_no", "emit_ord")


def socket_queues(rows: DataFrame) -> DataFrame:
    """Receive and send queues summed per protocol and program of one block."""
    f = fields(_clean())
    program = F.regexp_extract(F.get(f, F.size(f) - 1), SOCKET_PROGRAM, 2)
    sockets = rows.where(F.col("block") == "netstat_detail").where(
        (F.size(f) >= 6) & (_clean().startswith("tcp") | _clean().startswith("udp")) & (program != "")
    )
    base = _name("__netstat_detail__", sanitise(f[0]), F.lit("_"), sanitise(program))
    sockets = sockets.select(
        *BLOCK, "ts", base.alias("base"), number_or_zero(f[1]).alias("recv_q"), number_or_zero(f[2]).alias("send_q")
    )
    sums = sockets.groupBy(*BLOCK, "ts", "base").agg(F.sum("recv_q").alias("r"), F.sum("send_q").alias("s"))
    queues = F.array(
        F.struct(F.concat("base", F.lit("_recv_q")).alias("name"), F.col("r").alias("value")),
        F.struct(F.concat("base", F.lit("_send_q")).alias("name"), F.col("s").alias("value")),
    )
    exploded = sums.select("file_id", "entry_ord", "ts", F.col("block_at").alias("line_no"), F.posexplode(queues).alias("emit_ord", "q"))
    return exploded.select("file_id", "q.name", "ts", "q.value", "entry_ord", "line_no", "emit_ord")


def application_volumes(rows: DataFrame, app_names: DataFrame | None = None) -> DataFrame:
    """Per-application volumes; ids become names through (file_id, app_id, name), else `app-<id>`."""
    window = Window.partitionBy(*BLOCK).orderBy("line_no")
    apps = rows.where((F.col("block") == "panio_infreq") & (_is(APP_VSYS) | _is(APP_ROW)))
    apps = apps.withColumn("vsys", F.coalesce(F.last(extract(_clean(), APP_VSYS), ignorenulls=True).over(window), F.lit("1")))
    apps = apps.where(_is(APP_ROW)).withColumn("app_id", _part(APP_ROW).try_cast("int"))
    apps = apps.where(F.col("app_id").isNotNull())
    label = F.concat(F.lit("app-"), F.col("app_id"))
    if app_names is not None:
        known = app_names.where(F.col("name") != "").select("file_id", "app_id", F.col("name").alias("_known"))
        apps = apps.join(known, ["file_id", "app_id"], "left")
        label = F.coalesce("_known", label)
    base = _name("__appstats__vsys", sanitise(F.col("vsys")), F.lit("_"), sanitise(label))
    return _long(apps, _columns(base, APP_ROW, APP_METRICS, 2))


def extract_counters(
    lines: DataFrame, app_names: DataFrame | None = None, monitor_file: str = MONITOR_FILE, dedupe: bool = False
) -> DataFrame:
    """Every counter sample as (file_id, name, ts, value) with its place in the log.

    Overlapping tables repeat (name, ts); `dedupe` keeps the last one.
    """
    rows = settle(blocks(lines, monitor_file))
    states = _states(rows.where(~F.col("block").isin("netstat_detail", "panio_infreq")))
    own = F.col("block").isin(*OWN_FORMAT)
    # split once, not for every value of a line
    states = states.select("*", computed(F.when(own, fields(_clean())).alias("words")))
    samples = F.when(own, first_case(_block_rows())).otherwise(first_case(_section_rows()))
    counters = _long(states, samples).unionByName(socket_queues(rows)).unionByName(application_volumes(rows, app_names))
    if not dedupe:
        return counters
    place = F.struct("entry_ord", "line_no", "emit_ord")
    last = F.max_by(F.struct("value", *["entry_ord", "line_no", "emit_ord"]), place)
    return counters.groupBy("file_id", "name", "ts").agg(last.alias("_l")).select("file_id", "name", "ts", "_l.*")
