"""Endpoint-agent connection logs: timeline, overview, connection attempts and authentication events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.text import any_case, base_name, computed, extract, first_case, groups, rows_where, trimmed, unix
from logquarry.functions.timestamps import agent_timestamp
from logquarry.operators.ordered import CHUNK, by_lines, by_range, settle
from logquarry.operators.structure import EVENT_LINE

# Log names, phases, stages, markers and message shapes.
EVENT_LOG = "pan_gp_event.log"
SERVICE_LOG = "pangps.log"
TIMELINE_LOGS = ("pan_gp_event.log", "pan_gpa_event.log", "pan_cp_events.log", "pan_gpa_cp_event.log")
PHASES = (
    (r"failed to pre ?- ?login", "prelogin", "fail"),
    (r"auth failed|authentication failed", "auth", "fail"),
    (r"portal status is Connected|portal login completed", "portal", "ok"),
    (r"invalid portal|portal is unresponsive", "portal", "fail"),
    (r"gateway is unresponsive|no network connectivity", "gateway", "fail"),
    (r"tunnel is up|tunnel connected|tunnel established", "tunnel", "ok"),
    (r"service started|PanGPS service|service stopped", "service", ""),
    (r"captive|CP_DETECT|CP_GENERAL|CP Log|webview|CPanCPView", "captive-portal", ""),
    (r"portal pre ?- ?login|prelogin|CheckServerCert", "prelogin", ""),
    (r"PanPUAC|cookie|SSO starts|logging into portal|portal login starts|SAML|auth", "auth", ""),
    (r"connect method|prelogon status|portal", "portal", ""),
    (r"gateway", "gateway", ""),
    (r"hip", "hip", ""),
    (r"network discovery|discovering (internal|external)", "discovery", ""),
    (r"disconnect|tunnel", "tunnel", ""),
)
STAGES = (
    "portal pre-login", "portal auth", "portal config", "network discovery",
    "gateway select", "gateway auth", "tunnel", "HIP",
)
STAGE_MARKERS = (
    (r"failed to pre ?- ?login to the portal", "portal pre-login", "failed", "pre-login got no answer"),
    (r"portal status is Invalid portal", "portal pre-login", "failed", "bad portal address, or no route to it"),
    (r"portal pre-login result received", "portal pre-login", "ok", ""),
    (r"started the portal pre ?- ?login", "portal pre-login", "reached", ""),
    (r"auth failed for portal|portal status is User authentication failed", "portal auth", "failed", "sign-in refused by the portal"),
    (r"portal status is Connected", "portal auth", "ok", ""),
    (r"portal login starts|logging into portal", "portal auth", "reached", ""),
    (r"portal login completed with address", "portal config", "ok", ""),
    (r"matching client config not found|no client configuration", "portal config", "failed", "no client configuration fits"),
    (r"network discovery started|discovering (internal|external) network", "network discovery", "reached", ""),
    (r"gateway pre-?login starts to|prelogin to gateway", "gateway select", "ok", ""),
    (r"gateway login (finished|starts) ", "gateway auth", "reached", ""),
    (r"(auto |manual )?gateway login finished with address", "gateway auth", "ok", ""),
    (r"(ipsec|ssl) tunnel creation finished", "tunnel", "ok", ""),
    (r"trying to create tunnel with gateway", "tunnel", "reached", ""),
    (r"tunnel creation failed|failed to create tunnel", "tunnel", "failed", "no tunnel came up"),
    (r"hip report submitted to the gateway", "HIP", "ok", ""),
    (r"completed hip report check with gateway", "HIP", "reached", ""),
)
NO_GATEWAY = (r"network connection is unreachable or the gateway is unresponsive", "gateway select", "every gateway was out of reach")
NO_NETWORK = (r"no network connectivity", "portal pre-login", "no network on the way to the portal")
ATTEMPT_START = r"^(started the portal pre ?- ?login|SSO starts)"
ATTEMPT_GAP_SECONDS = 2
FLOW_PORTAL = r"(?:portal|to the portal) ([A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z0-9.\-]+)"
FLOW_GATEWAY = r"(?:gateway|with Gateway|to gateway) ([A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z0-9.\-]+)"
FLOW_USER = r"and user (\S+?)\.?$"
BROWSER = r"Load the SAML Browser|ShowPage - using (embedded|default) browser|SAMLDlg"
COOKIE_READ = r"Unserialized non-empty cookie for portal (\S+) and user (\S+)"
CREDENTIALS = r"Enter login credentials|authentication-message"
GATEWAY_LOGIN = r"Gateway (pre-?Login Starts|Login starts)"
PORTAL_SETTLED = r"portal status is (Connected|User authentication failed|Invalid portal)|Auth failed for portal"
CLIENT_VERSION = r"GlobalProtect service started \(client version: ([^,]+), OS version: ([^)]*)\)"
SERVICE_VERSION = r"Start PanGPS service \(ver: ([^)]+)\)"
PORTAL_EXPLICIT = r"portal (?:login completed with address|pre ?- ?login to the portal) (\S+)"
PORTAL_MENTION = r"(?:for|to) portal ([A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z0-9.\-]+)"
COOKIE_USER = r"cookie for portal \S+ and user (\S+)"
CONNECT_METHOD = r"Connect method is (\S+)"
PORTAL_STATUS = r"portal status is (.+?)\.?$"
GATEWAY_PRIORITY = r"gateway ([A-Za-z0-9][A-Za-z0-9.\-]*), priority"
HOST_PAIR = r"^([A-Z][A-Za-z /()]+):\s{2,}(.*\S)\s*$"
HOST_KEYS = {
    "host_name": "Host Name", "os_name": "OS Name", "os_version": "OS Version", "vendor": "System Manufacturer",
    "model": "System Model", "total_mem_mb": "Total Physical Memory", "boot_time": "System Boot Time",
}
REPORT_TAGS = {"hip_user": "user-name", "hip_host_id": "host-id", "hip_ip": "ip-address", "hip_generated": "generate-time"}
METHOD_LABELS = {"browser": "SAML (browser)", "cookie": "cookie reuse", "credentials": "credentials"}
OUTCOME_WORDS = {"ok": "success", "failed": "failed", "reached": "incomplete"}

PLACE = ("entry_ord", "line_no")


def event_lines(lines: DataFrame, logs: tuple[str, ...] = (EVENT_LOG,)) -> DataFrame:
    """Event-format lines of the named logs as (file_id, entry_ord, line_no, source, ts, severity, msg)."""
    rows = lines.where(base_name(F.col("path")).isin(*logs))
    found = computed(groups(F.rtrim(F.col("text"), F.lit("\r")), EVENT_LINE, 5).alias("_part"))
    rows = rows.select("file_id", *PLACE, base_name(F.col("path")).alias("source"), found)
    part = F.col("_part")
    events = rows.select(
        "file_id",
        *PLACE,
        "source",
        rows_where(
            part.isNotNull(),
            agent_timestamp(part[0], part[1]).alias("ts"),
            trimmed(part[3]).alias("severity"),
            part[4].alias("msg"),
        ),
    )
    return events.where(F.col("ts").isNotNull())


def _says(pattern: str) -> Column:
    return F.col("msg").rlike(any_case(pattern))


def _found(pattern: str, group: int = 1) -> Column:
    """Group of the first match, null without a match; none of the patterns has an empty group."""
    return F.nullif(F.regexp_extract("msg", any_case(pattern), group), F.lit(""))


def phase(msg: Column, severity: Column) -> Column:
    """(phase, outcome) of the first matching rule; an error without an outcome counts as failed."""
    row = first_case(
        [
            (msg.rlike(any_case(p)), F.struct(F.lit(name).alias("phase"), F.lit(outcome).alias("outcome")))
            for p, name, outcome in PHASES
        ],
        F.struct(F.lit("").alias("phase"), F.lit("").alias("outcome")),
    )
    failed = (row["outcome"] == "") & (F.lower(severity) == "error")
    return F.struct(row["phase"].alias("phase"), F.when(failed, F.lit("fail")).otherwise(row["outcome"]).alias("outcome"))


def timeline(lines: DataFrame, limit: int = 0) -> DataFrame:
    """Classified events of each archive in time order; with a limit the latest ones."""
    events = event_lines(lines, TIMELINE_LOGS)
    rows = by_range(events, ("file_id",), ("ts", *PLACE)).positions("ord", "_n").rows()
    if limit > 0:
        rows = rows.where(F.col("ord") > F.col("_n") - limit)
    return rows.select(*[c for c in rows.columns if c != "_n"], F.inline(F.array(phase(F.col("msg"), F.col("severity")))))


def phase_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("file_id", "phase").agg(F.count(F.lit(1)).alias("count"))


def problems(events: DataFrame) -> DataFrame:
    return events.where((F.col("outcome") == "fail") | (F.lower("severity") == "error"))


def _attempt_starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decide which start markers open an attempt; the state of one stretch is three small values."""
    stretch = None
    start = gateway = awaiting = None
    for batch in batches:
        keep = []
        for i, row in enumerate(batch.itertuples(index=False)):
            key = (row.file_id, row.reset_entry, row.reset_line)
            if key != stretch:
                stretch, start = key, None
            if row.is_start and (start is None or (not awaiting and row.seconds - start > ATTEMPT_GAP_SECONDS)):
                start, gateway, awaiting = row.seconds, False, False
                keep.append(i)
            gateway = gateway or row.is_gateway
            if row.is_browser and not gateway:
                awaiting = True
            if row.is_settled:
                awaiting = False
        yield batch.iloc[keep][["file_id", "entry_ord", "line_no"]]


MARKS = {"is_start": ATTEMPT_START, "is_browser": BROWSER, "is_gateway": GATEWAY_LOGIN, "is_settled": PORTAL_SETTLED}


def marked(events: DataFrame) -> DataFrame:
    """Events with their marks, settled: the steps below read them many times."""
    return settle(events.select("*", computed(*[_says(p).alias(n) for n, p in MARKS.items()])))


def attempt_starts(events: DataFrame) -> DataFrame:
    """Places of the lines that open a connection attempt."""
    return _starts(marked(events))


def _starts(events: DataFrame) -> DataFrame:
    """Places of the lines of marked events that open a connection attempt.

    Only marker lines matter. A start marker opens an attempt whatever happened before it when no browser
    prompt is open and every earlier start marker is more than the gap away; the marker lines are cut at
    these certain starts, and only the stretches between them are decided in order.
    """
    flagged = events.select("file_id", *PLACE, "ts", *MARKS)
    flagged = flagged.where(F.col("is_start") | F.col("is_browser") | F.col("is_gateway") | F.col("is_settled"))
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    place = F.struct(*PLACE)
    flagged = flagged.select(
        "*",
        seconds.alias("seconds"),
        F.when(F.col("is_browser"), place).alias("_browser"),
        F.when(F.col("is_settled"), place).alias("_settled"),
        F.when(F.col("is_start"), seconds).alias("_start"),
    )
    rows = by_lines(flagged, ("file_id",), PLACE).carry(above={"browser": "_browser", "settled": "_settled"})
    rows = rows.running({"latest_start": "_start"}, "max", exclusive=True)
    open_prompt = F.col("browser").isNotNull() & (F.col("settled").isNull() | (F.col("settled") < F.col("browser")))
    far = F.col("latest_start").isNull() | (F.col("seconds") - F.col("latest_start") > ATTEMPT_GAP_SECONDS)
    certain = F.col("is_start") & far & (F.col("latest_start").isNull() | ~open_prompt)
    # `carry` and `running` read their rows twice, so that steps on top of each other would repeat the first ones
    rows = rows._with(settle(rows.df.select("file_id", *PLACE, CHUNK, "seconds", *MARKS, F.when(certain, place).alias("_reset"))))
    rows = rows.carry({"reset_at": "_reset"}).rows().where(F.col("reset_at").isNotNull())
    rows = rows.select(
        "file_id", *PLACE, F.col("reset_at.entry_ord").alias("reset_entry"), F.col("reset_at.line_no").alias("reset_line"), "seconds", *MARKS
    )
    return (
        rows.repartition("file_id", "reset_entry", "reset_line")
        .sortWithinPartitions("file_id", "reset_entry", "reset_line", *PLACE)
        .mapInPandas(_attempt_starts, rows.select("file_id", *PLACE).schema)
    )


ATTEMPT = ("file_id", "attempt_at")


def attempt_lines(events: DataFrame, strict_gateway_ok: bool = False) -> DataFrame:
    """Event lines with their attempt, whether its gateway phase has begun, and the stage marker they match.

    With `strict_gateway_ok` the specific gateway-login marker is tried before the general one.
    """
    order = list(range(len(STAGE_MARKERS)))
    if strict_gateway_ok:
        order[11], order[12] = order[12], order[11]
    kept = events.columns
    events = marked(events)
    starts = settle(_starts(events).withColumn("_opens", F.struct(*PLACE)))
    rows = events.join(starts, ["file_id", *PLACE], "left")
    rows = rows.withColumn("_gateway", F.when(F.col("is_gateway"), F.struct(*PLACE)))
    rows = by_lines(rows, ("file_id",), PLACE).carry({"attempt_at": "_opens", "gateway_at": "_gateway"}).rows()
    at_gateway = F.coalesce(F.col("gateway_at") >= F.col("attempt_at"), F.lit(False))
    rows = rows.where(F.col("attempt_at").isNotNull()).select(*kept, "attempt_at", at_gateway.alias("at_gateway"))
    marker = first_case([(_says(STAGE_MARKERS[i][0]), F.lit(i)) for i in order])
    return settle(rows.select("*", computed(marker.alias("marker"))))


def stage_results(rows: DataFrame) -> DataFrame:
    """Status of every stage an attempt touched: failed beats ok beats reached, later lines win ties.

    The two unspecific failures only count when the stage was not already ok at that moment.
    """

    def hit(stage: str, status: str, detail: Column) -> Column:
        return F.struct(F.lit(STAGES.index(stage)).alias("stage"), F.lit(status).alias("status"), detail.alias("detail"))

    marker = first_case(
        [
            (F.col("marker") == i, F.array(hit(stage, status, F.lit(reason) if reason else F.col("msg"))))
            for i, (_, stage, status, reason) in enumerate(STAGE_MARKERS)
        ]
    )
    general = F.array_compact(
        F.array(*[F.when(_says(p), hit(stage, "forced", F.lit(detail))) for p, stage, detail in (NO_GATEWAY, NO_NETWORK)])
    )
    hits = rows.select(*ATTEMPT, *PLACE, "ts", F.inline(F.when(F.col("marker").isNotNull(), marker).otherwise(general)))
    place, status = F.struct(*PLACE), F.col("status")

    def first(name: str) -> Column:
        return F.min(F.when(status == name, place))

    def last(*names: str) -> Column:
        return F.max(F.when(status.isin(*names), F.struct(*PLACE, "ts", "detail")))

    stages = hits.groupBy(*ATTEMPT, "stage").agg(
        first("ok").alias("ok_at"),
        first("failed").alias("failed_at"),
        first("forced").alias("forced_at"),
        last("failed", "forced").alias("failure"),
        last("ok").alias("success"),
        last("reached").alias("touched"),
    )
    forced = F.col("forced_at").isNotNull() & (F.col("ok_at").isNull() | (F.col("forced_at") < F.col("ok_at")))
    failed = F.col("failed_at").isNotNull() | forced
    result = F.when(failed, F.col("failure")).otherwise(F.coalesce("success", "touched"))
    word = F.when(failed, "failed").when(F.col("success").isNotNull(), "ok").otherwise("reached")
    results = stages.select(*ATTEMPT, "stage", word.alias("status"), result["ts"].alias("at"), result["detail"].alias("detail"))
    return settle(results.where(F.col("at").isNotNull()))


def attempts(lines: DataFrame, strict_gateway_ok: bool = False) -> DataFrame:
    """One row per connection attempt with its furthest stage, verdict and authentication."""
    rows = attempt_lines(event_lines(lines), strict_gateway_ok)
    return attempt_table(rows, stage_results(rows))


def attempt_table(rows: DataFrame, stages: DataFrame) -> DataFrame:
    place, msg = F.struct(*PLACE), F.col("msg")
    kind = first_case(
        [(_says(BROWSER), F.lit("browser")), (_says(COOKIE_READ), F.lit("cookie")), (_says(CREDENTIALS), F.lit("credentials"))]
    )
    portal, user = _found(FLOW_PORTAL), _found(FLOW_USER)
    user = F.when(F.lower(user) != "pre-logon", F.rtrim(user, F.lit(".")))
    late = ("gateway auth", "tunnel", "HIP")
    after_select = F.col("marker").isin([i for i, m in enumerate(STAGE_MARKERS) if m[1] in late])
    gateway = F.when(after_select, _found(FLOW_GATEWAY))
    # settled: read for `base` and for the waits, which read `base` again
    facts = settle(rows.select(
        *ATTEMPT, *PLACE, "ts", "at_gateway",
        computed(
            kind.alias("kind"), portal.alias("portal"), user.alias("user"), gateway.alias("gateway"),
            F.lower(msg).contains("logging into portal").alias("entering"),
        ),
    ))
    at_portal = ~F.col("at_gateway")
    browser = F.col("kind") == "browser"

    def first(column: str, condition: Column) -> Column:
        return F.min_by(column, F.when(condition, place))

    base = settle(facts.groupBy(*ATTEMPT).agg(
        F.min_by("ts", place).alias("start"),
        F.max_by("ts", place).alias("end"),
        F.count(F.lit(1)).alias("events"),
        first("portal", F.col("portal").isNotNull()).alias("portal"),
        first("user", F.col("user").isNotNull()).alias("user"),
        F.max_by("gateway", F.when(F.col("gateway").isNotNull(), place)).alias("gateway"),
        F.min(F.when(at_portal & browser, F.struct(*PLACE, "ts"))).alias("prompt"),
        first("kind", at_portal & F.col("kind").isin("cookie", "credentials")).alias("other_portal"),
        F.max(F.col("at_gateway") & browser).alias("gateway_browser"),
        F.max(F.col("at_gateway") & (F.col("kind") == "cookie")).alias("gateway_cookie"),
    ))
    entering = facts.where(F.col("entering")).join(base.where(F.col("prompt").isNotNull()).select(*ATTEMPT, "prompt"), list(ATTEMPT))
    wait = F.timestamp_diff("SECOND", F.col("prompt.ts"), F.col("ts")).cast("double")
    entering = entering.withColumn("wait", wait).where((F.col("wait") != 0) & (place >= F.struct("prompt.entry_ord", "prompt.line_no")))
    waits = entering.groupBy(*ATTEMPT).agg(F.min_by("wait", place).alias("wait"))
    failed = F.col("status") == "failed"
    verdicts = stages.groupBy(*ATTEMPT).agg(
        F.max("stage").alias("furthest"),
        F.min(F.when(failed, F.col("stage"))).alias("first_fail"),
        F.min_by("detail", F.when(failed, F.col("stage"))).alias("fail_detail"),
        F.max((F.col("stage") == STAGES.index("tunnel")) & (F.col("status") == "ok")).alias("tunnel"),
    )
    joined = base.join(verdicts, list(ATTEMPT), "left").join(waits, list(ATTEMPT), "left")
    names = F.array(*[F.lit(s) for s in STAGES])
    reached = F.get(names, F.col("furthest"))
    has_failed, tunnel = F.col("first_fail").isNotNull(), F.coalesce("tunnel", F.lit(False))
    portal_auth = F.when(F.col("prompt").isNotNull(), F.lit("browser")).otherwise(F.col("other_portal"))
    gateway_auth = F.when(F.col("gateway_browser"), F.lit("browser")).when(F.col("gateway_cookie"), F.lit("cookie"))
    idle = F.concat(F.lit("the attempt stopped after "), reached, F.lit(" with no further activity"))
    return joined.select(
        *ATTEMPT,
        "start",
        "end",
        "events",
        "portal",
        "user",
        "gateway",
        portal_auth.alias("portal_auth"),
        gateway_auth.alias("gateway_auth"),
        F.coalesce("wait", F.lit(0.0)).alias("wait_secs"),
        F.coalesce(portal_auth.isin("browser", "credentials") & (gateway_auth == "cookie"), F.lit(False)).alias("single_sign_on"),
        reached.alias("reached"),
        F.when(has_failed, F.get(names, F.col("first_fail"))).when(~tunnel, reached).alias("stop_at"),
        F.when(has_failed, "failed").when(tunnel, "connected").otherwise("incomplete").alias("outcome"),
        F.when(has_failed, F.col("fail_detail")).when(~tunnel, idle).alias("reason"),
    )


def stage_matrix(attempt_rows: DataFrame, stages: DataFrame) -> DataFrame:
    """Every attempt with all stages in order; a stage without a result is `not reached`."""
    every = attempt_rows.select(*ATTEMPT, F.posexplode(F.array(*[F.lit(s) for s in STAGES])).alias("stage", "stage_name"))
    return every.join(stages, [*ATTEMPT, "stage"], "left").withColumn("status", F.coalesce("status", F.lit("not reached")))


def stop_summary(attempt_rows: DataFrame) -> DataFrame:
    """Connected attempts, and the stage where most of the others stopped (the earliest seen on a tie)."""
    stops = attempt_rows.groupBy("file_id", "stop_at", (F.col("outcome") == "connected").alias("connected")).agg(
        F.count(F.lit(1)).alias("n"), F.min("attempt_at").alias("seen")
    )
    open_stop = ~F.col("connected") & F.col("stop_at").isNotNull()
    worst = F.min_by(F.struct("stop_at", "n"), F.when(open_stop, F.struct(-F.col("n"), F.col("seen"))))
    summary = stops.groupBy("file_id").agg(
        F.coalesce(F.sum(F.when(F.col("connected"), F.col("n"))), F.lit(0)).alias("connected"),
        F.sum("n").alias("attempts"),
        worst.alias("w"),
    )
    return summary.select("file_id", "connected", "attempts", "w.stop_at", F.col("w.n").alias("stopped"))


def _words(value: Column, words: dict[str, str], default: str) -> Column:
    return first_case([(value == k, F.lit(w)) for k, w in words.items()], F.lit(default))


def auth_events(attempt_rows: DataFrame, stages: DataFrame) -> DataFrame:
    """Up to two rows per attempt: sign-in at the portal and at the gateway."""
    def stage(name: str, prefix: str) -> DataFrame:
        rows = stages.where(F.col("stage") == STAGES.index(name))
        return rows.select(*ATTEMPT, *[F.col(c).alias(f"{prefix}_{c}") for c in ("status", "at", "detail")])

    joined = attempt_rows.join(stage("portal auth", "p"), list(ATTEMPT), "left").join(stage("gateway auth", "g"), list(ATTEMPT), "left")
    portal_ts = F.coalesce("p_at", "start")

    def row(target: str, ts: Column, address: str, method: str, prefix: str, wait: Column, sso: Column) -> Column:
        return F.struct(
            F.lit(target).alias("target"),
            ts.alias("ts"),
            F.col(address).alias("address"),
            _words(F.col(method), METHOD_LABELS, "").alias("method"),
            _words(F.col(f"{prefix}_status"), OUTCOME_WORDS, "not reached").alias("outcome"),
            F.col(f"{prefix}_detail").alias("detail"),
            wait.alias("wait_secs"),
            sso.alias("single_sign_on"),
        )

    both = F.array(
        F.when(
            F.col("p_status").isNotNull() | F.col("portal_auth").isNotNull(),
            row("portal", portal_ts, "portal", "portal_auth", "p", F.col("wait_secs"), F.lit(False)),
        ),
        F.when(
            F.col("g_status").isNotNull() | F.col("gateway_auth").isNotNull(),
            row("gateway", F.coalesce(F.col("g_at"), portal_ts), "gateway", "gateway_auth", "g", F.lit(0.0), F.col("single_sign_on")),
        ),
    )
    return joined.select(*ATTEMPT, "user", F.inline(F.array_compact(both)))


def filter_auth(events: DataFrame, needle: str = "", only: str = "") -> DataFrame:
    """Rows of one target or only failures, containing a text in any shown column."""
    if only in ("portal", "gateway"):
        events = events.where(F.col("target") == only)
    elif only == "failed":
        events = events.where(F.col("outcome") == "failed")
    shown = F.concat_ws(" ", "user", "target", "address", "method", "outcome", "detail")
    return events.where(F.lower(shown).contains(needle.strip().lower())) if needle.strip() else events


def auth_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if("single_sign_on").alias("single_sign_on"),
    )


def overview(lines: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Host, versions, portal, user and last state of each archive; `nodes` adds the posture report's tags."""
    base, text = base_name(F.col("path")), F.rtrim(F.col("text"), F.lit("\r"))
    part = groups(text, EVENT_LINE, 5)
    # lines of the other files keep their text as the message
    rows = lines.where(base.isin("systeminfo.txt", EVENT_LOG, SERVICE_LOG)).select(
        "file_id", *PLACE, base.alias("base"), text.alias("text"), part.alias("p")
    )
    is_event = (F.col("base") == EVENT_LOG) & F.col("p").isNotNull()
    rows = rows.where((F.col("base") != EVENT_LOG) | is_event).select(
        "file_id", *PLACE, "base", F.coalesce(F.col("p")[4], F.col("text")).alias("msg"),
        F.when(is_event, agent_timestamp(F.col("p")[0], F.col("p")[1])).alias("ts"),
    )
    place = F.struct(*PLACE)
    in_event, in_service, in_host = (F.col("base") == b for b in (EVENT_LOG, SERVICE_LOG, "systeminfo.txt"))

    def last(value: Column, where: Column) -> Column:
        return F.max_by(value, F.when(where & value.isNotNull(), place))

    def first(value: Column, where: Column) -> Column:
        return F.min_by(value, F.when(where & value.isNotNull(), place))

    version = extract(F.col("msg"), CLIENT_VERSION, 1)
    version_os = extract(F.col("msg"), CLIENT_VERSION, 2)
    user = _found(COOKIE_USER)
    user = F.when(F.lower(user) != "pre-logon", user)
    key, value = trimmed(F.regexp_extract("msg", HOST_PAIR, 1)), extract(F.col("msg"), HOST_PAIR, 2)
    host = {c: last(F.when(key == k, value), in_host) for c, k in HOST_KEYS.items()}
    host["os_name"] = F.coalesce(host["os_name"], first(F.when(trimmed(version_os) != "", trimmed(version_os)), in_event))
    stamp = "yyyy-MM-dd HH:mm:ss"
    result = rows.groupBy("file_id").agg(
        last(trimmed(version), in_event).alias("client_version"),
        first(extract(F.col("msg"), SERVICE_VERSION), in_service).alias("service_version"),
        F.coalesce(last(_found(PORTAL_EXPLICIT), in_event), first(_found(PORTAL_MENTION), in_event)).alias("portal"),
        first(_found(GATEWAY_PRIORITY), in_service).alias("gateway"),
        last(user, in_event).alias("user"),
        last(_found(CONNECT_METHOD), in_event).alias("connect_method"),
        last(trimmed(_found(PORTAL_STATUS)), in_event).alias("final_state"),
        *[c.alias(n) for n, c in host.items()],
        F.date_format(F.min("ts"), stamp).alias("first_seen"),
        F.date_format(F.max("ts"), stamp).alias("last_seen"),
    )
    if nodes is None:
        return result
    tags = [*REPORT_TAGS.values(), "host-name"]
    heads = nodes.where(F.col("tag").isin(*tags)).groupBy("file_id", "path", "entry_ord", "tag")
    heads = heads.agg(F.min_by("text", "ord").alias("value"))
    report = heads.groupBy("file_id").agg(
        *[F.max_by("value", F.when(F.col("tag") == t, F.col("entry_ord"))).alias(c) for c, t in REPORT_TAGS.items()],
        F.min_by("value", F.when((F.col("tag") == "host-name") & (F.col("value") != ""), F.col("entry_ord"))).alias("_host"),
    )
    joined = result.join(report, "file_id", "full")
    return joined.withColumn("host_name", F.coalesce("host_name", "_host")).drop("_host")
