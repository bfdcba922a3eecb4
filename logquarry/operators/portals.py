"""Portals the endpoint agent talked to: identity facts, gateway rounds and outcomes.

Lines are cut into segments by the pre-login marker. Facts logged before a segment names its portal
bind to the first portal named after them; later facts go to the portal named last. A discovery line
opens a gateway round that is committed by the choice of a gateway or by the next discovery line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.text import any_case, groups, trimmed, unix
from logquarry.functions.timestamps import agent_timestamp
from logquarry.operators.agentlogs import PLACE, place, service_lines
from logquarry.operators.ordered import by_lines, settle
from logquarry.operators.structure import EVENT_LINE, TRACE_LINE

# Line shapes.
PRELOGIN = "----Portal Pre-login starts----"
REGION_CODE = r"REGION-PRIO, region code is (\S+)"
REGION_TAG = r"<region>([^<]+)</region>"
SAML_METHOD = r"<saml-auth-method>([^<]+)</saml-auth-method>"
CLOUD_AUTH = "<cas-auth>yes</cas-auth>"
TENANT = r"<tenant-id>([^<]+)</tenant-id>"
EMBEDDED_BROWSER = "<cas-embedded-browser>yes</cas-embedded-browser>"
DEFAULT_BROWSER = "<default-browser>yes</default-browser>"
AUTH_MESSAGE = r"authentication-message>([^<]*)"
COOKIE_USER = r"(?:Serialize|Unserialize)d? non-empty cookie for portal (\S+) and user (\S+)"
COOKIE_PORTAL = r"(?:Serialize|Unserialize)d? (?:non-)?empty cookie for portal (\S+) and"
LOGIN_DONE = r"Portal login completed with address (\S+)"
DISCOVER = r"Discover (external|internal) gateway: gateway count is (\d+), cutoff time is (\d+)"
PRIORITY = r"^.*?gateway (\S+) priority is (-?\d+)"
MANUAL_ONLY = r"gateway (\d+) of (\S+) is manual select only"
REGION_EXCLUDED = r"REGION-PRIO, gateway (\d+) is not selectable base on region"
DESCRIPTION = r"Process gateway: host (\S+), description (.+?)\s*$"
ADDRESS = r"Gateway (\S+?)\(([^)]*)\): ipv4 (\S*), ipv6"
WEIGHT = r"gateway (.+?) \((\S+?)\), priority=(-?\d+), duration=(\d+) ms, assign (-?\d+) as its weight"
CHOSEN = r"chose prefered gateway index =(-?\d+), gateway is (.+?)\s*$"
TUNNEL_UP = r"(ipsec|ssl) tunnel creation finished"
REPORT_SENT = r"HIP Report submitted to the Gateway"
SERVER_VERSION = r"<panos-version>([^<]+)</panos-version>"
ASSIGNED_IP = r"<ip-address>([0-9.]+)</ip-address>"
GATEWAY_USER = r"<user>([^<]+)</user>"

PORTAL = ("file_id", "address")
ROUND = ("file_id", "round_at")


def _text() -> Column:
    return F.col("text")


def _got(pattern: str, group: int = 1, gate: str | None = None) -> Column:
    """Group of a match or null; `gate` is a literal every match contains, tested first."""
    hit = _text().rlike(pattern)
    if gate:
        hit = _text().contains(gate) & hit
    return F.when(hit, F.regexp_extract("text", pattern, group))


def portal_lines(lines: DataFrame) -> DataFrame:
    """Lines with any fact, the portal and segment they fall into, and their gateway round."""
    event, trace = groups(_text(), EVENT_LINE, 5), groups(_text(), TRACE_LINE, 8)
    ts = F.coalesce(agent_timestamp(trace[4], trace[5]), agent_timestamp(event[0], event[1]))
    low = F.lower("text")
    cookie, done, other = (any_case(p) for p in (COOKIE_USER, LOGIN_DONE, COOKIE_PORTAL))
    cookie_user = F.when(low.contains("cookie for portal"), _got(cookie, 2))
    named = F.coalesce(
        F.when(low.contains("cookie for portal"), _got(cookie)),
        F.when(low.contains("portal login completed"), F.regexp_replace(_got(done), r"\.$", "")),
        F.when(low.contains("cookie for portal"), _got(other)),
    )
    signed_in = low.contains("portal login completed") & _text().rlike(done) & cookie_user.isNull()
    user = F.regexp_replace(cookie_user, r"\.$", "")
    message = _got(any_case(AUTH_MESSAGE))
    is_gateway = low.contains("gateway")
    parts = {
        "ts": ts,
        "prelogin": F.when(_text().contains(PRELOGIN), place()),
        "named": F.when(named != "", F.struct(*PLACE, named.alias("address"))),
        "user": F.when((user != "") & (F.lower(user) != "pre-logon"), user),
        "signed_in": signed_in,
        "region": F.coalesce(_got(unix(REGION_CODE), 1, "REGION-PRIO"), _got(REGION_TAG, 1, "<region>")),
        "saml": F.concat(F.lit("SAML ("), _got(SAML_METHOD, 1, "<saml-auth-method>"), F.lit(")")),
        "asked": low.contains("authentication-message>") & (trimmed(message) != ""),
        "cloud": _text().contains(CLOUD_AUTH),
        "tenant": _got(TENANT, 1, "<tenant-id>"),
        "browser": F.when(_text().contains(EMBEDDED_BROWSER), "embedded").when(_text().contains(DEFAULT_BROWSER), "OS default"),
        "discover": F.when(
            low.contains("discover") & _text().rlike(any_case(DISCOVER)),
            F.struct(*PLACE, _got(any_case(DISCOVER), 2).try_cast("int").alias("count"), _got(any_case(DISCOVER), 3).try_cast("int").alias("cutoff")),
        ),
        "chosen": F.when(low.contains("chose prefered gateway"), trimmed(_got(any_case(CHOSEN), 2))),
        "gateway": F.when(is_gateway, _gateway_facts()),
        "excluded_index": F.when(is_gateway, _got(any_case(REGION_EXCLUDED)).try_cast("int")),
        "tunnel": low.contains("tunnel creation finished") & _text().rlike(any_case(TUNNEL_UP)),
        "report": low.contains(REPORT_SENT.lower()),
        "panos_version": _got(SERVER_VERSION, 1, "<panos-version>"),
        "assigned_ip": _got(ASSIGNED_IP, 1, "<ip-address>"),
        "gateway_user": _got(GATEWAY_USER, 1, "<user>"),
    }
    # a projection: a generator with lambdas in it (`_gateway_facts`) would be interpreted
    rows = service_lines(lines).select("file_id", *PLACE, *[c.alias(n) for n, c in parts.items()])
    flags = ("signed_in", "asked", "cloud", "tunnel", "report")
    told = F.exists(F.array(*flags), lambda f: F.coalesce(f, F.lit(False)))
    for n in parts:
        if n not in (*flags, "ts", "prelogin"):
            told = told | F.col(n).isNotNull()
    # settled: `carry` reads its rows twice
    rows = settle(rows.select("*", told.alias("told")))
    ordered = by_lines(rows, ("file_id",), PLACE).carry(
        {"seen": "ts", "segment": "prelogin", "portal": "named", "round": "discover"},
        above={"portal_above": "named", "round_above": "discover"},
        next={"portal_next": "named"},
        below={"segment_below": "prelogin"},
    )
    rows, segment = ordered.rows(), F.col("segment")

    def at(name: str) -> Column:
        return F.struct(*[F.col(f"{name}.{c}").alias(c) for c in PLACE])

    def in_segment(name: str) -> Column:
        return F.col(name).isNotNull() & (segment.isNull() | (at(name) >= segment))

    current = F.when(in_segment("portal"), F.col("portal.address"))
    direct = F.when(in_segment("portal_above"), F.col("portal_above.address"))
    waits = F.col("portal_next").isNotNull() & (F.col("segment_below").isNull() | (at("portal_next") < F.col("segment_below")))
    pending = F.when(direct.isNull() & waits, F.col("portal_next.address"))
    kept = [n for n in parts if n not in ("ts", "prelogin")]
    facts = rows.where(F.col("told")).select(
        "file_id",
        *PLACE,
        *kept,
        "seen",
        current.alias("current"),
        F.coalesce(direct, pending).alias("owner"),
        F.when(pending.isNotNull(), at("portal_next")).alias("pending_at"),
        F.when(in_segment("round"), at("round")).alias("round_at"),
        F.when(in_segment("round_above"), at("round_above")).alias("previous_round"),
        F.col("round.count").alias("round_count"),
        F.col("round.cutoff").alias("round_cutoff"),
    )
    return settle(facts)


def _gateway_facts() -> Column:
    """Facts about gateways on one line, in the order they apply."""
    kinds = ("fqdn", "manual", "name", "first_name", "ipv4", "priority", "duration_ms", "weight")
    types = {"manual": "boolean", "priority": "int", "duration_ms": "int", "weight": "int"}

    def fact(pattern: str, fqdn: int, extra: Column | None = None, **values: Column) -> Column:
        hit = _text().rlike(pattern) if extra is None else _text().rlike(pattern) & extra
        columns = {"fqdn": F.regexp_extract("text", pattern, fqdn), **values}
        return F.when(hit, F.struct(*[columns.get(k, F.lit(None)).try_cast(types.get(k, "string")).alias(k) for k in kinds]))

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract("text", pattern, group)

    p, m, d, a, w = (any_case(PRIORITY), any_case(MANUAL_ONLY), any_case(DESCRIPTION), unix(ADDRESS), any_case(WEIGHT))
    facts = [
        fact(p, 1, ~_text().contains("priority="), priority=part(p, 2)),
        fact(m, 2, manual=F.lit(True)),
        fact(d, 1, name=trimmed(part(d, 2))),
        fact(a, 1, first_name=part(a, 2), ipv4=part(a, 3)),
        fact(w, 2, name=trimmed(part(w, 1)), priority=part(w, 3), duration_ms=part(w, 4), weight=part(w, 5)),
    ]
    found = F.array_compact(F.array(*facts))
    return F.when(F.size(found) > 0, found)


def _rounds(rows: DataFrame) -> DataFrame:
    """Committed rounds: owner portal, place of the commit, chosen gateway, count and cutoff."""
    inside = rows.where(F.col("round_at").isNotNull() & (place() > F.col("round_at")))
    opened = rows.where(F.col("discover").isNotNull()).select(
        "file_id", F.col("round_at"), F.col("current").alias("first_owner"), "round_count", "round_cutoff"
    )
    filled = inside.where(F.col("gateway").isNotNull()).groupBy(*ROUND).agg(F.min(place()).alias("filled_at"))
    ended = rows.where(F.col("discover").isNotNull() & F.col("previous_round").isNotNull()).select(
        "file_id", F.col("previous_round").alias("round_at"), place().alias("end_at"), F.col("current").alias("end_owner")
    )
    base = opened.join(filled, list(ROUND))
    picks = inside.where(F.col("chosen").isNotNull()).select(*ROUND, place().alias("pick_at"), "chosen", F.col("current").alias("pick_owner"))
    picks = picks.join(base.select(*ROUND, "first_owner", "filled_at"), list(ROUND))
    valid = (F.col("pick_at") >= F.col("filled_at")) & F.coalesce("first_owner", "pick_owner").isNotNull()
    picks = picks.groupBy(*ROUND).agg(F.min(F.when(valid, F.struct("pick_at", "chosen", "pick_owner"))).alias("pick"))
    joined = base.join(picks, list(ROUND), "left").join(ended, list(ROUND), "left")
    return joined.select(
        *ROUND,
        F.coalesce("first_owner", F.when(F.col("pick").isNotNull(), F.col("pick.pick_owner")).otherwise(F.col("end_owner"))).alias("address"),
        F.coalesce("pick.pick_at", "end_at").alias("commit_at"),
        F.col("pick.chosen").alias("chosen"),
        "round_count",
        "round_cutoff",
    ).where(F.col("address").isNotNull() & F.col("commit_at").isNotNull())


def _round_gateways(rows: DataFrame, rounds: DataFrame) -> DataFrame:
    """Gateways of every committed round with their last facts up to the commit."""
    inside = rows.where(F.col("round_at").isNotNull() & (place() > F.col("round_at")))
    inside = inside.select(*ROUND, *PLACE, "gateway", "excluded_index").join(rounds, list(ROUND)).where(place() <= F.col("commit_at"))
    facts = inside.select(*ROUND, "commit_at", "address", "chosen", *PLACE, F.posexplode("gateway").alias("idx", "g"))
    facts = facts.select(*ROUND, "commit_at", "address", "chosen", F.struct(*PLACE, "idx").alias("at"), "g.*")

    def last(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("at")))

    found = facts.groupBy(*ROUND, "commit_at", "address", "chosen", "fqdn").agg(
        F.min("at").alias("added"),
        F.coalesce(last("name"), F.min_by("first_name", F.when(F.col("first_name") != "", F.col("at")))).alias("name"),
        *[last(c).alias(c) for c in ("ipv4", "priority", "duration_ms", "weight")],
        F.max(F.when(F.col("manual"), F.col("at"))).alias("manual_at"),
    )
    order = ("newness", "entry_ord", "line_no", "idx")
    numbered = found.select("*", *[F.col(f"added.{c}").alias(c) for c in order], F.to_json("round_at").alias("round"))
    numbered = by_lines(numbered, ("file_id", "round"), order).positions("rn").rows()
    numbered = numbered.withColumn("excluded_index", (F.col("rn") - 1).cast("int"))
    bans = inside.where(F.col("excluded_index").isNotNull()).select(*ROUND, "excluded_index", F.struct(*PLACE, F.lit(9).alias("idx")).alias("ban_at"))
    banned = numbered.join(bans, [*ROUND, "excluded_index"], "left")
    banned = banned.groupBy(*ROUND, "fqdn").agg(F.max(F.when(F.col("ban_at") > F.col("added"), F.col("ban_at"))).alias("ban_at"))
    joined = numbered.join(banned, [*ROUND, "fqdn"])
    by_region = F.col("ban_at").isNotNull() & (F.col("manual_at").isNull() | (F.col("ban_at") > F.col("manual_at")))
    return joined.select(
        *ROUND, "commit_at", "address", F.col("rn").alias("ord"), "fqdn", "name", "ipv4", "priority", "duration_ms", "weight",
        F.when(by_region, "region").when(F.col("manual_at").isNotNull(), "manual-only").alias("excluded"),
        F.coalesce(F.lower("name") == F.lower("chosen"), F.lit(False)).alias("selected"),
    )


def portal_gateways(rows: DataFrame) -> DataFrame:
    """Gateways of the newest committed round of each portal."""
    rounds = settle(_rounds(rows))
    return _newest_gateways(rounds, _round_gateways(rows, rounds))


def _newest_gateways(rounds: DataFrame, found: DataFrame) -> DataFrame:
    newest = rounds.groupBy(*PORTAL).agg(F.max("commit_at").alias("commit_at"))
    return found.join(newest, [*PORTAL, "commit_at"], "left_semi").drop("round_at", "commit_at")


def portals(rows: DataFrame) -> DataFrame:
    """One row per portal address with its identity, rounds and outcome counters."""
    at = place()
    named = rows.where(F.col("named").isNotNull()).groupBy("file_id", F.col("named.address").alias("address")).agg(
        F.min(at).alias("first_at"),
        F.max("signed_in").alias("auth_success"),
        F.max_by("user", F.when(F.col("user").isNotNull(), at)).alias("cookie_user"),
        F.min_by("seen", F.when(F.col("seen").isNotNull(), at)).alias("first_seen"),
        F.max_by("seen", F.when(F.col("seen").isNotNull(), at)).alias("last_seen"),
    )

    def last(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), at)).alias(column)

    owned = rows.where(F.col("owner").isNotNull()).withColumn("address", F.col("owner"))
    identity = owned.groupBy(*PORTAL).agg(last("region"), last("tenant"), last("browser"), F.max("cloud").alias("cloud_auth"))
    # A named portal's sign-in method: the last SAML or bound pending method, else a plain prompt.
    methods = owned.where(F.col("saml").isNotNull() | F.col("asked"))
    bound = methods.where(F.col("pending_at").isNotNull()).groupBy(*PORTAL, "pending_at").agg(
        F.max(at).alias("at"), F.coalesce(F.max_by("saml", F.when(F.col("saml").isNotNull(), at)), F.lit("credentials")).alias("method")
    )
    direct = methods.where(F.col("pending_at").isNull())
    firm = bound.select(*PORTAL, "at", "method").unionByName(
        direct.where(F.col("saml").isNotNull()).select(*PORTAL, at.alias("at"), F.col("saml").alias("method"))
    )
    firm = firm.groupBy(*PORTAL).agg(F.max_by("method", "at").alias("firm"))
    prompted = direct.where(F.col("asked")).select(*PORTAL).distinct().withColumn("prompted", F.lit("credentials"))
    outcomes = rows.where(F.col("current").isNotNull() & F.col("discover").isNull()).withColumn("address", F.col("current"))
    outcomes = outcomes.groupBy(*PORTAL).agg(
        F.count_if("tunnel").alias("tunnels"),
        F.count_if("report").alias("hip_submitted"),
        last("panos_version"),
        last("assigned_ip"),
        F.min_by("gateway_user", F.when(F.col("gateway_user").isNotNull(), at)).alias("gateway_user"),
    )
    rounds = settle(_rounds(rows))
    found = settle(_round_gateways(rows, rounds))
    committed = rounds.groupBy(*PORTAL).agg(
        F.max_by("round_count", F.when(F.col("round_count") > 0, F.col("commit_at"))).alias("counted"),
        F.max_by("round_cutoff", F.when(F.col("round_cutoff").isNotNull(), F.col("commit_at"))).alias("cutoff_secs"),
    )
    chosen = found.where("selected").groupBy(*PORTAL).agg(F.max_by("fqdn", F.struct("commit_at", "ord")).alias("selected_gateway"))
    sizes = _newest_gateways(rounds, found).groupBy(*PORTAL).agg(F.count(F.lit(1)).alias("listed"))
    joined = named
    for more in (identity, firm, prompted, outcomes, committed, chosen, sizes):
        joined = joined.join(more, list(PORTAL), "left")
    return joined.select(
        *PORTAL,
        "region",
        F.coalesce("cookie_user", "gateway_user").alias("user"),
        F.coalesce("firm", "prompted").alias("auth_method"),
        "browser",
        F.coalesce("cloud_auth", F.lit(False)).alias("cloud_auth"),
        F.col("tenant").alias("tenant_id"),
        F.coalesce("counted", "listed", F.lit(0)).alias("gateway_count"),
        "cutoff_secs",
        "selected_gateway",
        "auth_success",
        F.coalesce("tunnels", F.lit(0)).alias("tunnels"),
        F.coalesce("hip_submitted", F.lit(0)).alias("hip_submitted"),
        "first_seen",
        "last_seen",
        "panos_version",
        "assigned_ip",
        "first_at",
    )


def sort_portals(rows: DataFrame) -> DataFrame:
    return rows.orderBy("file_id", F.col("auth_success").desc(), F.col("last_seen").desc_nulls_last(), "first_at")
