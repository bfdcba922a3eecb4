"""Gateway rounds, scores and portal folding on hand-worked logs."""

from logquarry.operators import gateways as gw
from logquarry.operators import portals as po
from tests.helpers import line_table, samples

PRE = "(P10-T20)Debug( 100): 08/18/26 10:00:{:02d}:000 "


def log(*messages, start=0):
    return "\n".join(PRE.format(start + i) + m for i, m in enumerate(messages))


OLD = log(
    "Parse gateway list for user ann",
    "Gateway old.example.com(Old): ipv4 1.1.1.1, ipv6 , FQDN yes",
    "One external gateway old.example.com, priority=5, manual is 0",
)
NEW = log(
    "tcp connection time is 99",
    "Parse gateway list for user ann",
    "Gateway a.example.com(Alpha): ipv4 10.0.0.1, ipv6 fe80::1, FQDN yes",
    "Gateway b.example.com(Beta): ipv4 10.0.0.2, ipv6 , FQDN yes",
    "tcp connection time is 40",
    "One external gateway a.example.com, priority=1, manual is 0",
    "One external gateway c.example.com, priority=3, manual is 1",
    "One external gateway and the priority is -2, region does not match",
    "REGION-PRIO, gateway 1(Alpha) and x region = EU, priority = 2, portalRegion=EU",
    "Gateway selection type is AUTO",
    "gateway count is 3, cutoff time is 5",
    "Gateway count is 0 for internal network",
    "Gateway selection(Priority-TCP-SSL-Weight): alpha(1-41-12-900),Ghost (2-50-20-300)",
    "gateway list is empty",
)


def test_gateway_selection(spark):
    lines = line_table(spark, {"PanGPS.log": NEW, "PanGPS.1.log": OLD})
    gateways, summary = gw.selection(lines)
    rows = samples(
        gw.in_order(gateways), "ord", "fqdn", "name", "priority", "manual", "region_match", "tcp_ms", "ssl_ms", "weight", "region", "selected"
    )
    assert rows == [
        ("1", "a.example.com", "Alpha", "1", "False", "True", "41", "12", "900", "EU", "False"),
        ("2", "b.example.com", "Beta", None, None, None, None, None, None, None, "False"),
        ("3", "c.example.com", None, "-2", "True", "False", None, None, None, None, "False"),
        ("4", "Ghost", "Ghost", "2", None, None, "50", "20", "300", None, "True"),
    ]
    assert samples(summary, "type", "best", "cutoff_secs", "external_count", "internal_count", "saw_empty") == [
        ("auto", "Ghost", "5", "3", "0", "True")
    ]
    notes = [r.note for r in gw.gateway_notes(gateways, summary).orderBy("ord").collect()]
    assert notes == ["region_mismatch", "empty_list", "several_gateways", "weighted"]


def test_tcp_time_attaches_once_and_not_across_rounds(spark):
    body = log(
        "tcp connection time is 7",
        "Parse gateway list for user ann",
        "One external gateway a.example.com, priority=1, manual is 0",
        "tcp connection time is 8",
        "One external gateway b.example.com, priority=1, manual is 0",
        "One external gateway c.example.com, priority=1, manual is 0",
        "m_pBestGateway=x1 (gateway=B.example.com)",
    )
    gateways, summary = gw.selection(line_table(spark, {"PanGPS.log": body}))
    assert samples(gateways, "fqdn", "tcp_ms", "selected") == [
        ("a.example.com", None, "False"),
        ("b.example.com", "8", "True"),
        ("c.example.com", None, "False"),
    ]
    assert samples(summary, "best") == [("B.example.com",)]


PORTAL = log(
    "----Portal Pre-login starts----",
    "REGION-PRIO, region code is EU",
    "<saml-auth-method>REDIRECT</saml-auth-method>",
    "<cas-auth>yes</cas-auth>",
    "Unserialized non-empty cookie for portal p1.example.com and user ann.",
    "<default-browser>yes</default-browser>",
    "Portal login completed with address p1.example.com.",
    "Discover external gateway: gateway count is 3, cutoff time is 6",
    "gateway g1.example.com priority is 1",
    "gateway g2.example.com priority is 2",
    "gateway 1 of g2.example.com is manual select only",
    "REGION-PRIO, gateway 0 is not selectable base on region",
    "Process gateway: host g1.example.com, description First one ",
    "gateway Second (g2.example.com), priority=4, duration=35 ms, assign 77 as its weight",
    "chose prefered gateway index =1, gateway is second",
    "IPSec tunnel creation finished with gateway g2.example.com",
    "HIP Report submitted to the Gateway",
    "<panos-version>11.1</panos-version>",
    "gateway g9.example.com priority is 9",
)
SECOND = log(
    "----Portal Pre-login starts----",
    "<region>US</region>",
    "authentication-message>Enter login</x>",
    "Serialize empty cookie for portal p2.example.com and user x",
    "Discover external gateway: gateway count is 0, cutoff time is 5",
    "gateway h1.example.com priority is 1",
    "Discover external gateway: gateway count is 1, cutoff time is 7",
    "gateway h2.example.com priority is 1",
    "----Portal Pre-login starts----",
    "<region>XX</region>",
    start=30,
)


def test_portals(spark):
    rows = po.portal_lines(line_table(spark, {"PanGPS.log": SECOND, "PanGPS.1.log": PORTAL}))
    got = samples(
        po.sort_portals(po.portals(rows)), "address", "region", "user", "auth_method", "browser", "cloud_auth", "gateway_count",
        "cutoff_secs", "selected_gateway", "auth_success", "tunnels", "hip_submitted", "panos_version", "first_seen", "last_seen",
    )
    assert got == [
        ("p1.example.com", "EU", "ann", "SAML (REDIRECT)", "OS default", "True", "3", "6", "g2.example.com", "True", "1", "1",
         "11.1", "2026-08-18 10:00:04", "2026-08-18 10:00:06"),
        ("p2.example.com", "US", None, "credentials", None, "False", "1", "5", None, "False", "0", "0",
         None, "2026-08-18 10:00:33", "2026-08-18 10:00:33"),
    ]
    gateways = samples(po.portal_gateways(rows), "address", "ord", "fqdn", "name", "priority", "duration_ms", "weight", "excluded", "selected")
    assert gateways == [
        ("p1.example.com", "1", "g1.example.com", "First one", "1", None, None, "region", "False"),
        ("p1.example.com", "2", "g2.example.com", "Second", "4", "35", "77", "manual-only", "True"),
        ("p2.example.com", "1", "h1.example.com", None, "1", None, None, None, "False"),
    ]


def test_portals_in_chunks(spark, monkeypatch):
    monkeypatch.setattr("logquarry.operators.ordered.CHUNK_LINES", 3)
    test_portals(spark)
    test_gateway_selection(spark)
