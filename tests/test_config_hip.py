"""Configuration tree and posture report on small documents."""

from pyspark.sql import functions as F

from logquarry.operators import agent as ag
from logquarry.operators import configtree as ct
from logquarry.operators import hip
from logquarry.sources.xmlnodes import xml_nodes
from tests.helpers import line_table, samples

CONFIG = """<?xml version="1.0"?>
<!-- <license> -->
<config version="10.2" urldb="x">
 <devices><entry name="localhost">
  <network>
   <interface><ethernet>
     <entry name="ethernet1/1"><layer3><ip><entry name="10.0.0.1/24"/><entry name="10.0.1.1/24"/></ip>
       <interface-management-profile>ping</interface-management-profile></layer3><comment>up &amp; fine</comment></entry>
     <entry name="ethernet1/2"><layer3><dhcp-client><enable>yes</enable></dhcp-client></layer3></entry>
     <entry name="ethernet1/3"><virtual-wire/></entry></ethernet>
     <tunnel><entry name="tunnel.1"><ip><entry name="192.168.1.1"/></ip></entry></tunnel></interface>
   <virtual-router><entry name="vr1"><interface><member>ethernet1/1</member><member>tunnel.1</member></interface>
     <protocol><ospf><enable>no</enable></ospf><bgp/></protocol>
     <routing-table><ip><static-route><entry name="r1"/><entry name="r2"/></static-route></ip></routing-table></entry></virtual-router>
  </network>
  <vsys><entry name="vsys1">
   <zone><entry name="trust"><network><layer3><member>ethernet1/1</member><member>ethernet1/2</member></layer3></network></entry>
     <entry name="other"><network><layer3><member>ethernet1/1</member></layer3></network></entry></zone>
   <tag><entry name="prod"><color>red</color></entry></tag>
   <pre-rulebase><security><rules><entry name="pre1"><action>deny</action></entry></rules></security></pre-rulebase>
   <rulebase><security><rules>
     <entry name="rule1"><from><member>trust</member><member>dmz</member></from><tag><member>prod</member></tag><action>allow</action></entry>
     <entry name="rule2"><source><member>any</member></source></entry></rules></security></rulebase>
   <post-rulebase><security><rules><entry name="post1"/></rules></security></post-rulebase>
  </entry></vsys>
  <deviceconfig><system><hostname>fw1</hostname><dns-setting><servers><primary>1.1.1.1</primary></servers></dns-setting>
    <permitted-ip><entry name="10.0.0.0/8"/></permitted-ip><ntp><member>a</member><member>b</member></ntp></system></deviceconfig>
 </entry></devices>
</config>"""


def nodes_of(spark, text, path="running-config.xml"):
    return xml_nodes(line_table(spark, {path: text})).cache()


def test_sections_and_lookups(spark):
    nodes = nodes_of(spark, CONFIG)
    assert nodes.where("depth = 0").select("tag", "attrs").collect()[0].attrs == {"version": "10.2", "urldb": "x"}
    rules = ct.policy_entries(nodes, "security").orderBy("origin_ord", "place")
    assert [(r.origin, r.name) for r in rules.collect()] == [("pre", "pre1"), ("local", "rule1"), ("local", "rule2"), ("post", "post1")]
    table = ct.section_table(nodes, "security", "rulebase").select("name", "From Zone", "Source", "Tags", "Action")
    assert sorted(tuple(r) for r in table.collect()) == [
        ("post1", "", "", "", ""),
        ("pre1", "", "", "", "deny"),
        ("rule1", "trust, dmz", "", "prod", "allow"),
        ("rule2", "", "any", "", ""),
    ]
    assert samples(ct.section_table(nodes, "tag"), "name", "Color") == [("prod", "red")]
    assert ct.find_by_tag(nodes, "virtual-wire", "entry").count() == 1
    generic = ct.generic_fields(ct.section_entries(nodes, "security", "rulebase"), nodes)
    assert [r.field for r in generic.orderBy("ord").collect()] == ["from", "tag", "action", "source"]


def test_interfaces_zones_routers(spark):
    nodes = nodes_of(spark, CONFIG)
    rows = samples(ct.interface_table(nodes), "kind", "interface", "type", "ip_address", "zone", "router", "mgmt_profile", "comment")
    assert rows == [
        ("Ethernet", "ethernet1/1", "Layer3", "10.0.0.1/24, 10.0.1.1/24", "trust", "vr1", "ping", "up & fine"),
        ("Ethernet", "ethernet1/2", "Layer3", "DHCP Client", "trust", "", "", ""),
        ("Ethernet", "ethernet1/3", "Virtual Wire", "", "", "", "", ""),
        ("Tunnel", "tunnel.1", "", "192.168.1.1", "", "vr1", "", ""),
    ]
    assert samples(ct.zone_table(nodes), "zone", "type", "interfaces") == [
        ("other", "Layer3", "ethernet1/1"),
        ("trust", "Layer3", "ethernet1/1, ethernet1/2"),
    ]
    assert samples(ct.router_table(nodes), "router", "interfaces", "ospf", "bgp", "rip", "static_routes") == [
        ("vr1", "ethernet1/1, tunnel.1", "no", "yes", "", "2")
    ]


def test_flat_pairs(spark):
    rows = ct.flatten_pairs(nodes_of(spark, CONFIG), "system", "deviceconfig").orderBy("ord").select("key", "value", "depth")
    assert [tuple(r) for r in rows.collect()] == [
        ("Hostname", "fw1", 0),
        ("Dns Setting", "", 0),
        ("Servers", "", 1),
        ("Primary", "1.1.1.1", 2),
        ("Permitted Ip", "", 0),
        ("10.0.0.0/8", "", 1),
        ("Ntp", "a, b", 0),
    ]


def test_choosing_the_config(spark):
    files = {
        "opt/pancfg/mgmt/licenses.xml": "<?xml version='1.0'?>\n<!-- <config> -->\n<licenses></licenses>",
        "other/running-config.xml": "<config><panorama/><template-stack x='1'></template-stack></config>",
        "z.xml": "<config/>",
        "note.txt": "<config/>",
    }
    lines = line_table(spark, files)
    sizes = {"opt/pancfg/mgmt/licenses.xml": 50, "other/running-config.xml": 40, "z.xml": 900, "note.txt": 1}
    entries = spark.createDataFrame(
        [("f", i, p, s, False) for i, (p, s) in enumerate(sizes.items())], "file_id string, entry_ord int, path string, size long, is_binary boolean"
    )
    rows = ct.choose_config(entries, lines).orderBy("rank").collect()
    assert [(r.path, r.picked, r.reason) for r in rows] == [
        ("opt/pancfg/mgmt/licenses.xml", False, "root element is <licenses>, not <config>"),
        ("other/running-config.xml", True, ""),
        ("z.xml", False, "not needed"),
    ]
    marks = {r.path: (r.markers, r.managed) for r in ct.managed_markers(lines).collect()}
    assert marks["other/running-config.xml"] == (["template-stack"], True)
    assert marks["z.xml"] == ([], False)


def test_broken_documents_keep_what_was_read(spark):
    nodes = nodes_of(spark, "<config><a>one</a><b><c>two</c>\n<d>fine & dandy")
    assert samples(nodes, "tag", "text") == [("a", "one"), ("b", ""), ("c", "two"), ("config", ""), ("d", "fine & dandy")]


REPORT = """<?xml version="1.0"?><hip-report><generate-time>08/18/2026 10:11:12</generate-time>
<hip-report-version>4</hip-report-version><user-name>ann</user-name><host-name>outer</host-name><ip-address>10.9.9.9</ip-address>
<categories>
<entry name="host-info"><client-version>6.2</client-version><os>Windows</os><host-name>pc1</host-name><host-id>id1</host-id>
<network-interface><entry name="{A}"><description>Wifi</description><mac-address>00-11</mac-address>
<ip-address><entry name="10.0.0.5"/><entry name="10.0.0.6"/></ip-address><ipv6-address><entry name="fe80::1"/></ipv6-address></entry></network-interface></entry>
<entry name="anti-malware"><list><entry><ProductInfo><Prod vendor="V" name="Shield" version="1.2" defver="9" engver="8" datemon="3" dateday="12" dateyear="2026"/>
<real-time-protection>yes</real-time-protection><last-full-scan-time>n/a</last-full-scan-time></ProductInfo></entry>
<entry><ProductInfo><Prod vendor="V" name="" version="0"/></ProductInfo></entry></list></entry>
<entry name="disk-encryption"><list><entry><ProductInfo><Prod vendor="M" name="Lock"/><drives><entry><drive-name>C:\\</drive-name><enc-state>encrypted</enc-state></entry></drives></ProductInfo></entry></list></entry>
<entry name="patch-management"><missing-patches><entry><title>KB1</title><severity>2</severity><is-installed>no</is-installed></entry></missing-patches></entry>
<entry name="firewall"><list/></entry>
</categories></hip-report>"""


def agent_log(*blocks):
    out = []
    for i, (text, ended) in enumerate(blocks):
        pre = f"(P1-T2)Debug( 10): 08/18/26 10:00:0{i}:000 "
        out += [pre + hip.BLOCK_START, *[pre + x if j == 0 else x for j, x in enumerate(text.split("\n"))]]
        out += [pre + hip.BLOCK_END] if ended else []
    return "\n".join(out)


def test_report_selection_and_tables(spark):
    old = REPORT.replace("pc1", "stale")
    files = {
        "PanGPS.1.log": agent_log((old, True)),
        "PanGPS.log": agent_log((old, True), (REPORT, True), (REPORT.replace("pc1", "cut off"), False)),
        "pan_gp_hrpt.xml": old,
    }
    chosen = hip.report_lines(line_table(spark, files))
    nodes = xml_nodes(chosen).cache()
    head = hip.generated_time(hip.report(nodes))
    assert samples(head, "host_name", "client_version", "user_name", "version", "generated_ts") == [
        ("pc1", "6.2", "ann", "4", "2026-08-18 10:11:12")
    ]
    assert samples(hip.products(nodes), "category", "vendor", "name", "def_date", "real_time_protection") == [
        ("anti-malware", "V", "Shield", "2026-03-12", "yes"),
        ("disk-encryption", "M", "Lock", "", ""),
    ]
    assert samples(hip.drives(nodes), "drive", "state") == [("C:\\", "encrypted")]
    assert samples(hip.patches(nodes), "title", "severity", "installed") == [("KB1", "2", "no")]
    assert samples(hip.interfaces(nodes), "id", "description", "ipv4", "ipv6") == [
        ("{A}", "Wifi", "['10.0.0.5', '10.0.0.6']", "['fe80::1']")
    ]
    assert samples(hip.empty_categories(nodes), "category") == [("firewall",)]
    rows = [tuple(r) for r in hip.facts(nodes).orderBy("ord").select("category", "item", "field", "value").collect()]
    assert rows[:2] == [("anti-malware", "Shield", "vendor", "V"), ("anti-malware", "Shield", "version", "1.2")]
    assert ("disk-encryption", "Lock", "drive C:\\", "encrypted") in rows
    assert ("firewall", "", "products found", "none") in rows
    assert [r[2] for r in rows if r[0] == "network-interface"] == ["adapter id", "mac-address", "ipv4", "ipv4", "ipv6"]
    assert hip.search(hip.products(nodes), "SHIELD").count() == 1
    assert hip.search(hip.interfaces(nodes), "fe80").count() == 1


def test_standalone_report_and_overview(spark):
    files = {
        "x/SystemInfo.txt": "Host Name:     HOST9\nOS Name:       Windows 11\nSystem Model:    M1",
        "pan_gp_hrpt.xml": REPORT,
        "pan_gp_event.log": "08/18/2026 10:00:00:123 [Info ]: GlobalProtect service started (client version: 6.2, OS version: W)\n"
        "08/18/2026 10:05:00:123 [Info ]: portal status is Connected.",
        "PanGPS.log": "Start PanGPS service (ver: 6.2.1)\nOne gateway gw.example.com, priority=1",
    }
    lines = line_table(spark, files)
    nodes = xml_nodes(hip.report_lines(lines))
    row = ag.overview(lines, nodes).collect()[0]
    assert (row.host_name, row.os_name, row.model, row.client_version) == ("HOST9", "Windows 11", "M1", "6.2")
    assert (row.service_version, row.gateway, row.final_state) == ("6.2.1", "gw.example.com", "Connected")
    assert (row.hip_user, row.hip_host_id, row.hip_ip, row.hip_generated) == ("ann", "id1", "10.9.9.9", "08/18/2026 10:11:12")
    assert (row.first_seen, row.last_seen) == ("2026-08-18 10:00:00", "2026-08-18 10:05:00")
    assert F.col is not None
