"""Device configuration: choosing the document, sections, policies, fields and reverse lookups.

All functions work on the flattened elements of `xml_nodes`, where every element knows the tags and
ids of its ancestors, so parents and containers are found without joining the tree to itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions.text import computed, first_case
from logquarry.operators.ordered import by_lines, by_range

# File tiers, limits, management tags, sections and interface kinds.
TIERS = (
    r"(?i)(^|/)opt/pancfg/mgmt/",
    r"(?i)(running|candidate|merged|pushed|panorama)[-_]?.*config.*\.xml$|mergesp\.xml$",
)
MANAGED_TAGS = ("pre-rulebase", "post-rulebase", "device-group", "template-stack", "template", "panorama")
RULEBASES = (("pre-rulebase", "pre"), ("rulebase", "local"), ("post-rulebase", "post"))
INTERFACE_KINDS = {"Ethernet": "ethernet", "VLAN": "vlan", "Loopback": "loopback", "Tunnel": "tunnel", "SD-WAN": "sdwan"}
ZONE_MEMBER_KINDS = ("layer3", "layer2", "virtual-wire", "tap")
ZONE_TYPES = {"layer3": "Layer3", "layer2": "Layer2", "virtual-wire": "Virtual Wire", "tap": "Tap", "external": "External"}
LAYER_TYPES = {"layer3": "Layer3", "virtual-wire": "Virtual Wire", "layer2": "Layer2"}
ROUTER_PROTOCOLS = {"OSPF": "ospf", "OSPFv3": "ospfv3", "BGP": "bgp", "RIPv2": "rip", "Multicast": "multicast"}
# (group, label, tag, parent tag)
SECTIONS = (
    ("policies", "Security", "security", "rulebase"),
    ("policies", "NAT", "nat", "rulebase"),
    ("policies", "QoS", "qos", "rulebase"),
    ("policies", "Policy Based Forwarding", "pbf", "rulebase"),
    ("policies", "Decryption", "decryption", "rulebase"),
    ("policies", "Application Override", "application-override", "rulebase"),
    ("policies", "Authentication", "authentication", "rulebase"),
    ("policies", "DoS Protection", "dos", "rulebase"),
    ("policies", "Tunnel Inspection", "tunnel-inspect", "rulebase"),
    ("policies", "SD-WAN", "sdwan", "rulebase"),
    ("objects", "Addresses", "address", None),
    ("objects", "Address Groups", "address-group", None),
    ("objects", "Regions", "region", None),
    ("objects", "Dynamic User Groups", "dynamic-user-group", None),
    ("objects", "Applications", "application", None),
    ("objects", "Application Groups", "application-group", None),
    ("objects", "Application Filters", "application-filter", None),
    ("objects", "Services", "service", None),
    ("objects", "Service Groups", "service-group", None),
    ("objects", "Tags", "tag", None),
    ("objects", "Devices", "device", None),
    ("objects", "HIP Objects", "hip-object", "global-protect"),
    ("objects", "HIP Profiles", "hip-profile", "global-protect"),
    ("objects", "Host Compliance Objects", "host-compliance-object", None),
    ("objects", "Host Compliance Profiles", "host-compliance-profile", None),
    ("objects", "External Dynamic Lists", "external-list", None),
    ("objects", "URL Category", "custom-url-category", None),
    ("objects", "Antivirus", "virus", "profiles"),
    ("objects", "Anti-Spyware", "spyware", "profiles"),
    ("objects", "Vulnerability Protection", "vulnerability", "profiles"),
    ("objects", "URL Filtering", "url-filtering", "profiles"),
    ("objects", "File Blocking", "file-blocking", "profiles"),
    ("objects", "WildFire Analysis", "wildfire-analysis", "profiles"),
    ("objects", "DoS Protection", "dos-protection", "profiles"),
    ("objects", "Security Profile Groups", "profile-group", "profiles"),
    ("objects", "Log Forwarding", "log-settings", "profiles"),
    ("objects", "Authentication", "authentication-profile", None),
    ("objects", "Decryption Profile", "decryption-profile", None),
    ("objects", "Path Quality Profile", "path-quality-profile", None),
    ("objects", "SaaS Quality Profile", "saas-quality-profile", None),
    ("objects", "Traffic Distribution Profile", "traffic-distribution-profile", None),
    ("objects", "Error Correction Profile", "error-correction-profile", None),
    ("objects", "Schedules", "schedule", None),
    ("network", "Zones", "zone", None),
    ("network", "VLANs", "vlan", "network"),
    ("network", "Virtual Wires", "virtual-wire", None),
    ("network", "Logical Routers", "virtual-router", None),
    ("network", "IPSec Tunnels", "ipsec", None),
    ("network", "GRE Tunnels", "gre", None),
    ("network", "DHCP", "interface", "dhcp"),
    ("network", "DNS Proxy", "dns-proxy", None),
    ("network", "Proxy", "proxy", None),
    ("network", "Portals", "portal", "global-protect"),
    ("network", "Gateways", "gateway", "global-protect"),
    ("network", "MDM", "mdm", "global-protect"),
    ("network", "Clientless Apps", "clientless-app", "global-protect"),
    ("network", "Clientless App Groups", "clientless-app-group", "global-protect"),
    ("network", "DHCP Profile", "dhcp-profile", "global-protect"),
    ("network", "QoS", "qos", "network"),
    ("network", "LLDP", "lldp", None),
    ("network", "GlobalProtect IPSec Crypto", "global-protect-ipsec-crypto-profiles", None),
    ("network", "IKE Gateways", "gateway", "ike"),
    ("network", "IPSec Crypto", "ipsec-crypto-profiles", "ike"),
    ("network", "IKE Crypto", "ike-crypto-profiles", "ike"),
    ("network", "Monitor", "monitor-profile", None),
    ("network", "Interface Mgmt", "interface-management-profile", None),
    ("network", "Zone Protection", "zone-protection-profile", None),
    ("network", "QoS Profile", "qos-profile", None),
    ("network", "LLDP Profile", "lldp-profile", None),
    ("network", "SD-WAN Interface Profile", "sdwan-interface-profile", None),
    ("device", "Setup — General", "system", "deviceconfig"),
    ("device", "High Availability", "high-availability", "deviceconfig"),
    ("device", "Certificates", "certificate", None),
)
# Fields shown per section tag as (header, field tag); other sections show their generic fields.
SECTION_FIELDS = {
    "security": (
        ("Tags", "tag"), ("Type", "rule-type"), ("From Zone", "from"), ("Source", "source"), ("Source User", "source-user"),
        ("To Zone", "to"), ("Destination", "destination"), ("Application", "application"), ("Service", "service"), ("Action", "action"),
    ),
    "nat": (
        ("Tags", "tag"), ("From Zone", "from"), ("To Zone", "to"), ("Destination Interface", "to-interface"), ("Source", "source"),
        ("Destination", "destination"), ("Service", "service"), ("Translated Source", "source-translation"),
        ("Translated Destination", "destination-translation"),
    ),
    "qos": (("From Zone", "from"), ("Source", "source"), ("Destination", "destination"), ("Application", "application"), ("Class", "class")),
    "address": (("Value", "ip-netmask"), ("FQDN", "fqdn"), ("Range", "ip-range"), ("Tags", "tag")),
    "address-group": (("Static Members", "static"), ("Dynamic Filter", "dynamic"), ("Tags", "tag")),
    "service": (("Protocol", "protocol"), ("Tags", "tag")),
    "service-group": (("Members", "members"), ("Tags", "tag")),
    "tag": (("Color", "color"), ("Comments", "comments")),
}

DOCUMENT = ("file_id", "entry_ord", "path")
NODE = (*DOCUMENT, "node_id")


def rank_candidates(entries: DataFrame) -> DataFrame:
    """XML files of every archive in the order they are tried: tier, larger first, path."""
    rows = entries.where(F.lower("path").endswith(".xml"))
    path = F.col("path")
    tier = first_case([(path.rlike(p), F.lit(i)) for i, p in enumerate(TIERS)], F.lit(len(TIERS)))
    rows = rows.select(*DOCUMENT, "size", tier.alias("tier"), (-F.col("size")).alias("_smaller"))
    return by_range(rows, ("file_id",), ("tier", "_smaller", "path", "entry_ord")).positions("rank").rows().drop("_smaller")


def root_tags(lines: DataFrame) -> DataFrame:
    """Root element of every XML file: the first start tag outside comments."""
    clean = F.regexp_replace(F.col("text"), r"<!--.*?-->|<\?.*?\?>", "")
    rows = lines.where(F.lower("path").endswith(".xml")).select(*DOCUMENT, "line_no", computed(clean.alias("clean")))
    opened, closed = F.instr("clean", "<!--"), F.instr("clean", "-->")
    mark = F.when(opened > closed, "open").when(closed > 0, "closed")
    rows = by_lines(rows.withColumn("_mark", mark), DOCUMENT).carry(above={"inside": "_mark"}).rows()
    after = F.when(closed > 0, F.expr("substring(clean, instr(clean, '-->') + 3)")).otherwise("")
    shown = F.substring_index(F.when(F.coalesce(F.col("inside") == "open", F.lit(False)), after).otherwise(F.col("clean")), "<!--", 1)
    tag = F.regexp_extract(shown, r"<([A-Za-z_][^\s/>]*)", 1)
    first = F.min_by(tag, F.when(tag != "", F.col("line_no"))).alias("root")
    roots = rows.groupBy(*DOCUMENT).agg(first)
    return roots.select(*DOCUMENT, F.regexp_replace(F.coalesce("root", F.lit("")), "^.*:", "").alias("root"))


def choose_config(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Every candidate with the reason it was passed over, or picked."""
    ranked = rank_candidates(entries).join(root_tags(lines), list(DOCUMENT), "left")
    fits = F.col("size") > 0
    picked = ranked.where(fits & (F.col("root") == "config")).groupBy("file_id").agg(F.min("rank").alias("picked_rank"))
    rows = ranked.join(picked, "file_id", "left")
    root = F.coalesce("root", F.lit(""))
    reason = first_case(
        [
            (F.col("rank") == F.col("picked_rank"), F.lit("")),
            (F.col("rank") > F.col("picked_rank"), F.lit("not needed")),
            (~fits, F.lit("empty")),
        ],
        F.concat(F.lit("root element is <"), root, F.lit(">, not <config>")),
    )
    chosen = F.coalesce(F.col("rank") == F.col("picked_rank"), F.lit(False))
    return rows.select(*DOCUMENT, "size", "tier", "rank", chosen.alias("picked"), reason.alias("reason"))


def managed_markers(lines: DataFrame) -> DataFrame:
    """Which central-management tags occur in every document."""
    text = F.col("text")
    found = [F.max(text.contains(f"<{t}>") | text.contains(f"<{t} ")).alias(t) for t in MANAGED_TAGS]
    flags = lines.groupBy(*DOCUMENT).agg(*found)
    names = F.array_compact(F.array(*[F.when(F.col(f"`{t}`"), F.lit(t)) for t in sorted(MANAGED_TAGS)]))
    return flags.select(*DOCUMENT, names.alias("markers"), (F.size(names) > 0).alias("managed"))


def _tag(back: int) -> Column:
    """Tag of the element (1) or of an ancestor (2 is the parent)."""
    return F.try_element_at("tags", F.lit(-back))


def _id(back: int) -> Column:
    return F.try_element_at("ids", F.lit(-back))


def find_by_tag(nodes: DataFrame, tag: str, parent: str | None = None) -> DataFrame:
    """Elements with a tag, directly under a parent tag if one is given."""
    rows = nodes.where(F.col("tag") == tag)
    return rows.where(_tag(2) == parent) if parent else rows


def section_entries(nodes: DataFrame, tag: str, parent: str | None = None) -> DataFrame:
    """Entries directly under a section or under its first `rules` wrapper, in document order."""
    entry = F.col("tag") == "entry"
    direct, wrapped = _tag(2) == tag, (_tag(2) == "rules") & (_tag(3) == tag) & (F.col("parent_nth") == 0)
    if parent:
        direct, wrapped = direct & (_tag(3) == parent), wrapped & (_tag(4) == parent)
    direct, wrapped = F.coalesce(direct, F.lit(False)), F.coalesce(wrapped, F.lit(False))
    place = F.struct(
        F.when(direct, _id(2)).otherwise(_id(3)).alias("container"), (~direct).cast("int").alias("wrapped"), F.col("ord")
    )
    return nodes.where(entry & (direct | wrapped)).withColumn("place", place)


def policy_entries(nodes: DataFrame, tag: str) -> DataFrame:
    """Rules of one policy from the pre, local and post rulebases, in evaluation order."""
    parts = [
        section_entries(nodes, tag, parent).withColumn("origin", F.lit(origin)).withColumn("origin_ord", F.lit(i))
        for i, (parent, origin) in enumerate(RULEBASES)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def children(nodes: DataFrame) -> DataFrame:
    """First child of every tag of every element, with its collected text."""
    first = nodes.where((F.col("nth") == 0) & F.col("parent_id").isNotNull())
    return first.select(*DOCUMENT, F.col("parent_id").alias("node_id"), F.col("tag").alias("field"), "collected", "ord")


def field_table(entries: DataFrame, nodes: DataFrame, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """Entries with one column per field: the collected text of the child with that tag, blank if absent."""
    wanted = children(nodes).where(F.col("field").isin([t for _, t in fields]))
    cells = wanted.groupBy(*NODE).agg(*[F.max(F.when(F.col("field") == t, F.col("collected"))).alias(h) for h, t in fields])
    kept = [c for c in entries.columns if c in (*NODE, "name", "place", "origin", "origin_ord")]
    joined = entries.select(*kept).join(cells, list(NODE), "left")
    return joined.select(*kept, *[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(h) for h, _ in fields])


def section_table(nodes: DataFrame, tag: str, parent: str | None = None) -> DataFrame:
    """A catalogue section with its columns; policies come from all three rulebases."""
    entries = policy_entries(nodes, tag) if parent == "rulebase" else section_entries(nodes, tag, parent)
    if tag in SECTION_FIELDS:
        return field_table(entries, nodes, SECTION_FIELDS[tag])
    # no listed columns: every child's text by its tag
    cell = F.struct("field", "collected")
    cells = children(nodes).where(F.col("field") != "entry").groupBy(*NODE).agg(F.map_from_entries(F.array_sort(F.collect_list(cell))).alias("fields"))
    kept = [c for c in entries.columns if c in (*NODE, "name", "place", "origin", "origin_ord")]
    return entries.select(*kept).join(cells, list(NODE), "left")


def generic_fields(entries: DataFrame, nodes: DataFrame, keys: Sequence[str] = DOCUMENT) -> DataFrame:
    """(field, ord) of the distinct child tags of a section's entries, in the order they appear."""
    held = children(nodes).where(F.col("field") != "entry").join(entries.select(*NODE, "place"), list(NODE))
    seen = held.groupBy(*keys, "field").agg(F.min(F.struct("place", "ord")).alias("seen"))
    return seen.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("seen"))).drop("seen")


def descendants(nodes: DataFrame, depth: int = 4) -> DataFrame:
    """Elements below entries as (entry node, relative path, text), up to a depth."""
    levels = F.array(
        *[
            F.when(
                _tag(k + 1) == "entry",
                F.struct(_id(k + 1).alias("entry_id"), F.array_join(F.slice("tags", -k, k), "/").alias("rel")),
            )
            for k in range(1, depth + 1)
        ]
    )
    rows = nodes.where(F.size("tags") > 1).select(*DOCUMENT, "name", "text", "collected", "nth", "ord", levels.alias("l"))
    return rows.select(*DOCUMENT, "name", "text", "collected", "nth", "ord", F.inline(F.array_compact("l")))


def zone_members(nodes: DataFrame, below: DataFrame) -> DataFrame:
    """First zone, in document order, that lists each interface."""
    zones = section_entries(nodes, "zone").select(*DOCUMENT, F.col("node_id").alias("entry_id"), F.col("name").alias("zone"), "place")
    held = below.where(F.col("rel").isin([f"network/{k}/member" for k in ZONE_MEMBER_KINDS]))
    rows = held.select(*DOCUMENT, "entry_id", F.col("text").alias("interface")).join(zones, [*DOCUMENT, "entry_id"])
    return rows.groupBy(*DOCUMENT, "interface").agg(F.min_by("zone", "place").alias("zone"))


def router_members(nodes: DataFrame, below: DataFrame) -> DataFrame:
    """First logical router that lists each interface."""
    routers = section_entries(nodes, "virtual-router").select(*DOCUMENT, F.col("node_id").alias("entry_id"), F.col("name").alias("router"), "place")
    held = below.where(F.col("rel") == "interface/member")
    rows = held.select(*DOCUMENT, "entry_id", F.col("text").alias("interface")).join(routers, [*DOCUMENT, "entry_id"])
    return rows.groupBy(*DOCUMENT, "interface").agg(F.min_by("router", "place").alias("router"))


def interface_table(nodes: DataFrame) -> DataFrame:
    """Interfaces of all kinds with type, addresses, zone, router, tag, management profile and comment."""
    below = descendants(nodes)
    parts = [section_entries(nodes, tag, "interface").withColumn("kind", F.lit(label)) for label, tag in INTERFACE_KINDS.items()]
    entries = parts[0]
    for more in parts[1:]:
        entries = entries.unionByName(more)
    entries = entries.select(*DOCUMENT, F.col("node_id").alias("entry_id"), F.coalesce("name", F.lit("")).alias("interface"), "kind", "place")
    rel = F.col("rel")

    def has(path: str) -> Column:
        return F.max(F.when(rel == path, 1)).isNotNull()

    def text(path: str) -> Column:
        return F.max(F.when((rel == path) & (F.col("nth") == 0), F.col("collected")))

    def names(path: str) -> Column:
        held = F.when((rel == path) & (F.col("name") != ""), F.struct("ord", "name"))
        return F.array_join(F.transform(F.array_sort(F.collect_list(held)), lambda a: a["name"]), ", ")

    wanted = ("layer3", "layer2", "virtual-wire", "ip", "ip/entry", "layer3/ip", "layer3/ip/entry", "dhcp-client", "layer3/dhcp-client",
              "tag", "comment", "interface-management-profile", "layer3/interface-management-profile")
    facts = below.where(rel.isin(*wanted)).join(entries.select(*DOCUMENT, "entry_id"), [*DOCUMENT, "entry_id"], "left_semi")
    facts = facts.groupBy(*DOCUMENT, "entry_id").agg(
        *[has(t).alias(f"_{t}") for t in LAYER_TYPES],
        has("dhcp-client").alias("_dhcp"),
        has("layer3/dhcp-client").alias("_dhcp3"),
        names("ip/entry").alias("_ip"),
        names("layer3/ip/entry").alias("_ip3"),
        has("ip/entry").alias("_has_ip"),
        has("layer3/ip/entry").alias("_has_ip3"),
        text("tag").alias("tag"),
        text("comment").alias("comment"),
        text("interface-management-profile").alias("_profile"),
        text("layer3/interface-management-profile").alias("_profile3"),
    )
    joined = entries.join(facts, [*DOCUMENT, "entry_id"], "left")
    joined = joined.join(zone_members(nodes, below), [*DOCUMENT, "interface"], "left").join(router_members(nodes, below), [*DOCUMENT, "interface"], "left")
    routed = F.coalesce("_layer3", F.lit(False))

    def either(inner: str, own: str) -> Column:
        return F.when(routed, F.col(inner)).otherwise(F.col(own))

    address = F.when(either("_has_ip3", "_has_ip"), either("_ip3", "_ip")).when(either("_dhcp3", "_dhcp"), "DHCP Client")
    columns = {
        "type": first_case([(F.coalesce(F.col(f"`_{t}`"), F.lit(False)), F.lit(label)) for t, label in LAYER_TYPES.items()]),
        "ip_address": address,
        "zone": F.col("zone"),
        "router": F.col("router"),
        "tag": F.col("tag"),
        "mgmt_profile": either("_profile3", "_profile"),
        "comment": F.col("comment"),
    }
    return joined.select(*DOCUMENT, "interface", "kind", "place", *[F.coalesce(c, F.lit("")).alias(n) for n, c in columns.items()])


def zone_table(nodes: DataFrame) -> DataFrame:
    """Zones with their type and interfaces."""
    zones = section_entries(nodes, "zone").select(*DOCUMENT, F.col("node_id").alias("entry_id"), F.col("name").alias("zone"), "place")
    below = descendants(nodes, 2).join(zones.select(*DOCUMENT, "entry_id"), [*DOCUMENT, "entry_id"], "left_semi")
    facts = below.groupBy(*DOCUMENT, "entry_id").agg(
        *[F.max(F.when(F.col("rel") == f"network/{t}", 1)).alias(f"_{t}") for t in ZONE_TYPES],
        F.max(F.when((F.col("rel") == "network") & (F.col("nth") == 0), F.col("collected"))).alias("interfaces"),
    )
    kind = first_case([(F.col(f"`_{t}`").isNotNull(), F.lit(label)) for t, label in ZONE_TYPES.items()], F.lit(""))
    joined = zones.join(facts, [*DOCUMENT, "entry_id"], "left")
    return joined.select(*DOCUMENT, "zone", "place", kind.alias("type"), F.coalesce("interfaces", F.lit("")).alias("interfaces"))


def router_table(nodes: DataFrame) -> DataFrame:
    """Logical routers with interfaces, enabled protocols and the number of static routes."""
    routers = section_entries(nodes, "virtual-router").select(*DOCUMENT, F.col("node_id").alias("entry_id"), F.col("name").alias("router"), "place")
    below = descendants(nodes).join(routers.select(*DOCUMENT, "entry_id"), [*DOCUMENT, "entry_id"], "left_semi")
    rel = F.col("rel")
    enable = {p: F.max(F.when((rel == f"protocol/{p}/enable") & (F.col("nth") == 0), F.col("collected"))) for p in ROUTER_PROTOCOLS.values()}
    present = {p: F.max(F.when(rel == f"protocol/{p}", 1)).isNotNull() for p in ROUTER_PROTOCOLS.values()}
    routes = F.count_if(rel.isin("routing-table/ip/static-route/entry", "routing-table/ipv6/static-route/entry"))
    facts = below.groupBy(*DOCUMENT, "entry_id").agg(
        F.max(F.when((rel == "interface") & (F.col("nth") == 0), F.col("collected"))).alias("interfaces"),
        *[F.when(present[p], F.when(enable[p].isin("yes", "no"), enable[p]).otherwise("yes")).otherwise("").alias(p) for p in enable],
        F.when(routes > 0, routes.cast("string")).otherwise("").alias("static_routes"),
    )
    joined = routers.join(facts, [*DOCUMENT, "entry_id"], "left")
    names = ("interfaces", *ROUTER_PROTOCOLS.values(), "static_routes")
    return joined.select(*DOCUMENT, "router", "place", *[F.coalesce(n, F.lit("")).alias(n) for n in names])


def pretty_tag(tag: Column) -> Column:
    words = F.split(F.replace(tag, F.lit("-"), F.lit(" ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), " ")


def flatten_pairs(nodes: DataFrame, tag: str, parent: str | None = None) -> DataFrame:
    """(key, value, depth) of everything below a section in document order; entries are not opened."""
    section = F.lit(tag)
    below = F.slice("tags", 1, F.size("tags") - 1)
    # position of the nearest enclosing section among the ancestors
    at = F.array_max(F.transform(F.sequence(F.lit(1), F.size(below)), lambda i: F.when(_matches(below, i, section, parent), i)))
    rows = nodes.where((F.size("tags") > 1) & F.array_contains(below, tag)).withColumn("_at", at).where(F.col("_at").isNotNull())
    between = F.slice("tags", F.col("_at") + 1, F.size("tags") - F.col("_at") - 1)
    shown = ~F.array_contains(between, "entry") & ((F.size(between) == 0) | F.col("parent_has_elements"))
    entry = F.col("tag") == "entry"
    header = ~entry & F.col("has_elements")
    return rows.where(shown).select(
        *DOCUMENT,
        F.get("ids", F.col("_at") - 1).alias("section_id"),
        "ord",
        F.when(entry, F.coalesce("name", F.lit("entry"))).otherwise(pretty_tag(F.col("tag"))).alias("key"),
        F.when(header, "").otherwise(F.col("collected")).alias("value"),
        F.size(between).alias("depth"),
    )


def _matches(below: Column, i: Column, section: Column, parent: str | None) -> Column:
    here = F.get(below, i - 1) == section
    return here & (F.get(below, i - 2) == parent) if parent else here
