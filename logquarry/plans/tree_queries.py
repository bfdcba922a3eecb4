"""Configuration trees, posture reports, gateway and portal logs, and archive kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.operators import configtree as ct
from logquarry.operators import gateways as gw
from logquarry.operators import hip
from logquarry.operators import kind as kd
from logquarry.operators import portals as po
from logquarry.operators.ordered import settle
from logquarry.plans.views import view, with_views
from logquarry.sources import archives as ar
from logquarry.sources.xmlnodes import xml_nodes, xml_status


def _config(spark, sf_dir):
    return settle(xml_nodes(view(spark, sf_dir, "config_xml")))


def config_nodes(spark, sf_dir):
    nodes = xml_nodes(view(spark, sf_dir, "config_xml"))
    return nodes.groupBy("file_id", "tag", "depth").agg(F.count(F.lit(1)).alias("n"), F.max("name").alias("last_name"))


def malformed_elements(spark, sf_dir):
    """One malformed document of all customers, read in chunks: every element with its place among those of its tag."""
    nodes = xml_nodes(view(spark, sf_dir, "broken_xml"), 1024)
    return nodes.where("depth > 0").select("tag", "depth", "nth", "parent_nth", "name", F.element_at("attrs", F.lit("kind")).alias("kind"), "text", "collected")


def document_status(spark, sf_dir):
    return xml_status(view(spark, sf_dir, "broken_xml"), 1024).select("file_id", "starts", "unclosed", "ignored_ends")


def policy_union(spark, sf_dir):
    rows = ct.section_table(_config(spark, sf_dir), "security", "rulebase")
    return rows.select("file_id", "origin", "name", F.col("From Zone").alias("from_zone"), F.col("Action").alias("action"))


def reverse_lookup(spark, sf_dir):
    rows = ct.interface_table(_config(spark, sf_dir))
    return rows.select("file_id", "interface", "type", "ip_address", "zone", "comment")


def zone_table(spark, sf_dir):
    return ct.zone_table(_config(spark, sf_dir)).select("file_id", "zone", "type", "interfaces")


def kv_flatten(spark, sf_dir):
    return ct.flatten_pairs(_config(spark, sf_dir), "system", "deviceconfig").select("file_id", "key", "value", "depth")


def generic_fields(spark, sf_dir):
    nodes = _config(spark, sf_dir)
    return ct.generic_fields(ct.section_entries(nodes, "security", "rulebase"), nodes).select("file_id", "field", "ord")


def _report(spark, sf_dir):
    return settle(xml_nodes(hip.report_lines(view(spark, sf_dir, "report_xml"))))


def hip_facts(spark, sf_dir):
    return hip.facts(_report(spark, sf_dir)).select("file_id", "category", "item", "field", "value")


def hip_products(spark, sf_dir):
    return hip.products(_report(spark, sf_dir)).select("file_id", "category", "vendor", "name", "version", "enabled")


def archive_kinds(spark, sf_dir):
    rows = kd.detect_kind(view(spark, sf_dir, "bundle_entries"))
    return rows.select("file_id", "kind", "firewall_hits", "agent_hits", F.array_join("kind_markers", "|").alias("markers"))


def sub_folders(spark, sf_dir):
    return ar.folders(view(spark, sf_dir, "bundle_entries"))


def config_candidates(spark, sf_dir):
    rows = ct.rank_candidates(view(spark, sf_dir, "bundle_entries"))
    return rows.select("file_id", "path", "size", "tier", "rank")


def gateway_selection(spark, sf_dir):
    gateways, _ = gw.selection(view(spark, sf_dir, "service_log"))
    return gateways.select("file_id", "fqdn", "name", "ipv4", "priority", "manual", "region_match", "tcp_ms", "selected")


def gateway_summary(spark, sf_dir):
    return gw.selection(view(spark, sf_dir, "service_log"))[1].select("file_id", "type", "best", "saw_empty")


def gateway_notes(spark, sf_dir):
    return gw.gateway_notes(*gw.selection(view(spark, sf_dir, "service_log"))).select("file_id", "note")


def portals(spark, sf_dir):
    rows = po.portals(po.portal_lines(view(spark, sf_dir, "service_log")))
    return rows.select("file_id", "address", "region", "user", "auth_success", "tunnels", "first_seen", "last_seen")


QUERIES = {
    "config_nodes": config_nodes,
    "malformed_elements": malformed_elements,
    "document_status": document_status,
    "policy_union": policy_union,
    "reverse_lookup": reverse_lookup,
    "zone_table": zone_table,
    "kv_flatten": kv_flatten,
    "generic_fields": generic_fields,
    "hip_facts": hip_facts,
    "hip_products": hip_products,
    "archive_kinds": archive_kinds,
    "sub_folders": sub_folders,
    "config_candidates": config_candidates,
    "gateway_selection": gateway_selection,
    "gateway_summary": gateway_summary,
    "gateway_notes": gateway_notes,
    "portals": portals,
}
# what the view writes: each entry begins on a line of its own, those of remainder 5 go on in the next line
BROKEN = """WITH e AS (SELECT c_custkey AS k, c_nationkey AS n, c_custkey % 6 AS r, row_number() OVER (ORDER BY c_custkey) - 1 AS nth
      FROM customer WHERE c_custkey > 0 AND (c_custkey % 6 IN (1, 2, 4) OR c_custkey % 6 = 5 AND c_custkey < (SELECT max(c_custkey) FROM customer)))"""
CUSTOMERS = "WITH c AS (SELECT *, concat('fw', c_nationkey) AS file_id, c_custkey AS k, c_custkey % 5 AS r FROM customer)"
RULES = "c.r < 3"
ENTRY_TAGS = " UNION ALL ".join(
    f"SELECT file_id, '{tag}' AS tag, {depth} AS depth, {name} AS name FROM c WHERE {where}"
    for tag, depth, name, where in (
        ("pre-rulebase", 2, "NULL", "r = 0"), ("rulebase", 2, "NULL", "r = 1"), ("post-rulebase", 2, "NULL", "r = 2"),
        ("security", 3, "NULL", "r < 3"), ("rules", 4, "NULL", "r < 3"), ("entry", 5, "c_name", "r < 3"),
        ("from", 6, "NULL", "r < 3"), ("member", 7, "NULL", "r < 3"), ("member", 7, "NULL", "r < 3"), ("action", 6, "NULL", "r < 3"),
        ("zone", 2, "NULL", "r = 3"), ("entry", 3, "concat('zone', k)", "r = 3"), ("network", 4, "NULL", "r = 3"),
        ("layer3", 5, "NULL", "r = 3"), ("member", 6, "NULL", "r = 3"),
        ("deviceconfig", 2, "NULL", "k % 10 = 9"), ("system", 3, "NULL", "k % 10 = 9"), ("host-name", 4, "NULL", "k % 10 = 9"),
        ("dns", 4, "NULL", "k % 10 = 9"), ("primary", 5, "NULL", "k % 10 = 9"), ("allowed", 4, "NULL", "k % 10 = 9"),
        ("entry", 5, "concat('e', k)", "k % 10 = 9"),
        ("interface", 2, "NULL", "k % 10 = 4"), ("ethernet", 3, "NULL", "k % 10 = 4"), ("entry", 4, "concat('ethernet1/', k % 7)", "k % 10 = 4"),
        ("layer3", 5, "NULL", "k % 10 = 4"), ("ip", 6, "NULL", "k % 10 = 4"), ("entry", 7, "concat('10.0.0.', k, '/24')", "k % 10 = 4"),
        ("comment", 5, "NULL", "k % 10 = 4"),
    )
)
SERVICE = r"""
    WITH l AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY entry_ord DESC, line_no) AS o,
        strptime(substr(text, 20, 17), '%m/%d/%y %H:%M:%S') AS ts, substr(text, 42) AS m FROM v_service_log),
    r AS (SELECT *, coalesce(max(CASE WHEN m LIKE 'Parse gateway list%' THEN o END) OVER w, 0) AS rd,
        max(CASE WHEN m LIKE '%Pre-login starts%' THEN o END) OVER w AS sg FROM l
        WINDOW w AS (PARTITION BY file_id ORDER BY o)),
    t AS (SELECT file_id, o, rd, regexp_extract(m, 'gateway (\S+?), priority', 1) AS fq, try_cast(regexp_extract(m, 'priority=(\d+)', 1) AS INT) AS pr,
        m LIKE '%manual is 1' AS man,
        last_value(CASE WHEN m LIKE 'tcp%' THEN o END IGNORE NULLS) OVER x AS tcp_at,
        last_value(CASE WHEN m LIKE 'tcp%' THEN regexp_extract(m, 'is (\d+)', 1)::INT END IGNORE NULLS) OVER x AS tcp,
        max(CASE WHEN m LIKE 'One external gateway gw%' THEN o END) OVER x AS used, m FROM r
        WINDOW x AS (PARTITION BY file_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    ad AS (SELECT file_id, rd, fqdn, min(o) AS added FROM (
        SELECT file_id, rd, regexp_extract(m, '(gw\d+\.example\.com)', 1) AS fqdn, o FROM t
        WHERE m LIKE 'Gateway gw%' OR m LIKE 'One external gateway gw%') GROUP BY ALL),
    bad AS (SELECT t.file_id, t.rd, t.o, arg_max(fqdn, added) AS fqdn FROM t JOIN ad ON ad.file_id = t.file_id AND ad.rd = t.rd
        AND ad.added < t.o WHERE m LIKE '%region does not match' GROUP BY ALL),
    fa AS (SELECT file_id, rd, o, regexp_extract(m, 'Gateway (\S+?)\(', 1) AS fqdn, regexp_extract(m, '\((\w+)\)', 1) AS name,
          regexp_extract(m, 'ipv4 (\S*),', 1) AS ipv4, NULL::INT AS pr, NULL::BOOLEAN AS man, NULL::BOOLEAN AS rm, NULL::INT AS tcp
        FROM t WHERE m LIKE 'Gateway gw%'
        UNION ALL SELECT file_id, rd, o, fq, NULL, NULL, pr, man, true, CASE WHEN tcp_at > coalesce(used, 0) AND tcp_at > rd THEN tcp END
        FROM t WHERE m LIKE 'One external gateway gw%'
        UNION ALL SELECT file_id, rd, o, fqdn, NULL, NULL, -2, NULL, false, NULL FROM bad),
    su AS (SELECT file_id, max(rd) AS rd, arg_max(lower(regexp_extract(m, 'type is (\w+)', 1)), o) FILTER (m LIKE '%type is%') AS type,
        arg_max(regexp_extract(m, 'gateway=([^)]+)', 1), o) FILTER (m LIKE 'm_p%') AS best, bool_or(m LIKE '%list is empty') AS saw_empty
        FROM t WHERE m NOT LIKE '----%' AND (m LIKE '%ateway%' OR m LIKE 'tcp%') AND m NOT LIKE 'IPSec%' GROUP BY 1),
    ga AS (SELECT fa.file_id, fqdn, arg_max(name, o) FILTER (name IS NOT NULL) AS name, arg_max(ipv4, o) FILTER (ipv4 IS NOT NULL) AS ipv4,
        arg_max(pr, o) FILTER (pr IS NOT NULL) AS priority, arg_max(man, o) FILTER (man IS NOT NULL) AS manual,
        arg_max(rm, o) FILTER (rm IS NOT NULL) AS region_match, arg_max(tcp, o) FILTER (tcp IS NOT NULL) AS tcp_ms,
        coalesce(lower(any_value(su.best)) = lower(fqdn), false) AS selected
      FROM fa JOIN su ON su.file_id = fa.file_id AND su.rd = fa.rd GROUP BY fa.file_id, fqdn)"""
ORACLE = {
    "config_nodes": CUSTOMERS
    + f""", t AS ({ENTRY_TAGS} UNION ALL SELECT concat('fw', n_nationkey), 'config', 0, NULL FROM nation
          UNION ALL SELECT concat('fw', n_nationkey), 'vsys', 1, NULL FROM nation)
        SELECT file_id, tag, depth, count(*) AS n, max(name) AS last_name FROM t GROUP BY ALL""",
    "policy_union": CUSTOMERS
    + """ SELECT file_id, CASE r WHEN 0 THEN 'pre' WHEN 1 THEN 'local' ELSE 'post' END AS origin, c_name AS name,
          concat('z', k % 9, ', any') AS from_zone, lower(c_mktsegment) AS action FROM c WHERE r < 3""",
    "reverse_lookup": CUSTOMERS
    + """, z AS (SELECT file_id, k % 7 AS j, concat('zone', min(k)) AS zone FROM c WHERE r = 3 GROUP BY ALL)
        SELECT c.file_id, concat('ethernet1/', k % 7) AS interface, 'Layer3' AS type, concat('10.0.0.', k, '/24') AS ip_address,
          coalesce(zone, '') AS zone, c_mktsegment AS comment FROM c LEFT JOIN z ON z.file_id = c.file_id AND z.j = k % 7
        WHERE k % 10 = 4""",
    "zone_table": CUSTOMERS
    + " SELECT file_id, concat('zone', k) AS zone, 'Layer3' AS type, concat('ethernet1/', k % 7) AS interfaces FROM c WHERE r = 3",
    "kv_flatten": CUSTOMERS
    + """, s AS (SELECT * FROM c WHERE k % 10 = 9)
        SELECT file_id, 'Host Name' AS key, concat('h', k) AS value, 0 AS depth FROM s
        UNION ALL SELECT file_id, 'Dns', '', 0 FROM s UNION ALL SELECT file_id, 'Primary', c_mktsegment, 1 FROM s
        UNION ALL SELECT file_id, 'Allowed', '', 0 FROM s UNION ALL SELECT file_id, concat('e', k), '', 1 FROM s""",
    "generic_fields": CUSTOMERS
    + """ SELECT DISTINCT file_id, f AS field, o AS ord FROM c, (VALUES ('from', 1), ('action', 2)) AS v(f, o) WHERE r = 1""",
    "hip_facts": """
        WITH p AS (SELECT *, concat('pc', p_size) AS file_id, p_partkey AS k, p_partkey % 4 AS r FROM part)
        SELECT DISTINCT file_id, 'report' AS category, '' AS item, 'generated' AS field, '01/02/2024 03:04:05' AS value FROM p
        UNION ALL SELECT DISTINCT file_id, 'host-info', '', 'user-name', concat('u', p_size) FROM p
        UNION ALL SELECT file_id, 'missing-patch', concat('KB', k), 'severity', p_size::VARCHAR FROM p WHERE r = 0
        UNION ALL SELECT file_id, concat('none', k), '', 'products found', 'none' FROM p WHERE r = 1
        UNION ALL SELECT file_id, concat('cat', k % 3), p_name, 'vendor', p_brand FROM p WHERE r > 1
        UNION ALL SELECT file_id, concat('cat', k % 3), p_name, 'version', k::VARCHAR FROM p WHERE r > 1
        UNION ALL SELECT file_id, concat('cat', k % 3), p_name, 'enabled', 'yes' FROM p WHERE r > 1 AND k % 3 = 0""",
    "hip_products": """
        SELECT concat('pc', p_size) AS file_id, concat('cat', p_partkey % 3) AS category, p_brand AS vendor, p_name AS name,
          p_partkey::VARCHAR AS version, CASE WHEN p_partkey % 3 = 0 THEN 'yes' ELSE '' END AS enabled FROM part WHERE p_partkey % 4 > 1""",
    "archive_kinds": with_views(
        "WITH e AS (SELECT file_id, entry_ord, regexp_replace(path, '^\\./', '') AS path FROM v_bundle_entries), m AS ("
        + " UNION ALL ".join(
            f"SELECT '{side}' AS side, {i} AS i, file_id, min(entry_ord) AS o, arg_min(path, entry_ord) AS path FROM e"
            f" WHERE regexp_matches(path, '{p}') GROUP BY file_id"
            for side, patterns in (("f", kd.FIREWALL_MARKERS), ("a", kd.AGENT_MARKERS))
            for i, p in enumerate(patterns)
        )
        + r"""), c AS (SELECT file_id, side, count(*) AS hits FROM m GROUP BY ALL),
        d AS (SELECT file_id, side, path, min(o * 100 + i) AS o FROM m GROUP BY ALL),
        k AS (SELECT file_id, side, string_agg(path, '|' ORDER BY o) AS markers FROM d GROUP BY ALL),
        b AS (SELECT file_id, count(*) AS n, count_if(path LIKE '%.log' OR regexp_matches(path, '\.log\.[^/]*$')) AS logs FROM e GROUP BY 1),
        g AS (SELECT file_id, string_agg(path, '|' ORDER BY entry_ord) AS markers FROM e WHERE contains(path, '.log') GROUP BY 1)
        SELECT b.file_id, CASE WHEN cf.hits > 0 THEN 'firewall' WHEN ca.hits > 0 OR (logs >= 2 AND logs * 2 >= n) THEN 'gp-agent'
            ELSE 'unknown' END AS kind, coalesce(cf.hits, 0)::INT AS firewall_hits,
          CASE WHEN cf.hits > 0 THEN NULL ELSE coalesce(ca.hits, 0)::INT END AS agent_hits,
          CASE WHEN cf.hits > 0 THEN kf.markers WHEN ca.hits > 0 THEN ka.markers WHEN logs >= 2 AND logs * 2 >= n THEN g.markers
            ELSE '' END AS markers
        FROM b LEFT JOIN c cf ON cf.file_id = b.file_id AND cf.side = 'f' LEFT JOIN c ca ON ca.file_id = b.file_id AND ca.side = 'a'
        LEFT JOIN k kf ON kf.file_id = b.file_id AND kf.side = 'f' LEFT JOIN k ka ON ka.file_id = b.file_id AND ka.side = 'a'
        LEFT JOIN g ON g.file_id = b.file_id""",
        "bundle_entries",
    ),
    "malformed_elements": BROKEN
    + """ SELECT 'entry' AS tag, 1 AS depth, nth, 0 AS parent_nth, CASE r WHEN 1 THEN k::VARCHAR ELSE concat('c', k) END AS name,
          CASE WHEN r = 5 THEN (k + 1)::VARCHAR END AS kind, '' AS text,
          CASE r WHEN 5 THEN '' WHEN 4 THEN concat(n, ' & more') ELSE n::VARCHAR END AS collected FROM e
        UNION ALL SELECT 'v', 2, 0, nth, NULL, NULL, CASE r WHEN 5 THEN '' WHEN 4 THEN concat(n, ' & more') ELSE n::VARCHAR END,
          CASE r WHEN 5 THEN '' WHEN 4 THEN concat(n, ' & more') ELSE n::VARCHAR END FROM e""",
    "document_status": BROKEN + " SELECT 'fleet' AS file_id, 1 + 2 * count(*) AS starts, 1 AS unclosed, count(*) FILTER (r = 1) AS ignored_ends FROM e",
    "sub_folders": with_views(
        "SELECT DISTINCT file_id, split_part(path, '/', 1) AS folder FROM v_bundle_entries WHERE contains(path, '/')", "bundle_entries"
    ),
    "config_candidates": with_views(
        """SELECT file_id, path, size, 2 AS tier, row_number() OVER (PARTITION BY file_id ORDER BY size DESC, path) AS rank
           FROM v_bundle_entries WHERE path LIKE '%.xml'""",
        "bundle_entries",
    ),
    "gateway_selection": with_views(SERVICE + " SELECT * FROM ga", "service_log"),
    "gateway_summary": with_views(SERVICE + " SELECT file_id, type, best, saw_empty FROM su", "service_log"),
    "gateway_notes": with_views(
        SERVICE
        + """, n AS (SELECT su.file_id, saw_empty, count(fqdn) AS n, count_if(NOT region_match) AS mm, count_if(priority < 0) AS neg
             FROM su LEFT JOIN ga USING (file_id) GROUP BY ALL)
        SELECT file_id, 'region_mismatch' AS note FROM n WHERE mm > 0 UNION ALL SELECT file_id, 'all_negative' FROM n WHERE neg > 0 AND neg = n
        UNION ALL SELECT file_id, 'empty_list' FROM n WHERE saw_empty UNION ALL SELECT file_id, 'several_gateways' FROM n WHERE n > 1""",
        "service_log",
    ),
    "portals": with_views(
        SERVICE
        + r""", nm AS (SELECT file_id, o, sg, ts, CASE WHEN m LIKE 'Unserialized%' THEN regexp_extract(m, 'portal (\S+) and', 1)
               WHEN m LIKE 'Portal login%' THEN regexp_extract(m, 'address (\S+)\.$', 1) END AS ad,
             CASE WHEN m LIKE 'Unserialized%' THEN regexp_extract(m, 'user (\S+)$', 1) END AS us,
             CASE WHEN m LIKE '%region code%' THEN regexp_extract(m, 'code is (\S+)', 1) END AS rg, m FROM r),
        na AS (SELECT * FROM nm WHERE ad IS NOT NULL),
        rs AS (SELECT f.file_id, f.o, f.rg, coalesce(
              (SELECT arg_max(ad, n.o) FROM na n WHERE n.file_id = f.file_id AND n.o < f.o AND n.sg IS NOT DISTINCT FROM f.sg),
              (SELECT arg_min(ad, n.o) FROM na n WHERE n.file_id = f.file_id AND n.o > f.o AND n.sg IS NOT DISTINCT FROM f.sg)) AS ad
            FROM nm f WHERE rg IS NOT NULL),
        tu AS (SELECT f.file_id, (SELECT arg_max(ad, n.o) FROM na n WHERE n.file_id = f.file_id AND n.o < f.o
              AND n.sg IS NOT DISTINCT FROM f.sg) AS ad FROM nm f WHERE m LIKE 'IPSec%')
        SELECT na.file_id, na.ad AS address, (SELECT arg_max(rg, rs.o) FROM rs WHERE rs.file_id = na.file_id AND rs.ad = na.ad) AS region,
          arg_max(us, na.o) FILTER (us IS NOT NULL) AS user, bool_or(m LIKE 'Portal login%') AS auth_success,
          (SELECT count(*) FROM tu WHERE tu.file_id = na.file_id AND tu.ad = na.ad) AS tunnels,
          arg_min(ts, na.o) AS first_seen, arg_max(ts, na.o) AS last_seen FROM na GROUP BY na.file_id, na.ad""",
        "service_log",
    ),
}
