"""Operators that the other query modules do not reach: kinds and gating, listings, paths, file hits, trees and first events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from logquarry.functions.linefields import field
from logquarry.functions.matching import phrase
from logquarry.functions.text import clip
from logquarry.operators import configtree as ct
from logquarry.operators import kind as kd
from logquarry.operators import memory as me
from logquarry.operators import search as se
from logquarry.operators import structure as st
from logquarry.operators.ordered import shared_folder
from logquarry.plans.views import table, view, with_views
from logquarry.sources import archives as ar
from logquarry.sources.tables import commit, current
from logquarry.sources.xmlnodes import xml_nodes

PATHS = tuple(f"docs/en/{i}.log" for i in range(0, 60, 7))


def kind_labels(spark, sf_dir):
    kinds = kd.detect_kind(view(spark, sf_dir, "bundle_entries"))
    return kinds.select("file_id", kd.kind_label(F.col("kind")).alias("label"))


def gated_entries(spark, sf_dir):
    """Entries of the archives that the firewall passes read."""
    entries = view(spark, sf_dir, "bundle_entries")
    rows = kd.for_kinds(entries, kd.detect_kind(entries), kd.FIREWALL_PASS_KINDS)
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("entries"))


def entry_listing(spark, sf_dir):
    return ar.listing(view(spark, sf_dir, "bundle_entries"), "logs", ".LOG").select("file_id", "path", "size")


def one_entry(spark, sf_dir):
    return ar.read_entry(view(spark, sf_dir, "lines"), "docs/en/6.log").select("file_id", "line_no", "text")


def search_paths(spark, sf_dir):
    rows = se.match_lines(view(spark, sf_dir, "lines"), phrase("the "), PATHS)
    return rows.select("path", "line_no")


def search_results(spark, sf_dir):
    """File-name hits and line hits in one list, with their types and clipped texts."""
    lines = view(spark, sf_dir, "lines")
    condition = phrase("en/1") | phrase("license")
    files = se.file_hits(lines.select("file_id", "entry_ord", "path").distinct(), condition)
    rows = se.outcome(se.search(lines, condition), files)[0]
    return rows.select("file_id", "entry_ord", "path", "type", "line_no", clip(F.col("text"), 30).alias("text"))


def separator_fields(spark, sf_dir):
    lines = view(spark, sf_dir, "lines")
    return lines.where(field(2, ",").matches("^ ?the\\b").on(F.col("text"))).select("path", "line_no")


def repeated_paths(spark, sf_dir):
    """Every document is an entry of the same path: context and carried labels must stay within an entry."""
    lines = view(spark, sf_dir, "lines").withColumn("path", F.concat("file_id", F.lit(".log")))
    rows = se.context_lines(se.match_lines(lines, phrase("license")), lines, 1, 1)
    return rows.select("file_id", "entry_ord", "hit_line", "line_no", F.md5("text").alias("digest"))


def repeated_path_times(spark, sf_dir):
    lines = view(spark, sf_dir, "monitor").withColumn("entry_ord", (F.col("line_no") % 2).cast("int"))
    rows = st.filter_lines(lines, 2024)
    return rows.select("file_id", "entry_ord", "line_no", F.col("ts"))


def tagged_elements(spark, sf_dir):
    nodes = xml_nodes(view(spark, sf_dir, "config_xml"))
    return ct.find_by_tag(nodes, "entry", "rules").select("file_id", "name")


def managed_documents(spark, sf_dir):
    rows = ct.managed_markers(view(spark, sf_dir, "config_xml"))
    return rows.select("file_id", F.array_join("markers", ",").alias("markers"), "managed")


def config_roots(spark, sf_dir):
    return ct.root_tags(view(spark, sf_dir, "config_xml")).select("file_id", "path", "root")


def first_oom(spark, sf_dir):
    rows = me.first_oom(me.oom_events(view(spark, sf_dir, "kernel_log"), 2024))
    return rows.select("file_id", "ooms", F.col("first.ts").alias("ts"))


def result_sets(spark, sf_dir):
    """Two generations of parsed archives: the second parses some again, a few of them to nothing."""
    number = F.col("user_id") % 50
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("bundle"), number).alias("file_id"), "event_id", "event_type", number.alias("number")
    )
    folder = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    commit(rows, rows, folder, ("event_id",))
    again = rows.where(F.col("number") < 20)
    commit(again.where((F.col("number") >= 5) & (F.col("event_type") == "click")), again, folder, ("event_id",))
    return current(spark, folder).select("file_id", "event_id", "event_type")


QUERIES = {
    "result_sets": result_sets,
    "kind_labels": kind_labels,
    "gated_entries": gated_entries,
    "entry_listing": entry_listing,
    "one_entry": one_entry,
    "search_paths": search_paths,
    "search_results": search_results,
    "separator_fields": separator_fields,
    "repeated_paths": repeated_paths,
    "repeated_path_times": repeated_path_times,
    "tagged_elements": tagged_elements,
    "managed_documents": managed_documents,
    "config_roots": config_roots,
    "first_oom": first_oom,
}
# The kinds from what the view writes, not from the engine's patterns.
KINDS = """
    WITH e AS (SELECT file_id, entry_ord, path,
        path LIKE 'x/opt/pancfg/%' OR path = 'var/log/pan/dp0-monitor.log' AS fw,
        path LIKE './logs/PanGPS.log%' OR path = 'HipReport.xml' AS ag,
        path LIKE '%.log' OR path LIKE '%.log.%' AS lg FROM v_bundle_entries),
    k AS (SELECT file_id, CASE WHEN bool_or(fw) THEN 'firewall' WHEN bool_or(ag) OR (count_if(lg) >= 2 AND 2 * count_if(lg) >= count(*))
        THEN 'gp-agent' ELSE 'unknown' END AS kind FROM e GROUP BY 1)"""
ORACLE = {
    "result_sets": """
        SELECT concat('bundle', user_id % 50) AS file_id, event_id, event_type FROM events
        WHERE user_id % 50 >= 20 OR (user_id % 50 >= 5 AND event_type = 'click')""",
    "kind_labels": with_views(
        KINDS
        + """ SELECT file_id, CASE kind WHEN 'firewall' THEN 'Firewall tech-support' WHEN 'gp-agent' THEN 'GlobalProtect agent'
          ELSE 'Unrecognised archive' END AS label FROM k""",
        "bundle_entries",
    ),
    "gated_entries": with_views(
        KINDS + " SELECT file_id, count(*) AS entries FROM e JOIN k USING (file_id) WHERE kind <> 'gp-agent' GROUP BY 1", "bundle_entries"
    ),
    "entry_listing": with_views("SELECT file_id, path, size FROM v_bundle_entries WHERE path LIKE 'logs/%' AND contains(lower(path), '.log')", "bundle_entries"),
    "one_entry": with_views("SELECT file_id, line_no, text FROM v_lines WHERE path = 'docs/en/6.log'", "lines"),
    "search_paths": with_views(
        f"SELECT path, line_no FROM v_lines WHERE path IN {PATHS} AND contains(lower(text), 'the ')", "lines"
    ),
    "search_results": with_views(
        """SELECT DISTINCT file_id, entry_ord, path, 'file' AS type, NULL::BIGINT AS line_no, NULL::VARCHAR AS text FROM v_lines
             WHERE contains(path, 'en/1')
           UNION ALL SELECT file_id, entry_ord, path, 'line', line_no,
             CASE WHEN length(rtrim(text, chr(13))) > 30 THEN left(text, 30) || '…' ELSE rtrim(text, chr(13)) END
             FROM v_lines WHERE contains(lower(text), 'en/1') OR contains(lower(text), 'license')""",
        "lines",
    ),
    "separator_fields": with_views(
        "SELECT path, line_no FROM v_lines WHERE regexp_matches(string_split(text, ',')[2], '(?i)^ ?the\\b')", "lines"
    ),
    "repeated_paths": with_views(
        """SELECT h.file_id, h.entry_ord, h.line_no AS hit_line, x.line_no, md5(x.text) AS digest FROM v_lines h JOIN v_lines x
             ON x.file_id = h.file_id AND x.entry_ord = h.entry_ord AND abs(x.line_no - h.line_no) = 1 WHERE contains(lower(h.text), 'license')""",
        "lines",
    ),
    "repeated_path_times": with_views(
        r"""SELECT file_id, (line_no % 2)::INT AS entry_ord, line_no, last_value(try_cast(replace(nullif(regexp_extract(text,
             '^(\d{4}[-/]\d{2}[-/]\d{2} \d{2}:\d{2}:\d{2})', 1), ''), '/', '-') AS TIMESTAMP) IGNORE NULLS) OVER (PARTITION BY file_id, line_no % 2
             ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ts FROM v_monitor""",
        "monitor",
    ),
    "tagged_elements": "SELECT concat('fw', c_nationkey) AS file_id, c_name AS name FROM customer WHERE c_custkey % 5 < 3",
    "managed_documents": """
        WITH m AS (SELECT concat('fw', n_nationkey) AS file_id, string_agg(DISTINCT rb, ',' ORDER BY rb) AS markers FROM nation LEFT JOIN (
          SELECT c_nationkey, CASE c_custkey % 5 WHEN 0 THEN 'pre-rulebase' ELSE 'post-rulebase' END AS rb FROM customer
          WHERE c_custkey % 5 IN (0, 2)) c ON c_nationkey = n_nationkey GROUP BY 1)
        SELECT file_id, coalesce(markers, '') AS markers, markers IS NOT NULL AS managed FROM m""",
    "config_roots": "SELECT concat('fw', n_nationkey) AS file_id, 'opt/pancfg/mgmt/running-config.xml' AS path, 'config' AS root FROM nation",
    "first_oom": with_views(
        r"""WITH k AS (SELECT *, CASE WHEN contains(lower(text), 'invoked oom-killer') THEN 'i'
             WHEN regexp_matches(text, '(?i)kill(ed)? process \d+ \(') THEN 'k' END AS kind,
             try_cast(nullif(regexp_extract(text, '\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}'), '') AS TIMESTAMP) AS t FROM v_kernel_log),
           m AS (SELECT *, lag(kind) OVER w AS bk, lag(t) OVER w AS bt, lead(kind) OVER w AS nk FROM k WHERE kind IS NOT NULL
             WINDOW w AS (PARTITION BY file_id, path ORDER BY line_no)),
           e AS (SELECT file_id, CASE WHEN kind = 'k' AND bk = 'i' THEN coalesce(bt, t) ELSE t END AS ts FROM m WHERE kind = 'k' OR nk IS DISTINCT FROM 'k')
           SELECT file_id, count(*) AS ooms, CASE WHEN count_if(ts IS NULL) > 0 THEN NULL ELSE min(ts) END AS ts FROM e GROUP BY 1""",
        "kernel_log",
    ),
}
