"""Command-line dump sections, licences and application traffic."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.operators import appstats as ap
from logquarry.operators import cli
from logquarry.plans.views import table, view, with_views


def cli_sections(spark, sf_dir):
    return cli.command_body(view(spark, sf_dir, "cli_dump"), cli.APP_STATS_COMMAND).select("file_id", "line_no", "text")


def system_info(spark, sf_dir):
    return cli.system_info(view(spark, sf_dir, "cli_dump"))


def _apps(spark, sf_dir):
    return cli.application_table(cli.command_body(view(spark, sf_dir, "cli_dump"), cli.APP_STATS_COMMAND))


def cli_app_table(spark, sf_dir):
    rows = ap.with_shares(_apps(spark, sf_dir)[0])
    return rows.select(
        "file_id", "vsys", "app", "sessions", "packets", "bytes", F.round("sessions_pct", 6).alias("sessions_pct"),
        F.round("avg_packet_size", 6).alias("avg_packet_size"),
    )


def cli_reported_totals(spark, sf_dir):
    return _apps(spark, sf_dir)[1]


def _licence_pairs(spark, sf_dir):
    return cli.licence_pairs(cli.command_body(view(spark, sf_dir, "cli_dump"), cli.LICENCE_COMMAND))


def licences(spark, sf_dir):
    return cli.licences(_licence_pairs(spark, sf_dir)).select("file_id", "entry_at", "feature", "description", "expires", "expired")


def licence_other(spark, sf_dir):
    pairs = _licence_pairs(spark, sf_dir)
    return cli.other_licence_pairs(pairs, cli.licences(pairs)).select("file_id", "entry_at", "key", "value")


def licence_counts(spark, sf_dir):
    return cli.licence_counts(cli.licences(_licence_pairs(spark, sf_dir)))


def _volumes(spark, sf_dir):
    volumes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("vsys"), F.col("l_suppkey").alias("app_id"))
    volumes = volumes.agg(
        F.count(F.lit(1)).cast("double").alias("sessions"),
        F.sum("l_quantity").alias("packets"),
        F.round(F.sum("l_extendedprice"), 2).alias("bytes"),
        F.sum("l_linenumber").cast("double").alias("app_changed"),
        F.max("l_linenumber").cast("double").alias("threats"),
    )
    names = table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 3 != 0)
    names = names.select(F.col("s_suppkey").alias("app_id"), F.col("s_name").alias("name"))
    return ap.label_apps(volumes, names, ("app_id",)).withColumn("file_id", F.lit("bundle"))


def app_label_join(spark, sf_dir):
    return _volumes(spark, sf_dir).select("vsys", "app_id", "app", "sessions")


def app_shares(spark, sf_dir):
    rows = ap.with_shares(_volumes(spark, sf_dir))
    names = ("sessions_pct", "packets_pct", "bytes_pct", "packets_per_session", "bytes_per_session", "avg_packet_size")
    return rows.select("vsys", "app", *[F.round(n, 6).alias(n) for n in names])


def app_table(spark, sf_dir):
    return ap.table(_volumes(spark, sf_dir), "app-", "packets").select("vsys", "app", "packets")


def app_preference(spark, sf_dir):
    series = _volumes(spark, sf_dir).where(F.col("vsys") != "R").withColumn("file_id", F.col("vsys"))
    snapshot = _volumes(spark, sf_dir).withColumn("file_id", F.col("vsys"))
    return ap.preferred(series, snapshot).select("file_id", "app", "source")


def vsys_list(spark, sf_dir):
    return ap.vsys_list(_apps(spark, sf_dir)[0], ("line_no",))


QUERIES = {
    "cli_sections": cli_sections,
    "system_info": system_info,
    "cli_app_table": cli_app_table,
    "cli_reported_totals": cli_reported_totals,
    "licences": licences,
    "licence_other": licence_other,
    "licence_counts": licence_counts,
    "app_label_join": app_label_join,
    "app_shares": app_shares,
    "app_table": app_table,
    "app_preference": app_preference,
    "vsys_list": vsys_list,
}
SECTIONS = r"""
    WITH c AS (SELECT *, CASE WHEN text LIKE '> %' THEN substr(text, 3) END AS cmd FROM v_cli_dump),
    d AS (SELECT *, last_value(cmd IGNORE NULLS) OVER w AS cur,
          last_value(CASE WHEN cmd IS NOT NULL THEN line_no END IGNORE NULLS) OVER w AS cur_at FROM c
          WINDOW w AS (PARTITION BY file_id, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    b AS (SELECT * FROM d WHERE cmd IS NULL AND cur_at = (SELECT min(line_no) FROM c WHERE c.file_id = d.file_id
          AND c.path = d.path AND c.cmd = d.cur)),
    body AS (SELECT * FROM b WHERE entry_ord = (SELECT min(entry_ord) FROM b x WHERE x.file_id = b.file_id
             AND x.cur = b.cur))"""
APPS = (
    SECTIONS
    + r""", ab AS (SELECT *, string_split_regex(trim(text), '\s+') AS p, last_value(CASE WHEN text LIKE 'Vsys:%' THEN
             regexp_extract(text, 'Vsys: (\S+)', 1) END IGNORE NULLS) OVER w AS vsys FROM body
             WHERE cur = 'show running application statistics' WINDOW w AS (PARTITION BY file_id, path ORDER BY line_no
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    ar AS (SELECT file_id, line_no, coalesce(vsys, '') AS vsys, array_to_string(p[1:len(p)-5], ' ') AS app,
             p[len(p)-4]::DOUBLE AS sessions, p[len(p)-3]::DOUBLE AS packets, p[len(p)-2]::DOUBLE AS bytes
           FROM ab WHERE len(p) >= 6 AND try_cast(p[len(p)-4] AS DOUBLE) IS NOT NULL
             AND try_cast(p[len(p)] AS DOUBLE) IS NOT NULL),
    ap AS (SELECT * FROM ar WHERE lower(app) <> 'total')"""
)
LICENCES = (
    SECTIONS
    + r""", lb AS (SELECT *, last_value(CASE WHEN text = 'License entry:' THEN line_no END IGNORE NULLS) OVER w AS entry_at
             FROM body WHERE cur = 'request license info' WINDOW w AS (PARTITION BY file_id, path ORDER BY line_no
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    lp AS (SELECT file_id, entry_at, line_no, regexp_extract(text, '^([^:]+): ', 1) AS key,
             regexp_extract(text, ': (.*)$', 1) AS value FROM lb WHERE entry_at < line_no AND text LIKE '%: %'),
    li AS (SELECT file_id, entry_at, coalesce(arg_max(value, line_no) FILTER (key = 'Feature'), '') AS feature,
             '' AS description, coalesce(arg_max(value, line_no) FILTER (key = 'Expires'), '') AS expires,
             coalesce(arg_max(value, line_no) FILTER (key = 'Expired?'), '') AS expired FROM lp GROUP BY ALL),
    lk AS (SELECT * FROM li WHERE feature <> '')"""
)
VOLUMES = """
    WITH vo AS (SELECT l_returnflag AS vsys, l_suppkey AS app_id, count(*)::DOUBLE AS sessions, sum(l_quantity) AS packets,
        round(sum(l_extendedprice), 2) AS bytes FROM lineitem GROUP BY ALL),
    ap AS (SELECT vo.*, coalesce(s_name, concat('app-', app_id)) AS app FROM vo LEFT JOIN supplier
           ON s_suppkey = app_id AND s_suppkey % 3 <> 0)"""
ORACLE = {
    "cli_sections": with_views(
        SECTIONS + " SELECT file_id, line_no, text FROM body WHERE cur = 'show running application statistics'", "cli_dump"
    ),
    "system_info": with_views(
        SECTIONS
        + r""", si AS (SELECT *, regexp_extract(text, '^([A-Za-z0-9_-]+):\s*(.*)$', 1) AS key FROM body
               WHERE cur = 'show system info'),
        so AS (SELECT file_id, min(line_no) AS lo FROM si WHERE key = 'hostname' GROUP BY 1),
        se AS (SELECT si.file_id, min(line_no) AS hi FROM si JOIN so USING (file_id)
               WHERE key = 'device-certificate-status' AND line_no > lo GROUP BY 1)
        SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS ord, key,
          regexp_extract(text, ':\s*(.*)$', 1) AS value FROM si JOIN so USING (file_id) JOIN se USING (file_id)
        WHERE key <> '' AND line_no BETWEEN lo AND hi""",
        "cli_dump",
    ),
    "cli_app_table": with_views(
        APPS
        + """ SELECT file_id, vsys, app, sessions, packets, bytes,
          round(sessions / sum(sessions) OVER (PARTITION BY file_id) * 100, 6) AS sessions_pct,
          round(CASE WHEN packets > 0 THEN bytes / packets ELSE 0 END, 6) AS avg_packet_size FROM ap""",
        "cli_dump",
    ),
    "cli_reported_totals": with_views(
        APPS
        + """ SELECT file_id, arg_max(sessions, line_no) AS reported_sessions, arg_max(packets, line_no) AS reported_packets,
          arg_max(bytes, line_no) AS reported_bytes FROM ar WHERE lower(app) = 'total' GROUP BY 1""",
        "cli_dump",
    ),
    "licences": with_views(LICENCES + " SELECT * FROM lk", "cli_dump"),
    "licence_other": with_views(
        LICENCES
        + """ SELECT file_id, entry_at, key, value FROM lp JOIN (SELECT file_id, entry_at FROM lk) USING (file_id, entry_at)
          WHERE key NOT IN ('Feature', 'Expires', 'Expired?')""",
        "cli_dump",
    ),
    "licence_counts": with_views(
        LICENCES + " SELECT file_id, count(*) AS installed, count_if(expired = 'yes') AS expired FROM lk GROUP BY 1", "cli_dump"
    ),
    "app_label_join": VOLUMES + " SELECT vsys, app_id, app, sessions FROM ap",
    "app_shares": VOLUMES
    + """ SELECT vsys, app, round(sessions / sum(sessions) OVER () * 100, 6) AS sessions_pct,
        round(packets / sum(packets) OVER () * 100, 6) AS packets_pct, round(bytes / sum(bytes) OVER () * 100, 6) AS bytes_pct,
        round(packets / sessions, 6) AS packets_per_session, round(bytes / sessions, 6) AS bytes_per_session,
        round(bytes / packets, 6) AS avg_packet_size FROM ap""",
    "app_table": VOLUMES + " SELECT vsys, app, packets FROM ap WHERE app LIKE '%app-%'",
    "app_preference": VOLUMES
    + " SELECT vsys AS file_id, app, CASE WHEN vsys = 'R' THEN 'cli' ELSE 'series' END AS source FROM ap",
    "vsys_list": with_views(
        APPS
        + """ SELECT file_id, vsys, row_number() OVER (PARTITION BY file_id ORDER BY f) AS ord FROM
          (SELECT file_id, vsys, min(line_no) AS f FROM ap GROUP BY ALL)""",
        "cli_dump",
    ),
}
