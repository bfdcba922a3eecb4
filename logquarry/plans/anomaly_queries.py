"""Log-event groups, counter breaches and time clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.functions.matching import phrase
from logquarry.operators import anomalies as an
from logquarry.plans.views import view, with_views

KNOWN_CASE = "\n".join(
    "WHEN regexp_matches(d, '(?i){}') THEN '{}'".format(p.replace("'", "''"), n) for n, p in an.KNOWN_EVENTS
)


def _template_sql() -> str:
    text = "d"
    for pattern, replacement in an.TEMPLATE_STEPS:
        pattern = pattern.replace("(?iu)", "(?i)").replace("'", "''")
        text = "regexp_replace({}, '{}', '{}', 'g')".format(text, pattern, replacement.replace("'", "''"))
    return f"trim({text})"


OCCURRENCES = (
    r"""
    WITH parsed AS (
      SELECT file_id, line_no, strptime(regexp_replace(regexp_extract(text, p, 1), '\s+', ' '),
             '%Y/%m/%d %H:%M:%S') AS ts, lower(regexp_extract(text, p, 2)) AS severity,
             lower(regexp_extract(text, p, 3)) AS subtype, trim(regexp_extract(text, p, 4)) AS d
      FROM v_syslog, (SELECT '"""
    + an.SYSTEM_LOG_LINE
    + r"""' AS p) WHERE regexp_matches(text, p)),
    occ AS (
      SELECT *, CASE """
    + KNOWN_CASE
    + " ELSE "
    + _template_sql()
    + r""" END AS label,
      CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2
                    WHEN 'informational' THEN 1 ELSE 0 END AS rk
      FROM parsed WHERE NOT regexp_matches(d, '(?i)^successfully connect(ed)? to (address|server|host)\b|"""
    + r"""^successfully (resolved|downloaded|updated|sent)\b'))"""
)
GROUPS = (
    OCCURRENCES
    + """, grp AS (
      SELECT file_id, label, count(*) AS count, arg_min(severity, -rk * 1000000000000 + line_no) AS severity,
             arg_min(subtype, line_no) AS subtype, arg_min(d, line_no) AS sample,
             min(ts) AS first_seen, max(ts) AS last_seen
      FROM occ GROUP BY ALL)"""
)
BREACH_CASES = r"""
    CASE WHEN regexp_matches(name, '^(mp|dp)__cpu_load_avg__i_(1|5|15)$') THEN
           CASE WHEN value > 5 THEN 'critical|cpu|above 5' WHEN value > 2.5 THEN 'critical|cpu|above 2.5' END
         WHEN regexp_matches(name, '^(mp|dp)__top__cpu__iowait_pct$') THEN
           CASE WHEN value > 5 THEN 'critical|cpu|above 5' WHEN value > 2 THEN 'high|cpu|above 2' END
         WHEN regexp_matches(name, '^(mp|dp)__cpu__(\d+)_(avg|max)$') THEN
           CASE WHEN value > 80 THEN 'critical|cpu|above 80%' END
         WHEN regexp_matches(name, '^(mp|dp)__processes__(.+)_(\d+)_cpu$') THEN
           CASE WHEN value > 85 THEN 'high|process|above 85%' END END"""
BREACHES = (
    "WITH b AS (SELECT *, "
    + BREACH_CASES
    + r""" AS hit FROM v_metrics), br AS (
      SELECT file_id, name, ts, value, split_part(hit, '|', 1) AS severity, split_part(hit, '|', 2) AS subtype,
        CASE WHEN name LIKE '%load_avg%' THEN concat(left(name, 2), ' cpu ', regexp_extract(name, '_(\d+)$', 1),
                                                     ' min load ', split_part(hit, '|', 3))
             WHEN name LIKE '%iowait%' THEN concat(left(name, 2), ' cpu iowait ', split_part(hit, '|', 3))
             WHEN name LIKE '%processes%' THEN concat(left(name, 2), ' process ',
                  regexp_extract(name, '__processes__(.+)_\d+_cpu$', 1), ' cpu ', split_part(hit, '|', 3))
             ELSE concat(left(name, 2), ' cpu core ', regexp_extract(name, '_(avg|max)$', 1), ' ',
                  split_part(hit, '|', 3)) END AS label
      FROM b WHERE hit IS NOT NULL)"""
)
QUEUES = r""", q AS (
      SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY file_id, name) AS n
      FROM v_metrics WHERE regexp_matches(name, '^(mp|dp)__netstat_detail__(.+)_(recv_q|send_q)$')
      WINDOW w AS (PARTITION BY file_id, name ORDER BY ts, line_no)),
    tr AS (SELECT file_id, name, median(value) FILTER (rn <= greatest(n // 3, 1)) AS first_median,
                  median(value) FILTER (rn > n - greatest(n // 3, 1)) AS last_median,
                  max(value) FILTER (rn = n) AS final FROM q WHERE n >= 5 GROUP BY ALL),
    gq AS (SELECT q.file_id, q.name, q.ts, q.value, first_median, last_median,
             CASE WHEN last_median >= 100000 THEN 'high' ELSE 'medium' END AS severity, 'netstat' AS subtype,
             concat(left(q.name, 2), ' netstat ', regexp_extract(q.name, '__netstat_detail__(.+)_recv_q$', 1),
                    ' recv_q increasing') AS label
           FROM q JOIN tr USING (file_id, name)
           WHERE last_median > first_median AND final > 0 AND value > first_median)"""


def anomaly_groups(spark, sf_dir):
    groups = an.group_occurrences(an.log_occurrences(view(spark, sf_dir, "syslog")))
    return an.sort_groups(groups)


def anomaly_occurrences(spark, sf_dir):
    rows = an.log_occurrences(view(spark, sf_dir, "syslog"))
    return rows.select("file_id", "line_no", "ts", "severity", "subtype", "label", "description")


def anomaly_search(spark, sf_dir):
    rows = an.log_occurrences(view(spark, sf_dir, "syslog"))
    groups = an.group_occurrences(rows)
    return an.search_groups(groups, rows, (phrase("10.1.7.9") | phrase("pkg-44")) & ~phrase("bgp peer")).select(
        "file_id", "label", "count"
    )


def band_breaches(spark, sf_dir):
    rows = an.band_breaches(view(spark, sf_dir, "metrics"))
    return rows.select("file_id", "name", "ts", "value", "label", "severity", "subtype")


def growing_queues(spark, sf_dir):
    rows = an.growing_queues(view(spark, sf_dir, "metrics"))
    return rows.select("file_id", "name", "ts", "value", "first_median", "last_median", "label", "severity")


def counter_anomaly_groups(spark, sf_dir):
    groups = an.counter_groups(view(spark, sf_dir, "metrics"))
    return groups.select("file_id", "label", "count", "severity", "subtype", "first_seen", "last_seen")


def merged_anomalies(spark, sf_dir):
    logs = an.group_occurrences(an.log_occurrences(view(spark, sf_dir, "syslog")))
    merged = an.merge_groups(logs, an.counter_groups(view(spark, sf_dir, "metrics")))
    return an.sort_groups(merged).select("file_id", "label", "count", "severity", "source", "last_seen")


def time_clusters(spark, sf_dir):
    return an.time_clusters(an.log_occurrences(view(spark, sf_dir, "syslog")))


def nearest_cluster(spark, sf_dir):
    clusters = an.time_clusters(an.log_occurrences(view(spark, sf_dir, "syslog")))
    return an.nearest_cluster(clusters, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))


CLUSTERS = (
    OCCURRENCES
    + """, per AS (
      SELECT file_id, label, ts, count(*) AS n FROM occ GROUP BY ALL),
    sp AS (SELECT file_id, label, epoch(max(ts)) - epoch(min(ts)) AS s, min(ts) AS lo FROM per GROUP BY ALL),
    wd AS (SELECT file_id, label, lo, CASE WHEN s > 43200 THEN 1800 WHEN s > 21600 THEN 900 WHEN s > 7200 THEN 600
                  WHEN s > 2700 THEN 300 ELSE 1 END AS w FROM sp),
    anchors AS (
      SELECT file_id, label, lo AS a, w FROM wd
      UNION ALL
      SELECT file_id, label, a, w FROM (
        SELECT x.file_id, x.label, x.w, (SELECT min(p.ts) FROM per p WHERE p.file_id = x.file_id AND p.label = x.label
               AND p.ts >= x.a + to_seconds(x.w)) AS a FROM anchors x) WHERE a IS NOT NULL),
    cl AS (SELECT p.file_id, p.label, a.a AS ts, max(p.ts) AS last_ts, sum(n)::BIGINT AS count
           FROM per p ASOF JOIN anchors a ON p.file_id = a.file_id AND p.label = a.label AND p.ts >= a.a
           GROUP BY ALL)"""
).replace("WITH", "WITH RECURSIVE", 1)

QUERIES = {
    "anomaly_groups": anomaly_groups,
    "anomaly_occurrences": anomaly_occurrences,
    "anomaly_search": anomaly_search,
    "band_breaches": band_breaches,
    "growing_queues": growing_queues,
    "counter_anomaly_groups": counter_anomaly_groups,
    "merged_anomalies": merged_anomalies,
    "time_clusters": time_clusters,
    "nearest_cluster": nearest_cluster,
}
COUNTER_GROUPS = (
    BREACHES
    + QUEUES
    + """, co AS (SELECT file_id, label, severity, subtype, ts FROM br
                  UNION ALL SELECT file_id, label, severity, subtype, ts FROM gq),
    cg AS (SELECT file_id, label, count(*) AS count, arg_max(severity, CASE severity WHEN 'critical' THEN 5
             WHEN 'high' THEN 4 WHEN 'medium' THEN 3 ELSE 2 END) AS severity, any_value(subtype) AS subtype,
             min(ts) AS first_seen, max(ts) AS last_seen FROM co GROUP BY ALL)"""
)
ORACLE = {
    "anomaly_groups": with_views(GROUPS + " SELECT * FROM grp", "syslog"),
    "anomaly_occurrences": with_views(
        OCCURRENCES + " SELECT file_id, line_no, ts, severity, subtype, label, d AS description FROM occ", "syslog"
    ),
    "anomaly_search": with_views(
        GROUPS
        + """, hay AS (SELECT file_id, label, lower(string_agg(d, '   ')) AS h FROM occ GROUP BY ALL)
        SELECT file_id, label, count FROM grp JOIN hay USING (file_id, label)
        WHERE (contains(h, '10.1.7.9') OR contains(h, 'pkg-44'))
          AND NOT contains(concat(h, lower(label)), 'bgp peer')""",
        "syslog",
    ),
    "band_breaches": with_views(
        BREACHES + " SELECT file_id, name, ts, value, label, severity, subtype FROM br", "metrics"
    ),
    "growing_queues": with_views(
        "WITH one AS (SELECT 1)"
        + QUEUES
        + " SELECT file_id, name, ts, value, first_median, last_median, label, severity FROM gq",
        "metrics",
    ),
    "counter_anomaly_groups": with_views(COUNTER_GROUPS + " SELECT * FROM cg", "metrics"),
    "merged_anomalies": with_views(
        GROUPS
        + COUNTER_GROUPS.replace("WITH b AS", ", b AS", 1)
        + """ SELECT file_id, label, count, severity, 'log' AS source, last_seen FROM grp
        UNION ALL SELECT file_id, label, count, severity, 'counter', last_seen FROM cg""",
        "syslog",
        "metrics",
    ),
    "time_clusters": with_views(CLUSTERS + " SELECT * FROM cl", "syslog"),
    "nearest_cluster": with_views(
        CLUSTERS
        + """ SELECT file_id, label, ts, last_ts, count FROM (
          SELECT *, row_number() OVER (PARTITION BY file_id, label
            ORDER BY abs(epoch(ts) - epoch(TIMESTAMP '2024-01-15 12:00:00')), ts) AS r FROM cl) WHERE r = 1""",
        "syslog",
    ),
}
