"""Memory trend, restarts, growth suspects, findings and out-of-memory pairing."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.operators import memory as me
from logquarry.plans.views import view, with_views


def _growth(spark, sf_dir):
    counters = view(spark, sf_dir, "memory_counters")
    trend = me.available_trend(counters)
    return counters, trend, me.process_growth(counters, trend)


def mem_trend(spark, sf_dir):
    rows = me.available_trend(view(spark, sf_dir, "memory_counters"))
    return rows.withColumn("span_days", F.round("span_days", 6))


def restart_detection(spark, sf_dir):
    rows = me.restarts(me.resident_samples(view(spark, sf_dir, "memory_counters"))).rows()
    return rows.where("restart").select("file_id", "process", "pid", "ts", "value", "rn")


def process_growth(spark, sf_dir):
    rows = _growth(spark, sf_dir)[2].drop("drop_kb")
    return rows.withColumn("pct_of_drop", F.round("pct_of_drop", 6))


def suspects_topk(spark, sf_dir):
    rows = me.suspects(_growth(spark, sf_dir)[2], 5)
    return rows.select("file_id", "plane", "process", "growth_kb", "rank")


def concurrent_duplicates(spark, sf_dir):
    counters, _, growth = _growth(spark, sf_dir)
    return me.duplicates(counters, growth)


def explained_share(spark, sf_dir):
    _, trend, growth = _growth(spark, sf_dir)
    return me.explained(growth, trend).select("file_id", "plane", F.round("explained_pct", 4).alias("explained_pct"))


def kernel_suspects(spark, sf_dir):
    counters, trend, _ = _growth(spark, sf_dir)
    rows = me.kernel_growth(counters, trend)
    return rows.withColumn("pct_of_drop", F.round("pct_of_drop", 6))


def memory_findings(spark, sf_dir):
    counters, trend, growth = _growth(spark, sf_dir)
    planes = trend.select("file_id", "plane")
    events = me.oom_events(view(spark, sf_dir, "kernel_log"), 2024)
    kernel = me.kernel_growth(counters, trend)
    rows = me.findings(planes, events, trend, growth, kernel, me.duplicates(counters, growth))
    return rows.select("file_id", "plane", "severity", "title", "ord.rule")


def overlay_names(spark, sf_dir):
    counters, trend, growth = _growth(spark, sf_dir)
    return me.overlay_series(trend, me.suspects(growth), counters)


def oom_pairing(spark, sf_dir):
    return me.oom_events(view(spark, sf_dir, "kernel_log"), 2024).drop("entry_ord")


QUERIES = {
    "mem_trend": mem_trend,
    "restart_detection": restart_detection,
    "process_growth": process_growth,
    "suspects_topk": suspects_topk,
    "concurrent_duplicates": concurrent_duplicates,
    "explained_share": explained_share,
    "kernel_suspects": kernel_suspects,
    "memory_findings": memory_findings,
    "overlay_names": overlay_names,
    "oom_pairing": oom_pairing,
}
GROWTH = r"""
    WITH av AS (SELECT file_id, name AS counter, arg_min(value, (ts, line_no)) AS start_kb,
        arg_max(value, (ts, line_no)) AS end_kb, min(value) AS min_kb, min(ts) AS from_ts, max(ts) AS to_ts,
        count(*) AS points FROM v_memory_counters WHERE name LIKE 'mp!_!_memory!_!_mem!_available' ESCAPE '!' GROUP BY ALL),
    tr AS (SELECT file_id, 'mp' AS plane, counter, start_kb, end_kb, min_kb, from_ts, to_ts, points,
        start_kb - end_kb AS drop_kb, round(date_diff('second', from_ts, to_ts) / 86400, 6) AS span_days
        FROM av WHERE points >= 2),
    rs AS (SELECT file_id, 'mp' AS plane, regexp_extract(name, '^mp__processes__(.+)_(\d+)_res_swap$', 1) AS process,
        regexp_extract(name, '^mp__processes__(.+)_(\d+)_res_swap$', 2) AS pid, name, ts, value, line_no
        FROM v_memory_counters WHERE regexp_matches(name, '^(mp|dp)__processes__(.+)_(\d+)_res_swap$')),
    lg AS (SELECT *, lag(pid) OVER w AS pp, lag(value) OVER w AS pv, row_number() OVER w AS rn,
        count(*) OVER (PARTITION BY file_id, process) AS n FROM rs
        WINDOW w AS (PARTITION BY file_id, process ORDER BY ts, line_no)),
    rt AS (SELECT *, pv IS NOT NULL AND (pid <> pp OR (pv > 0 AND value < pv * 0.5)) AS restart FROM lg),
    st AS (SELECT file_id, plane, process, arg_min(value, rn) AS start_kb, arg_max(value, rn) AS end_kb,
        max(value) AS peak_kb, max(CASE WHEN restart THEN rn END) AS lr, min(name) AS counter,
        count(DISTINCT pid) AS pids FROM rt WHERE n >= 2 GROUP BY ALL),
    po AS (SELECT rt.file_id, rt.process, median(value) AS post FROM rt JOIN st USING (file_id, process)
        WHERE rn >= lr GROUP BY ALL),
    gr AS (SELECT st.file_id, st.plane, st.process, st.counter, pids, st.start_kb, st.end_kb, peak_kb,
        CASE WHEN lr IS NULL THEN st.end_kb - st.start_kb
             ELSE greatest(st.end_kb - st.start_kb, peak_kb - st.start_kb, peak_kb - post) END AS growth_kb,
        lr IS NOT NULL AS restarted, coalesce(post, 0) AS post_restart_kb, coalesce(peak_kb - post, 0) AS reclaimed_kb,
        drop_kb FROM st LEFT JOIN po USING (file_id, process) LEFT JOIN tr ON tr.file_id = st.file_id),
    g AS (SELECT *, CASE WHEN drop_kb > 0 THEN growth_kb / drop_kb * 100 ELSE 0 END AS pct_of_drop FROM gr
        WHERE growth_kb > 0)"""
TOP = """, tp AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY growth_kb DESC, process) AS rank FROM g
        WHERE NOT coalesce(drop_kb > 0 AND pct_of_drop < 5 AND NOT restarted, false))"""
DUPLICATES = """, du AS (SELECT DISTINCT file_id, plane, process FROM (SELECT file_id, plane, process, date_trunc('second', ts)
        FROM rs GROUP BY ALL HAVING min(pid) <> max(pid)) WHERE (file_id, process) IN (SELECT (file_id, process) FROM g
        WHERE pids > 1))"""
KERNEL = r""", kn AS (SELECT file_id, 'mp' AS plane, name AS counter, CASE WHEN name LIKE '%sunreclaim' THEN
          'Unreclaimable slab (SUnreclaim)' ELSE concat('slab cache ', regexp_extract(name, 'slabinfo__(.+)_totalactsize', 1))
          END AS label, CASE WHEN name LIKE '%sunreclaim' THEN value ELSE value / 1024 END AS kb, ts, line_no
        FROM v_memory_counters WHERE name LIKE '%sunreclaim' OR name LIKE '%totalactsize'),
    ke AS (SELECT file_id, plane, label, counter, arg_min(kb, (ts, line_no)) AS start_kb,
          arg_max(kb, (ts, line_no)) AS end_kb, count(*) AS n FROM kn GROUP BY ALL HAVING count(*) >= 2),
    kg AS (SELECT ke.file_id, ke.plane, label, ke.counter, ke.start_kb, ke.end_kb, ke.end_kb AS peak_kb,
          ke.end_kb - ke.start_kb AS growth_kb, round(CASE WHEN drop_kb > 0 THEN (ke.end_kb - ke.start_kb) / drop_kb * 100
          ELSE 0 END, 6) AS pct_of_drop FROM ke LEFT JOIN tr ON tr.file_id = ke.file_id
        WHERE ke.end_kb > ke.start_kb)"""
OOM = r"""
    WITH k AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)([\w./-]+)\s+invoked\s+oom-killer') THEN 'i'
        WHEN regexp_matches(text, '(?i)kill(?:ed)?\s+process\s+(\d+)\s+\(([^)]+)\)') THEN 'k' END AS kind,
        try_cast(nullif(regexp_extract(text, '\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}'), '') AS TIMESTAMP) AS ts,
        regexp_extract(text, '(?i)([\w./-]+)\s+invoked', 1) AS inv,
        regexp_extract(text, '(?i)process\s+(\d+)\s+\(([^)]+)\)', 1) AS kp,
        regexp_extract(text, '(?i)process\s+(\d+)\s+\(([^)]+)\)', 2) AS kn,
        nullif(regexp_extract(text, '(?i)score\s+(\d+)', 1), '') AS sc FROM v_kernel_log),
    m AS (SELECT *, lag(kind) OVER w AS bk, lag(inv) OVER w AS bi, lag(ts) OVER w AS bt, lag(text) OVER w AS bx,
        lead(kind) OVER w AS nk FROM k WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY file_id, path ORDER BY line_no)),
    ev AS (SELECT file_id, path AS source, line_no,
        CASE WHEN kind = 'k' AND bk = 'i' THEN coalesce(bt, ts) ELSE ts END AS ts,
        CASE WHEN kind = 'i' THEN inv WHEN bk = 'i' THEN bi END AS invoked_by,
        CASE WHEN kind = 'k' THEN kn END AS killed, CASE WHEN kind = 'k' THEN kp END AS killed_pid,
        CASE WHEN kind = 'k' THEN sc END AS score,
        CASE WHEN kind = 'k' AND bk = 'i' THEN bx ELSE text END AS raw
      FROM m WHERE kind = 'k' OR nk IS DISTINCT FROM 'k')"""
ORACLE = {
    "mem_trend": with_views(GROWTH + " SELECT * FROM tr", "memory_counters"),
    "restart_detection": with_views(
        GROWTH + " SELECT file_id, process, pid, ts, value, rn FROM rt WHERE restart", "memory_counters"
    ),
    "process_growth": with_views(
        GROWTH
        + """ SELECT file_id, plane, process, counter, pids, start_kb, end_kb, peak_kb, growth_kb,
          round(pct_of_drop, 6) AS pct_of_drop, restarted, post_restart_kb, reclaimed_kb FROM g""",
        "memory_counters",
    ),
    "suspects_topk": with_views(
        GROWTH + TOP + " SELECT file_id, plane, process, growth_kb, rank FROM tp WHERE rank <= 5", "memory_counters"
    ),
    "concurrent_duplicates": with_views(GROWTH + DUPLICATES + " SELECT * FROM du", "memory_counters"),
    "explained_share": with_views(
        GROWTH
        + """ SELECT tr.file_id, tr.plane, round(CASE WHEN tr.drop_kb > 0 THEN coalesce(s, 0) / tr.drop_kb * 100
             ELSE 0 END, 4) AS explained_pct
           FROM tr LEFT JOIN (SELECT file_id, sum(growth_kb) AS s FROM g GROUP BY 1) x ON x.file_id = tr.file_id""",
        "memory_counters",
    ),
    "kernel_suspects": with_views(GROWTH + KERNEL + " SELECT * FROM kg", "memory_counters"),
    "memory_findings": with_views(
        OOM
        + GROWTH.replace("WITH av", ", av", 1)
        + TOP
        + DUPLICATES
        + KERNEL
        + """, ex AS (SELECT tr.file_id, tr.drop_kb, CASE WHEN tr.drop_kb > 0 THEN coalesce(sum(growth_kb), 0) / tr.drop_kb
               * 100 ELSE 0 END AS pct FROM tr LEFT JOIN g ON g.file_id = tr.file_id GROUP BY tr.file_id, tr.drop_kb),
          gb AS (SELECT file_id, drop_kb, regexp_replace(printf('%.2f', drop_kb / 1048576), '\\.?0+$', '') AS t FROM tr)
        SELECT file_id, 'mp' AS plane, 'critical' AS severity, 'OOM killer invoked' AS title, 0 AS rule FROM tr
          WHERE file_id IN (SELECT file_id FROM ev)
        UNION ALL SELECT file_id, 'mp', 'info', 'Multiple OOMs in the window', 1 FROM tr
          WHERE file_id IN (SELECT file_id FROM ev GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT file_id, 'mp', CASE WHEN drop_kb > 2097152 THEN 'high' ELSE 'medium' END,
          concat('Available memory declined by ', t, ' GB'), 3 FROM gb WHERE drop_kb > 0
        UNION ALL SELECT file_id, 'mp', 'info', 'Available memory stable', 4 FROM gb WHERE drop_kb <= 0
        UNION ALL SELECT file_id, 'mp', 'high', concat('Largest user-space growth: ', process), 5 FROM tp WHERE rank = 1
        UNION ALL SELECT file_id, 'mp', 'high', 'Kernel memory growth suspected', 6 FROM ex
          WHERE drop_kb > 0 AND pct < 50 AND file_id IN (SELECT file_id FROM kg)
        UNION ALL SELECT file_id, 'mp', 'medium', concat('Multiple instances of ', process), 7 FROM du
        UNION ALL SELECT file_id, 'mp', 'medium', concat(process, ' appears to have restarted'), 8 FROM tp
          WHERE restarted""",
        "kernel_log",
        "memory_counters",
    ),
    "overlay_names": with_views(
        GROWTH
        + TOP
        + """, nm AS (SELECT DISTINCT rs.file_id, rs.name, tp.rank FROM rs JOIN tp ON tp.file_id = rs.file_id
               AND tp.process = rs.process UNION ALL SELECT file_id, counter, 0 FROM tr)
        SELECT * FROM (SELECT file_id, 'mp' AS plane, row_number() OVER (PARTITION BY file_id ORDER BY rank, name) AS ord,
          name FROM nm)""",
        "memory_counters",
    ),
    "oom_pairing": with_views(OOM + " SELECT * FROM ev", "kernel_log"),
}
