"""Connection timeline, attempts and sign-ins of endpoint-agent logs built from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.operators import agent as ag
from logquarry.operators import structure as st
from logquarry.plans.views import view, with_views


def agent_structure(spark, sf_dir):
    rows = st.structure_agent(view(spark, sf_dir, "agent_log"))
    return rows.select("file_id", "line", "part_no", "ts", "ts_text", "label", "msg")


def agent_files(spark, sf_dir):
    return st.agent_files(view(spark, sf_dir, "agent_log")).select("file_id")


def embedded_split(spark, sf_dir):
    return st.split_embedded(view(spark, sf_dir, "agent_log")).select("file_id", "line_no", "part_no", "text")


def agent_timeline(spark, sf_dir):
    rows = ag.timeline(view(spark, sf_dir, "agent_log"))
    return rows.select("file_id", "line_no", "ts", "severity", "phase", "outcome")


def phase_counts(spark, sf_dir):
    return ag.phase_counts(ag.timeline(view(spark, sf_dir, "agent_log")))


def agent_problems(spark, sf_dir):
    rows = ag.problems(ag.timeline(view(spark, sf_dir, "agent_log")))
    return rows.select("file_id", "line_no", "phase", "severity")


def _parts(spark, sf_dir):
    rows = ag.attempt_lines(ag.event_lines(view(spark, sf_dir, "agent_log")))
    stages = ag.stage_results(rows)
    return ag.attempt_table(rows, stages), stages


def attempts(spark, sf_dir):
    rows = _parts(spark, sf_dir)[0]
    return rows.select(
        "file_id", F.col("attempt_at.line_no").alias("line_no"), "start", "end", "events", "portal", "user", "gateway",
        "portal_auth", "gateway_auth", "wait_secs", "single_sign_on", "reached", "stop_at", "outcome",
    )


def stage_matrix(spark, sf_dir):
    rows = ag.stage_matrix(*_parts(spark, sf_dir))
    return rows.select("file_id", F.col("attempt_at.line_no").alias("line_no"), "stage_name", "status", "at")


def stop_summary(spark, sf_dir):
    return ag.stop_summary(_parts(spark, sf_dir)[0])


def auth_events(spark, sf_dir):
    rows = ag.auth_events(*_parts(spark, sf_dir))
    return rows.select("file_id", F.col("attempt_at.line_no").alias("line_no"), "target", "ts", "address", "method", "outcome", "wait_secs")


def auth_summary(spark, sf_dir):
    return ag.auth_counts(ag.filter_auth(ag.auth_events(*_parts(spark, sf_dir)), "user1"))


def agent_overview(spark, sf_dir):
    return ag.overview(view(spark, sf_dir, "agent_log")).select("file_id", "portal", "user", "final_state", "first_seen", "last_seen")


QUERIES = {
    "agent_structure": agent_structure,
    "agent_files": agent_files,
    "embedded_split": embedded_split,
    "agent_timeline": agent_timeline,
    "phase_counts": phase_counts,
    "agent_problems": agent_problems,
    "attempts": attempts,
    "stage_matrix": stage_matrix,
    "stop_summary": stop_summary,
    "auth_events": auth_events,
    "auth_summary": auth_summary,
    "agent_overview": agent_overview,
}
PARTS = r"""
    WITH pt AS (SELECT file_id, line_no, part_no - 1 AS part_no, parts[part_no] AS text FROM (
        SELECT *, string_split(regexp_replace(text, '(.)(\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}:\d{3}\s*\[)', '\1' || chr(1) || '\2', 'g'),
          chr(1)) AS parts FROM v_agent_log), unnest(range(1, len(parts) + 1)) AS u(part_no))"""
EVENTS = r"""
    WITH ev AS (SELECT file_id, line_no, strptime(regexp_extract(text, p, 1) || ' ' || regexp_extract(text, p, 2),
          '%m/%d/%Y %H:%M:%S') AS ts, regexp_extract(text, p, 4) AS severity, regexp_extract(text, p, 5) AS msg
        FROM v_agent_log, (SELECT '""" + st.EVENT_LINE + r"""' AS p) WHERE regexp_matches(text, p))"""
PHASED = (
    EVENTS
    + ", ph AS (SELECT *, CASE "
    + " ".join(f"WHEN regexp_matches(msg, '(?i){p}') THEN '{n}|{o}'" for p, n, o in ag.PHASES)
    + """ ELSE '|' END AS po FROM ev),
    tl AS (SELECT *, split_part(po, '|', 1) AS phase, CASE WHEN split_part(po, '|', 2) = '' AND lower(severity) = 'error'
             THEN 'fail' ELSE split_part(po, '|', 2) END AS outcome,
             row_number() OVER (PARTITION BY file_id ORDER BY ts DESC, line_no DESC) AS back FROM ph)"""
)
# Attempt starts are chained by a recursive query: from one start, the next start marker that may open an attempt.
ATTEMPTS = (
    EVENTS.replace("WITH ev", "WITH RECURSIVE ev", 1)
    + r""", mk AS (SELECT file_id, ts, line_no, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS i,
        regexp_matches(msg, '(?i)^(started the portal pre ?- ?login|SSO starts)') AS s,
        regexp_matches(msg, '(?i)Load the SAML Browser|SAMLDlg') AS b,
        regexp_matches(msg, '(?i)Gateway (pre-?Login Starts|Login starts)') AS g,
        regexp_matches(msg, '(?i)portal status is (Connected|User authentication failed|Invalid portal)|Auth failed for portal') AS d
      FROM ev),
    wk AS (
      SELECT file_id, 0::BIGINT AS i, NULL::TIMESTAMP AS st, NULL::BIGINT AS att, false AS gw, false AS aw
      FROM (SELECT DISTINCT file_id FROM ev)
      UNION ALL
      SELECT file_id, i, st, att, gw, CASE WHEN d THEN false WHEN b AND NOT gw AND att IS NOT NULL THEN true ELSE aw END FROM (
        SELECT m.file_id, m.i, m.b, m.d,
          CASE WHEN m.s AND (w.st IS NULL OR (NOT w.aw AND epoch(m.ts) - epoch(w.st) > 2)) THEN m.ts ELSE w.st END AS st,
          CASE WHEN m.s AND (w.st IS NULL OR (NOT w.aw AND epoch(m.ts) - epoch(w.st) > 2)) THEN m.line_no ELSE w.att END AS att,
          CASE WHEN m.s AND (w.st IS NULL OR (NOT w.aw AND epoch(m.ts) - epoch(w.st) > 2)) THEN m.g ELSE w.gw OR m.g END AS gw,
          CASE WHEN m.s AND (w.st IS NULL OR (NOT w.aw AND epoch(m.ts) - epoch(w.st) > 2)) THEN false ELSE w.aw END AS aw
        FROM wk w JOIN mk m ON m.file_id = w.file_id AND m.i = w.i + 1)),
    al AS (SELECT ev.*, wk.att, wk.gw FROM ev JOIN mk USING (file_id, line_no) JOIN wk ON wk.file_id = mk.file_id AND wk.i = mk.i
           WHERE wk.att IS NOT NULL)"""
)
MARKER_CASE = "CASE " + " ".join(
    "WHEN regexp_matches(msg, '(?i){}') THEN '{}|{}'".format(p, ag.STAGES.index(s), t) for p, s, t, _ in ag.STAGE_MARKERS
)
STAGES = (
    ATTEMPTS
    + ", sm AS (SELECT *, "
    + MARKER_CASE
    + r""" WHEN regexp_matches(msg, '(?i)network connection is unreachable') THEN '4|forced'
           WHEN regexp_matches(msg, '(?i)no network connectivity') THEN '0|forced' END AS hit FROM al),
    sg AS (SELECT file_id, att, split_part(hit, '|', 1)::INT AS stage,
        min(line_no) FILTER (hit LIKE '%|ok') AS ok1, min(line_no) FILTER (hit LIKE '%|failed') AS f1,
        min(line_no) FILTER (hit LIKE '%|forced') AS x1,
        arg_max(ts, line_no) FILTER (hit LIKE '%|failed' OR hit LIKE '%|forced') AS ft,
        arg_max(ts, line_no) FILTER (hit LIKE '%|ok') AS ot, arg_max(ts, line_no) FILTER (hit LIKE '%|reached') AS rt
      FROM sm WHERE hit IS NOT NULL GROUP BY ALL),
    sr AS (SELECT file_id, att AS line_no, stage,
        CASE WHEN f1 IS NOT NULL OR (x1 IS NOT NULL AND (ok1 IS NULL OR x1 < ok1)) THEN 'failed'
             WHEN ok1 IS NOT NULL THEN 'ok' ELSE 'reached' END AS status,
        CASE WHEN f1 IS NOT NULL OR (x1 IS NOT NULL AND (ok1 IS NULL OR x1 < ok1)) THEN ft
             ELSE coalesce(ot, rt) END AS att FROM sg),
    nm AS (SELECT * FROM (VALUES """
    + ", ".join(f"({i}, '{s}')" for i, s in enumerate(ag.STAGES))
    + r""") AS v(stage, stage_name)),
    kd AS (SELECT *, CASE WHEN regexp_matches(msg, '(?i)Load the SAML Browser|SAMLDlg') THEN 'browser'
        WHEN regexp_matches(msg, '(?i)Unserialized non-empty cookie for portal (\S+) and user (\S+)') THEN 'cookie'
        WHEN regexp_matches(msg, '(?i)Enter login credentials|authentication-message') THEN 'credentials' END AS kind,
        nullif(regexp_extract(msg, '(?i)(?:portal|to the portal) ([A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z0-9.\-]+)', 1), '') AS po,
        nullif(regexp_extract(msg, '(?i)and user (\S+?)\.?$', 1), '') AS us,
        CASE WHEN split_part(hit, '|', 1) IN ('5', '6', '7') AND hit NOT LIKE '%forced' THEN nullif(regexp_extract(msg,
          '(?i)(?:gateway|with Gateway|to gateway) ([A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z0-9.\-]+)', 1), '') END AS ga FROM sm),
    ba AS (SELECT file_id, att AS line_no, arg_min(ts, line_no) AS start, arg_max(ts, line_no) AS "end", count(*) AS events,
        arg_min(po, line_no) FILTER (po IS NOT NULL) AS portal,
        arg_min(us, line_no) FILTER (us IS NOT NULL AND lower(us) <> 'pre-logon') AS user,
        arg_max(ga, line_no) FILTER (ga IS NOT NULL) AS gateway,
        min(line_no) FILTER (kind = 'browser' AND NOT gw) AS bl, arg_min(ts, line_no) FILTER (kind = 'browser' AND NOT gw) AS bt,
        arg_min(kind, line_no) FILTER (kind IN ('cookie', 'credentials') AND NOT gw) AS op,
        bool_or(kind = 'browser' AND gw) AS gb, bool_or(kind = 'cookie' AND gw) AS gc FROM kd GROUP BY ALL),
    wt AS (SELECT kd.file_id, kd.att AS line_no, arg_min(epoch(kd.ts) - epoch(bt), kd.line_no) AS w FROM kd
        JOIN ba ON ba.file_id = kd.file_id AND ba.line_no = kd.att WHERE kd.line_no >= bl
        AND contains(lower(msg), 'logging into portal') AND epoch(kd.ts) <> epoch(bt) GROUP BY ALL),
    vd AS (SELECT file_id, line_no, max(stage) AS fu, min(stage) FILTER (status = 'failed') AS ff,
        bool_or(stage = 6 AND status = 'ok') AS tu FROM sr GROUP BY ALL),
    att AS (SELECT ba.file_id, ba.line_no, start, "end", events, portal, user, gateway,
        CASE WHEN bl IS NOT NULL THEN 'browser' ELSE op END AS portal_auth,
        CASE WHEN gb THEN 'browser' WHEN gc THEN 'cookie' END AS gateway_auth, coalesce(w, 0)::DOUBLE AS wait_secs,
        coalesce((bl IS NOT NULL OR op = 'credentials') AND NOT coalesce(gb, false) AND gc, false) AS single_sign_on,
        r.stage_name AS reached,
        CASE WHEN ff IS NOT NULL THEN f.stage_name WHEN NOT coalesce(tu, false) THEN r.stage_name END AS stop_at,
        CASE WHEN ff IS NOT NULL THEN 'failed' WHEN tu THEN 'connected' ELSE 'incomplete' END AS outcome
      FROM ba LEFT JOIN vd USING (file_id, line_no) LEFT JOIN wt USING (file_id, line_no)
      LEFT JOIN nm r ON r.stage = fu LEFT JOIN nm f ON f.stage = ff)"""
)
AUTH = (
    STAGES
    + """, ae AS (
      SELECT att.file_id, att.line_no, 'portal' AS target, coalesce(p.att, start) AS ts, portal AS address, portal_auth AS m,
        p.status AS s, wait_secs, user, false AS sso FROM att LEFT JOIN sr p ON p.file_id = att.file_id AND p.line_no = att.line_no
        AND p.stage = 1 WHERE p.status IS NOT NULL OR portal_auth IS NOT NULL
      UNION ALL
      SELECT att.file_id, att.line_no, 'gateway', coalesce(g.att, p.att, start), gateway, gateway_auth, g.status, 0, user,
        single_sign_on FROM att LEFT JOIN sr p ON p.file_id = att.file_id AND p.line_no = att.line_no AND p.stage = 1
        LEFT JOIN sr g ON g.file_id = att.file_id AND g.line_no = att.line_no AND g.stage = 5
        WHERE g.status IS NOT NULL OR gateway_auth IS NOT NULL),
    au AS (SELECT *, CASE m WHEN 'browser' THEN 'SAML (browser)' WHEN 'cookie' THEN 'cookie reuse'
        WHEN 'credentials' THEN 'credentials' ELSE '' END AS method, CASE s WHEN 'ok' THEN 'success' WHEN 'failed' THEN 'failed'
        WHEN 'reached' THEN 'incomplete' ELSE 'not reached' END AS outcome FROM ae)"""
)
ORACLE = {
    "agent_structure": with_views(
        PARTS
        + r""", en AS (SELECT *, regexp_matches(text, '^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}:\d{3}\s*\[([A-Za-z]+)\s*\]:') AS e
               FROM pt), cr AS (SELECT file_id, line_no, part_no, text, e,
          last_value(CASE WHEN e THEN text END IGNORE NULLS) OVER w AS src FROM en
          WHERE e OR trim(text) <> '' WINDOW w AS (PARTITION BY file_id ORDER BY line_no, part_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT file_id, line_no AS line, part_no, strptime(left(src, 19), '%m/%d/%Y %H:%M:%S') AS ts,
          coalesce(strftime(strptime(left(src, 19), '%m/%d/%Y %H:%M:%S'), '%Y-%m-%d %H:%M:%S') || '.' || substr(src, 21, 3), '')
            AS ts_text, coalesce(regexp_extract(src, '\[([A-Za-z]+)', 1), '') AS label,
          CASE WHEN e THEN regexp_extract(text, '\]:\s?(.*)$', 1) ELSE text END AS msg FROM cr""",
        "agent_log",
    ),
    "agent_files": with_views(
        r"""SELECT file_id FROM v_agent_log WHERE line_no <= 20 AND trim(text) <> '' GROUP BY 1 HAVING 2 * count_if(
          regexp_matches(text, '^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}:\d{3}\s*\[[A-Za-z]+\s*\]:')) >= count(*)""",
        "agent_log",
    ),
    "embedded_split": with_views(PARTS + " SELECT file_id, line_no, part_no::INT AS part_no, text FROM pt", "agent_log"),
    "agent_timeline": with_views(
        PHASED + " SELECT file_id, line_no, ts, severity, phase, outcome FROM tl", "agent_log"
    ),
    "phase_counts": with_views(PHASED + " SELECT file_id, phase, count(*) AS count FROM tl GROUP BY ALL", "agent_log"),
    "agent_problems": with_views(
        PHASED
        + " SELECT file_id, line_no, phase, severity FROM tl WHERE outcome = 'fail' OR lower(severity) = 'error'",
        "agent_log",
    ),
    "attempts": with_views(STAGES + " SELECT * FROM att", "agent_log"),
    "stage_matrix": with_views(
        STAGES
        + """ SELECT att.file_id, att.line_no, stage_name, coalesce(status, 'not reached') AS status, sr.att AS "at" FROM att
          CROSS JOIN nm LEFT JOIN sr ON sr.file_id = att.file_id AND sr.line_no = att.line_no AND sr.stage = nm.stage""",
        "agent_log",
    ),
    "stop_summary": with_views(
        STAGES
        + """, so AS (SELECT file_id, stop_at, count(*) AS n, min(line_no) AS f FROM att WHERE outcome <> 'connected'
               AND stop_at IS NOT NULL GROUP BY ALL),
        sw AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, f) AS r FROM so)
        SELECT a.file_id, connected, attempts, stop_at, n AS stopped FROM (SELECT file_id,
          count_if(outcome = 'connected') AS connected, count(*) AS attempts FROM att GROUP BY 1) a
        LEFT JOIN sw ON sw.file_id = a.file_id AND r = 1""",
        "agent_log",
    ),
    "auth_events": with_views(
        AUTH + " SELECT file_id, line_no, target, ts, address, method, outcome, wait_secs FROM au", "agent_log"
    ),
    "auth_summary": with_views(
        AUTH
        + """ SELECT file_id, count(*) AS events, count_if(outcome = 'failed') AS failed, count_if(sso) AS single_sign_on
          FROM au WHERE contains(lower(user), 'user1') GROUP BY 1""",
        "agent_log",
    ),
    "agent_overview": with_views(
        EVENTS
        + r""", x AS (SELECT *, nullif(regexp_extract(msg, '(?i)portal (?:login completed with address|pre ?- ?login to the portal) (\S+)', 1), '') AS pe,
          nullif(regexp_extract(msg, '(?i)(?:for|to) portal ([A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z0-9.\-]+)', 1), '') AS pm,
          nullif(regexp_extract(msg, '(?i)cookie for portal \S+ and user (\S+)', 1), '') AS us,
          nullif(regexp_extract(msg, '(?i)portal status is (.+?)\.?$', 1), '') AS st FROM ev)
        SELECT file_id, coalesce(arg_max(pe, line_no) FILTER (pe IS NOT NULL), arg_min(pm, line_no) FILTER (pm IS NOT NULL)) AS portal,
          arg_max(us, line_no) FILTER (us IS NOT NULL AND lower(us) <> 'pre-logon') AS user,
          arg_max(st, line_no) FILTER (st IS NOT NULL) AS final_state, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen,
          strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM x GROUP BY 1""",
        "agent_log",
    ),
}
