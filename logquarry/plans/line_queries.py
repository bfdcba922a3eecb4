"""Structuring, time filtering, field filters and search over log lines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from logquarry.functions.linefields import field, message_fields
from logquarry.functions.matching import phrase, term
from logquarry.functions.text import fold
from logquarry.operators import search as se
from logquarry.operators import structure as st
from logquarry.plans.views import table, view, with_views

START, END = datetime(2024, 1, 5), datetime(2024, 1, 20, 12)


def structure_lines(spark, sf_dir):
    rows = st.structure_monitor(view(spark, sf_dir, "monitor"), START, END)
    return rows.select("file_id", "line", "ts", "ts_text", "label", "msg")


def structured_page(spark, sf_dir):
    rows = st.page(st.structure(view(spark, sf_dir, "monitor")), 100, 250)
    return rows.select("file_id", "line", "entry_no", "total", "label")



def time_filter(spark, sf_dir):
    rows = st.filter_lines(view(spark, sf_dir, "monitor"), 2024, START, END)
    return rows.select("file_id", "line_no", "ts", "text")


def entry_at_line(spark, sf_dir):
    return st.entry_at(st.structure_monitor(view(spark, sf_dir, "monitor")), 501).select("file_id", "line", "label")


def message_field_table(spark, sf_dir):
    parts = message_fields(F.col("text"))
    return view(spark, sf_dir, "syslog").select(
        "line_no", F.size(parts).alias("n_fields"), F.get(parts, 2).alias("third"), F.concat_ws("|", parts).alias("all")
    )


def field_filter(spark, sf_dir):
    keep = (field(8).compare(">", 30) & field(0).matches("certificate")) | field(5, "/").compare("==", "x")
    keep = keep | field(4).compare("!=", 3) & field(3).matches("installed")
    return view(spark, sf_dir, "syslog").where(keep.on(F.col("text"))).select("line_no", "text")


QUERY = (term("t[ai]ng?\\b") | phrase("License")) & ~phrase("the ")


def search_bool(spark, sf_dir):
    rows = se.match_lines(view(spark, sf_dir, "lines"), QUERY)
    return rows.select("file_id", "path", "line_no", F.length("text").alias("n"))


def search_context(spark, sf_dir):
    lines = view(spark, sf_dir, "lines")
    hits = se.line_hits(se.match_lines(lines, QUERY), 2, 1, field(2).matches("[aeiou]r"))
    return se.context_lines(hits, lines, 2, 1, field(2).matches("[aeiou]r")).select(
        "path", "hit_line", "line_no", "before", F.substring("text", 1, 40).alias("head")
    )


def search_hits(spark, sf_dir):
    found = se.search(view(spark, sf_dir, "lines"), QUERY, 2, 1, field(2).matches("[aeiou]r"))
    return found.select("path", "line_no", "filtered", F.coalesce(F.size("context"), F.lit(0)).alias("context_lines"))


def search_blocks(spark, sf_dir):
    found = se.search(view(spark, sf_dir, "lines"), QUERY, 1, 1)
    return se.blocks(found).select("path", "line_no", "first_line", "last_line", "block")


def search_summary(spark, sf_dir):
    lines = view(spark, sf_dir, "lines")
    condition = phrase("en/1") | phrase("error")
    files = se.file_hits(lines.select("file_id", "entry_ord", "path").distinct(), condition)
    return se.outcome(se.search(lines, condition), files, limit=40)[1]


def search_in_entries(spark, sf_dir):
    entries = st.structure_monitor(view(spark, sf_dir, "monitor"))
    found = se.search_entries(entries, phrase("plain 7"), 2, 3)
    return found.select("file_id", "line", "idx", "match", "gap")


def trigram_files(spark, sf_dir):
    grams = se.trigrams(view(spark, sf_dir, "lines"))
    return grams.groupBy("tri").agg(F.count(F.lit(1)).alias("files"))


def trigram_candidates(spark, sf_dir):
    lines = view(spark, sf_dir, "lines")
    condition = (phrase("license") & phrase("apache")) | phrase("token")
    grams, common = se.split_common(se.trigrams(lines, se.needed_trigrams(condition)), 20)
    return se.candidates(lines, grams, common, condition).select("file_id", "path")


def search_folding(spark, sf_dir):
    """Words written with letters that fold to others: the gate and the trigrams must find what the plain condition finds."""
    lines = view(spark, sf_dir, "lines").withColumn("text", F.translate("text", "kS", "\u212a\u017f"))
    condition = phrase("token") | phrase("apache") & phrase("\u017fee")
    grams, common = se.split_common(se.trigrams(lines, se.needed_trigrams(condition)), 20)
    rows = se.match_lines(lines, condition, candidates=se.candidates(lines, grams, common, condition))
    return rows.select("path", "line_no", F.md5("text").alias("digest"))


def pruned_search(spark, sf_dir):
    lines = view(spark, sf_dir, "lines")
    condition = phrase("license") | phrase("token")
    grams, common = se.split_common(se.trigrams(lines, se.needed_trigrams(condition)), 20)
    rows = se.match_lines(lines, condition, candidates=se.candidates(lines, grams, common, condition))
    return rows.select("path", "line_no", F.md5("text").alias("digest"))


QUERIES = {
    "structure_lines": structure_lines,
    "structured_page": structured_page,
    "time_filter": time_filter,
    "entry_at_line": entry_at_line,
    "message_fields": message_field_table,
    "field_filter": field_filter,
    "search_bool": search_bool,
    "search_context": search_context,
    "search_hits": search_hits,
    "search_blocks": search_blocks,
    "search_summary": search_summary,
    "search_in_entries": search_in_entries,
    "trigram_files": trigram_files,
    "trigram_candidates": trigram_candidates,
    "pruned_search": pruned_search,
    "search_folding": search_folding,
}
STRUCTURED = r"""
    WITH h AS (SELECT *, regexp_extract(text, '^(\d{4}[-/]\d{2}[-/]\d{2} \d{2}:\d{2}:\d{2})', 1) AS s,
        regexp_matches(text, '^\d{4}[-/]\d{2}[-/]\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?\s+[-+]\d{4}\s+---\s+\S+') AS hd
      FROM v_monitor),
    m AS (SELECT *, try_cast(replace(nullif(s, ''), '/', '-') AS TIMESTAMP) AS st,
        CASE WHEN hd THEN regexp_extract(text, '---\s+(\S+)', 1)
             WHEN text LIKE ':CPU load sampling%' THEN 'cpu_by_group'
             WHEN text LIKE ':CPU load (%' THEN 'CPU 60s'
             WHEN text LIKE ':Resource%' THEN concat('resource ', regexp_extract(text, 'last (\d+)', 1), 's') END AS lb,
        CASE WHEN text LIKE ':pool %' THEN regexp_extract(text, '^(:[a-z ]+):', 1) END AS sb FROM h),
    c AS (SELECT *, last_value(st IGNORE NULLS) OVER w AS ts, last_value(lb IGNORE NULLS) OVER w AS lab,
        last_value(CASE WHEN lb IS NOT NULL THEN line_no END IGNORE NULLS) OVER w AS lab_at,
        last_value(sb IGNORE NULLS) OVER w AS sub,
        last_value(CASE WHEN sb IS NOT NULL THEN line_no END IGNORE NULLS) OVER w AS sub_at
      FROM m WINDOW w AS (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    e AS (SELECT file_id, line_no AS line, ts, coalesce(strftime(ts, '%Y/%m/%d %H:%M:%S'), '') AS ts_text,
        CASE WHEN lab LIKE 'resource %' AND sub_at > lab_at THEN concat(lab, ' ', sub) ELSE coalesce(lab, '') END AS label,
        text AS msg FROM c)"""
RANGE = "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'"
MESSAGE = r"""
    WITH f AS (SELECT line_no, text,
      string_split_regex(regexp_extract(text, '^\S+ \S+ \S+ \S+ (.*)$', 1), '\s+') AS p FROM v_syslog)"""
HITS = r"""
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS idx,
        string_split_regex(trim(text, E' \t\n\r\f\v'), '\s+') AS p,
        (regexp_matches(lower(text), '(?i)t[ai]ng?\b') OR contains(lower(text), 'license'))
          AND NOT contains(lower(text), 'the ') AS hit FROM v_lines),
    x AS (SELECT *, coalesce(regexp_matches(p[2], '(?i)[aeiou]r'), false) AS keep FROM k),
    ctx AS (SELECT h.path, h.line_no AS hit_line, x.line_no, x.line_no < h.line_no AS before, left(x.text, 40) AS head
            FROM x h JOIN x ON x.path = h.path AND x.line_no BETWEEN h.line_no - 2 AND h.line_no + 1
                 AND x.line_no <> h.line_no
            WHERE h.hit AND x.keep)"""
GRAMS = r"""
    WITH t AS (SELECT DISTINCT path, file_id, substr(lower(upper(lower(text))), i, 3) AS tri
      FROM v_lines, unnest(range(1, length(text) - 1)) AS u(i) WHERE length(text) >= 3)"""
ORACLE = {
    "structure_lines": with_views(
        STRUCTURED + f" SELECT file_id, line, ts, ts_text, label, msg FROM e WHERE {RANGE}", "monitor"
    ),
    "structured_page": with_views(
        STRUCTURED
        + """ SELECT file_id, line, entry_no, total, label FROM (SELECT *,
          row_number() OVER (PARTITION BY file_id ORDER BY line) AS entry_no, count(*) OVER (PARTITION BY file_id) AS total
          FROM e) WHERE entry_no BETWEEN 101 AND 350""",
        "monitor",
    ),
    "time_filter": with_views(
        STRUCTURED + f" SELECT file_id, line AS line_no, ts, msg AS text FROM e WHERE {RANGE}", "monitor"
    ),
    "entry_at_line": with_views(
        STRUCTURED
        + " SELECT file_id, max(line) AS line, arg_max(label, line) AS label FROM e WHERE line <= 501 GROUP BY file_id",
        "monitor",
    ),
    "message_fields": with_views(
        MESSAGE + """ SELECT line_no, len(p)::INT AS n_fields, p[3] AS third, array_to_string(p, '|') AS "all" FROM f""",
        "syslog",
    ),
    "field_filter": with_views(
        MESSAGE
        + r""" SELECT line_no, text FROM f WHERE (regexp_matches(text, '(?i)certificate')
          AND try_cast(p[8] AS DOUBLE) > 30) OR (regexp_matches(p[3], '(?i)installed')
          AND try_cast(p[4] AS DOUBLE) <> 3)""",
        "syslog",
    ),
    "search_bool": with_views(HITS + " SELECT file_id, path, line_no, length(text) AS n FROM k WHERE hit", "lines"),
    "search_context": with_views(HITS + " SELECT path, hit_line, line_no, before, head FROM ctx", "lines"),
    "search_hits": with_views(
        HITS
        + """, h AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS r FROM x WHERE hit)
        SELECT h.path, h.line_no, NOT keep AS filtered, count(ctx.line_no) AS context_lines
        FROM h LEFT JOIN ctx ON h.path = ctx.path AND h.line_no = ctx.hit_line 
        GROUP BY ALL HAVING keep OR count(ctx.line_no) > 0""".replace("NOT keep AS filtered, ", "NOT keep AS filtered, "),
        "lines",
    ),
    "search_blocks": with_views(
        HITS
        + """, n AS (SELECT path, max(line_no) AS last FROM x GROUP BY path),
        h AS (SELECT path, line_no, greatest(line_no - 1, 1) AS first_line, least(line_no + 1, last) AS last_line
              FROM x JOIN n USING (path) WHERE hit),
        g AS (SELECT *, CASE WHEN first_line <= lag(last_line) OVER w + 1 THEN 0 ELSE 1 END AS s FROM h
              WINDOW w AS (PARTITION BY path ORDER BY line_no))
        SELECT path, line_no, first_line, last_line, sum(s) OVER (PARTITION BY path ORDER BY line_no)::BIGINT AS block
        FROM g""",
        "lines",
    ),
    "search_summary": with_views(
        """WITH l AS (SELECT file_id, path, count(*) AS n FROM v_lines
             WHERE contains(lower(text), 'en/1') OR contains(lower(text), 'error') GROUP BY ALL),
           f AS (SELECT DISTINCT file_id, path FROM v_lines WHERE contains(path, 'en/1') OR contains(path, 'error')),
           r AS (SELECT file_id, sum(n) AS n FROM l GROUP BY 1),
           s AS (SELECT file_id, count(*) AS n FROM f GROUP BY 1)
           SELECT file_id, (coalesce(r.n, 0) + coalesce(s.n, 0))::BIGINT AS total, coalesce(r.n, 0)::BIGINT AS line_hits,
             coalesce(r.n, 0) + coalesce(s.n, 0) >= 40 AS truncated
           FROM r FULL JOIN s USING (file_id)""",
        "lines",
    ),
    "search_in_entries": with_views(
        STRUCTURED
        + """, i AS (SELECT file_id, line, contains(lower(concat(ts_text, ' ', label, ' ', msg)), 'plain 7') AS match,
             row_number() OVER (PARTITION BY file_id ORDER BY line) AS idx FROM e),
        k AS (SELECT * FROM i WHERE EXISTS (SELECT 1 FROM i m WHERE m.match AND m.file_id = i.file_id
              AND m.idx BETWEEN i.idx - 3 AND i.idx + 2))
        SELECT file_id, line, idx, match,
          coalesce(idx > lag(idx) OVER (PARTITION BY file_id ORDER BY idx) + 1, false) AS gap FROM k""",
        "monitor",
    ),
    "trigram_files": with_views(
        GRAMS + " SELECT tri, count(DISTINCT path) AS files FROM t GROUP BY tri",
        "lines",
    ),
    "trigram_candidates": with_views(
        GRAMS
        + """, fr AS (SELECT file_id, tri, count(*) AS n FROM t GROUP BY ALL),
        w AS (SELECT DISTINCT alt, substr(word, i, 3) AS tri FROM (VALUES (0, 'license'), (0, 'apache'), (1, 'token'))
              AS v(alt, word), unnest(range(1, length(word) - 1)) AS u(i)),
        fl AS (SELECT DISTINCT file_id, path FROM v_lines),
        nd AS (SELECT b.file_id, w.alt, w.tri FROM (SELECT DISTINCT file_id FROM fl) b, w
               WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.file_id = b.file_id AND fr.tri = w.tri AND fr.n > 20))
        SELECT DISTINCT fl.file_id, fl.path FROM fl, (VALUES (0), (1)) AS a(alt)
        WHERE NOT EXISTS (SELECT 1 FROM nd WHERE nd.file_id = fl.file_id AND nd.alt = a.alt
          AND NOT EXISTS (SELECT 1 FROM t WHERE t.path = fl.path AND t.tri = nd.tri))""",
        "lines",
    ),
    "search_folding": with_views(
        """SELECT path, line_no, md5(t) AS digest FROM (SELECT *, replace(replace(text, 'k', chr(8490)), 'S', chr(383)) AS t FROM v_lines)
           WHERE contains(lower(t), 'token') OR (contains(lower(t), 'apache') AND contains(lower(t), chr(383) || 'ee'))""",
        "lines",
    ),
    "pruned_search": with_views(
        """SELECT path, line_no, md5(text) AS digest FROM v_lines
           WHERE contains(lower(text), 'license') OR contains(lower(text), 'token')""",
        "lines",
    ),
}
