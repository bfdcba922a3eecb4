"""Counter samples read back from monitor-log text that is built from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.operators import appstats as ap
from logquarry.operators import counters as co
from logquarry.plans.views import table, view, with_views


def _samples(spark, sf_dir, log="monitor_log"):
    return co.extract_counters(view(spark, sf_dir, log), _app_names(spark, sf_dir))


def _app_names(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 3 != 0)
    return names.select(
        F.concat(F.lit("bundle"), F.col("s_suppkey") % 2).alias("file_id"),
        F.col("s_suppkey").cast("int").alias("app_id"),
        F.col("s_name").alias("name"),
    )


def monitor_counters(spark, sf_dir):
    rows = _samples(spark, sf_dir).where(~F.col("name").rlike("__(netstat_detail|appstats)__"))
    return rows.select("file_id", "name", "ts", F.round("value", 6).alias("value"))


def netstat_sum(spark, sf_dir):
    rows = co.socket_queues(co.blocks(view(spark, sf_dir, "monitor_log")))
    return rows.select("file_id", "name", "ts", "value")


def header_table_unpivot(spark, sf_dir):
    rows = _samples(spark, sf_dir).where(F.col("name").rlike("__ifconfig__|__cpu__\\d"))
    return rows.select("file_id", "name", "ts", "value", "line_no")


def app_volumes(spark, sf_dir):
    rows = co.application_volumes(co.blocks(view(spark, sf_dir, "monitor_log")), _app_names(spark, sf_dir))
    return rows.select("file_id", "name", "ts", "value")


def deduped_counters(spark, sf_dir):
    lines = view(spark, sf_dir, "monitor_log")
    rows = co.extract_counters(lines, dedupe=True).where(F.col("name").contains("__cpu__"))
    return rows.select("file_id", "name", "ts", "value")


def app_table_from_series(spark, sf_dir):
    stats = ap.from_series(_samples(spark, sf_dir, "app_log"), "mp")
    shared = ap.with_shares(stats, ("file_id", "plane"))
    return shared.select("file_id", "vsys", "app", "sessions", "bytes", F.round("bytes_pct", 6).alias("bytes_pct"))


QUERIES = {
    "monitor_counters": monitor_counters,
    "netstat_sum": netstat_sum,
    "header_table_unpivot": header_table_unpivot,
    "app_volumes": app_volumes,
    "deduped_counters": deduped_counters,
    "app_table_from_series": app_table_from_series,
}
BASE = """
    WITH b AS (SELECT event_id AS e, user_id AS u, floor(value * 100)::BIGINT AS v, event_type AS t,
        concat('bundle', user_id % 2) AS file_id, CASE WHEN user_id % 4 < 2 THEN 'mp' ELSE 'dp' END AS pl,
        date_trunc('second', ts) AS ts FROM events)"""
ROWS = {
    "gc_a": "0 AND 50.5 + u >= 120|concat('gc__pkt_', t)|v|4|0",
    "gc_b": "0 AND 50.5 + u >= 120|'gc__pkt_sent'|u|5|0",
    "core_a": "1|'cpu__00_avg'|u|4|0",
    "core_b": "1|'cpu__00_max'|2|4|0",
    "core_c": "1|'cpu__11_avg'|v|4|0",
    "core_d": "1|'cpu__11_max'|4|4|0",
    "core_e": "1|'cpu__00_avg'|1|6|1",
    "core_f": "1|'cpu__00_max'|2|6|1",
    "core_g": "1|'cpu__11_avg'|3|6|1",
    "core_h": "1|'cpu__11_max'|u|6|1",
    "core_i": "1|'cpu__02_avg'|v|8|0",
    "core_j": "1|'cpu__02_max'|9|8|0",
    "cpu_a": "2|'cpu__last_3m_avg_pct'|u|3|0",
    "cpu_b": "2|'cpu__last_3m_max_pct'|v|3|0",
    "cpu_c": "2|'cpu_load_avg__i_1'|u + 0.25|6|0",
    "cpu_d": "2|'cpu_load_avg__i_5'|1.5|6|0",
    "cpu_e": "2|'cpu_load_avg__i_15'|u + 0.75|6|0",
    "if_a": "3|concat('ifconfig__eth', u, '_rx_bytes')|v|3|0",
    "if_b": "3|concat('ifconfig__eth', u, '_rx_packets')|u|3|0",
    "if_c": "3|concat('ifconfig__eth', u, '_rx_missed')|0|3|0",
    "if_d": "3|concat('ifconfig__eth', u, '_tx_bytes')|3|8|0",
    "if_e": "3|concat('ifconfig__eth', u, '_tx_collsns')|v|8|0",
    "mem_a": "4|'memory__mem_free'|v|1|0",
    "mem_b": "4|'memory__mem_min'|2|1|0",
    "mem_c": "4|'memory__mem_total'|8000000|1|0",
    "mem_d": "4|'memory__mem_available'|u|1|0",
    "mem_e": "4|'memory__swap_free'|u|2|0",
    "mem_f": "4|'memory__swap_min'|0|2|0",
    "mem_g": "4|'memory__swap_total'|v|2|0",
    "proc_a": "6|concat('processes__proc', u % 9, '_', u, '_cpu')|u % 100|2|0",
    "proc_b": "6|concat('processes__proc', u % 9, '_', u, '_fds_open')|11|2|0",
    "proc_c": "6|concat('processes__proc', u % 9, '_', u, '_virt_mem')|v|2|0",
    "proc_d": "6|concat('processes__proc', u % 9, '_', u, '_res_swap')|900|2|0",
    "proc_e": "6|concat('processes__proc', u % 9, '_', u, '_res_swap_sub_lazy')|800|2|0",
    "proc_f": "6|'total__processes'|u|3|0",
    "proc_g": "6|'total__cpu_pct'|3|4|0",
    "proc_h": "6|'total__fds'|v|4|0",
    "proc_i": "6|'total__virt_mem'|5|4|0",
    "proc_j": "6|'total__res_mem'|6|4|0",
    "proc_k": "6|'total__res_mem_sub_lazy'|7|4|0",
    "ru_a": "8|'ru__pktbuf_avg'|u|3|0",
    "ru_b": "8|'ru__pktbuf_avg'|v|3|1",
    "ru_c": "8|'ru__session_max'|v|6|0",
    "si_a": "9|'si__sessions_supported'|v|1|0",
    "si_b": "9|'si__hw_offload'|1|2|0",
    "si_c": "9|'si__timeout_tcp_default'|u|3|0",
    "si_d": "9|'si__setup_tunnel_accel'|-1|4|0",
    "top_a": "10|'top__uptime_minutes'|3 * 1440 + 120 + u % 10|1|0",
    "top_b": "10|'top__user_sess'|u|1|0",
    "top_c": "10|'top__load_avg_1'|1.5|1|0",
    "top_d": "10|'top__load_avg_5'|2.5|1|0",
    "top_e": "10|'top__load_avg_15'|u|1|0",
    "top_f": "10|'top__cpu__user_pct'|1.5|2|0",
    "top_g": "10|'top__cpu__system_pct'|u|2|0",
    "top_h": "10|'top__cpu__iowait_pct'|4|2|0",
    "top_i": "10|concat('topprocess__proc', u % 3, '_', u, '__cpu')|5.5|3|0",
    "top_j": "10|concat('topprocess__proc', u % 3, '_', u, '__mem_pct')|0.1|3|0",
    "top_k": "10|concat('topprocess__proc', u % 3, '_', u, '__nice')|0|3|0",
    "top_l": "10|concat('topprocess__proc', u % 3, '_', u, '__virt_mem')|v * 1048576.0|3|0",
    "top_m": "10|concat('topprocess__proc', u % 3, '_', u, '__res_mem')|12.0 * 1073741824|3|0",
    "top_n": "10|concat('topprocess__proc', u % 3, '_', u, '__shr_mem')|102400|3|0",
    "top_o": "10|concat('topprocess__proc', u % 3, '_', u, '__time')|62.5|3|0",
    "pool_a": "11|'pool__softpool__pool_a'|v|2|0",
    "pool_b": "11|'pool__softpool__pool_a_pct'|v / 1024|2|0",
    "pool_c": "11|'pool__softpool__b'|3|3|0",
    "pool_d": "11|'pool__mempool__fptcp_max_sz_kb'|v|5|0",
    "pool_e": "11|'pool__mempool__fptcp_threshold'|2|5|0",
    "pool_f": "11|'pool__mempool__fptcp_min_sz_kb'|3|5|0",
    "pool_g": "11|'pool__mempool__thread_max_sz_kb'|1|6|0",
    "pool_h": "11|'pool__mempool__thread_threshold'|0|6|0",
    "pool_i": "11|'pool__mempool__thread_min_sz_kb'|5|6|0",
    "pow_a": "11|'vmpow__thread03__sel_ok'|u|8|0",
    "pow_b": "11|'vmpow__thread03__io_wqe_alloc'|4|9|0",
    "pow_c": "11|'vmpow__thread03__io_wqe_null'|v|9|0",
    "task_a": "10|'top__tasks_total'|300|4|0",
    "task_b": "10|'top__tasks_running'|u|4|0",
    "ram_a": "10|'top__mem_total'|7921.5|5|0",
    "ram_b": "10|'top__mem_free'|u + 0.5|5|0",
    "swap_a": "10|'top__swap_total'|4000|6|0",
    "swap_b": "10|'top__swap_free'|u|6|0",
    "swap_c": "10|'top__swap_used'|100|6|0",
    "swap_d": "10|'top__avail_mem'|2500.5|6|0",
    "cache_a": "12|concat('ct__ssl_', t, '_max_entries')|v|2|0",
    "cache_b": "12|concat('ct__ssl_', t, '_cur_entries')|u|2|0",
    "cache_c": "12|concat('ct__ssl_', t, '_max_alloc')|177|2|0",
    "cache_d": "12|concat('ct__ssl_', t, '_cur_sz_b')|14080|2|0",
    "cache_e": "12|concat('ct__ssl_', t, '_insert_failure')|0|2|0",
    "pertask_a": "12|concat('gc01__pkt_', t)|v|6|0",
    "pertask_b": "12|concat(printf('gc%02d', u + 2), '__pkt_', t)|u|6|0",
    "shared_a": "12|'pool__sharedpool__appid_quota'|v|9|0",
    "shared_b": "12|'pool__sharedpool__appid_threshold'|80|9|0",
    "shared_c": "12|'pool__sharedpool__appid_min_alloc'|u|9|0",
    "shared_d": "12|'pool__sharedpool__appid_cur_alloc'|2|9|0",
    "detail_a_a": "13|'memorydetail__memavailable'|v|1|0",
    "detail_b_a": "13|'memorydetail__hugepages_total'|0|2|0",
    "detail_c_a": "13|'memorydetail__active_anon'|-(u + 1)|3|0",
    "slab_a": "14|concat('slabinfo__kmalloc_', u, '_activeobjs')|v|3|0",
    "slab_b": "14|concat('slabinfo__kmalloc_', u, '_numobjs')|20|3|0",
    "slab_c": "14|concat('slabinfo__kmalloc_', u, '_objsize')|96|3|0",
    "slab_d": "14|concat('slabinfo__kmalloc_', u, '_totalactsize')|v * 96|3|0",
    "receiver_a_a": "15|'logreceiver_statistics__log_incoming_rate'|u|1|0",
    "receiver_b_a": "15|'logreceiver_statistics__total_mb'|u + 0.5|3|0",
    "stats_a_a": "16|'nsstats__ip__total_packets_received'|v|3|0",
    "stats_b_a": "16|'nsstats__ip__forwarding'|u|4|0",
    "stats_c_a": "16|'nsstats__tcpext__resets_sent'|u|6|0",
    "files_a_a": "17|'filesystem__root_pct'|u % 100|1|0",
    "files_a_b": "17|'filesystem__root_used_kb'|v|1|0",
    "files_b_a": "17|concat('filesystem__opt_repo', u % 3, '_pct')|5|2|0",
    "files_b_b": "17|concat('filesystem__opt_repo', u % 3, '_used_kb')|u|2|0",
    "atomic_a_a": "18|'pool__powpool__work_entries'|v|2|0",
    "atomic_a_b": "18|'pool__powpool__work_entries_pct'|v / 200|2|0",
    "atomic_b_a": "18|'pool__powpool__idle'|5|3|0",
    "func_a": "18|'procus__func__pan_a_max_us'|v|5|0",
    "func_b": "18|'procus__func__pan_a_avg_us'|5|5|0",
    "func_c": "18|'procus__func__pan_a_count'|3|5|0",
    "func_d": "18|'procus__func__pan_a_total_us'|u|5|0",
    "func_e": "18|'procus__func__pan_a_ac_max_us'|1|5|0",
    "group_a": "18|concat('procus__group__grp_', t, '_max_us')|u|7|0",
    "group_b": "18|concat('procus__group__grp_', t, '_avg_us')|2|7|0",
    "ticks_a_a": "18|'procusd__group__detail_one_c2_avg_ticks'|u|9|0",
    "ticks_a_b": "18|'procusd__group__detail_one_c2_avg_us'|12|9|0",
    "ticks_a_c": "18|'procusd__group__detail_one_c2_count'|13|9|0",
    "ticks_a_d": "18|'procusd__group__detail_one_c2_total_us'|v|9|0",
    "ticks_b_a": "18|concat('procusd__func__detail_two_c', u % 4, '_avg_ticks')|1|11|0",
    "ticks_b_b": "18|concat('procusd__func__detail_two_c', u % 4, '_avg_us')|2|11|0",
    "ticks_b_c": "18|concat('procusd__func__detail_two_c', u % 4, '_count')|3|11|0",
    "ticks_b_d": "18|concat('procusd__func__detail_two_c', u % 4, '_total_us')|0|11|0",
    "limit_a_a": "19|'si__sessions_supported'|5|1|0",
    "limit_b_a": "19|'si__timeout_discard_tcp'|u|2|0",
    "limit_b_b": "19|'si__timeout_discard_udp'|60|2|0",
    "limit_b_c": "19|'si__timeout_discard_sctp'|30|2|0",
    "limit_b_d": "19|'si__timeout_discard_other_ip'|45|2|0",
    "limit_c_a": "19|'si__session_table_utelization_pct'|u % 100|3|0",
    "wqe_a_a": "19|'vmpow__total_inflight_wqe'|u|5|0",
    "wqe_b_a": "19|'vmpow__used_wqe'|u|6|0",
    "wqe_b_b": "19|'vmpow__used_wqe_total'|v|6|0",
    "wqe_b_c": "19|'vmpow__used_wqe_pct'|25|6|0",
    "wqe_c_a": "19|'vmpow__rcv_thresh'|u|7|0",
    "wqe_d_a": "19|'vmpow__thread02__rcv_tot'|9|8|0",
}


def _expected() -> str:
    selects = []
    for spec in ROWS.values():
        kind, name, value, line, back = spec.split("|")
        selects.append(
            f"SELECT file_id, concat(pl, '__', {name}) AS name, ts - to_minutes({back}) AS ts, ({value})::DOUBLE AS value,"
            f" e * 32 + {line} AS line_no FROM b WHERE e % 20 = {kind}"
        )
    return BASE + ", x AS (" + " UNION ALL ".join(selects) + ")"


APPS = """, apps AS (SELECT file_id, pl, ts, e, 15 AS id, 1 AS s, 2 AS p, 3 AS y, 4 AS c, 5 AS t FROM b WHERE e % 20 = 7
      UNION ALL SELECT file_id, pl, ts, e, u, v, 27, 15, 0, 3 FROM b WHERE e % 20 = 7),
    named AS (SELECT apps.*, concat('vsys2_', coalesce(lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '_', 'g')),
        concat('app_', id))) AS app FROM apps LEFT JOIN supplier ON s_suppkey = id AND s_suppkey % 3 <> 0
        AND concat('bundle', s_suppkey % 2) = file_id),
    av AS (SELECT file_id, concat(pl, '__appstats__', app, '_', m) AS name, ts,
        (CASE m WHEN 'sessions' THEN s WHEN 'packets' THEN p WHEN 'bytes' THEN y WHEN 'app_changed' THEN c ELSE t END)::DOUBLE
        AS value, e FROM named, (VALUES ('sessions'), ('packets'), ('bytes'), ('app_changed'), ('threats')) AS ms(m))"""
ORACLE = {
    "monitor_counters": _expected() + " SELECT file_id, name, ts, round(value, 6) AS value FROM x",
    "netstat_sum": BASE
    + """, s AS (SELECT file_id, pl, ts, e, 'tcp' AS proto, u % 3 AS a, v + 5 AS r, 2 + 6 AS s FROM b WHERE e % 20 = 5
           UNION ALL SELECT file_id, pl, ts, e, 'tcp6', u % 3, 4, u FROM b WHERE e % 20 = 5)
        SELECT file_id, concat(pl, '__netstat_detail__', proto, '_app', a, '_recv_q') AS name, ts, r::DOUBLE AS value FROM s
        UNION ALL SELECT file_id, concat(pl, '__netstat_detail__', proto, '_app', a, '_send_q'), ts, s::DOUBLE FROM s""",
    "header_table_unpivot": _expected()
    + r" SELECT file_id, name, ts, value, line_no FROM x WHERE regexp_matches(name, '__ifconfig__|__cpu__\d')",
    "app_volumes": BASE + APPS + " SELECT file_id, name, ts, value FROM av",
    "deduped_counters": _expected()
    + """ SELECT file_id, name, ts, arg_max(value, line_no) AS value FROM x WHERE contains(name, '__cpu__')
          GROUP BY ALL""",
    "app_table_from_series": BASE
    + APPS.replace("e % 20 = 7", "e % 12 = 7")
    + """, l AS (SELECT file_id, app, id, pl, arg_max(s, e * 2 + CASE WHEN id = 15 THEN 0 ELSE 1 END) AS s,
           arg_max(y, e * 2 + CASE WHEN id = 15 THEN 0 ELSE 1 END) AS y, max(ts) FROM named WHERE pl = 'mp' GROUP BY ALL)
        SELECT file_id, '2' AS vsys, substr(app, 7) AS app, s::DOUBLE AS sessions, y::DOUBLE AS bytes,
          round(y / sum(y) OVER (PARTITION BY file_id) * 100, 6) AS bytes_pct FROM l""",
}
