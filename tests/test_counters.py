"""Counter families on small monitor logs."""

import pytest

from logquarry.operators import counters as co
from tests.helpers import line_table

DATAPLANE = """noise before any header 1 2
2026-06-09 11:27:40.087 -0700  --- panio
:Global counters:
:Elapsed time since last sampling: 424.219 seconds
:name                                 value     rate
:pkt_recv                           6452370      103
:Total counters shown: 1
:Global counters:
:Elapsed time since last sampling: 10.001 seconds
:pkt_recv                                99        9
:Total counters shown: 1
:CPU load (%) during last 15 minutes:
:core    0       1
:     avg max avg max
:       0   5   1   1
:       9   9
:       0   6   1   2
:Cache-Type             MAX-Entries Cur-Entries Max.Alloc Cur.SZ(B) Insert-Failure Mem-Pool-Type
:ssl_server_cert        16384       176         177       14080     0              l7_misc
:		Per pan-task counter statistics
:Counter Name                                      1                    2                Total
:pkt_recv                                    1657994              4663514              6321508
:short                                             1
2026-06-09 11:31:00 -0700  --- logrcvr_statistics
 Log incoming rate:             8/sec
 Traffic logs written:          22176
 Total (MB):                416
 Log incoming rate:             999/sec
2026-02-31 12:00:00 -0700  --- filesystem
/  37  100
/opt/panrepo  5  200
"""
MANAGEMENT = """2026-06-09 12:00:00 -0700  --- netstat_stats
Ip:
    100 total packets received
    Forwarding: 2
TcpExt:
    7 resets sent
2026-06-09 12:01:00 -0700  --- panio
:Pow Atomic Memory Pools
:[ 0] Work Entries              :    100/200
:func   max-us
:pan_a  10 5 3 30 1
:detail_one (group)
:   2   11  12 13 14
:User  Quota Threshold
:appid  100 80 1 2(3)
:Resource utilization (%) during last 15 minutes:
:sw tags descriptor (maximum):
:  4
:  5
:odd thing (average):
:  1  2
:Number of sessions supported:         262142
:Session timeout: TCP: 90 secs, UDP: 60 secs, SCTP: 30, other IP protocols: 45 secs
:Tunnel acceleration:    True
:pow parameters:
:io: wqe alloc 5 wqe null 6
:thread 2 rcv_tot 9
:io: wqe alloc 7 wqe null 8
:Total inflight wqe 3
:used wqe 1 total wqe 4  25% used
:rcv_thresh : 12
2026-06-09 12:02:00 -0700  --- memory_detail
MemAvailable:  1024 kB
HugePages_Total:   0
2026-06-09 12:02:30 -0700  --- slabinfo
# name <active_objs>
kmalloc-96   10 20 96 42 1 : tunables
2026-06-09 12:03:00 -0700  --- top
top - 12:03:00 up 12 min,  3 users,  load average: 0.10, 0.20, 0.30
Tasks: 300 total,   2 running
MiB Mem :   7921.8 total,    100.5 free,  4000.0 used,  3821.3 buff/cache
MiB Swap:   4000.0 total,   3900.0 free,    100.0 used.   2500.5 avail Mem
 4321 root      20   0  1.5t   300m   1000 S   12.5  3.1  1:02:03.5 mgmtsrvr
"""
EXPECTED = {
    "dp__gc__pkt_recv": [("11:27:40", 6452370)],
    "dp__cpu__00_avg": [("11:26:40", 0), ("11:27:40", 0)],
    "dp__cpu__00_max": [("11:26:40", 6), ("11:27:40", 5)],
    "dp__cpu__01_max": [("11:26:40", 2), ("11:27:40", 1)],
    "dp__ct__ssl_server_cert_cur_entries": [("11:27:40", 176)],
    "dp__ct__ssl_server_cert_insert_failure": [("11:27:40", 0)],
    "dp__gc01__pkt_recv": [("11:27:40", 1657994)],
    "dp__gc02__pkt_recv": [("11:27:40", 4663514)],
    "dp__logreceiver_statistics__log_incoming_rate": [("11:31:00", 8)],
    "dp__logreceiver_statistics__total_mb": [("11:31:00", 416)],
    "dp__filesystem__root_pct": [("11:31:00", 37)],
    "dp__filesystem__opt_panrepo_used_kb": [("11:31:00", 200)],
    "mp__nsstats__ip__total_packets_received": [("12:00:00", 100)],
    "mp__nsstats__ip__forwarding": [("12:00:00", 2)],
    "mp__nsstats__tcpext__resets_sent": [("12:00:00", 7)],
    "mp__pool__powpool__work_entries_pct": [("12:01:00", 0.5)],
    "mp__procus__func__pan_a_ac_max_us": [("12:01:00", 1)],
    "mp__procusd__group__detail_one_c2_avg_ticks": [("12:01:00", 11)],
    "mp__pool__sharedpool__appid_cur_alloc": [("12:01:00", 2)],
    "mp__ru__swtags_max": [("12:01:00", 4)],
    "mp__ru__odd_thing_avg": [("12:00:00", 2), ("12:01:00", 1)],
    "mp__si__sessions_supported": [("12:01:00", 262142)],
    "mp__si__timeout_discard_sctp": [("12:01:00", 30)],
    "mp__si__setup_tunnel_accel": [("12:01:00", 1)],
    "mp__vmpow__thread00__io_wqe_alloc": [("12:01:00", 5)],
    "mp__vmpow__thread02__rcv_tot": [("12:01:00", 9)],
    "mp__vmpow__thread02__io_wqe_null": [("12:01:00", 8)],
    "mp__vmpow__total_inflight_wqe": [("12:01:00", 3)],
    "mp__vmpow__used_wqe_pct": [("12:01:00", 25)],
    "mp__vmpow__rcv_thresh": [("12:01:00", 12)],
    "mp__memorydetail__memavailable": [("12:02:00", 1024)],
    "mp__memorydetail__hugepages_total": [("12:02:00", 0)],
    "mp__slabinfo__kmalloc_96_totalactsize": [("12:02:30", 960)],
    "mp__top__uptime_minutes": [("12:03:00", 12)],
    "mp__top__tasks_running": [("12:03:00", 2)],
    "mp__top__mem_buffcache": [("12:03:00", 3821.3)],
    "mp__top__avail_mem": [("12:03:00", 2500.5)],
    "mp__topprocess__mgmtsrvr_4321__virt_mem": [("12:03:00", 1.5 * 2**40)],
    "mp__topprocess__mgmtsrvr_4321__shr_mem": [("12:03:00", 1024000)],
    "mp__topprocess__mgmtsrvr_4321__time": [("12:03:00", 3723.5)],
}
ABSENT = ("dp__logreceiver_statistics__traffic_logs_written", "dp__gc01__short", "mp__ru__", "dp__cpu__09_avg")


@pytest.mark.parametrize("chunked", [False, True])
def test_families(spark, monkeypatch, chunked):
    if chunked:
        monkeypatch.setattr("logquarry.operators.ordered.CHUNK_LINES", 5)
    lines = line_table(spark, {"var/log/pan/dp-monitor.log": DATAPLANE, "mp-monitor.log.2": MANAGEMENT, "dp0-monitor.log": DATAPLANE})
    found: dict = {}
    for r in co.extract_counters(lines).collect():
        found.setdefault(r.name, []).append((r.ts.strftime("%H:%M:%S"), r.value))
    for name, points in EXPECTED.items():
        assert sorted(found[name]) == points, name
    assert not set(ABSENT) & set(found)
