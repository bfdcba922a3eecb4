"""Inputs of the registered queries, derived from the driver tables.

Each view is one SELECT that Spark and DuckDB both run; only the timestamp format differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK_WORDS = {
    "slash_ts": "date_format(ts, 'yyyy/MM/dd HH:mm:ss')",
    "dash_ts": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
    "agent_ts": "date_format(ts, 'MM/dd/yyyy HH:mm:ss')",
    "trace_ts": "date_format(ts, 'MM/dd/yy HH:mm:ss')",
    "whole_ts": "date_trunc('second', ts)",
    "list": "array",
    "exploded": "p AS p, line AS line FROM s LATERAL VIEW posexplode(ls) x AS p, line",
    "numbered_lines": "p + 1 AS line_no, line AS text FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) x AS p, line",
}
DUCK_WORDS = {
    "slash_ts": "strftime(ts, '%Y/%m/%d %H:%M:%S')",
    "dash_ts": "strftime(ts, '%Y-%m-%d %H:%M:%S')",
    "agent_ts": "strftime(ts, '%m/%d/%Y %H:%M:%S')",
    "trace_ts": "strftime(ts, '%m/%d/%y %H:%M:%S')",
    "whole_ts": "date_trunc('second', ts)",
    "list": "list_value",
    "exploded": "p, ls[p + 1] AS line FROM s, unnest(range(0, len(ls))) AS u(p)",
    "numbered_lines": """i AS line_no, parts[i] AS text FROM (
            SELECT *, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i)""",
}

VIEWS = {
    "lines": """
        SELECT source AS file_id, doc_id AS entry_ord, concat('docs/', lang, '/', doc_id, '.log') AS path,
               {numbered_lines}""",
    "monitor": """
        SELECT concat('bundle', event_id % 3) AS file_id, 0 AS entry_ord, 'var/log/mp-monitor.log' AS path,
               event_id AS line_no,
               CASE WHEN event_id % 400 = 0 THEN '2024-02-31 00:00:00.5 -0700  --- broken'
                    WHEN event_id % 20 = 0 THEN concat({dash_ts}, '.123 -0700  --- ', event_type, '_block')
                    WHEN event_id % 11 = 1 THEN concat({slash_ts}, ' plain ', user_id)
                    WHEN event_id % 7 = 3 THEN ':CPU load sampling by group:'
                    WHEN event_id % 14 = 4 THEN ':CPU load (%) during last 60 seconds:'
                    WHEN event_id % 7 = 5 THEN concat(':Resource utilization (%) during last ', user_id, ' seconds:')
                    WHEN event_id % 7 = 6 THEN concat(':pool ', event_type, ':')
                    ELSE concat('key', user_id, ' ', value) END AS text
        FROM {events}""",
    "syslog": """
        SELECT concat('bundle', user_id % 4) AS file_id, 0 AS entry_ord, 'show_log_system.txt' AS path,
               event_id AS line_no,
               concat({slash_ts}, ' ',
                 CASE event_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'High' WHEN 2 THEN 'medium'
                                   WHEN 3 THEN 'low' ELSE 'informational' END,
                 ' ', event_type, ' obj 0 ',
                 CASE event_id % 8
                   WHEN 0 THEN concat('Interface ethernet1/', user_id % 8 + 1, ' link is down')
                   WHEN 1 THEN concat('BGP peer 10.0.', user_id % 256, '.', event_id % 256, ' session down')
                   WHEN 2 THEN concat('Lost 10.1.', user_id % 256, '.9/24 port: ', event_id, ' conn id: x', event_id)
                   WHEN 3 THEN concat('Successfully connected to server 10.2.0.', user_id % 256)
                   WHEN 4 THEN concat('Installed package ''pkg-', event_id, ''' in ', user_id, ' ms')
                   WHEN 5 THEN concat('User u', user_id, ' came via ae', user_id % 4, '.', event_id % 9)
                   WHEN 6 THEN concat('Certificate of host', user_id, ' expires in ', event_id % 90, ' days')
                   ELSE concat('Neighbour 00:1b:17:00:01:', 10 + user_id % 80, ' moved, dump core-', event_id, '.tgz')
                 END) AS text
        FROM {events}""",
    "memory_counters": """
        SELECT concat('bundle', user_id % 3) AS file_id,
               CASE event_type WHEN 'view' THEN 'mp__memory__mem_available' WHEN 'click' THEN 'mp__memorydetail__sunreclaim'
                 WHEN 'signup' THEN concat('mp__slabinfo__kmalloc_', user_id % 4, '_totalactsize')
                 ELSE concat('mp__processes__proc', user_id % 10, '_', CASE WHEN user_id % 10 < 5 THEN user_id % 10
                             ELSE user_id END, '_res_swap') END AS name,
               date_trunc('minute', ts) AS ts, floor(value * 64) * 1024 AS value, 0 AS entry_ord, event_id AS line_no, 0 AS emit_ord
        FROM {events}""",
    "agent_log": """
        SELECT concat('host', user_id % 8) AS file_id, 0 AS entry_ord, 'logs/pan_gp_event.log' AS path, event_id AS line_no,
               CASE WHEN event_id % 97 = 5 THEN '' WHEN event_id % 89 = 7 THEN concat('  continued ', user_id)
               ELSE concat({agent_ts}, ':', 100 + event_id % 900, CASE WHEN event_id % 13 = 1 THEN ' [Error]: ' ELSE ' [Info ]: ' END,
               CASE event_type
                 WHEN 'signup' THEN CASE WHEN user_id % 3 = 0 THEN 'SSO starts for user' ELSE
                      concat('started the portal pre-login to the portal vpn', user_id, '.example.com') END
                 WHEN 'view' THEN CASE event_id % 6 WHEN 0 THEN 'Load the SAML Browser now' WHEN 1 THEN 'logging into portal'
                      WHEN 2 THEN concat('Unserialized non-empty cookie for portal p.example.com and user user', user_id)
                      WHEN 3 THEN 'Enter login credentials' WHEN 4 THEN 'network discovery started' ELSE 'Gateway Login starts to x' END
                 WHEN 'click' THEN CASE event_id % 5 WHEN 0 THEN 'portal status is Connected.' WHEN 1 THEN 'portal pre-login result received'
                      WHEN 2 THEN concat('Portal login completed with address p', user_id, '.example.com')
                      WHEN 3 THEN concat('Gateway pre-login starts to gw', user_id, '.example.com')
                      ELSE concat('hip report submitted to the gateway gw', user_id, '.example.com') END
                 WHEN 'error' THEN CASE event_id % 5 WHEN 0 THEN 'Auth failed for portal p.example.com' WHEN 1 THEN 'no network connectivity'
                      WHEN 2 THEN 'The network connection is unreachable or the gateway is unresponsive'
                      WHEN 3 THEN concat('tunnel creation failed ', {agent_ts}, ':123 [Info]: tail ', user_id)
                      ELSE 'captive page' END
                 ELSE concat('IPSec tunnel creation finished with gateway gw', user_id, '.example.com') END) END AS text
        FROM {events}""",
    "service_log": """
        SELECT concat('host', user_id % 6) AS file_id, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END AS entry_ord,
               CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'logs/PanGPS.1.log' ELSE 'logs/PanGPS.log' END AS path,
               event_id AS line_no,
               concat('(P1-T2)Debug( 10): ', {trace_ts}, ':123 ', CASE event_type
                 WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'Parse gateway list for user u' ELSE '----Portal Pre-login starts----' END
                 WHEN 'view' THEN CASE event_id % 4
                   WHEN 0 THEN concat('Gateway gw', user_id % 5, '.example.com(Name', user_id % 5, '): ipv4 10.0.0.', user_id, ', ipv6 , FQDN yes')
                   WHEN 1 THEN concat('tcp connection time is ', user_id)
                   WHEN 2 THEN concat('Unserialized non-empty cookie for portal p', user_id % 3, '.example.com and user user', user_id)
                   ELSE concat('REGION-PRIO, region code is R', user_id % 7) END
                 WHEN 'click' THEN concat('One external gateway gw', user_id % 5, '.example.com, priority=', user_id % 9, ', manual is ', user_id % 2)
                 WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'One external gateway and the priority is -2, region does not match'
                   WHEN 1 THEN 'gateway list is empty' ELSE concat('Portal login completed with address p', user_id % 3, '.example.com.') END
                 ELSE CASE event_id % 3 WHEN 0 THEN 'IPSec tunnel creation finished' WHEN 1 THEN concat('Gateway selection type is Auto', user_id % 2)
                   ELSE concat('m_pBestGateway=x (gateway=GW', user_id % 5, '.example.com)') END END) AS text
        FROM {events}""",
    "config_xml": """
        SELECT concat('fw', c_nationkey) AS file_id, 0 AS entry_ord, 'opt/pancfg/mgmt/running-config.xml' AS path, c_custkey AS line_no,
               CASE WHEN c_custkey % 5 < 3 THEN concat('<', rb, '><security><rules><entry name="', c_name, '"><from><member>z', c_custkey % 9,
                      '</member><member>any</member></from><action>', lower(c_mktsegment), '</action></entry></rules></security></', rb, '>')
                    WHEN c_custkey % 5 = 3 THEN concat('<zone><entry name="zone', c_custkey, '"><network><layer3><member>ethernet1/', c_custkey % 7,
                      '</member></layer3></network></entry></zone>')
                    WHEN c_custkey % 10 = 9 THEN concat('<deviceconfig><system><host-name>h', c_custkey, '</host-name><dns><primary>', c_mktsegment,
                      '</primary></dns><allowed><entry name="e', c_custkey, '"/></allowed></system></deviceconfig>')
                    ELSE concat('<interface><ethernet><entry name="ethernet1/', c_custkey % 7, '"><layer3><ip><entry name="10.0.0.', c_custkey,
                      '/24"/></ip></layer3><comment>', c_mktsegment, '</comment></entry></ethernet></interface>') END AS text
        FROM (SELECT *, CASE c_custkey % 5 WHEN 0 THEN 'pre-rulebase' WHEN 1 THEN 'rulebase' ELSE 'post-rulebase' END AS rb FROM {customer}) q
        UNION ALL SELECT concat('fw', n_nationkey), 0, 'opt/pancfg/mgmt/running-config.xml', -1, '<config version="1"><vsys>' FROM {nation}
        UNION ALL SELECT concat('fw', n_nationkey), 0, 'opt/pancfg/mgmt/running-config.xml', 4000000000, '</vsys></config>' FROM {nation}""",
    "report_xml": """
        SELECT concat('pc', p_size) AS file_id, 0 AS entry_ord, 'pan_gp_hrpt.xml' AS path, p_partkey AS line_no,
               CASE WHEN p_partkey % 4 = 0 THEN concat('<entry name="patches', p_partkey, '"><missing-patches><entry><title>KB', p_partkey,
                      '</title><severity>', p_size, '</severity></entry></missing-patches></entry>')
                    WHEN p_partkey % 4 = 1 THEN concat('<entry name="none', p_partkey, '"><list/></entry>')
                    ELSE concat('<entry name="cat', p_partkey % 3, '"><list><entry><ProductInfo><Prod vendor="', p_brand, '" name="', p_name,
                      '" version="', p_partkey, '"/><is-enabled>', CASE WHEN p_partkey % 3 = 0 THEN 'yes' ELSE '' END,
                      '</is-enabled></ProductInfo></entry></list></entry>') END AS text
        FROM {part}
        UNION ALL SELECT DISTINCT concat('pc', p_size), 0, 'pan_gp_hrpt.xml', CAST(-1 AS BIGINT),
          concat('<hip-report><generate-time>01/02/2024 03:04:05</generate-time><user-name>u', p_size, '</user-name><categories>') FROM {part}
        UNION ALL SELECT DISTINCT concat('pc', p_size), 0, 'pan_gp_hrpt.xml', CAST(4000000000 AS BIGINT), '</categories></hip-report>' FROM {part}""",
    # one document of all customers: unquoted attributes, stray and missing closing tags, comments over lines, no end of the root
    "broken_xml": """
        SELECT 'fleet' AS file_id, 0 AS entry_ord, 'all-customers.xml' AS path, c_custkey AS line_no,
               CASE c_custkey % 6 WHEN 1 THEN concat('<entry name=', c_custkey, '><v>', c_nationkey, '</v></stray></entry>')
                    WHEN 2 THEN concat('<entry name="c', c_custkey, '"><v>', c_nationkey, '</entry>')
                    WHEN 3 THEN concat('<!-- <entry name="', c_custkey, '">')
                    WHEN 4 THEN concat('<entry name="hidden"/>--><entry name="c', c_custkey, '"><v>', c_nationkey, ' & more</v></entry>')
                    WHEN 5 THEN concat('<entry name="c', c_custkey, '"')
                    ELSE concat(' kind="', c_custkey, '"><v a="1>0"/></entry>') END AS text
        FROM {customer} WHERE c_custkey > 0
        UNION ALL SELECT 'fleet', 0, 'all-customers.xml', CAST(-1 AS BIGINT), '<list>' FROM {region} WHERE r_regionkey = 0""",
    "bundle_entries": """
        SELECT concat('a', CAST(floor(doc_id / 7) AS BIGINT)) AS file_id, doc_id % 7 AS entry_ord, n_chars AS size, false AS is_binary,
               CASE WHEN doc_id % 31 = 3 THEN concat('x/opt/pancfg/', lang, '.conf') WHEN doc_id % 29 = 4 THEN 'var/log/pan/dp0-monitor.log'
                    WHEN doc_id % 11 = 5 THEN concat('./logs/PanGPS.log.', doc_id) WHEN doc_id % 13 = 2 THEN 'HipReport.xml'
                    WHEN doc_id % 3 < 2 THEN concat('logs/', source, '.log') ELSE concat('data/', doc_id, '.bin') END AS path
        FROM {documents}""",
    "cli_dump": """
        SELECT concat('bundle', CAST(floor(k / 400) AS BIGINT)) AS file_id, CAST(floor(k / 200) AS BIGINT) % 2 AS entry_ord,
               concat('tmp/cli/part', CAST(floor(k / 200) AS BIGINT) % 2, '.txt') AS path, k AS line_no,
               CASE WHEN r IN (10, 160) THEN '> show running application statistics'
                    WHEN r IN (11, 50) THEN concat('Vsys: vsys', k % 7)
                    WHEN r = 99 THEN '----- ----'
                    WHEN r = 100 THEN concat('Total ', k, ' 2 3 4 5')
                    WHEN r BETWEEN 12 AND 98 THEN concat(p_name, ' v', k, '  ', p_size, ' ', k % 50, '   ',
                                                         CAST(floor(p_retailprice) AS BIGINT), ' 0 ',
                                                         CASE WHEN r = 70 THEN 'n/a' ELSE '3' END)
                    WHEN r = 102 THEN '> request license info'
                    WHEN r BETWEEN 104 AND 139 THEN CASE k % 6 WHEN 0 THEN 'License entry:'
                         WHEN 1 THEN CASE WHEN k % 5 = 0 THEN '' ELSE concat('Feature: ', p_brand) END
                         WHEN 2 THEN concat('Expires: day ', k) WHEN 3 THEN concat('Expired?: ', CASE WHEN k % 4 = 1 THEN 'yes'
                         ELSE 'no' END) WHEN 4 THEN concat('Custom Key: ', p_type) ELSE 'no pair here' END
                    WHEN r = 140 THEN '> show system info'
                    WHEN r = 142 THEN concat('hostname: fw', k)
                    WHEN r BETWEEN 143 AND 149 THEN CASE WHEN k % 4 = 0 THEN '' ELSE concat('key-', k, ': ', p_name) END
                    WHEN r = 150 THEN 'device-certificate-status: valid'
                    ELSE concat('other ', p_name) END AS text
        FROM (SELECT *, p_partkey AS k, p_partkey % 200 AS r FROM {part}) q""",
    "kernel_log": """
        SELECT concat('bundle', user_id % 3) AS file_id, 0 AS entry_ord, 'var/log/messages' AS path, event_id AS line_no,
               CASE event_id % 6
                 WHEN 0 THEN concat(CASE WHEN event_id % 4 = 0 THEN '' ELSE concat({dash_ts}, ' ') END, 'proc', user_id,
                                    ' invoked oom-killer: order=0')
                 WHEN 1 THEN concat({dash_ts}, ' Out of memory: Killed process ', user_id, ' (app', user_id % 7, ')',
                                    CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(' score ', event_id % 900) END)
                 WHEN 2 THEN concat({dash_ts}, ' Kill process ', user_id, ' without a name')
                 ELSE concat({dash_ts}, ' all quiet ', user_id) END AS text
        FROM {events}""",
    "monitor_log": """
        SELECT file_id, 0 AS entry_ord, concat('var/log/pan/', plane, '-monitor.log') AS path, e * 32 + p AS line_no,
               line AS text FROM (
        WITH b AS (SELECT event_id AS e, user_id AS u, CAST(floor(value * 100) AS BIGINT) AS v, event_type AS t,
                     concat('bundle', user_id % 2) AS file_id, CASE WHEN user_id % 4 < 2 THEN 'mp' ELSE 'dp' END AS plane,
                     concat({dash_ts}, '.087 -0700  --- ') AS h
                   FROM {events}),
        s AS (SELECT *, CASE e % 20
          WHEN 0 THEN {list}(concat(h, 'panio'), ':Global counters:',
            concat(':Elapsed time since last sampling: ', 50 + u, '.5 seconds'), ':name   value  rate',
            concat(':pkt_', t, '   ', v, '   3'), concat(':pkt_sent   ', u, '   -1'), ':Total counters shown: 2',
            ':pkt_late 1 1')
          WHEN 1 THEN {list}(concat(h, 'panio'), ':CPU load (%) during last 15 minutes:', ':core    0     11',
            ':     avg max avg max', concat(':  ', u, ' 2 ', v, ' 4'), ':  7   8', concat(':  1 2 3 ', u), ':core 2',
            concat(':  ', v, ' 9'))
          WHEN 2 THEN {list}(concat(h, 'cpu'), 'Last 180 seconds', 'Avg (%)    Max (%)', concat(u, '   ', v), '1  2',
            'Load Avg:', concat(u, '.25 1.5 ', u, '.75 1/1449 49'))
          WHEN 3 THEN {list}(concat(h, 'ifconfig'), concat('1: eth', u, '@if5: <UP> mtu 1'),
            '    RX:  bytes packets  missed', concat('   ', v, ' ', u, '  0'), '   5 6 7', '    TX:  bytes packets',
            '  1 2 3', concat('   TX:  bytes collsns'), concat(' 3  ', v))
          WHEN 4 THEN {list}(concat(h, 'memory'), concat('Mem   ', v, '   2  8000000 ', u), concat('Swap ', u, ' 0 ', v))
          WHEN 5 THEN {list}(concat(h, 'netstat_detail'), 'Proto Recv-Q Send-Q Local Foreign State PID',
            concat('tcp   ', v, ' 2 0.0.0.0:1 0.0.0.0:* LISTEN  33/app', u % 3), 'tcp 3 1 a b ESTABLISHED -',
            concat('tcp6   4 ', u, ' :::1 :::* LISTEN  34/app', u % 3), concat('tcp   5 6 0.0.0.0:1 x LISTEN  35/app', u % 3))
          WHEN 6 THEN {list}(concat(h, 'processes'), 'Name PID CPU FDs Virt Res State Lazy',
            concat('proc', u % 9, ' ', u, '  ', u % 100, ' 11 ', v, ' 900 S 800'), concat('Total num processes: ', u),
            concat('Totals 3 ', v, ' 5 6 7'))
          WHEN 7 THEN {list}(concat(h, 'panio_infreq'), ':Vsys: 2', ':15 1 2 3 4 5',
            concat(':', u, '   ', v, ' 27 15 0 3'), ':---')
          WHEN 8 THEN {list}(concat(h, 'panio'), ':Resource utilization (%) during last 15 minutes:',
            ':packet buffer (average):', concat(':   ', u, '  ', v), ':  9 9', ':session (maximum):', concat(':  ', v))
          WHEN 9 THEN {list}(concat(h, 'panio'), concat(':Number of sessions supported:   ', v), ':Hardware session offloading: True',
            concat(':TCP default timeout:    ', u, ' secs'), ':Tunnel acceleration:   False')
          WHEN 10 THEN {list}(concat(h, 'top'), concat('top - 11:00 up 3 days, 02:0', u % 10, ',  ', u, ' users,  load average: 1.5, 2.5, ', u),
            concat('%Cpu(s):  1.5 us, ', u, ' sy, 4 wa'), concat(u, ' root 20 0 ', v, 'm 12g 100 S 5.5 0.1 1:02.5 proc', u % 3),
            concat('Tasks: 300 total,   ', u, ' running'), concat('MiB Mem :   7921.5 total,    ', u, '.5 free'),
            concat('MiB Swap:   4000.0 total,   ', u, '.0 free,    100.0 used.   2500.5 avail Mem'))
          WHEN 11 THEN {list}(concat(h, 'panio'), ':Software Pools', concat(':[ 1] Pool A  (  0):   ', v, '/1024'), ':[ 2] B (1): 3/0',
            ':Mem-Pool-Type  MaxSz', concat(':fptcp ', v, ' 2 3(0)'), ':thread 1 deq 5', ':pow parameters:', concat(':thread 3 sel ok ', u),
            concat(':io: wqe alloc 4 wqe null ', v))
          WHEN 12 THEN {list}(concat(h, 'panio'), ':Cache-Type   MAX-Entries Cur-Entries Max.Alloc Cur.SZ(B)',
            concat(':ssl_', t, '  ', v, ' ', u, ' 177 14080 0 l7_misc'), ':short_cache 1 2 3', ':  Per pan-task counter statistics',
            concat(':Counter Name   1   ', u + 2, '  Total'), concat(':pkt_', t, ' ', v, ' ', u, ' 9'), ':short 1',
            ':User  Quota Threshold', concat(':appid ', v, ' 80 ', u, ' 2(3)'))
          WHEN 13 THEN {list}(concat(h, 'memory_detail'), concat('MemAvailable:  ', v, ' kB'), 'HugePages_Total:   0',
            concat('Active(anon):  -', u + 1, ' kB'), 'not a pair')
          WHEN 14 THEN {list}(concat(h, 'slabinfo'), 'slabinfo - version: 2.1', '# name 1 2 3 4 5 : x',
            concat('kmalloc-', u, '   ', v, ' 20 96 42 1 : tunables 0 0 0'))
          WHEN 15 THEN {list}(concat(h, 'logrcvr_statistics'), concat(' Log incoming rate:   ', u, '/sec'),
            concat(' Traffic logs written:  ', v), concat(' Total (MB):   ', u, '.5'), ' Log incoming rate:  999/sec')
          WHEN 16 THEN {list}(concat(h, 'netstat_stats'), '7 early lines', 'Ip:', concat('    ', v, ' total packets received'),
            concat('    Forwarding: ', u), 'TcpExt:', concat('    ', u, ' resets sent'))
          WHEN 17 THEN {list}(concat(h, 'filesystem'), concat('/  ', u % 100, '  ', v), concat('/opt/repo', u % 3, '  5  ', u),
            'tmpfs none 3')
          WHEN 18 THEN {list}(concat(h, 'panio'), ':Pow Atomic Memory Pools', concat(':[ 0] Work Entries   :    ', v, '/200'),
            ':[ 1] Idle : 5/0', ':func   max-us avg-us', concat(':pan_a  ', v, ' 5 3 ', u, ' 1'), ':group  max-us',
            concat(':grp_', t, ' ', u, ' 2'), ':detail_one (group)', concat(':   2   ', u, '  12 13 ', v), ':detail_two (func)',
            concat(':  ', u % 4, ' 1 2 3 x'))
          ELSE {list}(concat(h, 'panio'), ':Number of sessions supported:  5', concat(':Session timeout: TCP: ', u,
            ' secs, UDP: 60 secs, SCTP: 30, other IP protocols: 45 secs'), concat(':Session table utilization:  ', u % 100, '%'),
            ':pow parameters:', concat(':Total inflight wqe ', u), concat(':used wqe ', u, ' total wqe ', v, '  25% used'),
            concat(':rcv_thresh : ', u), ':thread 2 rcv_tot 9') END AS ls FROM b)
        SELECT file_id, plane, e, {exploded}) q""",
    "counters": """
        SELECT concat('bundle', user_id % 2) AS file_id, concat('mp__evt__', event_type, '_', user_id % 5) AS name,
               ts, value, 0 AS entry_ord, event_id AS line_no, 0 AS emit_ord
        FROM {events}""",
    "metrics": """
        SELECT concat('bundle', user_id % 2) AS file_id,
               CASE event_type
                 WHEN 'view' THEN concat('mp__cpu_load_avg__i_', CASE user_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '5'
                                                                     ELSE '15' END)
                 WHEN 'click' THEN concat('dp__cpu__0', user_id % 4, '_avg')
                 WHEN 'error' THEN concat('mp__processes__proc', user_id % 6, '_', user_id, '_cpu')
                 WHEN 'purchase' THEN concat('mp__netstat_detail__tcp_app', user_id % 8, '_recv_q')
                 ELSE 'dp__top__cpu__iowait_pct' END AS name,
               {whole_ts} AS ts,
               CASE event_type WHEN 'view' THEN value / 32 WHEN 'click' THEN value / 4 WHEN 'error' THEN value / 4
                               WHEN 'purchase' THEN value * 1024 ELSE value / 64 END AS value,
               0 AS entry_ord, event_id AS line_no, 0 AS emit_ord
        FROM {events}""",
}

# the monitor log with an application block for every twelfth event; the other events keep their kinds
VIEWS["app_log"] = VIEWS["monitor_log"].replace(
    "CASE e % 20", "CASE CASE WHEN e % 12 = 7 THEN 7 WHEN e % 20 = 7 THEN 19 ELSE e % 20 END"
)


def spread(df: DataFrame) -> DataFrame:
    """Deal a table out over the cores: a view makes many lines of a row, and the tables here are one file each."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name].format(**SPARK_WORDS, **{t: "{" + t + "}" for t in TABLES})
    tables = {t: spread(table(spark, sf_dir, t)) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **tables)


def duck(name: str) -> str:
    """The view as a DuckDB subquery."""
    return VIEWS[name].format(**DUCK_WORDS, **{t: t for t in TABLES})


def with_views(sql: str, *names: str) -> str:
    """Put the named views in front of a DuckDB query as common table expressions `v_<name>`."""
    views = ", ".join(f"v_{n} AS ({duck(n)})" for n in names)
    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    sql = sql.replace("WITH RECURSIVE", "WITH", 1).strip()
    if sql.upper().startswith("WITH"):
        return f"WITH {recursive}{views}, {sql[4:].strip()}"
    return f"WITH {recursive}{views} {sql}"


TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)
