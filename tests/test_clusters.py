"""Clusters over chunks are those of one greedy walk over all events of a key."""

import datetime
import random

import pytest

from logquarry.operators import anomalies as an

START = datetime.datetime(2024, 1, 1)


def walk(events):
    """{(key, first): (last, count)} of (key, second, count) rows."""
    out, by = {}, {}
    for key, at, n in events:
        own = by.setdefault(key, {})
        own[at] = own.get(at, 0) + n
    for key, own in by.items():
        times = sorted(own)
        span = times[-1] - times[0]
        width = next((step for above, step in an.CLUSTER_STEPS if span > above), 0)
        anchor = None
        for at in times:
            if anchor is None or at - anchor >= max(width, 1e-6):
                anchor = at
            last, count = out.get((key, anchor), (at, 0))
            out[key, anchor] = (max(last, at), count + own[at])
    return out


def seconds(ts):
    return (ts - START).total_seconds()


@pytest.mark.parametrize("parts", [1, 7])
def test_clusters_over_any_chunks(spark, parts):
    rnd = random.Random(parts)
    events = [("dense", i, 1 + i % 2) for i in range(0, 90_000, 3)]
    events += [("gaps", rnd.randrange(10**7), 1) for _ in range(400)] + [("short", i, 1) for i in (0, 1, 1, 2, 50)] + [("one", 5, 3)]
    events += [(f"k{i % 20}", rnd.randrange(1000 * (i % 20 + 1)), 1) for i in range(4000)]
    rows = [(k, "l", START + datetime.timedelta(seconds=at)) for k, at, n in events for _ in range(n)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "file_id string, label string, ts timestamp_ntz")
        got = {(r.file_id, seconds(r.ts)): (seconds(r.last_ts), r["count"]) for r in an.time_clusters(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got == walk(events)
    assert an.time_clusters(df.where("ts is null")).count() == 0
