"""Chunked steps give the same rows as plain windows, whatever the chunk borders."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logquarry.operators.ordered import by_lines, by_range, median_by_position


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for key, size in (("hot", 400), ("warm", 40), ("one", 1)):
        for i in range(size):
            data.append((key, "p", i, rng.choice([None, None, None, i]), rng.choice([None, None, i * 2.0]), float(rng.randint(0, 50))))
    return spark.createDataFrame(data, "file_id string, path string, line_no long, a long, b double, v double")


def cut(kind, rows):
    if kind == "lines":
        return by_lines(rows, ("file_id", "path"), lines=7)
    return by_range(rows, ("file_id", "path"), ("line_no",))


def plain(kind_df):
    return sorted(tuple(r) for r in kind_df.collect())


@pytest.mark.parametrize("kind", ["lines", "range"])
def test_steps_match_plain_windows(rows, kind):
    ordered = cut(kind, rows)
    w = Window.partitionBy("file_id", "path").orderBy("line_no")
    d = Window.partitionBy("file_id", "path").orderBy(F.desc("line_no"))
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), d.rowsBetween(Window.unboundedPreceding, 0)
    above, below = w.rowsBetween(Window.unboundedPreceding, -1), d.rowsBetween(Window.unboundedPreceding, -1)
    got = ordered.carry({"la": "a", "lb": "b"}, {"xa": "a"}, {"na": "a"}, {"ya": "a"}).rows()
    want = rows.select(
        "*",
        F.last("a", True).over(up).alias("la"),
        F.last("b", True).over(up).alias("lb"),
        F.last("a", True).over(above).alias("xa"),
        F.last("a", True).over(down).alias("na"),
        F.last("a", True).over(below).alias("ya"),
    )
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    got = ordered.shift({"pv": "v", "pa": "a"}, {"nv": "v"}).rows()
    want = rows.select("*", F.lag("v").over(w).alias("pv"), F.lag("a").over(w).alias("pa"), F.lead("v").over(w).alias("nv"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    got = ordered.positions("rn", "n").rows()
    want = rows.select("*", F.row_number().over(w).cast("long").alias("rn"), F.count("*").over(Window.partitionBy("file_id", "path")).alias("n"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    for how, fn in (("sum", F.sum), ("max", F.max)):
        for exclusive, frame in ((False, up), (True, above)):
            got = ordered.running({"s": "b"}, how, exclusive).rows()
            want = rows.select("*", fn("b").over(frame).alias("s"))
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_key_is_spread_over_chunks(rows):
    ordered = cut("range", rows)
    assert ordered.df.where(F.col("file_id") == "hot").select("_chunk").distinct().count() > 1


def test_median_by_position(rows):
    got = median_by_position(rows, ("file_id",), "v", ("line_no",), "m")
    want = rows.groupBy("file_id").agg(F.median("v").alias("m"))
    assert plain(got) == plain(want)
