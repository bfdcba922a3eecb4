"""Small line tables for tests."""

from __future__ import annotations


def line_table(spark, files, file_id="f"):
    """{path: text} to (file_id, entry_ord, path, line_no, text)."""
    rows = [
        (file_id, ord_, path, number, text)
        for ord_, (path, body) in enumerate(files.items())
        for number, text in enumerate(body.split("\n"), 1)
    ]
    return spark.createDataFrame(rows, "file_id string, entry_ord int, path string, line_no int, text string")


def samples(df, *columns):
    return sorted(tuple(str(v) if v is not None else None for v in r) for r in df.select(*columns).collect())
