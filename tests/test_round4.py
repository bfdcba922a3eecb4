import time

import pyarrow as pa

from logquarry.sources import xmlnodes

LINES = "file_id string, entry_ord int, path string, line_no long, text string"


def test_long_line_without_marks(spark):
    """Patterns that may start anywhere took the square of a line's length."""

    def took(size):
        lines = spark.createDataFrame([("f", 0, "a.xml", 1, "<a>"), ("f", 0, "a.xml", 2, "x" * size), ("f", 0, "a.xml", 3, "</a>")], LINES)
        began = time.time()
        assert xmlnodes._chunked(lines, 2).count() == 3
        return time.time() - began

    took(10)
    assert took(150_000) < 15


def test_elements_come_in_small_batches():
    """All elements of a chunk were one batch."""
    note = {"chunk": 0, "offset": 0, "ended": False, "last": True, "stack": [], "inner": {}}
    text = "<a>" + '<entry name="n&amp;" x="1"><member>m</member></entry>' * xmlnodes.BATCH_ROWS + "</a>"
    rows = [("f", 0, "p", 0, True, None, __import__("json").dumps(note)), ("f", 0, "p", 0, False, None, text)]
    names = [*xmlnodes.KEYS, "chunk", "note", "lead", "text"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
    got = list(xmlnodes._elements(iter([batch])))
    assert sum(b.num_rows for b in got) == 2 * xmlnodes.BATCH_ROWS + 1 and max(b.num_rows for b in got) <= xmlnodes.BATCH_ROWS
    found = next(r for b in got for r in b.to_pylist() if r["tag"] == "entry")
    assert dict(found["attrs"]) == {"name": "n&", "x": "1"} and found["tags"] == ["a", "entry"] and found["collected"] == "m"
