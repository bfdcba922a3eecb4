from logquarry.operators import search as se

SCHEMA = "file_id string, entry_ord int, path string, line_no long, text string"


def by_hand(rows, only=None):
    return {(f, o, p, t[i : i + 3].lower()) for f, o, p, _, t in rows for i in range(len(t or "") - 2) if only is None or t[i : i + 3].lower() in only}


def test_trigrams_of_odd_texts(spark, monkeypatch):
    """Characters beyond the basic plane gave sequences that start with half a character."""
    rows = [
        ("a", 0, "x", 1, "a\U0001f600bcd"), ("a", 0, "x", 2, "cd"), ("a", 0, "x", 3, ""), ("a", 0, "x", 4, None), ("a", 0, "x", 5, "ABCABC\x00\x00\x00 é"),
        ("a", 1, "x", 6, "ab"), (None, None, None, 7, "null key"), ("b", 0, None, 8, "x\ny￿\U00010000"), ("b", 0, "y", 9, "e"),
    ]
    lines = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    for only in (None, ["abc", "cab", "zzz"], []):
        for size in (1 << 20, 4):
            monkeypatch.setattr(se, "GROUP_CHARS", size)
            got = [tuple(r) for r in se.trigrams(lines, only).collect()]
            assert len(got) == len(set(got)) and set(got) == by_hand(rows, only)
    assert se.trigrams(lines.limit(0)).count() == 0
