import hashlib
import random
import re
from functools import cache
from itertools import product
from zlib import crc32

import pyarrow as pa

from logquarry.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "" if found[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain(rows):
    """(cost, edits, repaired rows) by trying what may follow, from the end; rows are (role, text)."""
    fault = faults(rows)

    @cache
    def rest(i, last, room):
        options = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        ends = {"": "u", "s": "u", "u": "a", "a": "u"}
        role = {"u": "user", "a": "assistant"}[ends[last]]

        def add(cost, letter, row, step):
            if step is not None:
                options.append((cost + step[0], letter + step[1], row + step[2]))

        if room:
            add(5, "I", ((role, ""),), rest(i, ends[last], room - 1))
        if i < len(rows):
            add(2, "D", (), rest(i + 1, last, 3))
            if fault[i] not in ("blank", "duplicate"):
                more = 5 if fault[i] == "truncated" else 0
                add(1 + more, "R", ((role, rows[i][1]),), rest(i + 1, ends[last], 3))
                initial = rows[i][0][:1]
                if initial == ends[last] or (initial == "s" and last == ""):
                    add(more, "K", (rows[i],), rest(i + 1, initial, 3))
        return min(options, default=None)

    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for last, room in product(["", "s", "u", "a"], range(4)):
            rest(i, last, room)
    return rest(0, "", 3)


def expected(rows):
    """The report of one conversation of (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    own = [(r, t) for _, r, t in rows]
    cost, audit, left = plain(own)
    found, known = faults(own), {t for t, _, _ in rows if t is not None}
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(own, own[1:], strict=False)]
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    text = "\n".join(f"{r}:{t}" for r, t in left)
    return (gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


TEXTS = ["Yes.", "No!", "cut off", "", " \t", "Why?", "open end\n"]


def conversations(seed, n, longest):
    rnd = random.Random(seed)
    return {c: [(rnd.choice([None, *range(longest)]), rnd.choice(["user", "assistant", "system", "tool", "", "u"]), rnd.choice(TEXTS)) for _ in range(rnd.randrange(1, longest + 1))] for c in range(n)}


def reported(spark, held, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = spark.createDataFrame([(c, *r) for c, own in held.items() for r in own], SCHEMA)
        return {r[0]: tuple(r)[1:] for r in turns.report(rows, rows).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_every_short_conversation(spark):
    rows = [("system", "S."), ("user", "U."), ("assistant", "A"), ("user", "")]
    held = {i: list(zip(range(9), *zip(*own, strict=True), strict=False)) for i, own in enumerate(x for n in range(1, 5) for x in product(rows, repeat=n))}
    got = reported(spark, held, 8)
    assert got == {c: expected(own) for c, own in held.items()}


def test_random_conversations_and_long_ones_over_several_parts(spark):
    held = conversations(1, 60, 12) | {100 + c: own for c, own in conversations(2, 3, 700).items()}
    for own in held.values():
        own += own[: len(own) // 5]
    held[200] = [(i, "assistant" if i % 3 else "user", f"text {i}.") for i in range(900)]
    want = {c: expected(own) for c, own in held.items()}
    assert reported(spark, held, 13) == want
    assert reported(spark, held, 2) == want


def test_fragments_join_to_the_same_path():
    rnd = random.Random(4)
    columns = ["conv", "part", "turn", "role", "digest", "fault", "copies"]
    for seed in range(40):
        own = sorted(set(conversations(seed, 1, 300)[0]), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        found = faults([(r, t) for _, r, t in own])
        cuts = sorted(rnd.randrange(len(own) + 1) for _ in range(seed % 5))
        rows = [dict(zip(columns, (7, sum(i >= c for c in cuts), t, r, b"%05d" % i, f, rnd.choice([1, 1, 1, 3])), strict=True)) for i, ((t, r, _), f) in enumerate(zip(own, found, strict=True))]
        whole = [r | {"part": 0} for r in rows]

        def joined(rows):
            parts = [p for b in turns._fragments(iter([pa.RecordBatch.from_pylist(rows)])) for p in b.to_pylist()]
            return turns._joined([p | {"least": min((r["turn"] for r in rows if r["part"] == p["part"] and r["turn"] is not None), default=None)} for p in parts])[-1]

        a, b = joined(rows), joined(whole)
        assert all(a[k] == b[k] for k in ("cost", "audit", "gaps", "illegal", "blank", "duplicate", "truncated"))


def test_repaired_rows(spark):
    held = conversations(9, 30, 10)
    rows = spark.createDataFrame([(c, *r) for c, own in held.items() for r in own], SCHEMA)
    out = {}
    for r in turns.repaired(rows).orderBy("conv_id", "position").collect():
        out.setdefault(r.conv_id, []).append((r.role, r.text))
        assert r.position == len(out[r.conv_id])
    hashes = {c: h[-1] for c, h in reported(spark, held, 4).items()}
    for c, h in hashes.items():
        own = out.get(c, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in own))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in own).encode()).hexdigest() == h


def test_damage_nulls_repeats_and_clashing_columns(spark):
    raw = [(c, t, r, x) for c in (None, 1, 2, 3) for t in (None, *range(12)) for r, x in (("user", "Hi."), ("assistant", None), (None, "Oh! Ah? No."))]
    raw += raw[:9]
    clash = [(*r, 1, "p", "d", 2.0) for r in raw]
    rows = spark.createDataFrame(clash, f"{SCHEMA}, conv int, part string, digest string, letters double")
    held = {}
    for c, t, r, x in raw:
        code = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = "user" if code == 4 else " " if r is None else r, " " if x is None else x
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        held.setdefault(c, []).extend([(t, r, x)] * (0 if code == 0 else 2 if code == 3 else 1))
    got = {r[0]: tuple(r)[1:] for r in turns.report(turns.damaged(rows), rows).collect()}
    assert got == {c: expected(own) for c, own in held.items()}


def test_nothing_left_and_nothing_at_all(spark):
    rows = spark.createDataFrame([(5, 1, "user", "x")], SCHEMA)
    got = turns.report(rows.where("turn > 1"), rows).collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert turns.report(rows.where("turn > 1"), rows.where("turn > 1")).count() == 0
    assert turns.repaired(rows.where("turn > 1")).count() == 0
