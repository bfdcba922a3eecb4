"""Repair of conversation structure by a shortest path whose weights are single large integers.

A conversation's rows are ordered by turn (nulls first), then role, then the SHA-256 of the text. A row's first fault
counts: blank (no character but spaces), duplicate (role and text seen earlier), truncated (its last such character
does not end a sentence). The repair keeps, reroles, deletes and inserts rows so that the initials of the roles read
`(s?(ua)+)?`, at the least cost; of repairs that cost the same, the one whose list of edits (D, I, K, R) is the least.

Nodes of the graph are the places between rows with what was emitted last: nothing, `s`, `u` or `a`. Edges edit a row or
insert one, at most two before a row, since two inserted rows lead back to the same node. A path's weight is one
integer: the cost in the high digits, then a fixed number of base-256 digits, one for each edit in order of position,
zeros at the end. So the ordinary minimum of integers decides the cost and the ties. That is sound at each node: two
paths there end with the edit of the same row, so neither list of edits begins with the other.

A conversation is cut into fragments by a range partitioning, so a long one is spread: each fragment gives the lightest
path from each state to each other, `BLOCK` rows at a time; at a block's end the digits go to a list of letters and
one digit remains, the rank among the states, which is all that a later comparison needs. Fragments are joined in
order the same way. Only hashes, flags and letters are ordered like this; the texts travel once, for the replay, which
reads a conversation as a stream, holding one row (the hash of a repaired conversation is one sequence of steps). A
conversation's list of edits is one string, which bounds it to 2^31 edits; nothing else of it is held together.

Defined results: a null role or text is one space; a row without a role has no initial and is never kept as it is; null
ids are one conversation; repeated rows are duplicates; a conversation whose rows were all dropped has zeros and the hash
of the empty string; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import saved, shuffle_partitions

#: Rows whose edits one integer holds.
BLOCK = 64
_WIDTH = 3 * BLOCK
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: What was emitted last: nothing, s, u, a.
_STATES = range(4)
#: State after an inserted or reroled row, and its role.
_NEXT, _ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_LEGAL = frozenset({"su", "ua", "au"})
_SPACES = "[^\\x20\\x09-\\x0D]"

Path = tuple[int, int]


def _put(weight: int, at: int, letter: bytes, cost: int, width: int = _WIDTH) -> Path:
    """The weight with a letter at its position and the cost on top."""
    return weight + (cost << 8 * (width + 1)) + (letter[0] << 8 * (width - 1 - at)), at + 1


def _after_inserts(paths: dict[int, Path]) -> dict[int, Path]:
    """The lightest paths with up to two rows inserted."""
    best, fresh = dict(paths), paths
    for _ in range(2):
        grown: dict[int, Path] = {}
        for state, path in fresh.items():
            new = _put(*path, b"I", INSERT)
            if _NEXT[state] not in grown or new < grown[_NEXT[state]]:
                grown[_NEXT[state]] = new
        for state, path in grown.items():
            if state not in best or path < best[state]:
                best[state] = path
        fresh = grown
    return best


def _after_row(paths: dict[int, Path], initial: str, fault: str) -> dict[int, Path]:
    """The lightest paths over one row."""
    out: dict[int, Path] = {}

    def offer(state: int, path: Path) -> None:
        if state not in out or path < out[state]:
            out[state] = path

    more = TRUNCATED if fault == "truncated" else 0
    for state, path in _after_inserts(paths).items():
        offer(state, _put(*path, b"D", DELETE))
        if fault not in ("blank", "duplicate"):
            offer(_NEXT[state], _put(*path, b"R", REROLE + more))
            if (state, initial) in _KEPT:
                offer(_KEPT[state, initial], _put(*path, b"K", more))
    return out


class _Walk:
    """Lightest paths from one state over rows that are fed to it."""

    def __init__(self, start: int):
        self.done = {start: (0, 0, None)}  # state: cost, rank among the states, letters so far as (letters before, piece)
        self._open()

    def _open(self) -> None:
        self.rows, self.paths = 0, {s: ((c << 8 * (_WIDTH + 1)) + (rank << 8 * _WIDTH), 0) for s, (c, rank, _) in self.done.items()}
        self.before = {rank: letters for _, rank, letters in self.done.values()}

    def close(self) -> None:
        """Digits become letters; of each path the cost, the rank and the letters stay."""
        low = (1 << 8 * (_WIDTH + 1)) - 1
        order = sorted(self.paths, key=lambda s: self.paths[s][0] & low)
        done = {}
        for rank, state in enumerate(order):
            weight, at = self.paths[state]
            digits = (weight & low).to_bytes(_WIDTH + 1, "big")
            before = self.before[digits[0]]
            done[state] = (weight >> 8 * (_WIDTH + 1), rank, (before, digits[1 : 1 + at]) if at else before)
        self.done = done
        self._open()

    def feed(self, initial: str, fault: str, copies: int) -> None:
        self.paths = _after_row(self.paths, initial, fault)
        self.rows += 1
        if self.rows == BLOCK:
            self.close()
        if copies > 1:  # the further ones are deleted, whatever was before
            self.close()
            self.done = {s: (c + DELETE * (copies - 1), rank, (letters, b"D" * (copies - 1))) for s, (c, rank, letters) in self.done.items()}
            self._open()

    def result(self) -> dict[int, tuple[int, bytes]]:
        self.close()
        return {s: (c, _letters(held)) for s, (c, _, held) in self.done.items()}


def _letters(held) -> bytes:
    out = []
    while held is not None:
        held, piece = held
        out.append(piece)
    return b"".join(reversed(out))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            yield from batch.slice(at, 1000).to_pylist()


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_PATH = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("letters", pa.binary())]))


def _arrow(columns: str) -> pa.Schema:
    """Of plain columns, `name type, name type`."""
    return pa.schema([(name, _TYPES[kind]) for name, kind in map(str.split, columns.split(","))])


_PLACED = "conv long, part int, turn long, role string, digest binary, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"
_FRAGMENT = _PLACED + ", paths array<struct<start:int, stop:int, cost:long, letters:binary>>"


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted rows, one row for each conversation and part with the lightest paths between states."""
    schema, out, held, walks = _arrow(_PLACED).append(pa.field("paths", _PATH)), [], None, []

    def ended() -> dict:
        paths = [{"start": q, "stop": s, "cost": c, "letters": x} for q, walk in enumerate(walks) for s, (c, x) in walk.result().items()]
        return held | {"paths": paths}

    for row in _rows(batches):
        initial = row["role"][:1]
        if held is None or (held["conv"], held["part"]) != (row["conv"], row["part"]):
            if held is not None:
                out.append(ended())
            held = {k: row[k] for k in ("conv", "part", "turn", "role", "digest")} | dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
            held |= {"first": initial, "last": None, "last_turn": None}
            walks = [_Walk(q) for q in _STATES]
        more = row["copies"] - 1
        if row["turn"] is not None and row["turn"] != held["last_turn"]:
            held["turns"] += 1
        held["last_turn"] = row["turn"]
        if row["fault"]:
            held[row["fault"]] += 1
        held["blank" if row["fault"] == "blank" else "duplicate"] += more
        held["illegal"] += more + (held["last"] is not None and held["last"] + initial not in _LEGAL)
        held["last"] = initial
        for walk in walks:
            walk.feed(initial, row["fault"], row["copies"])
        if len(out) >= 500:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if held is not None:
        out.append(ended())
    yield pa.RecordBatch.from_pylist(out, schema)


_REPAIR = "conv long, turn long, role string, digest binary, state int, letters binary, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _weight(cost: int, rank: int, letters: bytes, width: int) -> int:
    return (cost << 8 * (width + 1)) + (rank << 8 * width) + (int.from_bytes(letters, "big") << 8 * (width - len(letters)))


def _joined(fragments: list[dict]) -> list[dict]:
    """The fragments of a conversation with the edits of its lightest path; the last one carries what holds for all."""
    done, total, before = {0: (0, 0, None)}, dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0), None
    for i, part in enumerate(fragments):
        for k in total:
            total[k] += part[k]
        if before is not None:
            total["illegal"] += before["last"] + part["first"] not in _LEGAL
            total["turns"] -= part["turn"] is not None and part["turn"] == before["last_turn"]
        before = part
        width = max(len(p["letters"]) for p in part["paths"])
        found: dict[int, tuple] = {}
        for p in part["paths"]:
            if p["start"] in done:
                cost, rank, held = done[p["start"]]
                new = (_weight(cost + p["cost"], rank, p["letters"], width), cost + p["cost"], (held, i, p["start"], p["letters"]))
                if p["stop"] not in found or new[0] < found[p["stop"]][0]:
                    found[p["stop"]] = new
        low = (1 << 8 * (width + 1)) - 1
        order = sorted(found, key=lambda s: found[s][0] & low)
        done = {s: (found[s][1], rank, found[s][2]) for rank, s in enumerate(order)}
    # after the last row, rows are inserted until the roles may end
    ends = {0: 0, 1: 2, 2: 1, 3: 0}
    state = min(done, key=lambda s: _weight(done[s][0] + INSERT * ends[s], done[s][1], b"I" * ends[s], 2))
    cost, _, held = done[state]
    out = [{k: part[k] for k in ("conv", "turn", "role", "digest")} for part in fragments]
    while held is not None:
        held, i, start, letters = held
        out[i] |= {"state": start, "letters": letters}
    out[-1]["letters"] += b"I" * ends[state]
    least = next((x for part in fragments for x in (part["turn"], part["least"]) if x is not None), None)
    gaps = 0 if least is None else before["last_turn"] - least + 1 - total["turns"]
    audit = b"".join(x["letters"] for x in out).decode()
    return [*out[:-1], out[-1] | {k: total[k] for k in ("blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost + INSERT * ends[state], "audit": audit}]


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, out, held = _arrow(_REPAIR), [], []
    for row in _rows(batches):
        if held and held[0]["conv"] != row["conv"]:
            out += _joined(held)
            held = []
        held.append(row)
        if len(out) >= 500:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if held:
        out += _joined(held)
    yield pa.RecordBatch.from_pylist(out, schema)


def _ordered(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, *by)


def _named(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, digest) with nulls as one space."""
    space = F.lit(" ")
    whole = F.coalesce(F.col(text).cast("string"), space)
    named = rows.select(F.col(key).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"), whole.alias("text"))
    return named.withColumn("digest", F.unhex(F.sha2(F.encode("text", "utf-8"), 256)))


def _plan(named: DataFrame) -> DataFrame:
    """One row for each fragment with its letters; those that end a conversation carry its report."""
    last = F.regexp_extract("text", f"({_SPACES})[\\x20\\x09-\\x0D]*\\z", 1)
    flags = named.select("conv", "turn", "role", "digest", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    runs = flags.groupBy("conv", "turn", "role", "digest", "blank", "cut").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))).alias("first")
    firsts = runs.groupBy("conv", "role", "digest").agg(first).select(F.col("conv").alias("c"), F.col("first.turn").alias("t"), F.col("role").alias("r"), F.col("digest").alias("d"))
    same = F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    fault = F.when(F.col("blank"), "blank").when(F.col("d").isNull(), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    marked = runs.join(firsts, same, "left").select("conv", "turn", "role", "digest", "copies", fault.alias("fault"))
    order = ["turn", "role", "digest"]
    ranged = marked.repartitionByRange(shuffle_partitions(named.sparkSession), "conv", *order)
    parts = saved(ranged.withColumn("part", F.spark_partition_id()))
    fragments = _ordered(parts, ["conv", "part"], order).mapInArrow(_fragments, _FRAGMENT)
    # the first turn that is not null may stand behind rows without one
    least = parts.groupBy("conv", "part").agg(F.min("turn").alias("least")).select(F.col("conv").alias("c"), F.col("part").alias("p"), "least")
    fragments = fragments.join(least, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")
    return saved(_ordered(fragments, ["conv"], ["part"]).mapInArrow(_repairs, _REPAIR))


def _replayed(rows: Iterator[dict]) -> Iterator[tuple]:
    """(conv, turn, role, text, edit) of what a repair leaves, in order, from its letters and the texts behind them."""
    letters, letter, state, conv = iter(()), None, 0, None

    def inserted() -> Iterator[tuple]:
        nonlocal state, letter
        while (letter := next(letters, None)) == ord("I"):
            yield conv, None, _ROLE[state], "", "I"
            state = _NEXT[state]

    for row in rows:
        if row["letters"] is not None:
            yield from inserted()
            letters, state, conv = iter(row["letters"]), row["state"], row["conv"]
            continue
        yield from inserted()
        if letter == ord("K"):
            yield conv, row["turn"], row["role"], row["text"], "K"
            state = _KEPT[state, row["role"][:1]]
        elif letter == ord("R"):
            yield conv, row["turn"], _ROLE[state], row["text"], "R"
            state = _NEXT[state]
    yield from inserted()


def _to_replay(named: DataFrame, plan: DataFrame) -> DataFrame:
    """Letters and texts of each conversation together, letters in front of the texts they are for."""
    keys = ["conv", "turn", "role", "digest"]
    letters = plan.select(*keys, F.lit(None).cast("string").alias("text"), "state", "letters")
    texts = named.select(*keys, "text", F.lit(None).cast("int").alias("state"), F.lit(None).cast("binary").alias("letters"))
    both = letters.unionByName(texts).withColumn("behind", F.col("letters").isNull())
    return _ordered(both, ["conv"], ["turn", "role", "digest", "behind"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, hash) of every conversation that has rows left."""
    convs, found, own, digest = [], [], None, None
    for conv, _, role, text, _ in _replayed(_rows(batches)):
        if digest is None or conv != own:
            if digest is not None:
                convs.append(own)
                found.append(digest.hexdigest())
            own, digest = conv, hashlib.sha256()
        else:
            digest.update(b"\n")
        digest.update(f"{role}:{text}".encode())
    if digest is not None:
        convs.append(own)
        found.append(digest.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(found, pa.string())], ["conv", "hash"])


_LINE = "conv long, position long, turn long, role string, text string, edit string"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, out, own, at = _arrow(_LINE), [], (), 0
    for conv, turn, role, text, edit in _replayed(_rows(batches)):
        at = at + 1 if own == (conv,) else 1
        own = (conv,)
        out.append({"conv": conv, "position": at, "turn": turn, "role": role, "text": text, "edit": edit})
        if len(out) >= 500:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema)


def repaired(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position, turn, role, text, edit): the repaired conversations, row by row; inserted rows have no turn."""
    named = _named(rows, key, turn, role, text)
    out = _to_replay(named, _plan(named)).mapInArrow(_listed, _LINE)
    return out.withColumnRenamed("conv", "conv_id")


def report(rows: DataFrame, ids: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """For every id of `ids`: faults, cost, audit and the hash of the repaired conversation in `rows`."""
    named = _named(rows, key, turn, role, text)
    plan = _plan(named)
    hashes = _to_replay(named, plan).mapInArrow(_hashes, "conv long, hash string").select(F.col("conv").alias("h"), "hash")
    told = plan.where("audit is not null").drop("turn", "role", "digest", "state", "letters")
    wanted = ids.select(F.col(key).cast("long").alias("conv_id")).distinct()
    out = wanted.join(told, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("h")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("hash", empty).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32 of `conv_id:turn`, nulls as one space."""
    space = F.lit(" ")

    def spaced(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), space)

    code = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(spaced("role"))
    coded = rows.select("conv_id", "turn", "role", "text", code.alias("code")).where("code <> 0")
    copies = F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return coded.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


ORACLE = r"""
    with recursive numbered as (
        select row_number() over () as id, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
            coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
    coded as (
        select *, xor(list_reduce(list_transform(string_split(key, ''), lambda c: ord(c)::bigint), lambda acc, b:
            list_reduce(range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(acc, b)), 4294967295), 4294967295) % 20 as code
        from numbered),
    damaged as (
        select conv_id, turn, case when code = 4 then 'user' else role end as role,
            case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
        from coded, unnest(case when code = 3 then [1, 2] else [1] end) where code <> 0),
    placed as (
        select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as i,
            regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as final from damaged),
    faulty as (
        select *, left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by i) as before,
            case when final = '' then 'blank'
                when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
                when final not in ('.', '!', '?') then 'truncated' else '' end as fault from placed),
    told as (
        select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
            count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
            count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, count(*) as n
        from faulty group by conv_id),
    inserts(state, letters, cost, mid) as (values (0, '', 0, 0), (0, 'I', 5, 2), (0, 'II', 10, 3), (1, '', 0, 1), (1, 'I', 5, 2), (1, 'II', 10, 3),
        (2, '', 0, 2), (2, 'I', 5, 3), (2, 'II', 10, 2), (3, '', 0, 3), (3, 'I', 5, 2), (3, 'II', 10, 3)),
    kept(mid, initial, state) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
    edits as (
        select f.conv_id, f.i, s.state as mid, s.state, 'D' as letter, 2 as cost from faulty f, (values (0), (1), (2), (3)) s(state)
        union all select f.conv_id, f.i, s.mid, s.state, 'R', 1 + case fault when 'truncated' then 5 else 0 end
            from faulty f, (values (0, 2), (1, 2), (2, 3), (3, 2)) s(mid, state) where fault not in ('blank', 'duplicate')
        union all select f.conv_id, f.i, k.mid, k.state, 'K', case fault when 'truncated' then 5 else 0 end
            from faulty f join kept k using (initial) where fault not in ('blank', 'duplicate')),
    walked as (
        select conv_id, 0::bigint as i, 0 as state, 0 as cost, '' as audit from told
        union all
        select conv_id, i, state, best.cost, best.audit from (
            select w.conv_id, e.i, e.state, min({'cost': w.cost + n.cost + e.cost, 'audit': w.audit || n.letters || e.letter}) as best
            from walked w join inserts n on n.state = w.state join edits e on e.conv_id is not distinct from w.conv_id and e.i = w.i + 1 and e.mid = n.mid
            group by all)),
    ended as (
        select w.conv_id, min({'cost': w.cost + n.cost, 'audit': w.audit || n.letters}) as best
        from walked w join told t on t.conv_id is not distinct from w.conv_id and t.n = w.i join inserts n on n.state = w.state
        where n.mid in (0, 3) group by w.conv_id),
    letters as (
        select conv_id, best.audit as audit, p, best.audit[p] as letter,
            length(replace(best.audit, 'D', '')) as size,
            length(replace(best.audit[1:p], 'I', '')) as i, length(replace(best.audit[1:p], 'D', '')) as place
        from ended, unnest(range(1, length(best.audit) + 1)) as t(p)),
    lines as (
        select l.conv_id, l.place,
            case when letter = 'K' then f.role when (place + size) % 2 = 1 then 'user' else 'assistant' end
                || ':' || case when letter = 'I' then '' else f.text end as line
        from letters l left join faulty f on f.conv_id is not distinct from l.conv_id and f.i = l.i where letter <> 'D'),
    hashed as (select conv_id, sha256(string_agg(line, chr(10) order by place)) as hash from lines group by conv_id),
    ids as (select distinct conv_id from conversations)
    select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
        coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.cost, 0)::bigint as cost,
        coalesce(best.audit, '') as audit, coalesce(hash, sha256('')) as repaired_sha256
    from ids left join told on told.conv_id is not distinct from ids.conv_id
    left join ended on ended.conv_id is not distinct from ids.conv_id
    left join hashed on hashed.conv_id is not distinct from ids.conv_id"""
