"""XML documents held as lines, flattened to one row per element by matching brackets over chunks of lines.

A document is cut into chunks of `CHUNK_LINES` lines, so a long one is spread over tasks; a tag that runs over a border
stays in the chunk where it starts. Three steps:

1. each chunk matches what opens and closes within it and leaves what it cannot decide: closing tags without an opening
   one, elements left open, and how many children of each tag stand between them;
2. what the chunks of a document left is joined in order, which gives each chunk the elements open at its start;
3. each chunk is read again with those and yields its elements. Only elements that are open over a chunk border are
   put together afterwards, from one row for each chunk: their texts and the texts collected from their children.

Reading is tolerant. A closing tag closes the nearest open element of its name and all within it; without such an
element it is ignored. Attribute values may lack quotes, an ampersand may stand alone, a stray `<` is text. What
follows the root is ignored, what is left open at the end is closed there. `xml_status` counts all that per document.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.operators.ordered import CHUNK_LINES, settle

KEYS = ("file_id", "entry_ord", "path")
NODE_COLUMNS = (
    "file_id string, path string, entry_ord long, node_id long, parent_id long, depth int, ord long, tags array<string>, "
    "ids array<long>, tag string, nth int, parent_nth int, attrs map<string,string>, name string, text string, "
    "collected string, has_elements boolean, parent_has_elements boolean"
)
BATCH_ROWS = 4096
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<raw>.*?)(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<![^>]*>?|</\s*(?P<end>[^\s<>/]+)[^<>]*>?"""
    r"""|<(?P<start>[A-Za-z_:][^\s<>/="']*)(?P<attrs>(?:[^<>"']|"[^"<]*"|'[^'<]*')*?)(?P<closed>/?)>|(?P<text><?[^<]*)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=<>"'/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s<>"']+))""")
_ENTITY = re.compile(r"&(?:(amp|lt|gt|quot|apos)|#(\d+)|#[xX]([0-9a-fA-F]+));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_EVENT = tuple[str, str, dict[str, str]]


def _plain(text: str) -> str:
    """Entities replaced; what is none stays as it is."""

    def value(found: re.Match) -> str:
        if found[1]:
            return _NAMED[found[1]]
        code = int(found[2]) if found[2] else int(found[3], 16)
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else found[0]

    return _ENTITY.sub(value, text) if "&" in text else text


def _local(name: str) -> str:
    return name.rsplit(":", 1)[-1]


def events(text: str) -> Iterator[_EVENT]:
    """(kind, tag or text, attributes) in order; kind is start, end or text."""
    for found in _TOKEN.finditer(text):
        kind = found.lastgroup
        if found["start"] is not None:
            attrs = {_local(a[0]): _plain(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(found["attrs"])}
            yield "start", _local(found["start"]), attrs
            if found["closed"]:
                yield "end", _local(found["start"]), {}
        elif kind == "end":
            yield "end", _local(found["end"]), {}
        elif kind in ("raw", "text"):
            for line in found[kind].split("\n"):
                piece = (line if kind == "raw" else _plain(line)).strip()
                if piece:
                    yield "text", piece, {}


def _chunked(lines: DataFrame, chunk_lines: int) -> DataFrame:
    """(keys, chunk, lead, line_no, text): `lead` opens the comment or section in which a chunk starts.

    Each chunk tells the last mark it holds; those of the chunks before it say where a chunk starts. If that is within
    a tag, its lines up to the one that ends the tag go to the chunk that has the start.
    """
    rows = lines.select(*KEYS, F.col("line_no").cast("long").alias("line_no"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("chunk", F.floor(F.col("line_no") / chunk_lines))
    # anchored: a text without a mark would be gone through again from each of its characters
    mark = F.regexp_extract("text", r"(?s)\A.*(<!--|-->|<!\[CDATA\[|\]\]>)", 1)
    bracket = F.regexp_extract(F.regexp_replace("text", r"(?s)<!--.*?(-->|\z)|<!\[CDATA\[.*?(\]\]>|\z)", ""), r"(?s)\A.*([<>])", 1)
    lasts = [F.max_by(c, F.when(c != "", F.col("line_no"))).alias(n) for n, c in (("mark", mark), ("bracket", bracket))]
    ends = rows.groupBy(*KEYS, "chunk").agg(*lasts, F.min(F.when(F.contains("text", F.lit(">")), F.col("line_no"))).alias("tag_end"))
    by_chunk = Window.partitionBy(*KEYS).orderBy("chunk")
    above = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    within, cut = F.last("mark", ignorenulls=True).over(above), F.last("bracket", ignorenulls=True).over(above) == "<"
    starts = ends.select(*KEYS, "chunk", "tag_end", F.when(within.isin("<!--", "<![CDATA["), within).alias("lead"), cut.alias("cut"), F.last(F.when(F.col("bracket").isNotNull(), F.col("chunk")), ignorenulls=True).over(above).alias("before"))
    held = rows.join(starts, [*KEYS, "chunk"])
    moved = F.col("lead").isNull() & F.col("cut") & (F.coalesce("tag_end", "line_no") >= F.col("line_no"))
    return held.select(*KEYS, F.when(moved, F.col("before")).otherwise(F.col("chunk")).alias("chunk"), "lead", "line_no", "text")


def _unfinished(text: str) -> bool:
    """Whether a tag, a comment or a section goes on after the text."""
    if "<!--" not in text and "<![CDATA[" not in text:
        return text.rfind("<") > text.rfind(">")
    token = ""
    for found in _TOKEN.finditer(text):
        token = found[0] or token
    if token.startswith(("<!--", "<![CDATA[")):
        return not token.endswith("-->" if token.startswith("<!--") else "]]>")
    return "<" in token and ">" not in token


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[bool, str]]]]:
    """For each chunk its key and what it holds: (is a note, note or lines that belong together)."""

    def flat() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in (*KEYS, "chunk", "note", "lead", "text")), strict=True)

    for key, rows in groupby(flat(), key=lambda row: row[:4]):

        def held(rows=rows) -> Iterator[tuple[bool, str]]:
            waiting, first = [], True
            for *_, note, lead, text in rows:
                if note:
                    yield True, text
                    continue
                waiting.append(lead + text if first and lead else text)
                first = False
                if len(waiting) == 1 or ">" in text:
                    joined = "\n".join(waiting)
                    if not _unfinished(joined):
                        yield False, joined
                        waiting = []
            if waiting:
                yield False, "\n".join(waiting)

        yield key, held()


def _left(texts: Iterator[str]) -> tuple[list, int]:
    """What a chunk cannot decide alone, in order, and how many elements start in it.

    Items are ["open", tag, number], ["close", tag] and ["kids", {tag: count}], the last for what is between them.
    """
    items: list = []
    frames: list[tuple[str, int, Counter]] = []
    base: Counter = Counter()
    count = 0

    def flush() -> None:
        nonlocal base
        if base:
            items.append(["kids", dict(base)])
        for tag, number, kids in frames:
            items.append(["open", tag, number])
            if kids:
                items.append(["kids", dict(kids)])
        base = Counter()
        frames.clear()

    for text in texts:
        for kind, tag, _ in events(text):
            if kind == "start":
                frames.append((tag, count, Counter()))
                count += 1
            elif kind == "end":
                at = next((i for i in range(len(frames) - 1, -1, -1) if frames[i][0] == tag), None)
                if at is None:
                    flush()
                    items.append(["close", tag])
                else:
                    del frames[at + 1 :]
                    frames.pop()
                    (frames[-1][2] if frames else base)[tag] += 1
    flush()
    return items, count


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, held in _groups(batches):
        items, count = _left(text for _, text in held)
        yield from _batches([(*key, json.dumps([items, count]))], _SUMMARY)


class _Open:
    """An element open at a chunk's border."""

    def __init__(self, number: int, tag: str, nth: int):
        self.number, self.tag, self.nth, self.seen = number, tag, nth, Counter()

    def inner(self) -> bool:
        return any(tag != "member" for tag in self.seen)


def _entered(chunks: list[tuple[int, list, int]]) -> tuple[list[dict], dict]:
    """For each chunk of a document the elements open at its start, and the document's status."""
    stack: list[_Open] = []
    notes, offset, ended, ignored = [], 0, False, 0
    for chunk, items, count in chunks:
        entry = [(e, e.number, e.tag, e.nth, dict(e.seen)) for e in stack]
        left_open = []
        note = {"chunk": chunk, "offset": offset, "ended": ended, "last": False}
        for item in items:
            if ended:
                break
            if item[0] == "open":
                nth = stack[-1].seen[item[1]] if stack else 0
                if stack:
                    stack[-1].seen[item[1]] += 1
                stack.append(_Open(offset + item[2], item[1], nth))
                left_open.append(stack[-1])
            elif item[0] == "kids":
                if stack:
                    stack[-1].seen.update(item[1])
                else:
                    ended = True  # the root opened and closed within this chunk
            else:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == item[1]), None)
                if at is None:
                    ignored += 1
                else:
                    del stack[at:]
                    ended = not stack
        notes.append((note, entry, left_open))
        offset += count
    notes[-1][0]["last"] = True
    out = []
    for note, entry, left_open in notes:
        held = [{"id": number, "tag": tag, "nth": nth, "seen": seen, "inner": e.inner()} for e, number, tag, nth, seen in entry]
        out.append(note | {"stack": held, "inner": {str(e.number): e.inner() for e in left_open}})
    return out, {"starts": offset, "unclosed": len(stack), "ignored_ends": ignored}


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each chunk with what is open at its start, and one for the document with its status."""
    held, own = [], None

    def ended() -> pd.DataFrame:
        notes, status = _entered(held)
        rows = [(*own, note["chunk"], json.dumps(note)) for note in notes]
        return pd.DataFrame([*rows, (*own, None, json.dumps(status))], columns=[*KEYS, "chunk", "text"]).astype({"chunk": "Int64"})

    for batch in batches:
        for *key, chunk, text in zip(*(batch[c] for c in (*KEYS, "chunk", "text")), strict=True):
            if key != own:
                if own is not None:
                    yield ended()
                held, own = [], key
            held.append((int(chunk), *json.loads(text)))
    if own is not None:
        yield ended()


class _Element:
    """An open element: its own fields and what its closed children left behind in this chunk."""

    __slots__ = ("attrs", "depth", "ids", "inner", "kept", "members", "named", "nested", "node_id", "nth", "pieces", "rows", "seen", "spans", "tag", "tags")

    def __init__(self, tag: str, node_id: int, parent: _Element | None, attrs: dict[str, str], nth: int):
        self.tag, self.attrs, self.node_id, self.nth = tag, attrs, node_id, nth
        self.depth = parent.depth + 1 if parent else 0
        self.tags = [*parent.tags, tag] if parent else [tag]
        self.ids = [*parent.ids, node_id] if parent else [node_id]
        self.pieces, self.members, self.named, self.nested, self.rows = [], [], [], [], []
        self.seen: dict[str, int] = {}
        self.inner, self.spans, self.kept = None, False, True


def _collected(members: str | None, named: str | None, text: str, nested: str) -> str:
    """Members, else entry names, else own text, else what the children collect."""
    return members if members is not None else named if named is not None else text or nested


_SUMMARY = "file_id string, entry_ord long, path string, chunk long, text string"
_PART = f"kind string, closes boolean, chunk long, has_members boolean, has_named boolean, members string, named string, nested string, {NODE_COLUMNS}"
_NAMES = [c.strip().split(" ")[0] for c in re.sub(r"<[^>]*>", "", _PART).split(",")]


_ARROW = {
    "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()),
    "array<long>": pa.list_(pa.int64()), "map<string,string>": pa.map_(pa.string(), pa.string()),
}


def _batches(rows: list[tuple], columns: str) -> Iterator[pa.RecordBatch]:
    """The rows as Arrow data; lists and maps go there without pandas, which takes far longer for them."""
    fields = [(name, _ARROW[kind]) for name, kind in (c.split(" ") for c in columns.split(", "))]
    for at in range(0, len(rows), BATCH_ROWS):
        values = zip(*rows[at : at + BATCH_ROWS], strict=True)
        arrays = [pa.array([v and list(v.items()) for v in x] if pa.types.is_map(t) else x, t) for x, (_, t) in zip(values, fields, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    for c in ("chunk", "parent_id", "node_id", "ord", "depth", "nth", "parent_nth"):
        if c in names:
            frame[c] = frame[c].astype("Int64")
    for c in ("has_elements", "parent_has_elements", "closes", "has_members", "has_named"):
        if c in names:
            frame[c] = frame[c].astype("boolean")
    return frame


class _Chunk:
    """Reads one chunk with the elements open at its start; rows are elements closed here, and parts of the others."""

    def __init__(self, key: tuple, note: dict):
        self.file, self.entry, self.path, self.chunk = key
        self.note, self.rows, self.stack, self.count, self.ended = note, [], [], note["offset"], note["ended"]
        for held in note["stack"]:
            element = _Element(held["tag"], held["id"], self.stack[-1] if self.stack else None, {}, held["nth"])
            element.seen, element.inner, element.spans, element.kept = dict(held["seen"]), held["inner"], True, False
            self.stack.append(element)

    def feed(self, text: str) -> None:
        for kind, value, attrs in events(text):
            if self.ended:
                return
            if kind == "text":
                if self.stack:
                    self.stack[-1].pieces.append(value)
            elif kind == "start":
                self.start(value, attrs)
            else:
                at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag == value), None)
                while at is not None and len(self.stack) > at:
                    self.close()

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        parent = self.stack[-1] if self.stack else None
        nth = parent.seen.get(tag, 0) if parent else 0
        if parent:
            parent.seen[tag] = nth + 1
        element = _Element(tag, self.count, parent, attrs, nth)
        inner = self.note["inner"].get(str(self.count))
        if inner is not None:  # left open by this chunk as far as it can tell alone
            element.inner = inner
        self.stack.append(element)
        self.count += 1

    def fields(self, e: _Element, parent: _Element | None, collected: str | None, inner: bool) -> tuple:
        return (
            self.file, self.path, self.entry, e.node_id, parent.node_id if parent else None, e.depth, e.node_id, e.tags, e.ids, e.tag, e.nth,
            parent.nth if parent else 0, e.attrs, e.attrs.get("name"), " ".join(e.pieces), collected, inner,
        )

    def part(self, e: _Element, parent: _Element | None, closes: bool) -> None:
        """What this chunk knows of an element that is open over its border."""
        members, named, nested = ", ".join(e.members), ", ".join(e.named), ", ".join(t for t in e.nested if t)
        own = self.fields(e, parent, None, bool(e.inner))
        above = True if parent is None else bool(parent.inner)
        self.rows.append(("opens" if e.kept else "goes on", closes, self.chunk, bool(e.members), bool(e.named), members, named, nested, *own, above))

    def close(self) -> None:
        e = self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        inner = e.inner if e.inner is not None else any(tag != "member" for tag in e.seen)
        self.rows += [(*row, inner) for row in e.rows]
        if e.spans:
            self.part(e, parent, True)
        else:
            text = " ".join(e.pieces)
            collected = _collected(", ".join(e.members) if e.members else None, ", ".join(e.named) if e.named else None, text, ", ".join(t for t in e.nested if t))
            row = ("whole", True, self.chunk, False, False, "", "", "", *self.fields(e, parent, collected, inner))
            if parent is None:
                self.rows.append((*row, True))
            else:
                parent.rows.append(row)
                if e.tag == "member":
                    parent.members.append(text)
                elif e.tag == "entry":
                    parent.named.append(e.attrs.get("name", collected))
                parent.nested.append(collected)
        self.ended = not self.stack

    def finish(self) -> None:
        while self.note["last"] and self.stack and not self.stack[-1].spans:
            self.close()
        for i in range(len(self.stack) - 1, -1, -1):
            e = self.stack[i]
            self.rows += [(*row, bool(e.inner)) for row in e.rows]
            self.part(e, self.stack[i - 1] if i else None, False)
            e.rows = []

    def taken(self) -> list[tuple]:
        """Rows that are ready; children of an element of which all is known need not wait for its end."""
        for e in self.stack:
            if e.inner is not None:
                self.rows += [(*row, e.inner) for row in e.rows]
                e.rows = []
        rows, self.rows = self.rows, []
        return rows


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, held in _groups(batches):
        chunk = None
        for is_note, text in held:
            if is_note:
                chunk = _Chunk(key, json.loads(text))
                continue
            chunk.feed(text)
            if len(chunk.rows) >= BATCH_ROWS:
                yield from _batches(chunk.taken(), _PART)
        if chunk is not None:
            chunk.finish()
            yield from _batches(chunk.taken(), _PART)


class _Joined:
    """An element put together from its parts."""

    def __init__(self, row: dict):
        self.row, self.text, self.members, self.named, self.nested = row, [], [], [], []

    def add(self, row: dict) -> None:
        for found, value in ((self.text, row["text"]), (self.nested, row["nested"])):
            if value:
                found.append(value)
        if row["has_members"]:
            self.members.append(row["members"])
        if row["has_named"]:
            self.named.append(row["named"])

    def closed(self, parent: _Joined | None) -> dict:
        text = " ".join(self.text)
        collected = _collected(", ".join(self.members) if self.members else None, ", ".join(self.named) if self.named else None, text, ", ".join(self.nested))
        if parent:
            if self.row["tag"] == "member":
                parent.members.append(text)
            elif self.row["tag"] == "entry":
                parent.named.append(collected if self.row["name"] is None else self.row["name"])
            if collected:
                parent.nested.append(collected)
        return self.row | {"text": text, "collected": collected}


def _spanning(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Elements over chunk borders, from their parts in order of chunk; in each what closes comes first, innermost first."""
    names = _NAMES[8:]
    stack: list[_Joined] = []
    own, out = None, []

    def close() -> None:
        e = stack.pop()
        out.append(e.closed(stack[-1] if stack else None))

    for batch in batches:
        for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
            key = tuple(row[c] for c in KEYS)
            if key != own:
                while stack:
                    close()
                own = key
            if row["kind"] == "opens":
                # outer ones come later among the parts of a chunk
                at = next((i for i, e in enumerate(stack) if e.row["depth"] > row["depth"]), len(stack))
                stack.insert(at, _Joined({c: row[c] for c in names}))
            element = next(e for e in reversed(stack) if e.row["node_id"] == row["node_id"])
            element.add(row)
            if row["closes"]:
                while stack[-1] is not element:
                    close()
                close()
        if len(out) >= BATCH_ROWS:
            yield _frame([tuple(r[c] for c in names) for r in out], names)
            out = []
    while stack:
        close()
    yield _frame([tuple(r[c] for c in names) for r in out], names)


def _dealt(rows: DataFrame, keys: tuple[str, ...], *order: str | Column) -> DataFrame:
    # a number of partitions, lest adaptive execution takes few bytes for little work
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order)


def _read(lines: DataFrame, chunk_lines: int) -> tuple[DataFrame, DataFrame]:
    """The lines with their chunks, and the notes of step 2 (chunk is null for a document's status)."""
    rows = settle(_chunked(lines, chunk_lines))
    dealt = _dealt(rows.withColumn("note", F.lit(False)), (*KEYS, "chunk"), "line_no")
    left = dealt.mapInArrow(_summaries, _SUMMARY)
    return rows, settle(_dealt(left, KEYS, "chunk").mapInPandas(_documents, _SUMMARY))


def xml_nodes(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Elements of every document (file_id, entry_ord, path) in `lines`."""
    rows, notes = _read(lines, chunk_lines)
    told = notes.where("chunk is not null").select(*KEYS, "chunk", F.lit(None).cast("string").alias("lead"), F.lit(None).cast("long").alias("line_no"), "text", F.lit(True).alias("note"))
    both = told.unionByName(rows.withColumn("entry_ord", F.col("entry_ord").cast("long")).withColumn("note", F.lit(False)))
    found = settle(_dealt(both, (*KEYS, "chunk"), F.col("note").desc(), "line_no").mapInArrow(_elements, _PART))
    names = _NAMES[8:]
    parts = _dealt(found.where("kind <> 'whole'"), KEYS, "chunk", F.col("closes").desc(), F.col("depth").desc())
    return found.where("kind = 'whole'").select(*names).unionByName(parts.mapInPandas(_spanning, NODE_COLUMNS).select(*names))


def xml_status(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """(file_id, entry_ord, path, starts, unclosed, ignored_ends): one row for each document.

    `starts` counts opening tags, `unclosed` the elements that the end of the lines closed, `ignored_ends` the closing
    tags without an open element.
    """
    told = _read(lines, chunk_lines)[1].where("chunk is null")
    fields = F.from_json("text", "starts long, unclosed long, ignored_ends long")
    return told.select(*KEYS, fields.alias("s")).select(*KEYS, "s.*")
