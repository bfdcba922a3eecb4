"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

A text is cut into paragraphs at line ends, a paragraph into pieces where its content says so (about
`PIECE` bytes each), and consecutive paragraphs form a section that ends where a paragraph's digest says
so. All cuts follow the content, so an edit changes only the branches above it. A paragraph's digest covers
its bytes, a section's the digests of its paragraphs, the root those of the sections.

A fingerprint is the tree as text: root, then `/section` followed by `.paragraph` followed by its piece
digests. Equal roots mean equal texts; `differing` walks down only into branches that differ.

Defined results: a null text counts as empty; an empty text has a root and no section; two empty texts are
alike by 1, an empty and a non-empty one by 0; rows that repeat or share an id follow each other in the
order (doc_id, text); a null id comes first; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from logquarry.llm.common import pieces_of, shuffle_partitions

#: A piece ends where the top bits of a hash of the last eight bytes are zero: 32 bytes on average.
PIECE_BITS = 5
#: No piece crosses a multiple of this offset, which bounds the memory a long text needs.
BLOCK = 1 << 20
#: Rows of one range of ids.
RANGE_ROWS = 20_000
#: Bounds looked through at a time when an id's range is sought.
STEP = 64
ROOT_HEX, NODE_HEX, PIECE_HEX = 32, 8, 6

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_UNBASE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, BLOCK + 1), _powers(_UNBASE, BLOCK + 1)


def _block_pieces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and 24-bit digests of the pieces of one block; `starts` are offsets where a piece must begin."""
    n = len(data)
    wide = data.astype(np.uint64)
    for shift in (1, 2, 4):
        wide[shift:] |= wide[:-shift] << np.uint64(8 * shift)
    cut = (wide * _MIX) >> np.uint64(64 - PIECE_BITS) == 0
    # cuts look at bytes of their own paragraph only, whatever lies in front of it
    for i in range(7):
        cut[starts[starts + i < n] + i] = False
    cut[n - 1] = True
    cut[starts[starts > 0] - 1] = True
    ends = np.flatnonzero(cut) + 1
    begins = np.concatenate(([0], ends[:-1]))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _UP[:n], dtype=np.uint64)))
    digest = (sums[ends] - sums[begins]) * _DOWN[begins] + (ends - begins).astype(np.uint64)
    digest = (digest ^ (digest >> np.uint64(29))) * _MIX
    return ends, digest >> np.uint64(40)


def _node(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=NODE_HEX // 2).digest()


def _tree(text: bytes, ends: np.ndarray, digests: list[str]) -> tuple[str, list[str]]:
    """Fingerprint of one text from the ends and digests of its pieces, and the piece digests."""
    if not text:
        return hashlib.blake2b(b"", digest_size=ROOT_HEX // 2).hexdigest(), []
    out, sections, held, parts = [], [], [], []
    at = piece = 0
    while at < len(text):
        stop = text.find(b"\n", at) + 1 or len(text)
        after = int(np.searchsorted(ends, stop, "right"))
        full = hashlib.blake2b(text[at:stop], digest_size=ROOT_HEX // 2).digest()
        held.append(full)
        parts.append("." + full[: NODE_HEX // 2].hex() + "".join(digests[piece:after]))
        at, piece = stop, after
        if full[0] < 64 or at == len(text):
            section = hashlib.blake2b(b"".join(held), digest_size=ROOT_HEX // 2).digest()
            sections.append(section)
            out.append("/" + section[: NODE_HEX // 2].hex() + "".join(parts))
            held, parts = [], []
    return hashlib.blake2b(b"".join(sections), digest_size=ROOT_HEX // 2).hexdigest() + "".join(out), digests


def trees(texts: list[bytes]) -> list[tuple[str, list[str]]]:
    """(fingerprint, piece digests) of each text."""
    out = []
    for a, b in pieces_of(texts, BLOCK):
        lengths = np.array([len(t) for t in texts[a:b]], np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        starts = np.concatenate((offsets[:-1], np.flatnonzero(data == 10) + 1))
        ends, digests = [], []
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            found, hashes = _block_pieces(block, starts[(starts >= at) & (starts < at + len(block))] - at)
            ends.append(found + at)
            digests.append(hashes)
        ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        names = [f"{x:0{PIECE_HEX}x}" for x in np.concatenate(digests).tolist()] if digests else []
        marks = np.searchsorted(ends, offsets, "right")
        for i, text in enumerate(texts[a:b]):
            own = slice(int(marks[i]), int(marks[i + 1]))
            out.append(_tree(text, ends[own] - offsets[i], names[own]))
    return out


def fingerprint(text: str | None) -> str:
    return trees([(text or "").encode()])[0][0]


def _alike(a: tuple[str, list[str]], b: tuple[str, list[str]]) -> float:
    if a[0][:ROOT_HEX] == b[0][:ROOT_HEX]:
        return 1.0
    total = len(a[1]) + len(b[1])
    return 2 * (Counter(a[1]) & Counter(b[1])).total() / total if total else 0.0


def _parsed(fingerprint: str) -> list[tuple[str, list[tuple[str, list[str]]]]]:
    return [
        (section[:NODE_HEX], [(p[:NODE_HEX], [p[i : i + PIECE_HEX] for i in range(NODE_HEX, len(p), PIECE_HEX)]) for p in section[NODE_HEX + 1 :].split(".")])
        for section in fingerprint[ROOT_HEX:].split("/")[1:]
    ]


def likeness(a: str, b: str) -> float:
    """Share of pieces that two fingerprints have in common, 0 to 1; 1 for equal roots."""
    flat = lambda f: (f, [x for _, paragraphs in _parsed(f) for _, pieces in paragraphs for x in pieces])
    return _alike(flat(a), flat(b))


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) positions of `a` that `b` does not have; equal branches are not entered."""
    if a[:ROOT_HEX] == b[:ROOT_HEX]:
        return []
    other = _parsed(b)
    sections = {name for name, _ in other}
    paragraphs = {name for _, inner in other for name, _ in inner}
    return [(i, j) for i, (name, inner) in enumerate(_parsed(a)) if name not in sections for j, (p, _) in enumerate(inner) if p not in paragraphs]


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` with `fingerprint`; one narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = trees([(t or "").encode() for t in batch.column(text).to_pylist()])
            columns = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "fingerprint"]
            names = [n for n in batch.schema.names if n != "fingerprint"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f for f, _ in found], pa.string())], [*names, "fingerprint"])

    kept = [f for f in docs.schema.fields if f.name != "fingerprint"]
    return docs.mapInArrow(run, StructType([*kept, StructField("fingerprint", StringType())]))


def _range_of(key: Column, bounds: list[float]) -> Column:
    """How many bounds are at or below the key, sought in two steps; null keys come first."""
    if not bounds:
        return F.lit(0)
    coarse = F.array(*[F.lit(float(x)) for x in bounds[STEP - 1 :: STEP]]) if len(bounds) >= STEP else F.array().cast("array<double>")
    block = F.size(F.filter(coarse, lambda x: x <= key)) * STEP
    fine = F.slice(F.array(*[F.lit(float(x)) for x in bounds]), block + 1, STEP)
    return F.coalesce(F.when(key.isNotNull(), block + F.size(F.filter(fine, lambda x: x <= key))), F.lit(0))


EDIT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, each range followed by a copy of the row after it."""
    pending = None  # (range, id, text, tree) of the last row seen

    for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
        rows = list(zip(batch.column("range").to_pylist(), batch.column("after").to_pylist(), batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()], strict=True))
        own = trees([t.encode() for *_, t in rows])
        todo = []
        for (part, after, doc_id, text), tree in zip(rows, own, strict=True):
            if pending is not None and pending[0] == part:
                todo.append((*pending, text, tree))
                pending = None
            if not after:
                pending = (part, doc_id, text, tree)
        if not todo:
            continue
        changed = []
        for _, _, text, _, following, _ in todo:
            k = len(text) // 4
            changed.append((text[: len(text) - k] + following[:k]).encode())
        edited = trees(changed)
        columns = (
            [x[1] for x in todo],
            [len(x[2]) for x in todo],
            [hashlib.sha256(x).hexdigest() for x in changed],
            [x[3][0] for x in todo],
            [x[0] for x in edited],
            [_alike(x[3], e) for x, e in zip(todo, edited, strict=True)],
            [_alike(x[3], x[5]) for x in todo],
        )
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))


def edit_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text whose end is replaced by the start of the next one.

    Rows are dealt out once, by ranges of ids; each range also gets a copy of the first row of the range after
    it, found by an aggregate with one row per range. Texts stream through a range in order, one pending at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranges = max(shuffle_partitions(spark), math.ceil(rows.count() / RANGE_ROWS))
    bounds = sorted(set(rows.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges)))
    ranged = rows.withColumn("range", _range_of(F.col("doc_id").cast("double"), bounds).cast("int"))
    heads = sorted((r.range, r.least) for r in ranged.groupBy("range").agg(F.min("doc_id").alias("least"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).select("range", F.when(F.col("nulls") == 0, F.col("least")).alias("least")).collect())
    before = [(heads[i - 1][0], least) for i, (_, least) in enumerate(heads)]
    copied = spark.createDataFrame(before, "to int, first long")
    after = rows.join(F.broadcast(copied), F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", F.col("to").alias("range"), F.lit(True).alias("after"))
    dealt = ranged.select("doc_id", "text", "range", F.lit(False).alias("after")).unionByName(after)
    ordered = dealt.repartition(ranges, "range").sortWithinPartitions("range", "after", "doc_id", "text")
    return ordered.mapInArrow(_edited, EDIT_SCHEMA)
