"""Removal of repeated byte strings, found by sampled strings and hashes of the stretches between them, one bucket at a time.

A byte goes if a string of `LENGTH` bytes covers it that also starts earlier: in a smaller doc_id, or earlier
in the same document. So every suffix has to be compared with all others to a depth of `LENGTH` bytes. Doing
that for all of them at once would move many times the text, so suffixes are compared through a cover:

1. Each window of `LENGTH` bytes samples the one of its `SAMPLE`-byte strings with the smallest hash. Equal
   windows sample the same string, so windows can only be equal within a bucket of one sample. Neighbouring
   windows mostly share their sample; a stretch of them is named by a hash of all bytes it touches.
2. A bucket at a time is sorted by sample, name and place. Stretches that have the name of an earlier one are
   repeats from end to end: the name of the stretch resolves these long ties without reading any text. A
   sample with one name only, and no repeat within it, has no repeated window.
3. What is left, the stretches whose sample has other names too (the edges of repeats, mostly), is resolved
   window by window: their windows' hashes are dealt out and sorted, again a bucket at a time.

The cover is chosen by content. A difference cover, chosen by position, has the same guarantee for any two
equal windows, but needs about three times as many samples; README has the figures.

Tasks drop what they can decide themselves (a stretch seen before within the task is a repeat for certain)
before anything is dealt out, so a passage that all documents share arrives once from each task. Texts travel
compressed, and only to meet their own marks. Memory is bounded by `HELD` rows, by texts cut at `PIECE`
bytes, and by buckets whose number follows the bytes of the table.

Equality of stretches is that of a 64-bit sample hash and a 48-bit name, of windows that of 96 bits.

Defined results: a null text counts as empty; texts shorter than `LENGTH` bytes lose nothing; rows that share
an id are versions of one document, each judged against earlier starts in any of them, so repeated rows have
equal results; a null id is smaller than all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import as_bytes, saved, shuffle_partitions

LENGTH, SAMPLE = 100, 40
WINDOW = LENGTH - SAMPLE + 1
#: Window starts of one piece of a text.
PIECE = 1 << 20
#: Rows a task holds before it sorts and sends them.
HELD = 1 << 20
#: Text bytes a task holds before it sends them, and bytes of text for each part.
HELD_BYTES, PART_BYTES = 24 << 20, 48 << 20
#: Kinds of rows that meet in a part, in the order in which they are read.
RUN, ASK, MARK, TEXT = 0, 1, 2, 3
#: The id that stands for null.
NO_ID = -(1 << 63)

SCHEMA = "part int, kind int, payload binary"
_BASE = 0xD6E8FEB86659FD93
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLES = np.random.default_rng(11).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _up_down(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _powers[name] = np.cumprod(out, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _sums(data: np.ndarray, table: int) -> np.ndarray:
    up, _ = _up_down(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLES[table][data] * up[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def _strings(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the strings [start, stop)."""
    _, down = _up_down(len(sums))
    return _mixed((sums[stop] - sums[start]) * down[start])


def sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return op(x[:-rest], x[rest:]) if rest else x


def stretches(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one sample, in pieces of text [edges[i], edges[i + 1]) that lie side by side.

    (first start, last start, sample, name, whether a window may repeat within the stretch).
    """
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    sums = _sums(data, 0)
    _, down = _up_down(len(data) + 1)
    h = _mixed((sums[SAMPLE:] - sums[:-SAMPLE]) * down[: len(data) - SAMPLE + 1])
    least = sliding(np.minimum, h, WINDOW)
    step = np.zeros(len(data) + 1, np.int32)
    inner = edges[1:-1]
    np.add.at(step, np.maximum(inner - LENGTH + 1, 0), 1)
    np.add.at(step, inner, -1)
    valid = np.cumsum(step[:n]) == 0
    first = valid.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= (least[1:] != least[:-1]) | ~valid[1:]
    start, stop = np.flatnonzero(first), np.flatnonzero(last)
    sample = least[start]
    name = (_strings(sums, start, stop + LENGTH) + (stop - start).astype(np.uint64)) & np.uint64((1 << 48) - 1)
    # a window repeats within a stretch only if its sample occurs there twice, at most `WINDOW` apart
    pad = np.zeros(WINDOW - 1, np.uint64)
    sampled = np.flatnonzero(sliding(np.maximum, np.concatenate((pad, least, pad)), WINDOW) == h)
    gap, equal = np.diff(sampled), h[sampled[1:]] == h[sampled[:-1]]
    twice = np.flatnonzero(equal & (gap < WINDOW))
    inside = np.zeros(len(start), bool)
    if len(twice):
        step = np.zeros(len(data) + 2, np.int32)
        np.add.at(step, np.maximum(sampled[twice + 1] - WINDOW + 1, 0), 1)
        np.add.at(step, sampled[twice] + 1, -1)
        covered = np.concatenate(([0], np.cumsum(np.cumsum(step[:n]) > 0)))
        inside = covered[stop + 1] > covered[start]
    # at a gap of `WINDOW` no window holds both: the last one with the first sample and the next one share a stretch
    meet = sampled[:-1][equal & (gap == WINDOW)]
    own = np.searchsorted(start, meet, "right") - 1
    meet, own = meet[own >= 0], own[own >= 0]
    inside[own[stop[own] > meet]] = True
    return start, stop, sample, name, inside


# Columns of numbers as bytes and back: byte planes compress well.


def packed(*columns: np.ndarray) -> bytes:
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(payload: bytes, kinds: str) -> list[np.ndarray]:
    """Columns of the given numpy kinds."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds.split()]
    n, at, out = len(data) // sum(widths), 0, []
    for kind, width in zip(kinds.split(), widths, strict=True):
        out.append(np.ascontiguousarray(data[at : at + n * width].reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out


#: sample, name, id, tag (crc32 of the text), first start, number of starts, repeats within
RUN_KINDS = "u8 u8 i8 u4 i4 i4 u1"
#: window hash, second hash, id, tag, start
WINDOW_KINDS = "u8 u4 i8 u4 i4"
#: id, tag, first start, end of the starts
RANGE_KINDS = "i8 u4 i4 i4"


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (_mixed(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _dealt(part: np.ndarray, kind: int, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """One row for each part that has something."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
        if b > a:
            yield int(part[a]), kind, packed(*[c[a:b] for c in columns])


def _ranges(kind: int, parts: int, key: np.ndarray, tag: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Ranges of window starts, joined where they touch, for the parts of their documents."""
    if not len(key):
        return
    order = np.lexsort((start, tag, key))
    key, tag, start, stop = key[order], tag[order], start[order], stop[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] != stop[:-1])
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(key)) - 1
    yield from _dealt(_part_of(key[heads], parts), kind, [key[heads], tag[heads], start[heads].astype(np.int32), stop[ends].astype(np.int32)])


def _batches(rows: Iterator[tuple[int, int, bytes]], limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= limit:
            yield _batch(held)
            held, size = [], 0
    yield _batch(held)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["part", "kind", "payload"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    """(id, tag, bytes) of each row of (doc_id, text)."""
    for part in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
        for key, data in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
            yield NO_ID if key is None else key, zlib.crc32(data), data


def _pieces(docs: Iterator[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """(id, tag, offset, bytes) of pieces that hold whole windows, some `PIECE` bytes together."""
    held, size = [], 0
    for key, tag, data in docs:
        for at in range(0, max(len(data) - LENGTH + 1, 0), PIECE):
            held.append((key, tag, at, data[at : at + PIECE + LENGTH - 1]))
            size += len(held[-1][3])
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _side_by_side(pieces: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    edges = np.concatenate(([0], np.cumsum([len(p[3]) for p in pieces])))
    return np.frombuffer(b"".join(p[3] for p in pieces), np.uint8), edges


def _not_first(order: np.ndarray, same: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """In the given order (equal things together, by place): which rows have an equal one at an earlier place."""
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    key, start = key[order], start[order]
    return same & ((key != key[head]) | (start != start[head]))


def _known_runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by sample, name and place, and which rows repeat an earlier one in that order."""
    sample, name, key, _, start, *_ = columns
    order = np.lexsort((start, key, name, sample))
    same = np.zeros(len(order), bool)
    same[1:] = (sample[order][1:] == sample[order][:-1]) & (name[order][1:] == name[order][:-1])
    return order, _not_first(order, same, key, start)


def _marks_of(columns: list[np.ndarray], rows: np.ndarray, parts: int, kind: int) -> Iterator[tuple[int, int, bytes]]:
    _, _, key, tag, start, size, _ = columns
    yield from _ranges(kind, parts, key[rows], tag[rows], start[rows], start[rows] + size[rows])


def _send_runs(found: list[list[np.ndarray]], parts: int) -> Iterator[tuple[int, int, bytes]]:
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    order, repeat = _known_runs(columns)
    yield from _marks_of(columns, order[repeat], parts, MARK)
    sent = [c[order[~repeat]] for c in columns]
    yield from _dealt(_part_of(sent[0], parts), RUN, sent)


def _find_runs(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        found, held = [], 0
        for pieces in _pieces(_documents(batches)):
            data, edges = _side_by_side(pieces)
            start, stop, sample, name, inside = stretches(data, edges)
            own = np.searchsorted(edges, start, "right") - 1
            key, tag, at = (np.array([p[i] for p in pieces], np.int64)[own] for i in range(3))
            found.append([sample, name, key, tag.astype(np.uint32), (start - edges[own] + at).astype(np.int32), (stop - start + 1).astype(np.int32), inside.astype(np.uint8)])
            held += len(start)
            if held >= HELD:
                yield from _send_runs(found, parts)
                found, held = [], 0
        if held:
            yield from _send_runs(found, parts)

    return lambda batches: _batches(rows(batches))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[int, bytes]]]:
    """(kind, payload) of one part after the other; rows come in the order of (part, kind)."""
    rows = ((p, k, x) for b in batches for p, k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
    row = next(rows, None)
    while row is not None:
        part = row[0]

        def own(part=part):
            nonlocal row
            while row is not None and row[0] == part:
                yield row[1:]
                row = next(rows, None)

        yield (held := own())
        for _ in held:
            pass


def _sort_runs(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A bucket of samples: repeats become marks, samples with several names become questions about their windows."""

    def bucket(payloads: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        columns = [np.concatenate(c) for c in zip(*[unpacked(p, RUN_KINDS) for p in payloads], strict=True)]
        # most samples occur once: only the others are sorted further
        sample, inside = columns[0], columns[6]
        by_sample = np.argsort(sample)
        shared = np.zeros(len(sample), bool)
        equal = sample[by_sample][1:] == sample[by_sample][:-1]
        shared[by_sample[1:][equal]] = True
        shared[by_sample[:-1][equal]] = True
        kept = np.flatnonzero(shared | (inside > 0))
        columns = [c[kept] for c in columns]
        order, repeat = _known_runs(columns)
        yield from _marks_of(columns, order[repeat], parts, MARK)
        left = order[~repeat]
        sample, name, inside = columns[0][left], columns[1][left], columns[6][left]
        if not len(left):
            return
        heads = np.flatnonzero(np.concatenate(([True], sample[1:] != sample[:-1])))
        group = np.cumsum(np.concatenate(([0], (sample[1:] != sample[:-1]).astype(np.int64))))
        names = np.maximum.reduceat(name, heads) != np.minimum.reduceat(name, heads)
        yield from _marks_of(columns, left[names[group] | (inside > 0)], parts, ASK)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for n, part in enumerate(_parts(batches)):
            runs = []
            for kind, payload in part:
                if kind == RUN:
                    runs.append(payload)
                else:  # marks go on to the parts of their documents, which are as many as these
                    key, tag, start, stop = unpacked(payload, RANGE_KINDS)
                    yield from _ranges(kind, parts, key, tag, start, stop)
            if runs:
                yield from bucket(runs)

    return lambda batches: _batches(rows(batches))


def _pack_texts(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts for the parts of their documents: ids, tags and lengths, then the compressed bytes."""

    def send(docs: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        part = _part_of(np.array([d[0] for d in docs], np.int64), parts)
        for p in np.unique(part).tolist():
            own = [docs[i] for i in np.flatnonzero(part == p).tolist()]
            heads = packed(np.array([d[0] for d in own], np.int64), np.array([d[1] for d in own], np.uint32), np.array([len(d[2]) for d in own], np.int64))
            yield p, TEXT, len(heads).to_bytes(4, "little") + heads + zstandard.ZstdCompressor(level=3).compress(b"".join(d[2] for d in own))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        held, size = [], 0
        for doc in _documents(batches):
            held.append(doc)
            size += len(doc[2])
            if size >= HELD_BYTES:
                yield from send(held)
                held, size = [], 0
        if held:
            yield from send(held)

    return lambda batches: _batches(rows(batches))


def _texts(payload: bytes) -> Iterator[tuple[int, int, bytes]]:
    size = int.from_bytes(payload[:4], "little")
    keys, tags, lengths = unpacked(payload[4 : 4 + size], "i8 u4 i8")
    data = zstandard.ZstdDecompressor().decompress(payload[4 + size :])
    ends = np.cumsum(lengths).tolist()
    for key, tag, end, n in zip(keys.tolist(), tags.tolist(), ends, lengths.tolist(), strict=True):
        yield key, tag, data[end - n : end]


class Ranges:
    """Ranges of window starts by document."""

    def __init__(self, payloads: list[bytes]):
        columns = [np.concatenate(c) for c in zip(*[unpacked(p, RANGE_KINDS) for p in payloads], strict=True)] if payloads else [np.zeros(0, k) for k in RANGE_KINDS.split()]
        key, tag, start, stop = columns
        order = np.lexsort((start, tag, key))
        key, tag, self.start, self.stop = key[order], tag[order], start[order].astype(np.int64), stop[order].astype(np.int64)
        heads = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])))) if len(key) else np.zeros(0, np.int64)
        ends = np.append(heads[1:], len(key)) if len(key) else heads
        self.at = {(k, t): (a, b) for k, t, a, b in zip(key[heads].tolist(), tag[heads].tolist(), heads.tolist(), ends.tolist(), strict=True)}

    def of(self, key: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.at.get((key, tag), (0, 0))
        return self.start[a:b], self.stop[a:b]


def _send_windows(found: list[list[np.ndarray]], parts: int) -> Iterator[tuple[int, int, bytes]]:
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    order, repeat = _known_windows(columns)
    yield from _window_marks(columns, order[repeat], parts)
    sent = [c[order[~repeat]] for c in columns]
    yield from _dealt(_part_of(sent[0], parts), RUN, sent)


def _known_windows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, check, key, _, start = columns
    order = np.lexsort((start, key, check, h))
    same = np.zeros(len(order), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (check[order][1:] == check[order][:-1])
    return order, _not_first(order, same, key, start)


def _window_marks(columns: list[np.ndarray], rows: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    _, _, key, tag, start = columns
    yield from _ranges(MARK, parts, key[rows], tag[rows], start[rows], start[rows] + 1)


def _find_windows(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes of the windows that are asked for."""

    def hashed(key: int, tag: int, data: bytes, start: np.ndarray, stop: np.ndarray) -> Iterator[list[np.ndarray]]:
        for at in range(0, len(data) - LENGTH + 1, PIECE):
            a, b = np.clip(start - at, 0, PIECE), np.clip(stop - at, 0, PIECE)
            sizes = b - a
            if not sizes.sum():
                continue
            piece = np.frombuffer(data, np.uint8, min(PIECE + LENGTH - 1, len(data) - at), at)
            places = np.repeat(a - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            h, check = (_strings(_sums(piece, i), places, places + LENGTH) for i in (0, 1))
            yield [h, (check >> np.uint64(32)).astype(np.uint32), np.full(len(places), key, np.int64), np.full(len(places), tag, np.uint32), (places + at).astype(np.int32)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        found, held = [], 0
        for part in _parts(batches):
            payloads, asked = [], None
            for kind, payload in part:
                if kind == ASK:
                    payloads.append(payload)
                    continue
                asked = asked or Ranges(payloads)
                for key, tag, data in _texts(payload) if asked.at else ():
                    start, stop = asked.of(key, tag)
                    if not len(start):
                        continue
                    for columns in hashed(key, tag, data, start, stop):
                        found.append(columns)
                        held += len(columns[0])
                    if held >= HELD:
                        yield from _send_windows(found, parts)
                        found, held = [], 0
        if held:
            yield from _send_windows(found, parts)

    return lambda batches: _batches(rows(batches))


def _sort_windows(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for part in _parts(batches):
            payloads = []
            for kind, payload in part:
                if kind == RUN:
                    payloads.append(payload)
                else:
                    yield from _ranges(kind, parts, *unpacked(payload, RANGE_KINDS))
            if payloads:
                columns = [np.concatenate(c) for c in zip(*[unpacked(p, WINDOW_KINDS) for p in payloads], strict=True)]
                order, repeat = _known_windows(columns)
                yield from _window_marks(columns, order[repeat], parts)

    return lambda batches: _batches(rows(batches))


def removed(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by windows that start in the given ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(start.tolist(), (stop + LENGTH - 1).tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        payloads, marks = [], None
        for kind, payload in part:
            if kind != TEXT:
                payloads.append(payload)
                continue
            marks = marks or Ranges(payloads)
            keys, texts, gone, places = [], [], [], []
            for key, tag, data in _texts(payload):
                spans = removed(*marks.of(key, tag))
                edges = [0, *[x for s in spans for x in s], len(data)]
                keys.append(None if key == NO_ID else key)
                texts.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                gone.append(len(data) - len(texts[-1]))
                places.append([{"start": a, "stop": b} for a, b in spans])
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            for at in range(0, len(keys), 2000):
                part_of = (x[at : at + 2000] for x in (keys, texts, gone, places))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part_of, kinds, strict=True)], ["doc_id", "kept", "n_removed", "spans"])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept, n_removed, spans): what is left of each text as bytes, and the byte ranges that go."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), math.ceil(size / PART_BYTES))

    def by_part(table: DataFrame) -> DataFrame:
        return table.repartition(parts, "part").sortWithinPartitions("part", "kind")

    def texts() -> DataFrame:
        return rows.mapInArrow(_pack_texts(parts), SCHEMA)

    runs = saved(by_part(rows.mapInArrow(_find_runs(parts), SCHEMA)).mapInArrow(_sort_runs(parts), SCHEMA))
    asked = by_part(texts().unionByName(runs.where(F.col("kind") == ASK))).mapInArrow(_find_windows(parts), SCHEMA)
    windows = saved(by_part(asked).mapInArrow(_sort_windows(parts), SCHEMA))
    marks = runs.where(F.col("kind") == MARK).unionByName(windows)
    schema = "doc_id long, kept binary, n_removed long, spans array<struct<start:long,stop:long>>"
    return by_part(texts().unionByName(marks)).mapInArrow(_cut, schema)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    found = without_repeats(docs, key, text)
    return found.select(
        "doc_id", (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
