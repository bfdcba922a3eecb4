"""Benchmark decontamination by pigeonhole edit matching.

Texts and benchmark items are compared in lower case with every run of other characters than letters and
digits as one space. An item may differ from a passage by `budget` edits, a share of its length. It is split
into budget + 1 pieces; a passage within the budget holds at least one of them unchanged. An automaton finds
all exact hits of all pieces in one run over a text; each hit names the window where its item would lie, and
Myers' bit-parallel algorithm takes the smallest edit distance between the whole item and any part of it.

The items are read in blocks of bounded size, each held by every task, and every document meets every block
within its own task: no document is shuffled.

Defined results: null and empty texts match nothing; items whose normal form has fewer than `MIN_CHARS`
characters must stand unchanged, as whole words (a piece of them would be found nearly everywhere); empty
items are never found; items that are equal are each reported; repeated rows are judged alike; an empty table of either kind gives no matches; other columns are ignored by `matches`
and kept by `clean`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed for each character of an item.
ERROR_SHARE = 0.05
MIN_CHARS = 25
#: Characters of items that a task holds at a time.
BLOCK_CHARS = 4 << 20
MATCH_SCHEMA = "doc_id long, item_id long, distance int, match_start int, match_end int"

_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def budget_of(item: str, share: float = ERROR_SHARE) -> int:
    return int(len(item) * share) if len(item) >= MIN_CHARS else 0


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of nearly equal length."""
    edges = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def masks_of(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """Smallest edit distance between the item and any part of the text, and where the first such part ends."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best, at = full, 0, size, size, 0
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | minus
        eq |= ((eq & plus) + plus) ^ plus
        up, down = minus | (full & ~(eq | plus)), plus & eq
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, at = score, end
    return best, at


class Matcher:
    """Finds items of one block in normal texts."""

    def __init__(self, items: list[tuple[int, str]], share: float = ERROR_SHARE):
        self.items = [(key, item, budget_of(item, share)) for key, item in items]
        self.masks: dict[int, dict[str, int]] = {}
        named: dict[str, list[tuple[int, int]]] = {}
        for i, (_, item, budget) in enumerate(self.items):
            for offset, piece in pieces(item, budget):
                named.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in named.items():
            self.automaton.add_word(piece, (len(piece), places))
        if named:
            self.automaton.make_automaton()

    def _windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each item hit, the stretches of text where it would lie; those that touch are one."""
        found: dict[int, list[tuple[int, int]]] = {}
        if not len(self.automaton):
            return found
        for end, (size, places) in self.automaton.iter(text):
            for i, offset in places:
                _, item, budget = self.items[i]
                start = end + 1 - size - offset
                if len(item) < MIN_CHARS and not (text[start - 1 : start] in ("", " ") and text[end + 1 : end + 2] in ("", " ")):
                    continue
                a, b = max(0, start - budget), min(len(text), start + len(item) + budget)
                held = found.setdefault(i, [])
                # hits come in order of their ends, so starts may step back by no more than the item
                if held and a <= held[-1][1] and held[-1][0] - a <= len(item):
                    held[-1] = (min(a, held[-1][0]), max(b, held[-1][1]))
                else:
                    held.append((a, b))
        return found

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the best match of each item within its budget; the start is the end less the item's length."""
        out = []
        for i, windows in self._windows(text).items():
            key, item, budget = self.items[i]
            best = None
            for a, b in windows:
                at = text.find(item, a, b)
                if at >= 0:
                    best = (0, at + len(item))
                    break
                if i not in self.masks:
                    self.masks[i] = masks_of(item)
                distance, end = myers(self.masks[i], len(item), text[a:b])
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, a + end)
            if best:
                out.append((key, best[0], max(0, best[1] - len(item)), best[1]))
        return sorted(out)


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in normal form, a block of bounded size at a time."""
    items = benchmark.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, math.ceil(total / block_chars))
    for block in range(count):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == block).collect()
        normals = ((r.key, normal(r.text)) for r in rows)
        yield sorted(((k, t) for k, t in normals if t), key=lambda x: (x[1], x[0] is not None, x[0] or 0))


def matches(docs: DataFrame, benchmark: DataFrame, share: float = ERROR_SHARE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, match_start, match_end), places counted in the document's normal form."""
    spark, found = docs.sparkSession, None
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    for block in blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, share)
            for batch in batches:
                out = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for m in matcher.find(normal(t))]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["doc_id", "item_id", "distance", "match_start", "match_end"])

        part = rows.mapInArrow(run, MATCH_SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, share: float = ERROR_SHARE, text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item; every row passes through the task that reads it."""
    spark = docs.sparkSession
    for block in blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, share)
            for batch in batches:
                texts = batch.column(batch.schema.names.index(text)).to_pylist()
                yield batch.filter(pa.array([not (t and matcher.find(normal(t))) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
