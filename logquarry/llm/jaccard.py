"""Exact Jaccard self-join on sets of word n-grams by a partition of the universe.

Texts are sets of hashed shingles (XXH64; equal sets are one set from the start). Two sets of s and l shingles with a
similarity of p/q or more differ in at most (s + l)(q - p)/(q + p) shingles. Sizes fall into bands, each a quarter
wider than its start; a class holds the pairs whose larger set is in its band, so a set enters the class of its own band
and, near the band's end, the next one. A class with at most H differences hashes the universe into m segments and gives
each an allowance of 0, 1 or 2 that together exceed H: some segment of every pair differs in less than its allowance
(pigeonhole). Allowance 1 indexes the segment's subset as it is; 2 also indexes the subset without each one of its
shingles, so subsets that differ in one meet. Which m and which allowances are least costly, counting index entries
and pairs that meet, is decided for each class on a sample of texts with about `SAMPLE` shingles; it changes the work, not the
result, and a class without a sample takes m = H + 1.

Sets that share an entry are candidates, unless their sizes or their parity bitmaps rule them out: one bit is flipped by
each shingle, so the bitmaps' differing bits are a lower bound of the differing shingles; a bitmap has 1,024 bits, or as
many as half of the shingles or more. Chance meetings, whose number grows faster than the table, end here, before any
text is read again. Every entry's sets are tested with the least of them first, then all pairs of sets that this left
apart. The components of what passes are verified: similarity is counted on whole sets, again of pairs in reach. A
component with up to `SLICE` shingles is verified by one task, from set to set as they are found linked. A larger one
first meets `LEADERS` of its sets, in slices; then the sets of entries whose bitmaps pass and which are not linked yet are
compared by every pair of slices, which leaves the result exact. Each task holds two slices at most.

Defined results: null and empty texts and texts without words have no shingles and are linked with nothing; a text with
fewer words than a shingle is one shingle; rows that repeat are linked like any equal texts; rows that share an id are
linked by their own texts; a row whose id is null takes part, and its component is null where no row has an id; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquarry.llm.common import as_bytes, saved, shuffle_partitions
from logquarry.llm.components import components
from logquarry.llm.simhash import forest, shingle_hashes

#: Shingles of the texts on which the allowances are decided, and those that one task verifies at once.
SAMPLE, SLICE = 1 << 19, 1 << 19
LEADERS = 16
#: Sets that a task remembers to index copies once.
REMEMBERED = 100_000
#: What a pair that meets costs, counted in index entries.
PAIR_COST = 40
_PARITY = 1024
#: Bits for each wanted id in the bitmap that texts pass before they are joined, and in one row of it.
_ID_BITS, _ROW_BITS = 16, 1 << 15
_ODD, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

Share = tuple[int, int]


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * _MORE
    x ^= x >> np.uint64(32)
    x *= _ODD
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The sorted hashes of a text's shingles, each once."""
    return np.unique(shingle_hashes(text, size))


def mark_of(own: np.ndarray) -> int:
    """A number that stands for the set."""
    return int.from_bytes(xxhash.xxh64_digest(own.tobytes(), 7), "big", signed=True)


@cache
def bands(share: Share, most: int = 1 << 40) -> tuple[list[int], list[int]]:
    """First sizes of the bands, and the differences that pairs with their larger set in the band may have."""
    starts, gaps, low = [], [], 1
    while low < most:
        high = max(low, low * 5 // 4, low * share[1] // share[0])
        starts.append(low)
        gaps.append(2 * high * (share[1] - share[0]) // (share[1] + share[0]))
        low = high + 1
    return starts, gaps


def classes_of(n: int, share: Share) -> list[int]:
    """The classes that a set of n shingles enters: those in which it may differ at all from its partner."""
    if not n:
        return []
    starts, gaps = bands(share)
    own = int(np.searchsorted(starts, n, "right")) - 1
    near = [own] + ([own + 1] if n * share[1] >= starts[own + 1] * share[0] else [])
    return [c for c in near if gaps[c]]


def _segments(own: np.ndarray, of: int, m: int) -> np.ndarray:
    """The segment of each shingle in class `of`."""
    return ((_mixed(own, 2 * of + 1) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)


def _sums(values: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Sums modulo 2^64 of the values at each place."""
    low = np.bincount(at, weights=(values & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=m)
    high = np.bincount(at, weights=(values >> np.uint64(32)).astype(np.float64), minlength=m)
    return (high.astype(np.uint64) << np.uint64(32)) + low.astype(np.uint64)


def entries(own: np.ndarray, of: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a set in a class, and the segment of each."""
    m = len(allowed)
    at, values = _segments(own, of, m), _mixed(own, 3)
    whole = _sums(values, at, m)
    chosen = np.flatnonzero(allowed)
    sums, segment = whole[chosen], chosen
    near = np.flatnonzero(allowed[at] == 2)
    if len(near):
        sums = np.concatenate([sums, whole[at[near]] - values[near]])
        segment = np.concatenate([segment, at[near]])
    return _mixed(sums + segment.astype(np.uint64) * _ODD, of + 1_000_003), segment


def allowances(sets: list[np.ndarray], of: int, gap: int, scale: float) -> np.ndarray:
    """The least costly allowances of a class, as far as its sample tells; `scale` texts stand behind each of the sample."""
    best, least = np.ones(gap + 1, np.int8), np.inf
    for m in sorted({gap + 1, gap + 1 - (gap + 1) // 4, (gap + 2) // 2, gap + 2}):
        cost = np.zeros((3, m))
        for allowed in (1, 2):
            keys, segments = zip(*(entries(x, of, np.full(m, allowed, np.int8)) for x in sets), strict=True)
            key, segment = np.concatenate(keys), np.concatenate(segments)
            cost[allowed] = np.bincount(segment, minlength=m)
            order = np.argsort(key)
            first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            n = np.diff(np.r_[first, len(key)]).astype(float)
            cost[allowed] += PAIR_COST * scale * np.bincount(segment[order][first], weights=n * (n - 1) / 2, minlength=m)
        # the least cost of each sum of allowances, segment by segment
        need = gap + 1
        total, choices = np.full(need + 1, np.inf), np.zeros((m, need + 1), np.int8)
        total[0] = 0
        for i in range(m):
            reached = total.copy()
            for allowed in (1, 2):
                moved = np.r_[np.full(allowed, np.inf), total][: need + 1] + cost[allowed, i]
                better = moved < reached
                reached[better], choices[i, better] = moved[better], allowed
            total = reached
        if total[need] < least:
            least, left, best = total[need], need, np.zeros(m, np.int8)
            for i in range(m - 1, -1, -1):
                best[i] = choices[i, left]
                left -= int(best[i])
    return best


def _perhaps(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text) with an id of `wanted`, and about one in `_ID_BITS` of the others."""
    bits = -(-max(wanted.count(), 1) * _ID_BITS // _ROW_BITS) * _ROW_BITS
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(bits))
    row, within = F.floor(place / _ROW_BITS), place % _ROW_BITS
    known = wanted.groupBy(row.alias("row")).agg(F.bitmap_construct_agg(within).alias("bits"))
    octet = F.conv(F.hex(F.substring("bits", (within / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    found = docs.withColumn("row", row).join(F.broadcast(known), "row")  # two bytes for each wanted id
    return found.where(F.getbit(octet, (within % 8).cast("int")) == 1).select("doc_id", "text")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """`wanted` (doc_id, mark, others) with `own`, the set's hashes as bytes."""
    others = [f for f in wanted.schema.fields if f.name not in ("doc_id", "mark")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, sets = batch.column(0).to_pylist(), [shingle_set(t, shingle) for t in as_bytes(batch.column(1))]
            right = [i for i, x in enumerate(sets) if mark_of(x) == marks[i]]  # rows may share an id
            rest = batch.take(pa.array(right, pa.int64()))
            yield pa.RecordBatch.from_arrays([rest.column(0), *rest.columns[2:], pa.array([sets[i].tobytes() for i in right], pa.binary())], ["mark", *[f.name for f in others], "own"])

    joined = _perhaps(docs, wanted).join(wanted, "doc_id").select("mark", "text", *[f.name for f in others])
    return joined.mapInArrow(run, ", ".join(["mark long", *[f"{f.name} {f.dataType.simpleString()}" for f in others], "own binary"]))


def _plan(docs: DataFrame, share: Share, shingle: int, sample: int) -> dict[int, np.ndarray]:
    """The allowances of the classes that are better off with others than one for each of H + 1 segments.

    The sample is drawn by the texts' hashes, at a rate that a word for every six characters would make right.
    """
    words = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) / 6
    rate = min(1.0, sample / max(words, 1))
    drawn = docs.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)) < F.lit(round(rate * (1 << 30)))).select("text").distinct()
    gaps = bands(share)[1]

    def decide(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        of = int(key[0])
        found = allowances([np.frombuffer(x, np.uint64) for x in rows["own"]], of, gaps[of], 1 / rate)
        return pd.DataFrame({"of": [of], "allowed": [found.tobytes()]})

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                own = shingle_set(text, shingle)
                found = classes_of(len(own), share)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([own.tobytes()] * len(found), pa.binary())], ["of", "own"])

    rows = drawn.mapInArrow(enter, "of int, own binary").groupBy("of").applyInPandas(decide, "of int, allowed binary")
    plan = {r.of: np.frombuffer(bytes(r.allowed), np.int8) for r in rows.toLocalIterator()}
    return {of: x for of, x in plan.items() if len(x) != gaps[of] + 1 or (x != 1).any()}


def _entered(docs: DataFrame, plan: dict[int, np.ndarray], share: Share, shingle: int) -> DataFrame:
    """(doc_id, n, mark, print, cell): every row once with its size and no cell, and the index entries of all sets.

    A task enters equal texts once as long as it remembers them; the row that enters them has their bitmap. Rows without
    an id enter nothing.
    """
    gaps = bands(share)[1]

    def out(ids, sizes, marks, prints, cells) -> pa.RecordBatch:
        rows = sum(len(x) for x in cells)
        columns = [pa.array(ids + [None] * rows, pa.int64()), pa.array(sizes + [None] * rows, pa.int64())]
        own = pa.array(np.concatenate([np.array([m for m, _ in marks], np.int64), *(np.full(len(c), m, np.int64) for m, c in marks)]))
        columns += [own, pa.concat_arrays([pa.array(prints, pa.binary()), pa.nulls(rows, pa.binary())])]
        columns += [pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *cells]))])]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "mark", "print", "cell"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, None] = OrderedDict()
        for batch in batches:
            ids, sizes, marks, prints, cells, room = [], [], [], [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                own = shingle_set(text, shingle)
                mark, found = mark_of(own), np.zeros(0, np.int64)
                if key is not None and mark not in seen:
                    seen[mark] = None
                    if len(seen) > REMEMBERED:
                        seen.popitem(last=False)
                    for of in classes_of(len(own), share):
                        allowed = plan.get(of)
                        new = entries(own, of, np.ones(gaps[of] + 1, np.int8) if allowed is None else allowed)[0]
                        found = np.concatenate([found, new.view(np.int64)])
                ids.append(key)
                sizes.append(len(own))
                marks.append((mark, found))
                prints.append(parity(own, width_of(len(own))).tobytes() if len(found) else None)
                cells.append(found)
                room += len(found) + 1
                if room > 200_000:
                    yield out(ids, sizes, marks, prints, cells)
                    ids, sizes, marks, prints, cells, room = [], [], [], [], [], 0
            yield out(ids, sizes, marks, prints, cells)

    return docs.mapInArrow(run, "doc_id long, n long, mark long, print binary, cell long")


def width_of(n: int) -> int:
    """Bits of the bitmap of n shingles: unlike sets differ in about half of them, far more than sets in reach may."""
    return max(_PARITY, 1 << max(n - 1, 1).bit_length() - 1)


def parity(own: np.ndarray, width: int) -> np.ndarray:
    """A bitmap in which every shingle flips one bit."""
    flipped = np.bincount((_mixed(own, 5) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(flipped.astype(np.uint8)).view(np.uint64)


def folded(prints: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of the narrowest one's width."""
    least, rows = min(map(len, prints), default=8) // 8, []
    for own in prints:
        row = np.frombuffer(own, np.uint64)
        while len(row) > least:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        rows.append(row)
    return np.array(rows, np.uint64).reshape(len(rows), least)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """The bitmaps of all sets, as wide as the largest one's."""
    width = width_of(max(map(len, sets), default=0))
    return np.array([parity(x, width) for x in sets], np.uint64).reshape(len(sets), width // 64)


def in_reach(i: int, among: np.ndarray, sizes: np.ndarray, prints: np.ndarray, share: Share) -> np.ndarray:
    """Those of `among` that neither sizes nor bitmaps rule out as partners of i."""
    near = among[share[1] * np.minimum(sizes[among], sizes[i]) >= share[0] * np.maximum(sizes[among], sizes[i])]
    apart = np.bitwise_count(prints[near] ^ prints[i]).sum(axis=1, dtype=np.int64)
    return near[apart * (share[1] + share[0]) <= (sizes[near] + sizes[i]) * (share[1] - share[0])]


def possible(sizes: np.ndarray, prints: np.ndarray, roots: np.ndarray, share: Share) -> tuple[list[int], list[int]]:
    """Links between sets that join all pairs in reach with different roots."""
    _, kind, counts = np.unique(roots, return_inverse=True, return_counts=True)
    group, a, b = np.arange(len(sizes)), [], []
    for i in np.flatnonzero(kind != counts.argmax()).tolist():  # one of each pair is among these
        near = in_reach(i, np.flatnonzero((group != group[i]) & (kind != kind[i])), sizes, prints, share)
        groups, first = np.unique(group[near], return_index=True)
        a += [i] * len(first)
        b += near[first].tolist()
        group[np.isin(group, groups)] = group[i]
    return a, b


def alike(a: np.ndarray, b: np.ndarray, share: Share) -> bool:
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()) if len(a) and len(b) else 0
    return common > 0 and share[1] * common >= share[0] * (len(a) + len(b) - common)


def linked(sets: list[np.ndarray], share: Share, groups: np.ndarray, sources: np.ndarray) -> tuple[list[int], list[int]]:
    """Links between sets of different groups that join all that are linked; every pair with a source is tested until joined."""
    sizes, prints = np.array([len(x) for x in sets], np.int64), parities(sets)
    group, tested, a, b = groups.copy(), np.zeros(len(sets), bool), [], []
    for i in sources.tolist():
        tested[i] = True
        for j in in_reach(i, np.flatnonzero((group != group[i]) & ~tested), sizes, prints, share).tolist():
            if group[j] != group[i] and alike(sets[i], sets[j], share):
                group[group == group[j]] = group[i]
                a.append(i)
                b.append(j)
    return a, b


def _in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of `cell`, one table for each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cell = batch.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        for at, end in zip(cuts, cuts[1:], strict=False):
            if at == end:
                continue
            if held and held[0].column("cell")[0].as_py() != cell[at]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held)


def _verified(rows: DataFrame, share: Share) -> DataFrame:
    """(a, b): the links within each cell of `rows` (cell, mark, root, leads, own) that join sets of different roots.

    Where a cell has rows that lead, only pairs with one of them are tested.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _in_groups(batches):
            marks = table.column("mark").to_numpy()
            order = np.unique(marks, return_index=True)[1]
            leads = np.isin(marks[order], marks[table.column("leads").to_numpy(zero_copy_only=False).astype(bool)])
            owns = table.column("own").to_pylist()
            sets = [np.frombuffer(owns[i], np.uint64) for i in order]
            roots = np.unique(table.column("root").to_numpy()[order], return_inverse=True)[1]
            sources = np.flatnonzero(leads) if leads.any() else np.arange(len(sets))
            a, b = forest(len(sets), *(np.array(x, np.int64) for x in linked(sets, share, roots, sources)))
            yield pa.RecordBatch.from_arrays([pa.array(marks[order][a]), pa.array(marks[order][b])], ["a", "b"])

    dealt = rows.select("cell", "mark", "root", "leads", "own").repartition(shuffle_partitions(rows.sparkSession), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "a long, b long")


def _sliced(members: DataFrame, slice_shingles: int) -> DataFrame:
    """`members` (component, n, others) with the number of slices of their component."""
    weight = F.sum(F.col("n") + F.lit(slice_shingles // 1024 + 1))
    slices = members.groupBy("component").agg(F.ceil(weight / slice_shingles).cast("int").alias("slices"))
    return members.join(slices, "component")


def _pairs_of_slices(members: DataFrame) -> DataFrame:
    """Each member once for every pair of slices that its own belongs to, as a cell."""
    own = F.pmod(F.xxhash64("mark"), "slices").cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda x: F.struct(F.least(x, own).alias("x"), F.greatest(x, own).alias("y")))
    dealt = members.select("*", F.explode(pair).alias("pair"))
    return dealt.withColumn("cell", F.xxhash64("component", "pair.x", "pair.y")).withColumn("leads", F.lit(False))


def _met(stars: DataFrame, prints: DataFrame, share: Share) -> DataFrame:
    """(a, b): the pairs of `stars` (mark, lead) that sizes and bitmaps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, of, own, other = (x.to_pylist() for x in batch.columns)
            pair = np.array([0, 1])
            kept = [i for i in range(len(a)) if len(in_reach(0, pair[1:], np.array([n[i], of[i]]), folded([own[i], other[i]]), share))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in kept], pa.int64()) for x in (a, b)], ["a", "b"])

    lead = prints.select(F.col("mark").alias("lead"), F.col("n").alias("of"), F.col("print").alias("other"))
    return stars.join(prints, "mark").join(lead, "lead").select("mark", "lead", "n", "of", "print", "other").mapInArrow(run, "a long, b long")


def _open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(cell, mark, root): the sets of the cells in which those of `roots` (mark, root) have different roots."""
    cell = Window.partitionBy("cell")
    rows = shared.select("cell", "mark").join(roots, "mark")
    return rows.withColumns({"low": F.min("root").over(cell), "high": F.max("root").over(cell)}).where("low <> high").select("cell", "mark", "root")


def _possible(rows: DataFrame, prints: DataFrame, share: Share) -> DataFrame:
    """(a, b): links that join, in each cell of `rows` (cell, mark, root), all pairs in reach with different roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _in_groups(batches):
            marks, sizes, roots = (table.column(x).to_numpy() for x in ("mark", "n", "root"))
            a, b = possible(sizes, folded(table.column("print").to_pylist()), roots, share)
            yield pa.RecordBatch.from_arrays([pa.array(marks[np.array(x, np.int64)]) for x in (a, b)], ["a", "b"])

    dealt = rows.join(prints, "mark").select("cell", "mark", "root", "n", "print")
    return dealt.repartition(shuffle_partitions(rows.sparkSession), "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def _rooted(sets: DataFrame, found: DataFrame) -> DataFrame:
    """`sets` (mark, others) with the smallest set that `found` (a, b) joins each one to."""
    roots = components(found).select(F.col("node").alias("mark"), F.col("component").alias("root"))
    return saved(sets.join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark")))


def links(docs: DataFrame, entered: DataFrame, prints: DataFrame, reps: DataFrame, share: Share, shingle: int, slice_shingles: int = SLICE) -> DataFrame:
    """(a, b): links between marks that join all sets of `reps` (mark, doc_id, n) that are linked; `entered` (cell, mark), `prints` (mark, n, print)."""
    cell = Window.partitionBy("cell")
    ends = entered.withColumns({"lead": F.min("mark").over(cell), "last": F.max("mark").over(cell), "several": F.count("*").over(cell) > 2})
    shared = saved(ends.where("lead <> last").drop("last").distinct())
    prints = saved(prints.join(shared.select("mark").distinct(), "mark").dropDuplicates(["mark"]))
    met = saved(_met(shared.select("mark", "lead").where("mark <> lead").distinct(), prints, share))
    roots = _rooted(prints.select("mark"), met)
    met = saved(met.unionByName(_possible(_open(shared.where("several"), roots), prints, share)))
    asked = components(met).withColumnRenamed("node", "mark")
    members = saved(_sets(docs, saved(_sliced(asked.join(reps, "mark"), slice_shingles)), shingle))
    small = members.where("slices = 1").withColumns({"cell": F.col("component"), "root": F.col("mark"), "leads": F.lit(False)})
    found = saved(_verified(small, share))
    large = members.where("slices > 1")
    if large.isEmpty():
        return found
    # some sets of each large component against all of its slices
    rank = F.row_number().over(_window("component"))
    leaders = large.withColumn("rank", rank).where(F.col("rank") <= LEADERS).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    both = large.withColumns({"slice": F.pmod(F.xxhash64("mark"), "slices").cast("int"), "leads": F.lit(False)}).unionByName(leaders.drop("rank").withColumn("leads", F.lit(True)))
    found = saved(found.unionByName(_verified(both.withColumns({"cell": F.xxhash64("component", "slice"), "root": F.col("mark")}), share)))
    # what shares an entry, is in reach and is not linked yet
    rooted = _rooted(large.select("mark", "n"), found)
    open_ = components(saved(_possible(_open(shared, rooted.select("mark", "root")), prints, share)))
    left = _sliced(open_.withColumnRenamed("node", "mark").join(rooted, "mark"), slice_shingles)
    dealt = _pairs_of_slices(left.join(members.select("mark", "own"), "mark"))
    return saved(found.unionByName(_verified(dealt, share)))


def _window(key: str):
    return Window.partitionBy(key).orderBy(F.xxhash64("mark", F.lit(29)), "mark")


def similar_texts(docs: DataFrame, shingle: int = 3, share: Share = (90, 100), key: str = "doc_id", text: str = "text", slice_shingles: int = SLICE, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    seen = saved(_entered(named, _plan(named, share, shingle, sample), share, shingle))
    described = saved(seen.where("cell is null").drop("print", "cell"))
    reps = saved(described.where("n > 0 and doc_id is not null").groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")))
    prints = seen.where("print is not null").select("mark", "n", "print")
    found = links(named, seen.where("cell is not null").select("cell", "mark"), prints, reps, share, shingle, slice_shingles)
    joined = components(found).withColumnRenamed("node", "mark")
    least = saved(reps.join(joined, "mark", "left").select("mark", "doc_id", F.coalesce("component", "mark").alias("component")))
    least = least.join(least.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("mark", "component_id")
    out = described.where("n > 0").join(least, "mark", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(described.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


ORACLE = r"""
    with worded as (
        select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
        from documents),
    sets as (
        select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
            else list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) end as s
        from worded),
    marked as (select doc_id, len(s) as n, md5(array_to_string(s, chr(10))) as mark, s from sets),
    classes as (select mark, any_value(n) as n, min(doc_id) as doc_id, any_value(s) as s from marked where n > 0 group by mark),
    numbered as (select mark, n, unnest(s) as shingle from classes),
    frequent as (select shingle, hash(shingle) as h, count(*) as f from numbered group by all),
    -- a pair of sets in reach shares one of the rarest shingles of either: n - ceil(0.9 n) + 1 of them
    ranked as (
        select n.mark, n.n, n.shingle, row_number() over (partition by n.mark order by f.f, n.shingle) as place
        from numbered n join frequent f using (shingle)),
    prefixes as (select * from ranked where place <= n - (9 * n + 9) // 10 + 1),
    candidates as (
        select distinct a.mark as x, b.mark as y from prefixes a join prefixes b on a.shingle = b.shingle
        where a.mark < b.mark and 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)),
    linked as (
        select x, y from candidates c join classes a on a.mark = c.x join classes b on b.mark = c.y
        where 100 * len(list_intersect(a.s, b.s)) >= 90 * (a.n + b.n - len(list_intersect(a.s, b.s)))),
    edges as (select x, y from linked union all select y, x from linked),
    least as (
        with recursive walk as (
            select mark as x, mark as y from classes
            union select w.x, e.y from walk w join edges e on e.x = w.y)
        select x, min(c.doc_id) as component_id from walk w join classes c on c.mark = w.y group by x)
    select doc_id, n::bigint as n_shingles, case when n = 0 then doc_id else component_id end as component_id
    from marked left join least on least.x = marked.mark"""
