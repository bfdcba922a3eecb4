"""SimHash near-duplicates by a segment-popcount embedding.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values have it set. Longer
fingerprints have further words of 64 bits, made the same way from rehashed values. The 64 bits of a word
fall into 32 segments of two; the embedding keeps how many bits of each segment are set. Written in unary,
two bits a segment, the embedding is a 64-bit number again, and the Manhattan distance of two embeddings is
the number of bits in which those numbers differ. Moving a set bit within a segment costs nothing there, so
the distance never exceeds the Hamming distance of the fingerprints.

Range join: the axes of a word's embedding are gathered into `blocks` groups, the coordinates of a grid. A
pair within distance d agrees on all but d coordinates, hence on some choice of `blocks - d` of them: every
fingerprint enters the grid cell of each choice, and each pair with a word in reach meets in at least one
cell. Within a cell the Manhattan distance is tested first, the Hamming distance of what is left then.

A cell with many fingerprints is dealt out in tiles, and each pair of tiles is compared by itself. A cell
reports a spanning forest of its links instead of all pairs, which leaves every component the same.
Copies are one fingerprint from the start.

Defined results: a null text counts as empty; texts without words have fingerprint zero, which is linked
like any other; repeated rows and rows that share an id have the same component; a row whose id is null
gets its fingerprint and, if no row with an id is linked to it, a null component; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import as_bytes, put_back, saved, set_apart, shuffle_partitions
from logquarry.llm.components import components

SEED = 42
#: Fingerprints a cell compares at once; larger cells are dealt out in tiles of about half of this.
TILE = 2048
_EVEN = np.uint64(0x5555555555555555)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of the text's shingles, repeats included; of the whole sequence if it has fewer words than a shingle."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-size]]]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)], np.uint64)


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, highest bit first."""
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + _OCTET
    return (np.bincount(octets.reshape(-1), minlength=2048).reshape(8, 256) @ _BITS).reshape(-1)


_OCTET = np.arange(8, dtype=np.int64) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def rehashed(hashes: np.ndarray, word: int) -> np.ndarray:
    """The values that the given word of a fingerprint is made from; word 0 takes the hashes as they are."""
    if word == 0:
        return hashes
    mixed = hashes * np.uint64((2 * word * 0x9E3779B97F4A7C15 + 1) % (1 << 64))
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


def simhash(text: bytes, size: int, words: int = 1) -> bytes:
    """Big-endian fingerprint of 8 bytes a word."""
    return _print_of(shingle_hashes(text, size), words)


def _print_of(hashes: np.ndarray, words: int) -> bytes:
    counts = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        for w in range(words):
            counts[w] += _set_bits(rehashed(block, w))
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, shingle: int, words: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print): the fingerprint as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(t, shingle, words) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "print"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, print binary")


def as_words(prints: pa.Array) -> np.ndarray:
    """Fingerprints as rows of 64-bit numbers."""
    listed = prints.to_pylist()
    return np.frombuffer(b"".join(listed), ">u8").astype(np.uint64).reshape(len(listed), -1) if listed else np.zeros((0, 1), np.uint64)


def embedding(prints: np.ndarray) -> np.ndarray:
    """Bits set in each two-bit segment, in unary."""
    low, high = prints & _EVEN, (prints >> np.uint64(1)) & _EVEN
    return (low | high) | ((low & high) << np.uint64(1))


def cells(prints: np.ndarray, blocks: int, chosen: int) -> np.ndarray:
    """Cell numbers of each fingerprint, one column for each word and choice of coordinates."""
    unary = embedding(prints)
    edges = [2 * round(32 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for word in range(prints.shape[1]):
        for choice in combinations(masks, chosen):
            cell = (unary[:, word] & np.uint64(sum(choice))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(out) * 0xD6E8FEB86659FD93 % (1 << 64))
            cell ^= cell >> np.uint64(32)
            cell *= np.uint64(0xD6E8FEB86659FD93)
            out.append(cell ^ (cell >> np.uint64(29)))
    return np.stack(out, axis=1)


def _in_reach(prints: np.ndarray, unary: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int) -> np.ndarray:
    """Which of the pairs are in reach: Manhattan distance first, Hamming distance of the rest."""
    left = np.flatnonzero(np.bitwise_count(unary[i] ^ unary[j]).sum(axis=1, dtype=np.int64) <= bits)
    return left[np.bitwise_count(prints[i[left]] ^ prints[j[left]]).sum(axis=1, dtype=np.int64) <= bits]


def pairs_in_cells(cell: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of the pairs in reach that share a cell; equal cells are adjacent."""
    unary = embedding(prints)
    n, found, step = len(cell), [], 0
    rows = np.arange(n)
    while True:  # neighbours at distance 1, then 2, as long as some share a cell
        step += 1
        rows = rows[rows + step < n]
        rows = rows[cell[rows] == cell[rows + step]]
        if not len(rows):
            break
        for at in range(0, len(rows), 1 << 20):
            part = rows[at : at + (1 << 20)]
            found.append(part[_in_reach(prints, unary, part, part + step, bits)] * n + step)
    both = np.concatenate(found) if found else np.zeros(0, np.int64)
    i, step = both // max(n, 1), both % max(n, 1)
    return i, i + step


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (i, j) among n things as (thing, smallest thing of its tree)."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, least[i], low)
        np.minimum.at(new, least[j], low)
        new = new[new]
        if (new == least).all():
            linked = np.flatnonzero(least != np.arange(n))
            return linked, least[linked]
        least = new


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of their cells, cut between cells."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        cell = table.column("cell").to_numpy()
        if not len(cell):
            continue
        last = int(np.searchsorted(cell, cell[-1], "left"))
        if last:
            yield table.slice(0, last)
        held = table.slice(last)
    if held is not None:
        yield held


def _cell_links(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            cell, nodes = table.column("cell").to_numpy(), table.column("node").to_numpy()
            prints = as_words(table.column("print"))
            a, b = forest(len(cell), *pairs_in_cells(cell, prints, bits))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    return run


def _in_tiles(entered: DataFrame, large: DataFrame) -> DataFrame:
    """`entered` (cell, print, others) with each pair of a large cell's tiles as a cell of its own."""
    if large.isEmpty():
        return entered
    others = [c for c in entered.columns if c != "cell"]
    own = F.pmod(F.xxhash64("print"), "tiles").cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.struct(F.least(x, own).alias("x"), F.greatest(x, own).alias("y")))
    split = entered.join(large, "cell").select(F.explode(pair).alias("pair"), "cell", *others)
    split = split.select(F.xxhash64("cell", "pair.x", "pair.y").alias("cell"), *others)
    return entered.join(large, "cell", "left_anti").unionByName(split)


def links(prints: DataFrame, bits: int, blocks: int, chosen: int, tile: int = TILE, held: int | None = None) -> DataFrame:
    """(a, b): a forest that links the nodes of `prints` (node, print; each print once) that meet in a cell within `bits`.

    With `chosen = blocks - bits` and fingerprints of one word that is every link there is. All words make cells;
    `bits` counts in the first `held` words, all by default, which are what travels.
    """

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                whole = part.column("print")
                found = cells(as_words(whole), blocks, chosen)
                sent = whole if held is None else pa.array([x[: 8 * held] for x in whole.to_pylist()], pa.binary())
                again = pa.array(np.repeat(np.arange(len(found)), found.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1).view(np.int64)), sent.take(again), part.column("node").take(again)], ["cell", "print", "node"])

    entered = prints.select("print", "node").mapInArrow(enter, "cell long, print binary, node long")
    large = saved(entered.groupBy("cell").count().where(F.col("count") > tile).select("cell", F.ceil(F.col("count") / (tile // 2)).cast("int").alias("tiles")))
    dealt = _in_tiles(entered, large)
    return dealt.repartition(shuffle_partitions(dealt.sparkSession), "cell").sortWithinPartitions("cell").mapInArrow(_cell_links(bits), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, words: int = 1, bits: int = 4, blocks: int = 7, chosen: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = saved(fingerprints(docs, shingle, words, key, text))
    nodes = saved(prints.groupBy("print").agg(F.min("doc_id").alias("node")).where("node is not null"))
    found = components(links(nodes, bits, blocks, chosen))
    known = saved(nodes.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component_id")))
    return prints.join(known, "print", "left").select("doc_id", F.lower(F.hex("print")).alias("fingerprint"), "component_id")


def _sets(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """(doc_id, print): the fingerprint of the set of shingles, each counted once, and a hash of the set behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in as_bytes(batch.column(1)):
                own = np.unique(shingle_hashes(text, shingle))
                found.append(_print_of(own, words) + xxhash.xxh128_digest(own.tobytes(), SEED))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "print"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, print binary")


def similar(sets: list[np.ndarray], prints: np.ndarray, share: tuple[int, int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the sets in reach whose Jaccard similarity is at least `share`, a fraction."""
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    member = np.zeros(len(codes) + 1, bool)
    fresh, a, b = np.ones(len(sets), bool), [], []
    for root in range(len(sets)):
        if not fresh[root]:
            continue
        fresh[root], left = False, [root]
        while left:
            i = left.pop()
            own = codes[ends[i] - sizes[i] : ends[i]]
            near = np.flatnonzero(fresh)
            near = near[share[1] * np.minimum(sizes[near], sizes[i]) >= share[0] * np.maximum(sizes[near], sizes[i])]
            near = near[np.bitwise_count(prints[near] ^ prints[i]).sum(axis=1, dtype=np.int64) <= bits]
            if not len(near):
                continue
            member[own] = True
            for j in near.tolist():
                common = int(member[codes[ends[j] - sizes[j] : ends[j]]].sum())
                if share[1] * common >= share[0] * (sizes[i] + sizes[j] - common):
                    fresh[j] = False
                    left.append(j)
                    a.append(i)
                    b.append(j)
            member[own] = False
    return np.array(a, np.int64), np.array(b, np.int64)


def _verified(shingle: int, words: int, share: tuple[int, int], bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            cell, nodes = table.column("cell").to_numpy(), table.column("node").to_numpy()
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").slice(at, end - at).to_pylist()]
                prints = np.frombuffer(b"".join(table.column("print").slice(at, end - at).to_pylist()), np.uint64).reshape(len(sets), words)
                a, b = similar(sets, prints, share, bits)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at:end][a]), pa.array(nodes[at:end][b])], ["a", "b"])

    return run


def near_copies(docs: DataFrame, shingle: int, words: int, bits: int, blocks: int, chosen: int, held: int, held_bits: int, share: tuple[int, int], tile: int = TILE) -> DataFrame:
    """(doc_id, component_id) of the rows of `docs` (doc_id, text) with an id.

    Candidates meet in cells and are within `held_bits` in `held` words; their components are as large as the true
    ones or larger. Within each, every pair within `bits` of all words is held against the Jaccard similarity of
    the two sets of shingles, and only links that reach `share` make the components of the result.
    """
    docs = docs.where("doc_id is not null")
    prints = saved(_sets(docs, shingle, words))
    nodes = saved(prints.groupBy("print").agg(F.min("doc_id").alias("node")))
    tables = nodes.select("node", F.substring("print", 1, 8 * words).alias("print"))
    asked = saved(components(links(tables, held_bits, blocks, chosen, tile, held)))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle)) for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_print_of(x, words) for x in sets], pa.binary()), batch.column(1), pa.array([x.tobytes() for x in sets], pa.binary())], ["cell", "print", "node", "shingles"])

    texts = asked.join(docs.withColumnRenamed("doc_id", "node"), "node").select(F.col("component").alias("cell"), "node", "text")
    entered = saved(texts.mapInArrow(enter, "cell long, print binary, node long, shingles binary"))
    large = saved(entered.groupBy("cell").count().where(F.col("count") > tile).select("cell", F.ceil(F.col("count") / (tile // 2)).cast("int").alias("tiles")))
    dealt = _in_tiles(entered, large).repartition(shuffle_partitions(docs.sparkSession), "cell").sortWithinPartitions("cell")
    found = components(dealt.mapInArrow(_verified(shingle, words, share, bits), "a long, b long"))
    known = saved(nodes.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component_id")))
    return prints.join(known, "print").select("doc_id", "component_id")


def first_of_each(docs: DataFrame, words: int = 12, bits: int = 170, blocks: int = 6, chosen: int = 2, held: int = 3, held_bits: int = 52, share: tuple[int, int] = (4, 5), key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without near copies: of each component the row with the smallest id stays, once; rows without an id stay.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, which is counted
    exactly (by 64-bit hashes of the shingles) for every link. Fingerprints of 768 bits only choose what is counted:
    at 0.8 they differ in 115 bits on average, with a standard deviation of 10; README has the share of pairs found.
    """
    docs, names = set_apart(docs, key, text)
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = near_copies(named, 5, words, bits, blocks, chosen, held, held_bits, share)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.where(F.col(key).isNotNull()).join(kept, F.col(key) == F.col("_kept")).drop("_kept")
    return put_back(named.dropDuplicates([key]).unionByName(docs.where(F.col(key).isNull())), names)
