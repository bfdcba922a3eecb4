"""Text search over lines: boolean conditions, field filters, context, caps and blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from logquarry.functions.linefields import FieldCondition
from logquarry.functions.matching import Condition
from logquarry.functions.text import clip, fold, folded
from logquarry.operators.ordered import by_lines

# Fixed value: the most context lines that a query text may ask for.
MAX_INLINE_CONTEXT = 30
#: Characters of a file's lines that are searched for sequences together.
GROUP_CHARS = 1 << 20

FILE = ("file_id", "entry_ord", "path")
HIT = (*FILE, "line_no")


def context_size(inline: int = 0, option: int = 0) -> int:
    """Inline sizes are clamped, option values are not; the larger one counts."""
    return max(min(inline, MAX_INLINE_CONTEXT), option)


def _gate(condition: Condition, text: Column) -> Column:
    """Cheap substring test in front of the regular expressions when one literal is mandatory."""
    alternatives = condition.literal_groups()
    if not alternatives or len(alternatives) != 1:
        return condition.on(text)
    longest = max(alternatives[0], key=len)
    return F.when(fold(text).contains(folded(longest)), condition.on(text)).otherwise(False)


def match_lines(
    lines: DataFrame, condition: Condition, paths: Sequence[str] = (), candidates: DataFrame | None = None
) -> DataFrame:
    """Lines that satisfy the condition, of the given paths or candidate files only if any are named."""
    if paths:
        lines = lines.where(F.col("path").isin(list(paths)))
    if candidates is not None:
        lines = lines.join(candidates, list(FILE), "left_semi")
    return lines.where(_gate(condition, F.col("text")))


def file_hits(entries: DataFrame, condition: Condition) -> DataFrame:
    """Files, binary ones included, whose path satisfies the condition."""
    return entries.where(condition.on(F.col("path"))).select("file_id", "entry_ord", "path")


def line_hits(
    hits: DataFrame,
    before: int = 0,
    after: int = 0,
    keep: FieldCondition | None = None,
    file_cap: int | None = None,
) -> DataFrame:
    """Hits marked `filtered` when the field filter rejects them; a rejected hit stays only to anchor context."""
    passes = keep.on(F.col("text")) if keep else F.lit(True)
    rows = hits.withColumn("filtered", ~passes)
    if not before and not after:
        rows = rows.where(~F.col("filtered"))
    if file_cap:
        rows = by_lines(rows).positions("hit_no").where(F.col("hit_no") <= file_cap).rows()
    return rows


def context_lines(
    hits: DataFrame,
    lines: DataFrame,
    before: int,
    after: int,
    keep: FieldCondition | None = None,
    clip_chars: int | None = None,
) -> DataFrame:
    """One row per context line of each hit: the lines above and below in the same file.

    Every hit asks for its line numbers and the lines are fetched by an equality join on
    (file, line number), so no file has to be sorted or held in one task.
    """
    offsets = F.array(*[F.lit(o) for o in range(-before, after + 1) if o])
    wanted = hits.select(*FILE, F.col("line_no").alias("hit_line"), F.explode(offsets).alias("_offset"))
    wanted = wanted.withColumn("line_no", F.col("hit_line") + F.col("_offset"))
    rows = wanted.join(lines.select(*HIT, "text"), list(HIT))
    above, shown = F.col("_offset") < 0, clip(F.col("text"), clip_chars)
    if keep:
        rows = rows.where(keep.on(clip(F.col("text"))))
    return rows.select(*FILE, "hit_line", "line_no", shown.alias("text"), above.alias("before"))


def search(
    lines: DataFrame,
    condition: Condition,
    before: int = 0,
    after: int = 0,
    keep: FieldCondition | None = None,
    paths: Sequence[str] = (),
    candidates: DataFrame | None = None,
    file_cap: int | None = None,
    clip_chars: int | None = None,
) -> DataFrame:
    """Line hits with their context as an array of at most `before + after` lines."""
    hits = line_hits(match_lines(lines, condition, paths, candidates), before, after, keep, file_cap)
    hits = hits.select(*HIT, clip(F.col("text"), clip_chars).alias("text"), "filtered")
    if not before and not after:
        empty = F.array().cast("array<struct<line_no:bigint,text:string,before:boolean>>")
        return hits.withColumn("context", empty)
    context = context_lines(hits, lines, before, after, keep, clip_chars)
    nested = context.groupBy(*FILE, F.col("hit_line").alias("line_no")).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "text", "before"))).alias("context")
    )
    joined = hits.join(nested, list(HIT), "left")
    return joined.where(~F.col("filtered") | F.col("context").isNotNull())


def outcome(
    results: DataFrame, files: DataFrame, file_id: str | None = None, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Results in archive order, file-name hits before line hits, and a summary row per archive.

    A limit keeps the first so many rows; the summary counts all of them and says whether it cut any.
    """
    rows = files.select(*FILE, F.lit("file").alias("type")).unionByName(
        results.withColumn("type", F.lit("line")), allowMissingColumns=True
    )
    if file_id is not None:
        rows = rows.where(F.col("file_id") == file_id)
    kept = rows.orderBy("file_id", "entry_ord", "type", F.col("line_no").asc_nulls_first())
    total = F.count(F.lit(1)).alias("total")
    cut = F.lit(False) if limit is None else F.col("total") >= limit
    summary = rows.groupBy("file_id").agg(total, F.count_if(F.col("type") == "line").alias("line_hits"))
    return kept if limit is None else kept.limit(limit), summary.withColumn("truncated", cut)


def blocks(results: DataFrame) -> DataFrame:
    """Block number of every hit: it continues the previous block when its context touches the previous hit's."""
    low = F.array_min(F.transform("context", lambda c: c["line_no"]))
    high = F.array_max(F.transform("context", lambda c: c["line_no"]))
    rows = results.select(
        *HIT, F.least("line_no", low).alias("first_line"), F.greatest("line_no", high).alias("last_line")
    )
    ordered = by_lines(rows).shift({"_end": "last_line"})
    starts = F.when(F.col("first_line") <= F.col("_end") + 1, 0).otherwise(1)
    return ordered._with(ordered.df.withColumn("_start", starts)).running({"block": "_start"}).rows().drop("_start", "_end")


def search_entries(
    entries: DataFrame, condition: Condition, before: int = 0, after: int = 0, keep: FieldCondition | None = None
) -> DataFrame:
    """Structured entries that match or lie inside the merged context of matches, with gap flags."""
    shown = F.concat_ws(" ", "ts_text", "label", "msg")
    order = ("line", "part_no")
    rows = by_lines(entries, order=order, line="line").positions("idx").rows()
    rows = rows.withColumn("match", condition.on(shown))
    near = F.array(*[F.lit(o) for o in range(-before, after + 1)])
    around = rows.where("match").select(*FILE, "idx", F.explode(near).alias("_offset"))
    wanted = around.select(*FILE, (F.col("idx") + F.col("_offset")).alias("idx")).distinct()
    kept = rows.join(wanted, [*FILE, "idx"], "left_semi")
    if keep:
        kept = kept.where(keep.on(shown))
    gaps = by_lines(kept, order=("idx",), line="idx").shift({"_previous": "idx"}).rows()
    return gaps.withColumn("gap", F.coalesce(F.col("idx") > F.col("_previous") + 1, F.lit(False))).drop("_previous")


def match_count(shown: DataFrame) -> DataFrame:
    return shown.groupBy(*FILE).agg(F.count_if("match").alias("matches"))


def trigrams(lines: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """Distinct case-folded three-character sequences per file; of the named ones if any are.

    Saved once, the whole table serves any search; one search needs no more than its own sequences.
    """
    told = lines.select(*FILE, fold(F.col("text")).alias("text"))
    grams = told.mapInArrow(_grams(only), StructType(told.schema.fields[:-1]).add("tris", ArrayType(StringType())))
    return grams.select(*FILE, F.explode("tris").alias("tri")).distinct()


def pieces(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) that hold at most GROUP_CHARS together, or one larger member."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > GROUP_CHARS:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def _sequences(texts: list[str]) -> np.ndarray:
    """Distinct sequences of three characters within the texts, 21 bits for each character."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.uint64)
    within = np.ones(len(codes), bool)
    ends = np.cumsum([len(t) for t in texts])
    within[ends - 1] = within[ends - 2] = False
    return np.unique((codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[within[:-2]])


def _spelled(found: np.ndarray) -> pa.Array:
    """The sequences as strings."""
    codes = np.stack([found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF], 1).astype("<u4")
    ends = np.cumsum((1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)).sum(axis=1))
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(found), pa.py_buffer(offsets), pa.py_buffer(codes.tobytes().decode("utf-32-le").encode()))


def _grams(only: Sequence[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up the lines of a file that come together: (file, its distinct sequences), of the named ones if any are."""

    wanted = None if only is None else np.unique(np.concatenate([_sequences([t]) for t in ["", *only]]))

    def rows(batch: pa.RecordBatch, picked: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        offsets = np.cumsum([0, *(len(found) for _, found in picked)]).astype(np.int32)
        tris = pa.ListArray.from_arrays(offsets, _spelled(np.concatenate([found for _, found in picked])))
        at = pa.array([i for i, _ in picked], pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in FILE), tris], [*FILE, "tris"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = zip(*(batch.column(c).to_pylist() for c in FILE), strict=True), batch.column("text").to_pylist()
            picked, size = [], 0
            for _, own in groupby(enumerate(keys), key=lambda x: x[1]):
                numbers = [i for i, _ in own]
                for a, b in pieces([len(texts[i] or "") for i in numbers]):
                    found = _sequences([texts[i] or "" for i in numbers[a:b]])
                    found = found if wanted is None else np.intersect1d(found, wanted, assume_unique=True)
                    if len(found):
                        picked.append((numbers[a], found))
                        size += len(found)
                    if size > GROUP_CHARS:
                        yield rows(batch, picked)
                        picked, size = [], 0
            if picked:
                yield rows(batch, picked)

    return run


def split_common(grams: DataFrame, max_files: int) -> tuple[DataFrame, DataFrame]:
    """(selective trigrams, trigrams found in more than `max_files` files of one archive).

    The latter prune next to nothing; a search skips them, which keeps every hit.
    """
    frequency = grams.groupBy("file_id", "tri").agg(F.count(F.lit(1)).alias("files"))
    common = frequency.where(F.col("files") > max_files).select("file_id", "tri")
    return grams.join(common, ["file_id", "tri"], "left_anti"), common


def literal_trigrams(literal: str) -> list[str]:
    whole = folded(literal)
    return sorted({whole[i : i + 3] for i in range(len(whole) - 2)})


def needed_trigrams(condition: Condition) -> list[str]:
    """The sequences that `candidates` looks at for a condition."""
    return sorted({t for group in condition.literal_groups() or () for x in group for t in literal_trigrams(x)})


def candidates(files: DataFrame, grams: DataFrame, common: DataFrame, condition: Condition) -> DataFrame:
    """Files that may hold a match: all selective trigrams of one alternative are present.

    An alternative with no selective trigram in an archive constrains nothing there.
    """
    alternatives = condition.literal_groups()
    if alternatives is None:
        return files.select(*FILE).distinct()
    spark = files.sparkSession
    pairs = [(i, t) for i, group in enumerate(alternatives) for t in sorted({t for x in group for t in literal_trigrams(x)})]
    wanted = spark.createDataFrame(pairs, "alt int, tri string")
    sizes = {i: sum(1 for p in pairs if p[0] == i) for i in range(len(alternatives))}
    size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    skipped = common.join(F.broadcast(wanted), "tri").groupBy("file_id", "alt").agg(F.count(F.lit(1)).alias("skipped"))
    present = grams.join(F.broadcast(wanted), "tri").groupBy(*FILE, "alt").agg(F.count(F.lit(1)).alias("present"))
    need = size[F.col("alt")] - F.coalesce("skipped", F.lit(0))
    found = present.join(skipped, ["file_id", "alt"], "left").where(F.col("present") == need).select(*FILE)
    free = skipped.where(size[F.col("alt")] == F.col("skipped")).select("file_id").distinct()
    open_files = files.select(*FILE).distinct()
    if 0 not in sizes.values():
        open_files = open_files.join(free, "file_id", "left_semi")
    return found.unionByName(open_files).distinct()
