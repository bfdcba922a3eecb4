"""What several operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of text bytes that vectorised code looks at together.
GROUP_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; only a local session without that setting gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="logquarry-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def saved(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The rows written once to the shared folder and read back: lineage is cut, a lost executor costs no recomputation."""
    folder = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def set_apart(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with the columns that start like internal ones, except those `used`, under names of their own; and the old names by these."""
    clashing = [c for c in docs.columns if c.startswith("_") and c not in used]
    if not clashing:
        return docs, {}
    prefix = "apart"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    names = {c: f"{prefix}{i}" for i, c in enumerate(clashing)}
    return docs.toDF(*[names.get(c, c) for c in docs.columns]), {new: c for c, new in names.items()}


def put_back(found: DataFrame, names: dict[str, str]) -> DataFrame:
    return found.toDF(*[names.get(c, c) for c in found.columns]) if names else found


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null ids count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def pieces_of(texts: list, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of consecutive byte strings that hold at most `limit` bytes together, or one longer string."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
