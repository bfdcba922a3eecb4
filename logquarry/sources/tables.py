"""Parsed tables on disk: one result set per archive, replaced as a whole.

`save` and `load` keep a directory for each archive. `commit` and `current` keep generations: the rows of all archives
parsed together lie in one directory, and a manifest names these archives, those without rows included.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest"
ROWS = "rows"


def save(rows: DataFrame, folder: str, order: Sequence[str] = (), key: str = "file_id") -> None:
    """Write a table, replacing only the archives that occur in `rows`.

    Rows are range-partitioned on (archive, order), so a large archive becomes several sorted files
    and many small ones share a task.
    """
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    ranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)


def save_counters(counters: DataFrame, folder: str) -> None:
    """Counter samples, sorted by name and time inside the files so that a series read skips row groups."""
    save(counters, folder, ("name", "ts", "entry_ord", "line_no", "emit_ord"))


def load(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def _manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """(key, generation, set) of every commit, None before the first."""
    try:
        return spark.read.parquet(f"{folder}/{MANIFEST}")
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def commit(rows: DataFrame, archives: DataFrame, folder: str, order: Sequence[str] = (), key: str = "file_id") -> int:
    """Add the rows of newly parsed archives as one generation and return its number.

    `archives` holds the key of each parsed archive. Its earlier rows are gone for readers even if `rows` has none for it
    now; rows of archives that it does not name stay unseen. The manifest is written last: a writer that dies before
    leaves nothing to see, and of two writers of one generation the second fails. Rows are ranged on (archive, order),
    so the number of files follows the amount of rows, not the number of archives. Null keys name no archive.
    """
    spark = rows.sparkSession
    earlier = _manifest(spark, folder)
    last = 0 if earlier is None else earlier.agg(F.max("generation")).first()[0] or 0
    name = f"s-{uuid.uuid4().hex}"
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    ranged.write.parquet(f"{folder}/{ROWS}/set={name}")
    named = archives.where(F.col(key).isNotNull()).select(key).distinct().withColumn("set", F.lit(name))
    named.write.mode("errorifexists").parquet(f"{folder}/{MANIFEST}/generation={last + 1}")
    return last + 1


def current(spark: SparkSession, folder: str, key: str = "file_id") -> DataFrame:
    """Rows of each archive from the last generation that names it."""
    manifest = _manifest(spark, folder)
    if manifest is None:
        raise FileNotFoundError(f"nothing was committed to {folder}")
    newest = manifest.groupBy(key).agg(F.max_by("set", "generation").alias("set"))
    rows = spark.read.parquet(f"{folder}/{ROWS}")
    return rows.join(newest, [key, "set"]).drop("set")


def registry(archives: DataFrame) -> DataFrame:
    """Archives, the newest upload first."""
    return archives.orderBy(F.col("uploaded_at").desc(), "file_id")
