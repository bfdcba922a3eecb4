"""From raw documents to a training mix: five stages, each one operator of `logquarry.llm`.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; all but the last keep the columns of
`documents`. Rows, nulls and clashing columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from logquarry.llm import decontaminate, mixing, sanitise, simhash, toxicity  # noqa: E402
from logquarry.llm.common import saved  # noqa: E402
from logquarry.shipping import shipped  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of documents that are not held out."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.first_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that give it away are replaced by the names of their kinds."""
    return sanitise.sanitised(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that tokens meet the targets of source, language and topic."""
    return mixing.sampled(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", shipped(drop_toxic)),
    ("simhash_near_dedup", shipped(drop_near_copies)),
    ("benchmark_decontamination", shipped(drop_benchmark)),
    ("pii", shipped(hide_private)),
    ("mixing", shipped(mix)),
]

#: Fitted trees, XXH64 and edit distances have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
