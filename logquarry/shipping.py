"""Sends this package to the executors, which need it to run the functions that it hands to Spark."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: the package as an archive that Spark fetches to every executor, new ones included."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    archive = Path(tempfile.mkdtemp(prefix="logquarry-")) / "logquarry.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(ROOT.rglob("*.py")):
            out.write(source, source.relative_to(ROOT.parent))
    context.addPyFile(str(archive))
    _sent.add(context.applicationId)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, with the package sent before it runs; the session is its first argument."""

    @wraps(query)
    def run(spark: SparkSession, *rest):
        ship(spark)
        return query(spark, *rest)

    return run
