"""Labelled rows for the classifiers: which rows may teach, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import fold, saved

#: Rows are held out where crc32 of the id leaves this remainder.
FOLDS, HELD_OUT = 5, 0


def held_out(key: str = "doc_id"):
    return fold(F.col(key), FOLDS) == HELD_OUT


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, parts: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label, part): about `rows` labelled rows that are not held out, drawn by a hash of the id.

    Rows with a null id, text or label teach nothing; of labels that repeat an id the largest counts. Both
    classes are drawn at the same rate. `part` (0 to parts - 1) splits the sample into disjoint steps of fitting.
    The sample's ids are sent to every task: their number is bounded by `rows`, whatever the size of the tables.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
    usable = usable.groupBy(F.col(key).cast("long").alias("_key")).agg(F.max(label).cast("double").alias("label"))
    number = F.pmod(F.xxhash64("_key", F.lit(17)), F.lit(1 << 30))
    known = usable.count()
    drawn = usable.where(number < F.lit(round((1 << 30) * min(1.0, rows / max(known, 1)))))
    drawn = drawn.withColumn("part", F.pmod(F.xxhash64("_key", F.lit(23)), F.lit(parts)).cast("int"))
    texts = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("text"))
    return saved(texts.where("text is not null").join(F.broadcast(drawn), "_key").select("_key", "text", "label", "part"))
