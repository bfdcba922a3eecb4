"""Quality by compression: zstandard dictionaries of good and of bad text, and which of them shortens a text more.

A text is compressed in chunks of `CHUNK` bytes, once with a dictionary built from good labelled texts and
once with one built from bad ones. The difference of the two sizes over their sum says which kind the text
resembles; a logistic curve over it, and over what the good dictionary leaves of a byte, gives the score.

Fitting uses at most about `TRAIN_ROWS` labelled rows in two disjoint parts, one for the dictionaries and one
for the curve. Dictionaries have at most `DICTIONARY_BYTES`. Scoring reads every text whole, in the task that
reads the row.

Defined results: null and empty texts have size 0 and the score of the share of good rows; repeated rows score
alike; labels that are null, or belong to no document, teach nothing; without usable labels of both classes
every score is the share of good labels (0.5 without any); an empty table gives no rows; other columns are
kept, those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from logquarry.llm.common import as_bytes, put_back, set_apart
from logquarry.llm.labelled import held_out, training_sample

TRAIN_ROWS = 12_000
CHUNK = 2048
DICTIONARY_BYTES = 112 << 10
#: Bytes of labelled text that a dictionary is built from.
TRAIN_BYTES = 8 << 20
#: Longer labelled texts build no dictionary, and so many of a side do at most.
TRAIN_TEXT, TRAIN_TEXTS = 20 << 10, 1500
LEVEL = 3
THRESHOLD = 0.3


def chunks(text: bytes) -> list[bytes]:
    return [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of the texts' common strings; plain text where there is too little to train on."""
    parts = [c for t in texts for c in chunks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:]


class Sizes:
    """Compressed sizes under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.sides = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (good, bad)]

    def of(self, text: bytes) -> tuple[int, int]:
        parts = chunks(text)
        return tuple(sum(len(side.compress(p)) for p in parts) for side in self.sides)

    def signals(self, text: bytes) -> tuple[float, float, float]:
        """Difference of the sizes over their sum, the good size over the text's own, and that it has a size at all."""
        if not text:
            return 0.0, 0.0, 0.0
        good, bad = self.of(text)
        return (bad - good) / (bad + good), min(good / len(text), 2.0), 1.0


def basis(signals: np.ndarray) -> np.ndarray:
    """Columns of the curve: the signals, squares and product, and a constant."""
    d, r, held = signals.T
    d, r = 10 * d, r - 0.4 * held
    return np.column_stack([d, d * d, r, r * r, d * r, held, np.ones(len(d))])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Weights by Newton steps with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-6) * np.eye(len(w)), gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _within(rows: list, limit: int = TRAIN_BYTES) -> list:
    total = np.cumsum([len(t) for t, _ in rows]) if rows else []
    return [r for r, n in zip(rows, total, strict=True) if n <= limit]


class Model:
    """Two dictionaries and the curve."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text"):
        sample = training_sample(docs, labels, label, rows, 2, key, text)
        counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
        self.share = counts.get(1.0, 0) / sum(counts.values()) if counts else 0.5
        self.weights = None
        if len(counts) < 2:
            return
        sides = []
        for side in (1.0, 0.0):
            # the first rows in the order of a hash, up to the bytes that a dictionary is built from
            drawn = sample.where((F.col("part") == 0) & (F.col("label") == side)).withColumn("n", F.octet_length("text"))
            taken = drawn.where(F.col("n") <= F.lit(TRAIN_TEXT)).orderBy(F.xxhash64("_key")).limit(TRAIN_TEXTS).select("text").collect()
            sides.append(dictionary([t for t, _ in _within([(r.text.encode(), side) for r in taken])]))
        self.good, self.bad = sides
        fitted = self._signals(sample.where("part = 1").select("text", "label")).select("_signals", "label").collect()
        if len({r.label for r in fitted}) == 2:
            signals, y = np.array([r._signals for r in fitted]), np.array([r.label for r in fitted])
            self.weights = logistic(basis(signals), y)

    def _signals(self, docs: DataFrame, text: str = "text") -> DataFrame:
        good, bad = self.good, self.bad
        at = docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sizes = Sizes(good, bad)
            for batch in batches:
                found = [list(sizes.signals(t)) for t in as_bytes(batch.column(at))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], [*batch.schema.names, "_signals"])

        return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_signals", ArrayType(DoubleType()))]))

    def scored(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """`docs` with `score` and `predicted`."""
        docs, names = set_apart(docs.drop("score", "predicted"), text)
        if self.weights is None:
            score = F.lit(self.share)
            return put_back(docs.withColumn("score", score).withColumn("predicted", (score >= THRESHOLD).cast("int")), names)
        w = [float(x) for x in self.weights]
        d, r, held = 10 * F.col("_signals")[0], F.col("_signals")[1] - 0.4 * F.col("_signals")[2], F.col("_signals")[2]
        z = w[0] * d + w[1] * d * d + w[2] * r + w[3] * r * r + w[4] * d * r + w[5] * held + w[6]
        score = F.when(held > 0, 1 / (1 + F.exp(-z))).otherwise(F.lit(self.share))
        rows = self._signals(docs, text).withColumn("score", score)
        return put_back(rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).drop("_signals"), names)


def report(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return Model(docs, labels, key=key, text=text).scored(rows).select("doc_id", held_out().alias("held_out"), "score", "predicted")
