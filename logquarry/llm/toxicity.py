"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features are rates for each word or character of the whole text: words of a public list of insults, words
and word beginnings learned from labelled rows, such words within `REACH` words of a second-person pronoun,
capitals, punctuation marks, and words in which letters are replaced by digits or signs.

Fitting uses at most about `TRAIN_ROWS` labelled rows in three disjoint parts: one teaches the list of
words, one the trees, one the calibration. Scoring reads every text whole, in the task that reads the row.

Defined results: null, empty and wordless texts have all rates 0 and the score of that point; repeated
rows score alike; labels that are null, or belong to no document, teach nothing; without any usable label
of both classes every score is 0; an empty table gives no rows; other columns are kept, those named like a
result column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from logquarry.llm.common import put_back, set_apart
from logquarry.llm.labelled import held_out, training_sample

#: About so many labelled rows are used for fitting.
TRAIN_ROWS = 12_000
#: A learned word or beginning stands in so many toxic rows, nearly only there, and no more than these are kept.
MIN_ROWS, MIN_PURITY, MAX_TERMS = 4, 0.8, 5000
BEGINNING = 5
REACH = 3
THRESHOLD = 0.5

# Common insults and second-person pronouns of the languages served.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown clowns fool fools jerk filthy "
    "dummkopf trottel abschaum versager arschloch blödmann widerlich wertlos "
    "imbécile crétin connard abruti ordure débile minable dégoûtant "
    "imbécil estúpido estúpida basura escoria asqueroso patético inútil".split()
)
PRONOUNS = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro".split())

FEATURES = ("insult", "learned", "learned_start", "near_you", "capitals", "shouted", "exclaimed", "marks", "obfuscated", "log_words")
_WORD = re.compile(r"(?:(?<![@$!|0-9])[@$!|0-9]{1,8})?[^\W\d_]+(?:['*@$!|0-9]+[^\W\d_]+)*")
_ODD = re.compile(r"['*@$!|0-9]")
_PLAIN = str.maketrans("0134578@$!|", "oieastbasil")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_MARKS = re.compile(r"[^\w\s]")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


def features(text: str, learned: frozenset[str], starts: frozenset[str]) -> tuple[float, ...]:
    words = words_of(text)
    n = max(len(words), 1)
    lower = [w.lower() for w in words]
    counts = Counter(lower)
    odd = {w: w.translate(_PLAIN).replace("*", "").replace("'", "") for w in counts if _ODD.search(w)}
    kinds = {w: (w in INSULTS or odd.get(w) in INSULTS, w in learned or odd.get(w) in learned, w[:BEGINNING] in starts) for w in counts}
    listed = [sum(c for w, c in counts.items() if kinds[w][k]) for k in range(3)]
    bad = {w for w in counts if any(kinds[w])}
    near = 0
    if bad and not PRONOUNS.isdisjoint(counts):
        said = [i for i, w in enumerate(lower) if w in PRONOUNS]
        at = np.searchsorted(said, hits := np.array([i for i, w in enumerate(lower) if w in bad]))
        places = np.array([-REACH - 1, *said, len(lower) + REACH + 1])
        near = int(((hits - places[at] <= REACH) | (places[at + 1] - hits <= REACH)).sum())
    chars = max(len(text), 1)
    shouted = sum(w.isupper() and len(w) > 2 for w in words)
    return (
        listed[0] / n,
        listed[1] / n,
        listed[2] / n,
        near / n,
        len(_CAPITALS.findall(text)) / chars,
        shouted / n,
        (text.count("!") + text.count("?")) / chars,
        len(_MARKS.findall(text)) / chars,
        sum(counts[w] for w in odd) / n,
        float(np.log1p(len(words))),
    )


def learned_terms(sample: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """(words, beginnings) that mark toxic rows; at most `MAX_TERMS` of them come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, labels = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {w.lower() for w in words_of(text)}
                own |= {w[:BEGINNING] + "-" for w in own if len(w) > BEGINNING}
                terms += own
                labels += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(labels, pa.float64())], ["term", "label"])

    seen = sample.select("text", "label").mapInArrow(run, "term string, label double").groupBy("term").agg(F.sum("label").alias("toxic"), F.count("*").alias("rows"))
    best = seen.where((F.col("toxic") >= MIN_ROWS) & (F.col("toxic") / F.col("rows") >= MIN_PURITY)).orderBy(F.col("toxic").desc(), "term").limit(MAX_TERMS).select("term").collect()
    terms = [r.term for r in best]
    return frozenset(t for t in terms if t[-1] != "-"), frozenset(t[:-1] for t in terms if t[-1] == "-")


def with_features(docs: DataFrame, learned: frozenset[str], starts: frozenset[str], text: str = "text") -> DataFrame:
    """`docs` with the features as columns `_f_...`."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t or "", learned, starts) for t in batch.column(text).to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *[f"_f_{n}" for n in FEATURES]])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *[StructField(f"_f_{n}", DoubleType()) for n in FEATURES]]))


class Model:
    """Fitted terms, trees and calibration."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text"):
        sample = training_sample(docs, labels, label, rows, 3, key, text)
        self.learned, self.starts = learned_terms(sample.where("part = 0"))
        self.gather = VectorAssembler(inputCols=[f"_f_{n}" for n in FEATURES], outputCol="_vector")
        rest = self.gather.transform(with_features(sample.where("part > 0").select("text", "label", "part"), self.learned, self.starts)).select("_vector", "label", "part").coalesce(2).cache()
        sides = {(r.part, r.label) for r in rest.select("part", "label").distinct().collect()}
        self.trees = self.curve = None
        if {(1, 0.0), (1, 1.0)} <= sides:
            self.trees = GBTClassifier(featuresCol="_vector", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.3, seed=5, cacheNodeIds=False).fit(rest.where("part = 1"))
            self.trees.setRawPredictionCol("_raw").setProbabilityCol("_chance").setPredictionCol("_class")
            if {(2, 0.0), (2, 1.0)} <= sides:
                margins = self._margins(rest.where("part = 2"))
                self.curve = IsotonicRegression(featuresCol="_margin", labelCol="label", predictionCol="_score").fit(margins)
        rest.unpersist()

    def _margins(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(rows).withColumn("_margin", F.get(vector_to_array("_raw"), 1))

    def judged(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """`docs` with `_tox`: score and predicted."""
        if self.trees is None:
            return docs.withColumn("_tox", F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("predicted")))
        rows = self._margins(self.gather.transform(with_features(docs, self.learned, self.starts, text)))
        # the curve is a step function: the margin keeps scores apart that it makes equal
        plain = 1 / (1 + F.exp(-2 * F.col("_margin")))
        score = plain if self.curve is None else 0.98 * F.col("_score") + 0.02 * plain
        rows = rows if self.curve is None else self.curve.transform(rows)
        return rows.withColumn("_tox", F.struct(score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))).select(*docs.columns, "_tox")

    def scored(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """`docs` with `score` and `predicted`."""
        docs, names = set_apart(docs, text)
        found = self.judged(docs, text).withColumns({"score": F.col("_tox.score"), "predicted": F.col("_tox.predicted")}).drop("_tox")
        return put_back(found, names)


def report(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return Model(docs, labels, key=key, text=text).scored(rows).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that are not toxic."""
    docs, names = set_apart(docs, key, text)
    return put_back(Model(docs, labels, key=key, text=text).judged(docs, text).where("_tox.predicted = 0").drop("_tox"), names)
