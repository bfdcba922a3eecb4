"""Language ID: unigram probabilities of vocabulary pieces for each language, summed over all segmentations.

The vocabulary is a public one and fixed; a language has a probability for each piece. A word's probability
is the sum over all ways to write it in pieces of the product of their probabilities, found by the forward
algorithm; a text's is the product over its words. The text gets the language that makes it likeliest.

Probabilities are fitted by expectation maximisation over the same lattices, on the words of at most about
`TRAIN_DOCS` documents of each language. A character that no piece covers has a piece of its own kind.

Defined results: words are runs of letters, in lower case; a null text and one without a letter are `und`
with score 0, as is every text if nothing can be learned; rows with a null lang teach nothing; words longer
than `LONGEST` letters are taken in stretches of that length; repeated rows are judged alike; ties go to the
first language by name; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquarry.llm.common import fold, pieces_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, HELD_OUT = 4, 2
#: Documents and different words of a language that teach at most.
TRAIN_DOCS, TRAIN_WORDS = 1500, 20_000
ROUNDS, SMOOTHING = 5, 0.02
LONGEST, LONGEST_PIECE = 24, 10
#: Words a task remembers.
REMEMBERED = 250_000
#: The score is the posterior of so many words at most.
SCORE_WORDS = 20
UNKNOWN = "und"
START = "▁"

#: Signs that count as word characters and as no decimal, but are no letters either; Java's letters leave them out as well.
_SIGNS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No"))
_WORD = re.compile(rf"[^\W\d_{re.escape(_SIGNS)}]+")
#: Runs of letters and signs, whole and in stretches: these small classes match many times faster than the one above.
_RUN, _STRETCH = re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")


def vocabulary(path: str = VOCABULARY) -> list[str]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return sorted({p for p in pieces if p == p.lower() and len(p) <= LONGEST_PIECE})


class Pieces:
    """Numbers of the vocabulary's pieces by their hash, looked up for whole arrays at a time."""

    BITS = 21

    def __init__(self, pieces: list[str]):
        self.count = len(pieces)
        self.hashes = np.zeros(self.count, np.uint64)
        codes = _codes(pieces, LONGEST_PIECE)
        for length, h in _substrings(codes, LONGEST_PIECE):
            own = np.array([len(p) == length for p in pieces], bool)
            self.hashes[own] = h[0, own]
        # pieces whose place is taken go to the next table
        self.tables, left = [], np.arange(self.count)
        while len(left):
            table = np.full(1 << self.BITS, -1, np.int32)
            place = self._place(self.hashes[left], len(self.tables))
            _, first = np.unique(place, return_index=True)
            table[place[first]] = left[first]
            self.tables.append(table)
            left = np.delete(left, first)

    def _place(self, h: np.ndarray, table: int) -> np.ndarray:
        return ((h * np.uint64(2 * table + 0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        out = self.tables[0][self._place(h, 0)]
        at = np.flatnonzero(out >= 0)
        at = at[self.hashes[out[at]] != h[at]]
        out[at] = -1
        # a piece is in a later table only where its place in those before is taken
        for i, table in enumerate(self.tables[1:], 1):
            found = table[self._place(h[at], i)]
            at, found = at[found >= 0], found[found >= 0]
            same = self.hashes[found] == h[at]
            out[at[same]] = found[same]
            at = at[~same]
        return out


def _codes(words: list[str], width: int) -> np.ndarray:
    """(position, word) code points, zeros after a word's end."""
    codes = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    return np.ascontiguousarray(codes.T).astype(np.uint64)


def _substrings(codes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of the substring of that length at each start)."""
    signs = codes * np.uint64(0xD6E8FEB86659FD93)
    h = np.zeros_like(signs)
    for length in range(1, min(longest, len(codes)) + 1):
        n = len(codes) - length + 1
        h = h[:n] * np.uint64(0x9E3779B97F4A7C15) + (signs[length - 1 :] ^ (signs[length - 1 :] >> np.uint64(32)))
        yield length, h


class Lattice:
    """All pieces of some words: edges (word, from, to, piece). The piece after the last of the vocabulary is the unknown character."""

    def __init__(self, words: list[str], known: Pieces):
        codes = _codes([START + w for w in words], max(map(len, words), default=0) + 1)
        self.size = np.array([len(w) + 1 for w in words], np.int64)
        self.width = int(self.size.max(initial=0)) + 1
        #: by end: (length, range of edges) with one edge of a word at most, shorter ones first
        self.into: list[list[tuple[int, slice]]] = [[] for _ in range(self.width)]
        parts, count = [], 0
        for length, h in _substrings(codes, LONGEST_PIECE):
            start, row = np.nonzero(codes[length - 1 :])
            piece = known.find(h[start, row]).astype(np.int64)
            if length == 1:
                piece[piece < 0] = known.count
            held = np.flatnonzero(piece >= 0)
            start = start[held]
            parts.append((row[held], start, start + length, piece[held]))
            borders = np.searchsorted(start, np.arange(len(codes) - length + 2)) + count
            count += len(start)
            for i, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)):
                if a < b:
                    self.into[i + length].append((length, slice(a, b)))
        self.row, self.start, self.end, self.piece = (np.concatenate(x) for x in zip(*parts, strict=True))

    def edges(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, words, pieces), in order of `to`."""
        for end, held in enumerate(self.into):
            for length, own in held:
                yield end - length, end, self.row[own], self.piece[own]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """(position, word, language): probability of the word up to the position."""
        alpha = np.zeros((self.width, len(self.size), p.shape[1]))
        alpha[0] = 1
        for start, end, row, piece in self.edges():
            alpha[end, row] += alpha[start, row] * p[piece]
        return alpha

    def whole(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[self.size, np.arange(len(self.size))]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is used, given how often each word is."""
        alpha = self.forward(p)
        share = counts / self.whole(alpha)
        beta = np.zeros_like(alpha)
        beta[self.size, np.arange(len(self.size))] = 1
        out = np.zeros_like(p)
        for start, end, row, piece in reversed([*self.edges()]):
            after = p[piece] * beta[end, row]
            beta[start, row] += after
            np.add.at(out, piece, alpha[start, row] * after * share[row])
        return out


def fitted(words: list[str], counts: np.ndarray, known: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """(piece, language) probabilities; `counts` has a column for each language."""
    lattice = Lattice(words, known)
    p = np.full((known.count + 1, counts.shape[1]), 1.0 / (known.count + 1))
    for _ in range(rounds):
        used = lattice.expected(p, counts) + SMOOTHING
        p = used / used.sum(axis=0)
    return p


def words_of(text: str) -> list[str]:
    """The words of a text, long ones in stretches."""
    words = _STRETCH.findall(text.lower())
    if not words or "".join(words).isalpha():
        return words
    # some run holds a sign that is no letter
    runs = (w for run in _RUN.findall(text.lower()) for w in ((run,) if run.isalpha() else _WORD.findall(run)))
    return [w[i : i + LONGEST] for w in runs for i in range(0, len(w), LONGEST)]


class Scorer:
    """Log probabilities of texts in each language; remembers words."""

    def __init__(self, known: Pieces, p: np.ndarray):
        self.known, self.p = known, p
        self.numbers: dict[str, int] = {}
        self.scores = np.zeros((0, p.shape[1]))

    def _learn(self, words: set[str]) -> None:
        if len(self.numbers) + len(words) > REMEMBERED:
            self.numbers, self.scores = {}, np.zeros((0, self.p.shape[1]))
        # words of one length lie together, which leaves little room unused
        new = sorted((w for w in words if w not in self.numbers), key=len)
        added = [self.scores]
        for at in range(0, len(new), 20_000):
            lattice = Lattice(new[at : at + 20_000], self.known)
            added.append(np.log(lattice.whole(lattice.forward(self.p))))
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        self.scores = np.concatenate(added)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, language) log probabilities and the number of words of each text."""
        sums, sizes = np.zeros((len(texts), self.p.shape[1])), np.zeros(len(texts), np.int64)
        for a, b in pieces_of(texts):
            words = [words_of(t) for t in texts[a:b]]
            self._learn(set(chain.from_iterable(words)))
            get = self.numbers.__getitem__
            for i, own in enumerate(words, a):
                sizes[i] = len(own)
                if own:
                    sums[i] = self.scores[np.fromiter(map(get, own), np.int64, len(own))].sum(axis=0)
        return sums, sizes


def learned_words(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[list[str], list[str], np.ndarray]:
    """(languages, words, counts) from a bounded draw of the documents that are not held out."""
    usable = docs.where((fold(F.col(key), FOLDS) != HELD_OUT) & F.col(lang).isNotNull())
    known = {r.lang: r["count"] for r in usable.groupBy(F.col(lang).cast("string").alias("lang")).count().collect()}
    if not known:
        return [], [], np.zeros((0, 0))
    rates = F.create_map(*chain.from_iterable((F.lit(k), F.lit(TRAIN_DOCS / n)) for k, n in known.items()))
    number = F.pmod(F.xxhash64(key, F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.where(number < rates[F.col(lang).cast("string")]).where(F.col(text).isNotNull())
    words = drawn.select(F.col(lang).cast("string").alias("lang"), F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    seen = words.where(F.length("word") <= LONGEST).groupBy("lang", "word").count()
    order = Window.partitionBy("lang").orderBy(F.col("count").desc(), "word")
    rows = seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TRAIN_WORDS).select("lang", "word", "count").collect()
    languages = sorted({r.lang for r in rows})
    listed = sorted({r.word for r in rows})
    numbers = {w: i for i, w in enumerate(listed)}
    counts = np.zeros((len(listed), len(languages)))
    for r in rows:
        counts[numbers[r.word], languages.index(r.lang)] = r["count"]
    return languages, listed, counts


def predicted(docs: DataFrame, path: str = VOCABULARY, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    languages, words, counts = learned_words(docs, text, lang, key)
    known = Pieces(vocabulary(path))
    model = docs.sparkSession.sparkContext.broadcast((known, fitted(words, counts, known) if languages else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value) if languages else None
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if scorer is not None:
                sums, sizes = scorer.of(texts)
                best = sums.argmax(axis=1)
                scale = np.minimum(1.0, SCORE_WORDS / np.maximum(sizes, 1))[:, None]
                chances = 1 / np.exp((sums - sums.max(axis=1, keepdims=True)) * scale).sum(axis=1)
                names = [languages[k] if n else UNKNOWN for k, n in zip(best.tolist(), sizes.tolist(), strict=True)]
                scores = np.where(sizes > 0, chances, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
