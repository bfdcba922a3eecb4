"""Collocations of two or three words for each language, by best-first branch and bound.

Texts are cut into pieces and words; everything is counted by language (null: `und`). A phrase of at least
`least` occurrences is a candidate; its score is that of its lowest-scoring cut into a first part and a rest,
floor(1000000 a a / (l r)), in decimals of 38 digits: exact while no count passes 10^16. A candidate that lies
inside a longer one with at least half of its occurrences is dropped, and the first `top` of what is left are
the result.

Search: phrases grow to the right. A single word's bound is the whole scale, so all words that occur often
enough are grown at once, by one count of neighbours. A pair w1 w2 with a occurrences bounds its own score and
that of each w1 w2 x by floor(1000000 a / f(w1)), since f(w2 x) is at least f(w1 w2 x) and that is at most a.
The frontier holds the pairs, best bound first. A wave grows all pairs from a cut of the bound on: it counts
just the triples that begin or end with such a pair, which gives the pairs' extensions and tells whether the
pairs themselves are dropped. What is not grown scores below the cut, so a language is settled when `top`
survivors, ties included, reach it, or when nothing is left to grow; the others go on with twice as many pairs.
Cuts and bounds are kept as tables; the driver only asks whether a language is left.

A task counts in a dictionary of at most `ENTRIES` phrases, so a frequent phrase leaves it as one row. A wave
reads the texts once for every `WAVE` pairs; so many keys of at most 64 bytes are what a task is sent.

Defined results: null and empty texts have no words; a document counts as often as its row occurs; ids and other
columns, whatever their names, are not looked at; an empty table gives no rows. Words may have any length.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.llm.common import saved

TOP, LEAST, INSIDE = 2000, 10, 50
SCALE = 1_000_000
#: Phrases a task counts at a time, and pairs that one reading of the texts grows.
ENTRIES, WAVE = 250_000, 200_000
#: Bytes of a pair by which tasks know it; pairs that share them are counted as well, which changes no count.
KEY_BYTES = 64
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_COUNTED = "lang string, size int, phrase string, f long"


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of each piece."""
    for piece in text.translate(_FOLD).split(b"\n"):
        words = piece.split()  # only spaces are left
        if words:
            yield words


def _pairs(words: list[bytes]) -> list[bytes]:
    return [b" ".join(x) for x in zip(words, words[1:], strict=False)]


def _short(words: list[bytes], held: dict[int, Counter]) -> None:
    held[0][b""] += len(words)
    held[1].update(words)
    held[2].update(_pairs(words))


def _grown(words: list[bytes], held: dict[int, Counter], chosen: frozenset[bytes]) -> None:
    """Counts the triples that begin or end with a chosen pair."""
    if len(words) < 3 or not chosen:
        return
    pairs = _pairs(words)
    known = [p[:KEY_BYTES] in chosen for p in pairs]
    if True in known:
        held[3].update(pairs[i] + b" " + words[i + 2] for i in range(len(pairs) - 1) if known[i] or known[i + 1])


def _batch(lang: str, held: dict[int, Counter]) -> pa.RecordBatch:
    size, phrase, f = [], [], []
    for k, counts in held.items():
        size += [k] * len(counts)
        phrase += counts.keys()
        f += counts.values()
    columns = [pa.array([lang] * len(f), pa.string()), pa.array(size, pa.int32()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(f, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "f"])


def _counted(texts: DataFrame, chosen: dict[str, frozenset[bytes]] | None = None, entries: int = ENTRIES) -> DataFrame:
    """(lang, size, phrase, f): words and pairs, with the number of words as size 0; or the triples grown from `chosen`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, Counter]] = defaultdict(lambda: defaultdict(Counter))
        count: Callable = _short if chosen is None else _grown
        room = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, more = held[lang], () if chosen is None else (chosen.get(lang, frozenset()),)
                for words in pieces((text or "").encode()):
                    count(words, own, *more)
                    room += len(words)
                    if room >= entries // 4:  # as many new phrases at most, twice over
                        room = 0
                        if sum(len(c) for by in held.values() for c in by.values()) >= entries // 2:
                            for name, by in held.items():
                                yield _batch(name, by)
                            held.clear()
                            own = held[lang]
        for name, by in held.items():
            yield _batch(name, by)

    rows = texts.mapInArrow(run, _COUNTED)
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCALE a a / (left right)), exact."""
    return F.expr(f"cast(cast({SCALE} as decimal(7,0)) * (cast({a} as decimal(16,0)) * cast({a} as decimal(16,0))) div (cast({left} as decimal(16,0)) * cast({right} as decimal(16,0))) as long)")


def _scored_pairs(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, bound) of the pairs."""
    words = counts.where("size = 1")
    parts = F.split("phrase", " ")
    pairs = counts.where("size = 2").select("lang", "phrase", F.col("f").alias("a"), parts[0].alias("first"), parts[1].alias("rest"))
    pairs = pairs.join(words.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    pairs = pairs.join(words.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    bound = F.expr(f"cast(cast({SCALE} as decimal(7,0)) * cast(a as decimal(16,0)) div cast(l as decimal(16,0)) as long)")
    return pairs.select("lang", "phrase", "a", "l", "r", _score("a", "l", "r").alias("score"), bound.alias("bound"))


def _scored_triples(triples: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): the lower-scoring of the two cuts, the first where they tie."""
    words, pairs = counts.where("size = 1"), counts.where("size = 2")
    parts = F.split("phrase", " ")
    out = triples.select("lang", "phrase", F.col("f").alias("a"), parts[0].alias("w1"), F.concat_ws(" ", parts[1], parts[2]).alias("p2"), F.concat_ws(" ", parts[0], parts[1]).alias("p1"), parts[2].alias("w3"))
    for key, known, name in (("w1", words, "l1"), ("p2", pairs, "r1"), ("p1", pairs, "l2"), ("w3", words, "r2")):
        out = out.join(known.select("lang", F.col("phrase").alias(key), F.col("f").alias(name)), ["lang", key])
    out = out.withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    return out.select("lang", "phrase", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))


def _cuts(pairs: DataFrame, by: str, wanted: DataFrame) -> DataFrame:
    """(lang, cut): the largest value of `by` that `wanted` pairs (lang, wanted) of a language reach; 0 if fewer do.

    Works on how many pairs have each value, of which there are at most SCALE + 1 a language.
    """
    levels = pairs.groupBy("lang", by).agg(F.count("*").alias("n")).withColumnRenamed(by, "level")
    reach = F.sum("n").over(Window.partitionBy("lang").orderBy(F.col("level").desc()))
    reached = levels.withColumn("reach", reach).join(wanted, "lang", "right")
    return reached.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("reach") >= F.col("wanted"), F.col("level"))), F.lit(0)).alias("cut"))


def _waves(fresh: DataFrame, wave: int) -> Iterator[dict[str, frozenset[bytes]]]:
    """The pairs to grow, at most about `wave` at a time, by language."""
    parts = max(1, -(-fresh.count() // wave))
    for i in range(parts):
        chosen: dict[str, set[bytes]] = defaultdict(set)
        part = fresh.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(parts)) == i)
        for row in part.select("lang", F.substring(F.encode("phrase", "utf-8"), 1, KEY_BYTES).alias("key")).toLocalIterator():
            chosen[row.lang].add(bytes(row.key))
        yield {lang: frozenset(keys) for lang, keys in chosen.items()}


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, least: int = LEAST, wave: int = WAVE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")).where("text is not null")
    counts = saved(_counted(texts).where((F.col("f") >= least) | (F.col("size") == 0)))
    pairs = saved(_scored_pairs(counts))
    triples = None
    open_ = saved(pairs.select("lang").distinct())
    cuts = saved(_cuts(pairs, "score", open_.withColumn("wanted", F.lit(2 * top))).withColumn("above", F.lit(SCALE + 1).cast("long")))
    found = None
    while True:
        # the pairs between the cut of this wave and that of the one before
        fresh = saved(pairs.join(cuts, "lang").where((F.col("bound") >= F.col("cut")) & (F.col("bound") < F.col("above"))).select("lang", "phrase"))
        for chosen in _waves(fresh, wave):
            grown = _counted(texts, chosen).where(F.col("f") >= least)
            triples = saved(grown if triples is None else triples.unionByName(grown).dropDuplicates(["lang", "phrase"]))
        inner = F.split("phrase", " ")
        inside = F.explode(F.array(F.concat_ws(" ", inner[0], inner[1]), F.concat_ws(" ", inner[1], inner[2])))
        held = triples.select("lang", inside.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
        own = pairs.join(cuts, "lang").where("bound >= cut").join(held, ["lang", "phrase"], "left")
        own = own.where(F.col("most").isNull() | (100 * F.col("most") < INSIDE * F.col("a")))
        columns = ["lang", "phrase", "a", "l", "r", "score"]
        found = saved(own.select(*columns).unionByName(_scored_triples(triples, counts).select(*columns)))
        reached = found.join(cuts.select("lang", "cut"), "lang").groupBy("lang").agg(F.count(F.when(F.col("score") >= F.col("cut"), 1)).alias("settled"))
        left = cuts.join(reached, "lang", "left").where((F.col("cut") > 0) & (F.coalesce("settled", F.lit(0)) < top)).select("lang", F.col("cut").alias("old"))
        left = saved(left)
        if left.isEmpty():
            break
        grown = pairs.join(left, "lang").groupBy("lang", "old").agg((2 * F.count(F.when(F.col("bound") >= F.col("old"), 1)) + top).alias("wanted"))
        lower = _cuts(pairs, "bound", grown.select("lang", "wanted")).join(left, "lang")
        lower = lower.select("lang", F.least("cut", F.col("old") - 1).alias("lower"), "old")
        stay = cuts.join(lower, "lang", "left")
        cuts = saved(stay.select("lang", F.coalesce("lower", "cut").alias("cut"), F.coalesce("old", "cut").alias("above")))
    n = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    best = found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
    with lines as (
        select row_number() over () as id, coalesce(lang, 'und') as lang,
            unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
        from documents),
    worded as (select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w from lines),
    words as (select lang, unnest(w) as phrase from worded),
    pairs as (select lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as phrase from worded where len(w) >= 2),
    triples as (select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as phrase from worded where len(w) >= 3),
    counted as (
        select lang, 1 as size, phrase, count(*) as f from words group by all
        union all select lang, 2, phrase, count(*) from pairs group by all
        union all select lang, 3, phrase, count(*) from triples group by all),
    totals as (select lang, sum(f)::bigint as n from counted where size = 1 group by lang),
    parts as (
        select lang, phrase, size, f as a, k, string_split(phrase, ' ') as w
        from counted, unnest(range(1, size)) as t(k) where size >= 2 and f >= 10),
    cut as materialized (select *, array_to_string(w[1:k], ' ') || '  ' || lang as head, array_to_string(w[k + 1:], ' ') || '  ' || lang as tail from parts),
    known as materialized (select phrase || '  ' || lang as whole, f from counted where f >= 10 and size < 3),
    scored as (
        select p.lang, p.phrase, p.size, p.a, p.k, x.f as l, y.f as r,
            (1000000::hugeint * p.a * p.a // (x.f::hugeint * y.f))::bigint as score
        from cut p join known x on x.whole = p.head join known y on y.whole = p.tail),
    lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    inner_pairs as (
        select lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as phrase, a from parts where size = 3 and k = 1),
    held as (select lang, phrase, max(a) as most from inner_pairs group by all),
    kept as (select c.* from lowest c left join held using (lang, phrase) where c.size = 3 or held.most is null or 100 * held.most < 50 * c.a)
    select lang, rank, phrase, a, l, r, n, score from (
        select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join totals using (lang)
    where rank <= 2000"""
