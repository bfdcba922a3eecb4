"""Personal data: patterns with checks, and terms that give a protected entity away; DataFrame functions only.

Base spans are leftmost non-overlapping matches of a kind's pattern in the whole text; matches that fail
their check are dropped. Spans count code points, the end is exclusive. The patterns run possessively and
start only where a run of their characters starts (or the last match ended), so no text takes quadratic time.

Terms: the values found are the protected entities; words are runs of letters and digits outside of emails,
less the digits of the text's other values. Over all different texts, n(t) hold the term, n(e) the entity and
n(t, e) both. Seeing the term makes the entity P(e|t) = n(t,e) / (n(t) + 1) likely, the estimate that one text
more without the entity would leave, and is worth log2(P(e|t) / P(e)) bits. Terms beyond both thresholds are
spans of kind `term` wherever they stand as whole words. What stands in one text alone is never beyond 1/2.
`sanitised` generalises every span to the name of its kind.

No pair is left out by a cap: n(t) + 1 <= n(e) / `min_chance` follows from n(t, e) <= n(e), and of entities of
the very same texts, which have the same counts, one is counted. Words are known by 64-bit hashes.

Defined results: a null text counts as empty and has no spans (`sanitised` leaves it null); rows of equal texts
count as one and have the same spans, whatever their ids; an empty table gives no rows; other columns, of
any name, are ignored by `report` and kept by `sanitised`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import saved

LOCAL = "[A-Za-z0-9._%+-]"
#: Kind to pattern, in the order in which spans are listed.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # shorter chains of digits fail the check, so they need not be found
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for its kind's pattern to be tried.
MARKS = {"email": "@", "phone": "+"}
TERM = "term"
MIN_CHANCE, MIN_BITS = 0.6, 6.0
#: The commonest words, at most so many, are joined apart.
HOT = 10_000
_WORD, _BETWEEN = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"

#: Spans that are gathered in one list before lists are joined.
BLOCK = 256
_SPAN = "array<struct<kind:string,start:int,stop:int,value:string>>"


def _luhn(number: Column) -> Column:
    digits = F.split(F.reverse(F.translate(number, " -", "")), "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(bare) <= 3) & (F.when(F.length(bare) <= 3, bare).cast("int") <= 255)


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _small),
    "card": lambda v: (_digits(v) <= 19) & F.when(_digits(v) <= 19, _luhn(v)),
    "phone": lambda v: _digits(v).between(9, 15),
}


def _placed(kind: str, found: str, gaps: str) -> Column:
    """Spans from the matches and the text between them."""

    def step(held: Column, i: Column) -> Column:
        value = F.get(F.col(found), i)
        start = held["at"] + F.length(F.get(F.col(gaps), i))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("stop"), value.alias("value"))
        return F.struct((start + F.length(value)).alias("at"), F.concat(held["spans"], F.array(span)).alias("spans"))

    # a list that grows is copied for each span, so spans are gathered by blocks and blocks are joined once
    none, last = F.array().cast(_SPAN), F.size(found) - 1
    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("blocks"))

    def block(held: Column, b: Column) -> Column:
        own = F.aggregate(F.sequence(b * BLOCK, F.least(b * BLOCK + BLOCK - 1, last)), F.struct(held["at"].alias("at"), none.alias("spans")), step)
        return F.transform(F.array(own), lambda x: F.struct(x["at"].alias("at"), F.concat(held["blocks"], F.array(x["spans"])).alias("blocks")))[0]

    walked = F.aggregate(F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int")), first, block, lambda held: F.flatten(held["blocks"]))
    return F.when(F.size(found) > 0, walked).otherwise(none)


def _checked(kind: str) -> Column:
    return F.filter(_placed(kind, f"_{kind}", f"_{kind}_gaps"), lambda span: CHECKS[kind](span["value"]))


def with_base(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """`docs`, which has no column whose name starts like those here, with `_base`: the checked spans of all kinds, in order."""
    whole = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    found = {f"_{k}": F.regexp_extract_all(whole, F.lit(p), F.lit(0)) if k not in MARKS else F.when(F.contains(whole, F.lit(MARKS[k])), F.regexp_extract_all(whole, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for k, p in PATTERNS.items()}
    out = docs.withColumns(found)
    out = out.withColumns({f"_{k}_gaps": F.when(F.size(f"_{k}") > 0, F.split(whole, p, -1)) for k, p in PATTERNS.items()})
    return out.withColumn("_base", F.concat(*[_checked(k) for k in PATTERNS])).drop(*found, *[f"_{k}_gaps" for k in PATTERNS])


def _split(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _BETWEEN, -1), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _words(whole: Column) -> Column:
    """Hashes of the different words outside of emails, without the digits of other values."""
    bare = F.when(F.contains(whole, F.lit("@")), F.regexp_replace(whole, PATTERNS["email"], " ")).otherwise(whole)
    numbers = F.filter("_base", lambda s: s["kind"] != "email")
    own = F.flatten(F.transform(numbers, lambda s: _split(s["value"])))
    words = F.array_distinct(_split(bare))
    return _hashes(F.when(F.size(numbers) > 0, F.array_except(words, own)).otherwise(words))


def _packed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, same, _base, entities) of every document, its own columns in `row`; written once."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = _whole(text)
    based = with_base(rows.withColumn("key", F.col("row").getField(key).cast("string")), whole)
    entities = F.array_distinct(F.transform("_base", lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))
    return saved(based.select("row", "key", F.xxhash64(whole).alias("same"), "_base", entities.alias("entities")), "zstd")


def _whole(text: str) -> Column:
    return F.coalesce(F.col("row").getField(text).cast("string"), F.lit(""))


def _matched(rows: DataFrame, counted: DataFrame, wanted: Column, limit: float) -> DataFrame:
    """`rows` with the `wanted` of the `counted` terms; those of more than `limit` texts, at most `HOT`, are broadcast, so no term fills a task."""
    hot = F.broadcast(counted.where(F.col("n") > limit))
    rest = counted.where((F.col("n") <= limit) & wanted)
    return rows.join(hot.where(wanted), "term").unionByName(rows.join(hot.select("term"), "term", "left_anti").join(rest, "term"))


def _limit(counted: DataFrame) -> float:
    """No more than `HOT` of the `counted` have an `n` above this."""
    found = counted.agg(F.sum("n").alias("n"), F.count("*").alias("size")).first()
    return found.n / HOT if found.size > HOT else 0.0


def revealing(packed: DataFrame, text: str = "text", min_chance: float = MIN_CHANCE, min_bits: float = MIN_BITS) -> DataFrame:
    """(term, n): the words that give an entity away, by their hashes, and the number of texts that hold them."""
    total = packed.select("same").distinct().count()
    # as n(t, e) <= n(t), a term needs n(t) of at least this, and so does an entity
    least = min_chance / (1 - min_chance) if min_chance < 1 else float("inf")
    held = saved(packed.select("same", F.explode("entities").alias("entity")).distinct())
    sets = [F.bit_xor(F.xxhash64("same", F.lit(seed))).alias(a) for a, seed in (("e_x", 1), ("e_y", 2))]
    known = held.groupBy("entity").agg(F.count("*").alias("e_n"), *sets)
    # one entity of those that stand in the same texts
    known = known.where((F.col("e_n") >= least) & (F.log2(F.lit(float(max(total, 1))) / F.col("e_n")) >= min_bits))
    known = saved(known.groupBy("e_n", "e_x", "e_y").agg(F.min("entity").alias("entity")).select("entity", "e_n"))
    most = (known.agg(F.max("e_n")).first()[0] or 0) / min_chance
    parts = saved(held.join(known, "entity"))
    texts = packed.select("same", _whole(text).alias("whole"), "_base").dropDuplicates(["same"])
    terms = texts.select(F.explode(_words(F.col("whole"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    terms = saved(terms.where(F.col("n") >= least))
    words = packed.select("same", _whole(text).alias("whole"), "_base").join(parts.select("same").distinct(), "same", "left_semi")
    words = words.dropDuplicates(["same"]).select("same", F.explode(_words(F.col("whole"))).alias("term"))
    places = _matched(words, terms, F.col("n") + 1 <= most, _limit(terms))
    pairs = places.join(parts, "same").where(F.col("n") + 1 <= F.col("e_n") / min_chance)
    pairs = pairs.groupBy("term", "n", "entity", "e_n").agg(F.count("*").alias("together"))
    chance = F.col("together") / (F.col("n") + 1)
    told = pairs.where((chance >= min_chance) & (F.log2(chance * total / F.col("e_n")) >= min_bits))
    return saved(told.select("term", "n").distinct())


def with_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """(row, _base, _spans): the columns of `docs`, and its spans without and with the terms that give entities away."""
    packed = _packed(docs, key, text)
    terms = revealing(packed, text, **thresholds)
    words, limit = packed.select("key", "same", F.explode(_words(_whole(text))).alias("term")), _limit(terms)
    found = _matched(words, terms, F.lit(True), limit) if limit else words.join(F.broadcast(terms), "term")
    found = found.groupBy(F.col("key").alias("k"), F.col("same").alias("s")).agg(F.collect_set("term").alias("told"))
    joined = packed.drop("entities").join(found, F.col("key").eqNullSafe(F.col("k")) & (F.col("same") == F.col("s")), "left")
    whole = _whole(text)
    joined = joined.withColumn("_words", F.when(F.col("told").isNotNull(), F.regexp_extract_all(whole, F.lit(_WORD), F.lit(0))).otherwise(F.array().cast("array<string>")))
    joined = joined.withColumn("_gaps", F.when(F.size("_words") > 0, F.split(whole, _WORD, -1)))
    return joined.select("row", "_base", F.concat("_base", _told("_words", "_gaps")).alias("_spans"))


def _told(words: str, gaps: str) -> Column:
    """Spans of the words whose hashes are in `told`; what a block holds of these is found first, so no word is held against all."""
    placed = _placed(TERM, words, gaps)

    def block(spans: Column, b: Column) -> Column:
        part = F.slice(spans, b * BLOCK + 1, BLOCK)
        own = F.array_intersect(F.col("told"), F.transform(part, lambda s: F.xxhash64(F.lower(s["value"]))))
        return F.transform(F.array(own), lambda o: F.filter(part, lambda s: F.array_contains(o, F.xxhash64(F.lower(s["value"])))))[0]

    kept = F.transform(F.array(placed), lambda spans: F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / BLOCK).cast("int")), lambda b: block(spans, b))))[0]
    return F.when(F.size(words) > 0, kept).otherwise(F.array().cast(_SPAN))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    found = with_spans(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", **thresholds)
    kinds = F.transform("_base", lambda s: s["kind"])
    counts = [(F.size("_base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select("row.doc_id", *counts, F.sha2(_listed("_base").cast("binary"), 256).alias("base_sha256"), _listed("_spans").alias("spans"))


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """`docs` with every span of the text replaced by its kind in brackets; `n_chars` follows where there is one.

    Overlapping spans are replaced together, by the kind of the first.
    """
    found = with_spans(docs, key, text, **thresholds)
    order = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["kind"].alias("kind"))))

    own = F.col("row").getField(text)

    def step(held: Column, s: Column, part: Column, base: Column) -> Column:
        between = F.substring(part, held["at"] - base + 1, F.greatest(s["start"] - held["at"], F.lit(0)))
        added = F.concat(between, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(held["at"], -s["back"]).alias("at"), F.concat(held["out"], F.when(s["start"] >= held["at"], added).otherwise(F.lit(""))).alias("out"))

    # a place is found by walking from the start, so each block of spans walks its own part of the text only
    def block(held: Column, spans: Column) -> Column:
        stop = F.greatest(held["at"], F.array_max(F.transform(spans, lambda s: -s["back"])))
        part = F.struct(held["at"].alias("base"), F.substring(own, held["at"] + 1, stop - held["at"]).alias("text"))
        first = F.struct(held["at"].alias("at"), F.lit("").alias("out"))
        done = F.transform(F.array(part), lambda p: F.aggregate(spans, first, lambda h, s: step(h, s, p["text"], p["base"])))
        return F.transform(done, lambda d: F.struct(d["at"].alias("at"), F.concat(held["out"], F.array(d["out"])).alias("out")))[0]

    blocks = F.transform(F.array(order), lambda o: F.transform(F.sequence(F.lit(0), F.floor((F.size(o) - 1) / BLOCK).cast("int")), lambda b: F.slice(o, b * BLOCK + 1, BLOCK)))[0]
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(blocks, none, block, lambda held: F.concat(F.array_join(held["out"], ""), F.substring(own, held["at"] + 1, F.length(own))))
    changed = {text: F.when(F.size("_spans") > 0, whole).otherwise(own)}
    out = found.withColumn("_text", changed[text])
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("_spans") > 0, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row").getField("n_chars"))
    changed[text] = F.col("_text")
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
