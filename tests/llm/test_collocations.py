import random
import re
from collections import Counter

from logquarry.llm import collocations as c


def brute(rows, top, least):
    """The result over (lang, text) rows."""
    counts, total, out = {}, Counter(), []
    for lang, text in rows:
        own = counts.setdefault(lang or "und" if lang is None else lang, Counter())
        low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            total["und" if lang is None else lang] += len(words)
            for size in (1, 2, 3):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    for lang, own in counts.items():
        found, most = [], Counter()
        for phrase, a in own.items():
            if len(phrase) == 3 and a >= least:
                for part in (phrase[:2], phrase[1:]):
                    most[part] = max(most[part], a)
        for phrase, a in own.items():
            if len(phrase) > 1 and a >= least and 100 * most[phrase] < 50 * a:
                cuts = [(1000000 * a * a // (own[phrase[:k]] * own[phrase[k:]]), k) for k in range(1, len(phrase))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(phrase).encode(), own[phrase[:k]], own[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def texts(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "x" * 90, "x" * 64 + "y", "ab"]
    fixed = [["new", "york", "city"], ["x" * 90, "ab"], ["x" * 64 + "y", "ab", "É"], ["so", "so", "so", "so"], ["of", "the"], ["of", "the", "sea"]]
    out = []
    for _ in range(n):
        said = []
        for _ in range(rnd.randrange(60)):
            said += rnd.choice(fixed) if rnd.random() < 0.3 else [rnd.choices(words, range(1, len(words) + 1))[0]]
            said.append(rnd.choice([" ", " ", "\t ", " ", ", ", ".", "\n", "\x0b"]))
        text = " ".join(said)
        out.append((rnd.choice(["en", "EN", "de", "", None]), text.upper() if rnd.random() < 0.2 else text))
    return [*out, ("en", None), (None, ""), ("fr", "only once"), ("de", " ,. ")]


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_brute_force(spark):
    rows = texts(1, 150)
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = brute(rows, 2000, 10)
    assert got(c.collocations(docs)) == want and len(want) > 25


def test_frontier_grows_in_waves(spark):
    rows = texts(2, 200)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for top in (1, 3, 12):
        assert got(c.collocations(docs, top=top, least=4, wave=7)) == brute(rows, top, 4)


def test_large_counts_are_exact(spark):
    rows = [("en", 0, "", 10**15), ("en", 1, "a", 10**15 - 1), ("en", 1, "b", 10**15 - 7), ("en", 2, "a b", 10**15 - 9)]
    counts = spark.createDataFrame(rows, "lang string, size int, phrase string, f long")
    row = c._scored_pairs(counts).first()
    assert row.score == 10**6 * (10**15 - 9) ** 2 // ((10**15 - 1) * (10**15 - 7)) and row.bound == 10**6 * (10**15 - 9) // (10**15 - 1)


def test_dictionary_is_emptied(spark):
    rows = texts(3, 60)
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    named = docs.selectExpr("coalesce(lang, 'und') as lang", "text")
    few, many = (sorted(tuple(r) for r in c._counted(named, entries=n).collect()) for n in (40, 10**6))
    assert few == many


def test_odd_rows(spark, odd, nothing):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert got(c.collocations(odd)) == brute(rows, 2000, 10)
    assert c.collocations(nothing).count() == 0
