import random

from logquarry.llm import decontaminate as d
from tests.llm.conftest import documents, prose


def nearest(item, text):
    """Smallest edit distance between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def changed(rnd, text, k):
    for _ in range(k):
        i = rnd.randrange(len(text))
        text = rnd.choice((text[:i] + text[i + 1 :], text[:i] + rnd.choice("abc") + text[i:], text[:i] + rnd.choice("abc") + text[i + 1 :]))
    return text


def test_myers_matches_the_table():
    rnd = random.Random(2)
    for _ in range(300):
        item = "".join(rnd.choices("abc d", k=rnd.randint(1, 90)))
        text = "".join(rnd.choices("abc d", k=rnd.randint(0, 120)))
        assert d.myers(d.masks_of(item), len(item), text)[0] == nearest(item, text)


def test_matches_against_all_pairs(spark):
    rnd = random.Random(4)
    items = [prose(900 + i, 25) for i in range(6)] + ["too short", "", None, prose(901, 30), "Who wrote Hamlet?", "a b a"]
    texts = []
    for i in range(30):
        text = prose(i, 25)
        if i % 2:
            item = d.normal(items[rnd.randrange(6)])
            text = text[:50] + " " + changed(rnd, item, rnd.randint(0, d.budget_of(item) + 3)).title() + ".\n" + text[50:]
        texts.append(text)
    texts += [None, "", items[0], "-".join(items[1].split(" ")), "who wrote hamlet", "so: WHO  wrote\nHamlet!", "who wrote hamlets", "xa b a b a", "a b ab a", "is too short", "too shorts"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in d.matches(documents(spark, texts), bench).collect()}
    expected = {}
    for i, text in enumerate(texts):
        for k, item in enumerate(items):
            item = d.normal(item)
            if len(item) >= d.MIN_CHARS and (x := nearest(item, d.normal(text))) <= d.budget_of(item):
                expected[i, k] = x
            if 0 < len(item) < d.MIN_CHARS and f" {item} " in f" {d.normal(text)} ":
                expected[i, k] = 0
    assert {(34, 10), (35, 10), (37, 11), (39, 6)} <= set(expected) and not {36, 38, 40} & {i for i, _ in expected}
    assert got == expected and {0 < x for x in expected.values()} == {True, False}
    kept = {r.doc_id for r in d.clean(documents(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in expected}


def test_blocks_give_the_same(spark, monkeypatch):
    items = [prose(900 + i, 20) for i in range(30)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, [prose(1, 20) + " " + items[i] for i in range(0, 30, 3)])
    plain = sorted(map(tuple, d.matches(docs, bench).collect()))
    monkeypatch.setattr(d, "BLOCK_CHARS", 500)
    assert sorted(map(tuple, d.matches(docs, bench).collect())) == plain and len(plain) == 10
    assert d.clean(docs, bench).count() == 0


def test_odd_rows_and_empty_tables(spark, odd, nothing):
    bench = spark.createDataFrame([(None, prose(2, 80)), (1, "")], "item_id long, text string")
    assert {r.doc_id for r in d.matches(odd, bench).collect()} == {3}
    assert d.clean(odd, bench).count() == odd.count() - 2
    assert d.clean(odd, bench.limit(0)).count() == odd.count()
    assert d.matches(nothing, bench).count() == 0 and d.clean(nothing, bench).columns == odd.columns
