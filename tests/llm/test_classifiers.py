import re
import time
import zlib

import numpy as np
import pytest

from logquarry.llm import compression, langid, toxicity
from logquarry.llm.common import fold

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def area(rows):
    """Chance that a positive scores above a negative; ties count half."""
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def check(report, docs, labels, label, least):
    rows = {r.doc_id: r for r in report(docs, labels).collect()}
    assert len(rows) == docs.count()
    for key, r in rows.items():
        assert r.held_out == (zlib.crc32(str(key).encode()) % 5 == 0) and 0 <= r.score <= 1
    known = [(rows[r.doc_id].score, r[label]) for r in labels.collect() if rows[r.doc_id].held_out]
    assert area(known) > least
    return rows


def test_quality_held_out(tables):
    rows = check(compression.report, *tables, "quality", 0.85)
    assert all(r.predicted == (r.score >= 0.3) for r in rows.values())


def test_toxicity_held_out(tables):
    rows = check(toxicity.report, *tables, "toxic", 0.9)
    assert all(r.predicted == (r.score >= 0.5) for r in rows.values())


def test_language_held_out(tables):
    docs, _ = tables
    rows = {r.doc_id: r for r in langid.predicted(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [k for k, r in rows.items() if r.held_out]
    assert held and all(rows[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in rows)
    assert sum(rows[k].lang_pred == truth[k] for k in held) / len(held) > 0.97


def test_held_out_labels_teach_nothing(spark, tables):
    docs, labels = tables
    other = labels.withColumn("toxic", (1 - labels.toxic)).where(fold(labels.doc_id, 5) == 0).union(labels.where(fold(labels.doc_id, 5) != 0))
    a, b = ({r.doc_id: r.score for r in toxicity.report(docs, x).collect()} for x in (labels, other))
    assert a == b


@pytest.mark.parametrize("report", [compression.report, toxicity.report])
def test_odd_rows(spark, tables, odd, nothing, report):
    docs, labels = tables
    assert len(report(odd, labels).collect()) == odd.count()
    assert report(nothing, labels).count() == 0
    few = spark.createDataFrame([(3, None, 1), (None, 1, 0), (999999, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(report(odd, few).collect()) == odd.count()
    assert len(report(odd, labels.limit(0)).collect()) == odd.count()


def test_clean_rows_stay_whole(tables, odd, nothing):
    docs, labels = tables
    both = docs.unionByName(odd.select(*docs.columns))
    kept = toxicity.accepted(both, labels)
    assert kept.columns == docs.columns and 0.8 * both.count() < kept.count() < both.count()
    clashing = odd.withColumn("doc_id", odd.doc_id + 0)
    assert toxicity.accepted(clashing, labels).columns == odd.columns
    assert toxicity.accepted(nothing, labels).count() == 0


def test_language_of_odd_rows(odd, nothing):
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predicted(odd).collect()]
    assert len(got) == odd.count()
    assert {x[1:] for x in got if x[0] in (1, 2, 6)} == {("und", 0.0)}
    assert langid.predicted(nothing).count() == 0


def test_forward_sums_all_segmentations():
    known = langid.Pieces(["▁", "a", "ab", "b", "▁a"])
    p = __import__("numpy").array([[0.1], [0.2], [0.3], [0.15], [0.05], [0.2]])
    lattice = langid.Lattice(["ab", "z"], known)
    # ▁ a b, ▁ ab, ▁a b; and ▁ z with the unknown character
    assert lattice.whole(lattice.forward(p)).reshape(-1).tolist() == pytest.approx([0.1 * 0.2 * 0.15 + 0.1 * 0.3 + 0.05 * 0.15, 0.1 * 0.2])


def test_pieces_are_found_by_their_text():
    listed = langid.vocabulary()
    known = langid.Pieces(listed)
    words = ["über", "thé", "zzqx", "a", "internationalisation"]
    lattice = langid.Lattice(words, known)
    numbers = {p: i for i, p in enumerate(listed)}
    expected = set()
    for i, word in enumerate(langid.START + w for w in words):
        for a in range(len(word)):
            for b in range(a + 1, min(len(word), a + langid.LONGEST_PIECE) + 1):
                if word[a:b] in numbers or b == a + 1:
                    expected.add((i, a, b, numbers.get(word[a:b], len(listed))))
    assert set(zip(*(x.tolist() for x in (lattice.row, lattice.start, lattice.end, lattice.piece)), strict=True)) == expected


def test_obfuscated_words_count():
    plain = toxicity.features("you are an 1d10t today", frozenset(), frozenset())
    assert plain[0] == 1 / 5 and plain[3] == 1 / 5 and plain[8] == 1 / 5
    assert toxicity.features("", frozenset(), frozenset()) == (0.0,) * 10


def test_numeric_signs_are_no_letters(spark):
    assert langid._WORD.findall("½ ² Ⅷ x² 一 é1ä") == ["x", "一", "é", "ä"]


def test_words_around_signs_and_in_stretches():
    text = "½ x²y Ⅷ 一二 é1ä_b İ ①a𐄇b " + "X" * 50 + "²" + "z" * 25
    assert langid.words_of(text) == ["x", "y", "一二", "é", "ä", "b", "i", "a", "b", "x" * 24, "x" * 24, "xx", "z" * 24, "z"]
    every = "".join(f" {chr(i)} a{chr(i)}b" for i in range(0x20000) if not 0xD800 <= i < 0xE000)
    assert langid.words_of(every) == langid._WORD.findall(every.lower())


def test_known_words_cost_little_more_than_splitting():
    """Numeric signs in one class with the letters made the words of a text take thirteen times as long as a plain split."""
    known = langid.Pieces(["▁", "a", "ab", "b", "▁a"])
    scorer = langid.Scorer(known, np.full((6, 2), 1 / 6))
    texts = [" ".join("abcdefghij"[i % 7 :] for i in range(5000))] * 20
    scorer.of(texts[:1])
    took = []
    for work in (lambda: [re.findall(r"[^\W\d_]+", t) for t in texts], lambda: scorer.of(texts)):
        times = []
        for _ in range(3):
            began = time.process_time()
            work()
            times.append(time.process_time() - began)
        took.append(min(times))
    assert took[1] < 6 * took[0]
