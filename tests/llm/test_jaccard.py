import random

import numpy as np

from logquarry.llm import jaccard
from tests.llm.conftest import documents, prose

SHARE = (90, 100)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)} - {()}


def brute(rows):
    """[(id, size, component)] of (id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (key, _), g in zip(rows, group, strict=True):
        if key is not None:
            least[g] = min(least.get(g, key), key)
    return sorted(((k, len(s), least.get(g)) for (k, _), s, g in zip(rows, sets, group, strict=True)), key=str)


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = "w" + str(rnd.randrange(10**6))
    return words


def corpus():
    rnd, texts = random.Random(3), []
    for size in (1, 2, 3, 9, 11, 12, 13, 15, 21, 22, 40, 41, 90, 300):
        base = prose(size, size).split()
        for n in range(8):
            near = edited(rnd, base, n % 4 * size // 60)
            cut = rnd.randrange(0, 1 + len(near) // 12) if n > 3 else 0
            texts.append("  ".join(near[cut:]).upper() if n == 5 else " ".join(near[cut:]))
    return texts + ["", None, " \t", "a b c", "A B\x0bC", "a b c"]


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_against_brute_force_whole_and_in_slices(spark):
    texts = corpus()
    docs, want = documents(spark, texts), brute(list(enumerate(texts)))
    assert got(jaccard.similar_texts(docs)) == want
    assert sum(a != c for a, _, c in want) > 30
    # every component of more than two or three texts takes the way of the large ones
    assert got(jaccard.similar_texts(docs, slice_shingles=256)) == want


def test_chain_whose_leaders_reach_few(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 300, 4)]
    want = brute(list(enumerate(texts)))
    assert {c for _, _, c in want} == {0}
    assert got(jaccard.similar_texts(documents(spark, texts), slice_shingles=512)) == want


def test_any_allowances_meet_every_pair_in_reach():
    rnd = np.random.default_rng(5)
    starts, gaps = jaccard.bands(SHARE)
    for trial in range(300):
        n = int(rnd.integers(9, 400))
        a = rnd.integers(0, 1 << 63, n).astype(np.uint64)
        keep = int(rnd.integers(int(0.88 * n), n + 1))
        b = np.concatenate([a[:keep], rnd.integers(0, 1 << 63, int(rnd.integers(0, n - keep + 2))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if len(a) == len(b) == common or 100 * common < 90 * (len(a) + len(b) - common):
            continue
        met = False
        for of in set(jaccard.classes_of(len(a), SHARE)) & set(jaccard.classes_of(len(b), SHARE)):
            left, allowed = gaps[of] + 1, []
            while left > 0:
                allowed.append(min(left, int(rnd.integers(0, 3))))
                left -= allowed[-1]
            allowed = np.array(allowed, np.int8)
            met |= bool(set(jaccard.entries(a, of, allowed)[0].tolist()) & set(jaccard.entries(b, of, allowed)[0].tolist()))
        assert met, trial


def test_allowances_are_the_cheapest_of_their_sum():
    rnd = np.random.default_rng(6)
    common = rnd.integers(0, 1 << 63, 10).astype(np.uint64)
    sets = [np.unique(np.r_[common, rnd.integers(0, 1 << 63, 2).astype(np.uint64)]) for _ in range(30)]
    for scale in (1.0, 1e6):
        found = jaccard.allowances(sets, 12, 2, scale)
        assert found.sum() == 3 and set(found.tolist()) <= {0, 1, 2}
    # where pairs that meet cost much, whole sets but one shingle are dearer than nothing
    assert (jaccard.allowances(sets, 12, 1, 1e9) == 2).any()


def test_bitmaps_rule_out_unlike_sets_of_any_length_and_no_pair_in_reach():
    rnd = np.random.default_rng(7)
    for n in (10, 300, 2048, 2100, 6000, 40_000):
        a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        apart = 2 * n * 10 // 190  # shingles in which sets of n may differ
        for other in (a[apart // 2 :], np.r_[a, rnd.integers(0, 1 << 63, n // 9).astype(np.uint64)], np.r_[a[apart // 2 :], a[: apart // 2] + np.uint64(1)]):
            sets = [a, np.unique(other), np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))]
            sizes = np.array([len(x) for x in sets])
            assert jaccard.alike(*sets[:2], SHARE)
            for prints in (jaccard.parities(sets), jaccard.folded([jaccard.parity(x, jaccard.width_of(len(x))).tobytes() for x in sets])):
                assert jaccard.in_reach(0, np.array([1, 2]), sizes, prints, SHARE).tolist() == [1], n


def test_sets_that_meet_by_chance_are_not_compared(spark, monkeypatch):
    rnd, texts = random.Random(8), []
    of = jaccard.classes_of(10, SHARE)[0]
    while len(texts) < 40:  # unlike texts whose second segment is empty meet in one cell
        words = [f"w{rnd.randrange(10**6)}" for _ in range(12)]
        if not jaccard._segments(jaccard.shingle_set(" ".join(words).encode(), 3), of, jaccard.bands(SHARE)[1][of] + 1).any():
            texts.append(" ".join(words))
    texts.append(texts[5] + " w0")
    dealt, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda rows, share: dealt.append(rows.count()) or verified(rows, share))
    want = brute(list(enumerate(texts)))
    assert got(jaccard.similar_texts(documents(spark, texts), slice_shingles=64, sample=0)) == want
    assert (40, 11, 5) in want
    assert sum(dealt) <= 4, dealt  # the two that are alike; all 41 in every pair of slices before


def test_texts_that_nothing_wants_stay_behind(spark):
    docs = spark.range(20_000).selectExpr("case when id > 0 then id end as doc_id", "repeat('x', 3) as text")
    wanted = spark.range(5, 20_000, 40).selectExpr("id as doc_id")
    kept = [r.doc_id for r in jaccard._perhaps(docs, wanted).collect()]
    assert set(kept) >= set(range(5, 20_000, 40)) and len(kept) < 2 * 500 + 20_000 // 10
    assert jaccard._perhaps(docs, wanted.limit(0)).count() == 0


def test_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(jaccard.similar_texts(odd)) == brute(rows)
    assert jaccard.similar_texts(nothing).count() == 0
