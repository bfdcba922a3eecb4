import numpy as np
import pytest
import xxhash

from logquarry.llm import simhash
from logquarry.llm.components import components
from tests.llm.conftest import documents, prose


def print_of(text, size):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(rows, near):
    """rows: (id, thing)."""
    least = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if near(rows[i][1], rows[j][1]):
                    low = min((x for x in (least[i], least[j]) if x is not None), default=None)
                    if least[i] != low:
                        least[i], changed = low, True
    return least


def edited(text, k, seed):
    words = text.split(" ")
    for i in np.random.default_rng(seed).integers(0, len(words), k):
        words[i] = f"w{seed}x{i}"
    return " ".join(words)


@pytest.fixture(scope="module")
def family():
    texts = [prose(i, 150) for i in range(12)]
    texts += [edited(texts[i % 12], 1 + i % 2, i) for i in range(60)]
    return [*texts, texts[3], texts[3].upper(), "", None, " ", "one", "ONE\t"]


def test_components_match_brute_force(spark, family, monkeypatch):
    rows = [(i, print_of(t, 4)) for i, t in enumerate(family)]
    expected = least_reachable(rows, lambda a, b: (a ^ b).bit_count() <= 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark, family), 4).collect()}
    assert got == {i: (f"{p:016x}", c) for (i, p), c in zip(rows, expected, strict=True)}
    assert len({c for _, c in got.values()}) < len(family)


def test_tiles_lose_no_link(spark, family):
    prints = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for p, i in {print_of(t, 4): i for i, t in enumerate(family)}.items()], "node long, print binary")
    plain = {tuple(r) for r in components(simhash.links(prints, 4, 7, 3)).collect()}
    assert {tuple(r) for r in components(simhash.links(prints, 4, 7, 3, tile=4)).collect()} == plain


def test_embedding_is_a_lower_bound_and_cells_catch_all():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for _ in a]
    b = a ^ np.array(flips, np.uint64)
    lower = np.bitwise_count(simhash.embedding(a) ^ simhash.embedding(b))
    assert (lower <= np.bitwise_count(a ^ b)).all()
    shared = (simhash.cells(a[:, None], 7, 3) == simhash.cells(b[:, None], 7, 3)).any(axis=1)
    assert shared.all()


def test_first_of_each(spark, family, odd, nothing):
    ids = {r.doc_id for r in simhash.first_of_each(documents(spark, family)).collect()}
    assert ids <= {*range(12), 74, 77} and {1, 2, 3} <= ids
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert len([r for r in rows if r.doc_id is None]) == 2 and sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 3, 4, 7, 8]
    assert simhash.first_of_each(nothing).count() == 0 and simhash.near_duplicates(nothing).count() == 0


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_links_have_the_stated_similarity(spark):
    """Pairs of their own, just above and below 0.8: a first text and one with some of its tail replaced."""
    texts, expected = [], set()
    for i in range(400):
        size = 150 + i
        words = [f"a{i}x{k}" for k in range(size)]
        own = round((size - 4) * (0.11 if i % 2 else 0.125))
        texts += [" ".join(words), " ".join(words[: size - own] + [f"b{i}x{k}" for k in range(own)])]
        a, b = shingles(texts[-2]), shingles(texts[-1])
        expected |= {2 * i} if len(a & b) / len(a | b) >= 0.8 else {2 * i, 2 * i + 1}
    assert 500 < len(expected) < 700
    got = {r.doc_id for r in simhash.first_of_each(documents(spark, texts).repartition(4)).collect()}
    assert got >= expected and len(got - expected) <= 6


def test_given_documents_by_exact_similarity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, frozenset(simhash.shingle_hashes((r.text or "").encode(), 5).tolist())) for r in docs.collect())
    least = least_reachable(rows, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    kept = {r.doc_id for r in simhash.first_of_each(docs).collect()}
    assert kept == {k for (k, _), c in zip(rows, least, strict=True) if k == c} and 177 not in kept


def test_repeats_within_a_text_do_not_make_links(spark):
    texts = [" ".join(["one line that comes again and again"] * 200) + " " + prose(i, 100) for i in range(4)]
    assert simhash.first_of_each(documents(spark, texts)).count() == 4


def test_forest_of_similar_sets_against_all_pairs():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, rng.integers(20, 60)).astype(np.uint64)) for _ in range(150)]
    a, b = simhash.similar(sets, np.zeros((150, 1), np.uint64), (3, 5), 0)
    rows = [(i, set(x.tolist())) for i, x in enumerate(sets)]
    near = lambda x, y: 5 * len(x & y) >= 3 * len(x | y)
    assert all(near(rows[i][1], rows[j][1]) for i, j in zip(a, b, strict=True))
    linked, least = simhash.forest(150, a, b)
    found = list(range(150))
    for i, j in zip(linked.tolist(), least.tolist(), strict=True):
        found[i] = j
    assert found == least_reachable(rows, near)


def test_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd, 4).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].component_id == by_id[2].component_id == by_id[6].component_id == 1 and by_id[2].fingerprint == "0" * 16
    assert by_id[5].component_id == 4


def test_chain_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    assert {r.node: r.component for r in components(chain).collect()} == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
