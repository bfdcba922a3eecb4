import hashlib
import random

import numpy as np

from logquarry.llm import suffixes
from tests.llm.by_hand import without_repeats
from tests.llm.conftest import documents


def brute(docs):
    """Every window of every text against all earlier ones."""
    seen, out = {}, {}
    docs = [(suffixes.NO_ID if k is None else k, (t or "").encode()) for k, t in docs]
    places = sorted((k, i, b[i : i + 100]) for k, b in docs for i in range(len(b) - 99))
    for k, i, w in places:
        seen.setdefault(w, (k, i))
    for k, b in docs:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if seen[b[i : i + 100]] < (k, i):
                gone[i : i + 100] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.setdefault(k, []).append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def found(docs):
    out = {}
    for r in suffixes.report(docs).collect():
        out.setdefault(suffixes.NO_ID if r.doc_id is None else r.doc_id, []).append(tuple(r)[1:])
    return {k: sorted(v) for k, v in out.items()}


def corpus(seed, size, words):
    rnd = random.Random(seed)
    known = ["".join(rnd.choices("abcdé", k=rnd.randint(1, 6))) for _ in range(words)]
    pool, texts = [], []
    for _ in range(size):
        text = " ".join(rnd.choices(known, k=rnd.randint(0, 120)))
        for _ in range(rnd.randint(0, 3)):
            if pool:
                other = rnd.choice(pool)
                at = rnd.randint(0, len(other))
                text = text[: rnd.randint(0, len(text))] + other[at : at + rnd.randint(50, 400)] + text[len(text) // 2 :]
        if rnd.random() < 0.1:
            text = rnd.choice(("ab ", "x", "abcab ")) * rnd.randint(20, 120) + text
        pool.append(rnd.choice(pool) if pool and rnd.random() < 0.1 else text)
        texts.append(pool[-1] if rnd.random() > 0.03 else None)
    return texts


def test_every_byte_against_brute_force(spark):
    for seed, words in ((1, 300), (2, 8)):
        texts = corpus(seed, 150, words)
        assert found(documents(spark, texts).repartition(6)) == brute(list(enumerate(texts)))


def test_every_period(spark):
    """A text that repeats itself, up to and beyond the windows of one sample."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abcdefghijklmnop ", k=p)) * (400 // p + 2) for p in range(1, 201)]
    texts += [f"{i} start " + ("".join(rnd.choices("abcdefghij", k=60)) + "\n") * n + f"end {i}" for i in range(10) for n in (2, 3, 5)]
    assert found(documents(spark, texts).repartition(6)) == brute(list(enumerate(texts)))


def test_small_pieces_and_small_buffers(spark, monkeypatch):
    texts = corpus(3, 80, 100)
    expected = brute(list(enumerate(texts)))
    monkeypatch.setattr(suffixes, "PIECE", 64)
    monkeypatch.setattr(suffixes, "HELD", 50)
    got = {}
    for key, kept, gone, spans in without_repeats(list(enumerate(texts))):
        got[key] = [(len(kept) + gone, gone, len(spans), hashlib.sha256(kept).hexdigest())]
    assert got == expected


def test_odd_rows(spark, odd, nothing):
    docs = odd.where("doc_id is null or doc_id not in (4, 5)")
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert suffixes.report(nothing).count() == 0
    both = {r.doc_id: r for r in suffixes.report(odd.where("doc_id in (4, 5)")).collect()}
    assert both[5].n_bytes - both[5].n_removed < 300 and both[4].n_removed < both[4].n_bytes
