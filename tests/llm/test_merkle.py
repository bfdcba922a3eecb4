import hashlib

from logquarry.llm import merkle
from tests.llm.conftest import documents, prose


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for i, (key, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        a, b, c = merkle.fingerprint(text), merkle.fingerprint(edited), merkle.fingerprint(following)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, merkle.likeness(a, b), merkle.likeness(a, c)))
    return sorted(out, key=str)


def test_report_against_neighbours_in_order(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in merkle.edit_report(odd).collect()), key=str) == brute(rows)


def test_many_ranges_hand_on_the_next_row(spark, monkeypatch):
    texts = [prose(i, 40 + i % 7) + "\n" + prose(i + 500, 30) for i in range(300)]
    docs = documents(spark, texts).repartition(5)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 3)
    got = sorted((tuple(r) for r in merkle.edit_report(docs).collect()), key=str)
    assert got == brute(list(enumerate(texts)))
    near = [r[5] for r in got]
    assert sum(near) / len(near) > 0.6 and all(r[5] > r[6] for r in got)


def test_tree_tells_equality_and_locates_edits():
    text = "\n".join(prose(i, 60) for i in range(40))
    lines = text.split("\n")
    lines[17] = lines[17].replace(" ", " CHANGED ", 1)
    a, b = merkle.fingerprint(text), merkle.fingerprint("\n".join(lines))
    assert a == merkle.fingerprint(text) and a != b
    assert merkle.likeness(a, a) == 1 and merkle.likeness(merkle.fingerprint(""), merkle.fingerprint(None)) == 1
    assert merkle.likeness(a, merkle.fingerprint("")) == 0
    found = merkle.differing(a, b)
    assert len(found) == 1
    order = [(i, j) for i, (_, inner) in enumerate(merkle._parsed(a)) for j in range(len(inner))]
    assert order.index(found[0]) == 17


def test_fingerprints_keep_rows(spark, odd, nothing):
    got = merkle.fingerprints(odd).select("text", "fingerprint").collect()
    assert all(r.fingerprint == merkle.fingerprint(r.text) for r in got) and len(got) == odd.count()
    assert merkle.edit_report(nothing).count() == 0 and merkle.fingerprints(nothing).count() == 0


def test_long_text_is_cut_in_blocks():
    text = prose(3, 400_000)
    assert len(text) > 2 * merkle.BLOCK
    assert 0.99 < merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(text[:-5] + "other")) < 1
