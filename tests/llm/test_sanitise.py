import hashlib
import random
import re

from logquarry.llm import sanitise
from tests.llm.conftest import documents, prose


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else 2 * d % 10 + 2 * d // 10 for i, d in enumerate(digits)) % 10 == 0


RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= sum(c.isdigit() for c in v) <= 19 and luhn(v)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= sum(c.isdigit() for c in v) <= 15),
)


def base(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern, check in RULES for m in re.finditer(pattern, text or "") if check(m[0])]


def texts(seed, n):
    rnd = random.Random(seed)
    parts = ["a@b.c", "x%y@q-1.example.com", "@", ".", "a.b", "1.2.3.4", "01.255.256.7", "10.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "41111111111111112", "+1 (415) 555-2671", "+", "-", " ", "é", "😀", "12", "3", "%", "+44 20", "(", ")", "  ", "\n"]
    return ["".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(n)]


def test_base_spans_match_the_plain_patterns(spark):
    rows = [*texts(1, 1500), None, "", "a@" * 300, "1." * 400, "+1" * 300, "a@b.c%d@e.f", "5" * 40, "a" * 50_000, "1" * 50_000]
    got = {r.doc_id: r for r in sanitise.report(documents(spark, rows)).collect()}
    for i, text in enumerate(rows):
        expected = base(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest(), text
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("term")] == expected
        assert got[i].n_email == sum(s.startswith("email") for s in expected) and got[i].n_phone == sum(s.startswith("phone") for s in expected)


def test_terms_that_give_an_entity_away(spark):
    near = [f"{prose(i, 20)} ask Zanzibarius at boss@corp.example.com now {prose(i + 50, 5)}" for i in range(5)]
    common = [f"{prose(i, 20)} the mail m{i}@corp.example.com now" for i in range(20)]
    others = [prose(100 + i, 30) + " ask at mail now" for i in range(500)] + ["Only ZANZIBARIUS, alone; zanzibariusx not"]
    rows = near + common + others
    got = {r.doc_id: r.spans for r in sanitise.report(documents(spark, rows)).collect()}
    terms = {i: [rows[i][int(s.split(":")[1]) : int(s.split(":")[2])] for s in v.split(",") if s.startswith("term")] for i, v in got.items()}
    assert all(terms[i] == ["Zanzibarius"] for i in range(5))
    assert terms[len(rows) - 1] == ["ZANZIBARIUS"] and not any(terms[i] for i in range(5, len(rows) - 1))
    safe = {r.doc_id: r.text for r in sanitise.sanitised(documents(spark, rows)).collect()}
    assert "ask [TERM] at [EMAIL] now" in safe[0] and safe[30] == rows[30] and safe[len(rows) - 1].startswith("Only [TERM], alone")


def test_copies_do_not_make_terms(spark):
    rows = ["ask Zanzibarius at boss@corp.example.com now"] * 50 + [prose(i, 30) for i in range(300)]
    assert not any("term" in r.spans for r in sanitise.report(documents(spark, rows)).collect())


def test_a_name_in_the_two_documents_of_its_email(spark):
    filler = prose(1, 300)
    rows = [f"li: {filler} mail x1@corp.example.com", f"x1@corp.example.com {prose(2, 300)} is Li's", "LI alone, not Lis"]
    rows += [prose(100 + i, 60) + f" is s mail not alone lis corp m{i}@corp.example.com" for i in range(600)]
    got = sanitise.sanitised(documents(spark, rows)).orderBy("doc_id").collect()
    # two of three texts: 2 / (3 + 1) is not enough; without the third, 2 / (2 + 1) is
    assert got[0].text.startswith("li: ") and got[2].text == rows[2]
    got = sanitise.sanitised(documents(spark, rows[:2] + rows[3:])).orderBy("doc_id").collect()
    assert got[0].text == f"[TERM]: {filler} mail [EMAIL]" and got[1].text.endswith(" is [TERM]'s")
    assert not any("TERM" in r.text for r in got[2:])


def plain_terms(texts, min_chance, min_bits):
    """Told words of each text, from all pairs of words and entities."""
    import math

    held, words = {}, {}
    texts = sorted(set(texts))
    for i, text in enumerate(texts):
        spans = [(k, m) for k, pattern, check in RULES for m in re.finditer(pattern, text) if check(m[0])]
        for kind, m in spans:
            held.setdefault((kind, m[0].lower()), set()).add(i)
        own = {w for k, m in spans if k != "email" for w in re.findall(r"[0-9]+", m[0])}
        for w in set(re.findall(r"[^\W_]+", re.sub(RULES[0][1], " ", text).lower())) - own:
            words.setdefault(w, set()).add(i)
    told = {t for t, a in words.items() for b in held.values() if len(a & b) / (len(a) + 1) >= min_chance and math.log2(len(a & b) / (len(a) + 1) * len(texts) / len(b)) >= min_bits}
    return {text: sorted(t for t in told if i in words[t]) for i, text in enumerate(texts)}


def test_terms_against_all_pairs(spark):
    rnd = random.Random(8)
    values = [f"u{i}@h.example" for i in range(6)] + ["10.0.0.1", "+1 (415) 555-2671", "4111 1111 1111 1111"]
    rows = []
    for i in range(300):
        words = [f"w{int(rnd.paretovariate(0.6)) % 500}" for _ in range(rnd.randint(0, 25))]
        if i % 3 == 0:
            v = rnd.randrange(len(values))
            words += [values[v], f"near{v}", f"often{v % 3}"][: rnd.randint(1, 3)]
        rnd.shuffle(words)
        rows.append(" ".join(words))
    rows += rows[:60] + [None, ""]
    for chance, bits in ((0.6, 3.0), (0.4, 1.0)):
        expected = plain_terms([r or "" for r in rows], chance, bits)
        assert any(expected.values())
        for r in sanitise.report(documents(spark, rows), min_chance=chance, min_bits=bits).collect():
            text = rows[r.doc_id] or ""
            spans = [x.split(":") for x in r.spans.split(",") if x.startswith("term")]
            assert sorted({text[int(a) : int(b)] for _, a, b in spans}) == expected[text], text


def test_columns_of_any_name_are_kept(spark):
    names = ["_base", "_SPANS", "_email", "_key", "key", "row", "same", "told", "_words", "entities", "term", "n", "x", "_text", "a.b"]
    docs = spark.createDataFrame([(1, "a@b.example", *names), (2, None, *names)], ["doc_id", "text", *names])
    got = sanitise.sanitised(docs)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} == {(1, "[EMAIL]", *names), (2, None, *names)}


def test_sanitised_replaces_every_span(spark):
    rows = texts(3, 300)
    for r in sanitise.sanitised(documents(spark, rows)).collect():
        text, spans = rows[r.doc_id], sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in base(rows[r.doc_id])))
        out, at = "", 0
        for start, back, kind in spans:
            if start >= at:
                out += text[at:start] + f"[{kind.upper()}]"
            at = max(at, -back)
        assert r.text == out + text[at:] and r.n_chars == len(r.text)


def test_odd_rows_and_empty_tables(spark, odd, nothing):
    assert sanitise.report(odd).count() == odd.count() and sanitise.report(nothing).count() == 0
    safe = sanitise.sanitised(odd)
    assert safe.columns == odd.columns
    rows = {(r.doc_id, r.spans, r.text) for r in safe.collect()}
    assert any(r[0] == 4 and r[2].endswith("[EMAIL]") and r[1] == 3 for r in rows) and (1, 3, None) in rows


def test_many_spans_take_time_in_proportion(spark):
    import time

    n = 40_000
    docs = documents(spark, [" ".join(f"a{i}@b.example.com" for i in range(n))])
    start = time.time()
    row = sanitise.with_base(docs).selectExpr("size(_base) as n", "element_at(_base, -1).stop as stop", "length(text) as size").first()
    assert (row.n, row.stop) == (n, row.size) and time.time() - start < 15
    start = time.time()
    assert sanitise.sanitised(docs).first().text == " ".join(["[EMAIL]"] * n) and time.time() - start < 60
