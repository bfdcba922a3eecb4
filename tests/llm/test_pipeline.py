import corpus_pipeline
from logquarry.llm import decontaminate, sanitise, toxicity
from tests.llm.test_decontaminate import nearest
from tests.llm.test_sanitise import base

DATA = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, tables = docs.columns, [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], DATA).cache())
    assert all(t.columns == names for t in tables[:-1])
    rows = [{r.doc_id: r for r in t.collect()} for t in tables]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")

    scores = {r.doc_id: r.predicted for r in toxicity.report(docs, labels).collect()}
    assert set(rows[1]) == {k for k, v in scores.items() if v == 0} and len(rows[1]) < len(rows[0])

    # of the texts whose sets of five words are alike, the smallest id of each group
    def shingles(text):
        words = text.encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = {k: shingles(r.text or "") for k, r in rows[1].items()}
    least = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(least[a], least[b]), min(least[a], least[b])
                least = {k: new if v == old else v for k, v in least.items()}
    assert set(rows[2]) == {k for k, v in least.items() if k == v} and len(rows[2]) < len(rows[1])

    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for k, r in rows[2].items():
        text = decontaminate.normal(r.text)
        held = any(i in text for i in items)
        assert held <= (k not in rows[3])
        if k not in rows[3] and not held:
            assert any(nearest(i, text) <= decontaminate.budget_of(i) for i in items)

    assert set(rows[4]) == set(rows[3])
    for k, r in rows[4].items():
        spans = base(rows[3][k].text)
        assert (r.text == rows[3][k].text) >= (not spans) or "[TERM]" in r.text
        assert not base(r.text) and r.n_chars == len(r.text)

    assert set(rows[5]) <= set(rows[4]) and len(rows[5]) > 20
    assert all(rows[5][k].text == rows[4][k].text for k in rows[5])


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "text", "probability"} <= set(got.columns) and got.count() > 20
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and sanitise.TERM == "term"
