from logquarry.llm import compression, mixing, simhash, toxicity, urlrules
from tests.llm.conftest import prose

#: What the operators call their own columns, partly in other letter case.
NAMES = ["_vector", "_RAW", "_margin", "_score", "_tox", "_f_words", "_signals", "_Kept", "_source", "_LANG", "_subject", "_found", "apart0"]


def table(spark, text="text"):
    rows = [(i, prose(i, 40) + (" you idiot" if i % 3 == 0 else ""), "en", "s", *[f"{n} {i}" for n in NAMES]) for i in range(30)]
    return spark.createDataFrame(rows, ["doc_id", text, "lang", "source", *NAMES])


def held(found):
    return {tuple(r[n] for n in NAMES) for r in found.collect()} <= {tuple(f"{n} {i}" for n in NAMES) for i in range(30)}


def test_columns_named_like_internal_ones_are_kept(spark):
    docs = table(spark)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), i % 2) for i in range(30)], "doc_id long, toxic int, quality int")
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns and held(kept)
    scored = toxicity.Model(docs, labels).scored(docs)
    assert scored.columns == [*docs.columns, "score", "predicted"] and scored.count() == 30 and held(scored)
    scored = compression.Model(docs, labels).scored(docs)
    assert scored.columns == [*docs.columns, "score", "predicted"] and scored.count() == 30 and held(scored)
    first = simhash.first_of_each(docs)
    assert first.columns == docs.columns and first.count() == 30 and held(first)
    drawn = mixing.sampled(docs)
    assert drawn.columns[: len(docs.columns)] == docs.columns and held(drawn)
    judged = urlrules.judged(table(spark, "url"))
    assert judged.columns[: len(docs.columns)] == ["doc_id", "url", *docs.columns[2:]] and judged.count() == 30 and held(judged)
