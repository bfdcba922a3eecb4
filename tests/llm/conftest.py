import pytest

from logquarry.shipping import ship

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like results or like what results are made of.
CLASHING = "score string, predicted string, fingerprint long, component_id string, topic long, n_tokens string, weight string, probability string, spans long, kept string, label string, host long, rule long, node string, part string"


@pytest.fixture(scope="session", autouse=True)
def sent(spark):
    ship(spark)


def prose(seed, words, size=400):
    import random

    rnd = random.Random(seed)
    known = ["".join(random.Random(1000 * i + 7).choices("aeinorstlhd", k=2 + i % 9)) for i in range(size)]
    return " ".join(rnd.choices(known, k=words))


def documents(spark, texts, lang="en", source="s"):
    rows = [(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns that clash."""
    extra = ["x"] * 2 + [1, "c", 2, "t", "w", "p", 3, "k", "l", 4, 5, "n", "q"]
    long = prose(5, 30_000) + " a@b.example.com"
    rows = [(None, prose(1, 50), "en", "s", 1), (1, None, "en", "s", 1), (2, "", "de", "s", 0), (3, prose(2, 80), None, None, None), (3, prose(2, 80), None, None, None)]
    rows += [(4, long, "en", "s", len(long)), (5, long + " more", "en", "s", 1), (6, "\t\n ", "en", "t", 3), (7, "x" * 5000, "en", "t", 5000), (8, "!!! 12", "en", "t", 6), (8, "other text of the same id", "fr", "t", 6), (None, None, None, None, None)]
    return [(*r, *extra) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), f"{COLUMNS}, {CLASHING}").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], f"{COLUMNS}, {CLASHING}")
