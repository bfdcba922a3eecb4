import duckdb
import pytest

from logquarry.llm import mixing

NAMES = ["doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability"]


def test_sample_matches_sql(spark, odd, tmp_path):
    docs = odd.drop("topic", "n_tokens", "weight", "probability").union(odd.drop("topic", "n_tokens", "weight", "probability").withColumn("doc_id", odd.doc_id + 100))
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    got = sorted(map(str, (tuple(r) for r in mixing.sampled(docs).select(*NAMES).collect())))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    assert got == sorted(map(str, con.sql(mixing.oracle()).fetchall() if hasattr(con.sql("select 1"), "fetchall") else con.execute(mixing.oracle()).fetchall()))


def cells(spark):
    rows = [(s, v, t, 10 + 7 * i + 3 * j + 11 * k) for i, s in enumerate("abc") for j, v in enumerate(("en", "de")) for k, t in enumerate(("x", "y"))]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"), rows


def fitted(rows, targets, rounds):
    w = [float(r[3]) for r in rows]
    for _ in range(rounds):
        for m in range(3):
            held = {}
            for r, x in zip(rows, w, strict=True):
                held[r[m]] = held.get(r[m], 0) + x
            w = [x * targets[m][r[m]] / held[r[m]] for r, x in zip(rows, w, strict=True)]
    return {r[:3]: x / sum(w) for r, x in zip(rows, w, strict=True)}


def test_raking_matches_plain_loops_and_meets_margins(spark):
    table, rows = cells(spark)
    targets = [{"a": 0.5, "b": 0.3, "c": 0.2}, {"en": 0.9, "de": 0.1}, {"x": 0.4, "y": 0.6}]
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.raked(table, dict(zip(mixing.MARGINS, targets, strict=True))).collect()}
    expected = fitted(rows, targets, mixing.ROUNDS)
    assert got == pytest.approx(expected)
    assert sum(x for k, x in got.items() if k[0] == "a") == pytest.approx(0.5, abs=1e-6)


def test_many_cells_take_the_shuffled_way(spark, monkeypatch):
    table, _ = cells(spark)
    plain = sorted(map(tuple, mixing.calibrated(mixing.raked(table)).collect()))
    monkeypatch.setattr(mixing, "TASK_CELLS", 0)
    other = sorted(map(tuple, mixing.calibrated(mixing.raked(table)).collect()))
    assert [r[:3] for r in plain] == [r[:3] for r in other]
    assert [r[3:] for r in plain] == [pytest.approx(r[3:]) for r in other]


def test_calibration_meets_the_budget(spark):
    table, rows = cells(spark)
    for budget in (0.05, 0.4, 0.8, 1.0):
        got = mixing.calibrated(mixing.raked(table), budget).collect()
        assert sum(r.tokens * r.probability for r in got) == pytest.approx(budget * sum(r[3] for r in rows))
        assert all(0 <= r.probability <= 1 for r in got)


def test_targets_without_a_value_and_empty_tables(spark, odd, nothing):
    got = mixing.sampled(odd, {"lang": {"en": 1.0}}, budget=1.0).collect()
    assert {r.lang for r in got} == {"en"}
    assert mixing.sampled(nothing).count() == 0
    assert set(odd.columns) <= set(mixing.sampled(odd).columns)
