"""A sample of the registered queries against DuckDB; `python -m tests.oracle` checks all of them."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import DATA, duck_rows, spark_rows

SAMPLE = ("anomaly_groups", "growing_queues", "time_clusters", "nearest_sample", "structure_lines", "search_context", "mem_trend",
          "oom_pairing", "app_shares", "attempts", "policy_union", "archive_kinds")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    assert spark_rows(spark, queries()[name], f"{DATA}/sf0.001") == duck_rows(oracle_sql()[name], f"{DATA}/sf0.001")


def test_small_chunks_give_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr("logquarry.operators.ordered.CHUNK_LINES", 16)
    for name in ("structure_lines", "growing_queues", "time_clusters"):
        assert spark_rows(spark, queries()[name], f"{DATA}/sf0.001") == duck_rows(oracle_sql()[name], f"{DATA}/sf0.001"), name


def test_contract(spark):
    assert entry(spark).limit(1).count() == 1
    assert set(oracle_sql()) <= set(queries())
