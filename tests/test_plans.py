"""Positions of the candidates count all rows, also where doc_ids have gaps, repeat or are null."""

import duckdb
import pytest

from siltstone.plans.queries import ORACLES, QUERIES

IDS = [5, 40, 7, 7, 7, None, None, -3, 10**12, 26, 26, 50, *range(100, 130)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("candidates"))
    rows = [(doc_id, f"text {k}", "en", f"source{k % 3}", 6) for k, doc_id in enumerate(IDS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{to}/documents.parquet")
    return to


@pytest.mark.parametrize("name", ["plan_exclude", "plan_rank"])
def test_positions_count_all_rows(spark, folder, name):
    df = QUERIES[name](spark, folder)
    rows = sorted(tuple(map(repr, r)) for r in df.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = con.execute(ORACLES[name])
    assert [d[0] for d in got.description] == df.columns
    assert rows == sorted(tuple(map(repr, r)) for r in got.fetchall())
    n = len(IDS) + sum(x is not None and x % 10 == 0 for x in IDS)
    assert sorted(int(r[0]) for r in rows) == list(range(1, n + 1))
