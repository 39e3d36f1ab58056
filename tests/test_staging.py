"""Ordinals over ranges against a sort in plain Python."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import staging


def stored(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def test_places_over_all_rows(spark, tmp_path):
    rows = [((k * 37) % 101 if k % 9 else None, f"r{k % 7}") for k in range(500)]
    out = staging.numbered(stored(spark, tmp_path, rows, "a long, b string"), ["a", "b"], "place", parts=7).collect()
    assert sorted(r["place"] for r in out) == list(range(500))
    key = lambda a, b: (a is not None, a or 0, b)
    assert [key(r["a"], r["b"]) for r in sorted(out, key=lambda r: r["place"])] == sorted(key(a, b) for a, b in rows)


def test_places_within_groups_of_any_size(spark, tmp_path):
    """One group holds most rows, another is the null group, and one key repeats hundreds of times."""
    rows = [(None if k % 10 == 0 else "hot" if k % 10 < 8 else f"g{k % 3}", 5 if k % 2 else k) for k in range(900)]
    df = stored(spark, tmp_path, rows, "g string, a long")
    out = staging.numbered(df, ["a"], "place", within=["g"], parts=6).collect()
    groups = {}
    for g, a in rows:
        groups.setdefault(g, []).append(a)
    for g, values in groups.items():
        own = sorted((r["place"], r["a"]) for r in out if r["g"] == g)
        assert [p for p, _ in own] == list(range(len(values))) and [a for _, a in own] == sorted(values)
    spread = staging.numbered(df.filter("g = 'hot'"), ["g"], "place", parts=6)
    assert spread.select(F.spark_partition_id()).distinct().count() > 1  # equal keys don't meet in one task


def test_places_of_nothing_and_of_clashing_columns(spark):
    assert staging.numbered(spark.createDataFrame([], "a long"), ["a"]).count() == 0
    with pytest.raises(ValueError, match="ordinal"):
        staging.numbered(spark.createDataFrame([(1, 2)], "a long, ordinal long"), ["a"])


@pytest.mark.parametrize(("master", "fine"), [("local", True), ("local[8]", True), ("local[*]", True), ("local-cluster[2,1,1024]", False), ("spark://h:7077", False), ("yarn", False)])
def test_a_cluster_must_name_its_shared_folder(master, fine):
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": master})  # noqa: N815

    if fine:
        assert staging.scratch_root(Session).startswith("file:///") and staging.scratch_root(Session) == Session.conf["spark.checkpoint.dir"]
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            staging.scratch_root(Session)
