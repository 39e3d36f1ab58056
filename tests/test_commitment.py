"""Trees and proofs against plain Python; commitments of plans, manifests and JSON lines."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import commitment, sampling
from siltstone.sources import files


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def root(rows, fan):
    nodes = [sha("leaf:" + json.dumps(r, sort_keys=True, separators=(",", ":"))) for r in rows]
    n = len(nodes)
    while len(nodes) > 1:
        nodes = [sha("node:" + "".join(nodes[k : k + fan])) for k in range(0, len(nodes), fan)]
    return sha(f"{n}:{nodes[0] if nodes else sha('')}")


@pytest.mark.parametrize(("n", "fan"), [(0, 2), (1, 4), (5, 2), (64, 4), (201, 7)])
def test_roots_whatever_the_partitions(spark, n, fan):
    rows = [{"a": k // 3, "b": None if k % 5 == 0 else f"x{k}"} for k in range(n)]
    df = spark.createDataFrame([(r["a"], r["b"]) for r in rows], "a long, b string")
    ordered = sorted(rows, key=lambda r: (r["a"], sha("leaf:" + json.dumps(r, sort_keys=True, separators=(",", ":")))))
    want = root(ordered, fan)
    for parts in (1, 9):
        assert commitment.root_of(df.orderBy(F.rand(parts)).repartition(parts), ["a"], fan=fan) == want


def test_proofs(spark):
    """Each row's proof leads to the root; no other row, place or number of rows does."""
    df = spark.range(150).select("id", F.concat(F.lit("v"), "id").alias("v"))
    tree = commitment.Tree(df, ["id"], fan=4)
    own = tree.proofs()
    rows = commitment.proven(own, tree.n, tree.root())
    assert rows.filter("verified").count() == 150 and tree.n == 150 and len(tree.levels) == 5
    assert commitment.proven(own.filter("id % 7 = 0"), tree.n, tree.root()).filter("NOT verified").count() == 0
    other = own.withColumn("leaf", F.sha2(F.concat(F.lit("leaf:"), F.lit('{"id":999}')), 256))
    assert commitment.proven(other, tree.n, tree.root()).filter("verified").count() == 0
    assert commitment.proven(own, tree.n + 1, tree.root()).filter("verified").count() == 0
    swapped = own.withColumn("proof", F.reverse("proof"))
    assert commitment.proven(swapped, tree.n, tree.root()).filter("verified").count() == 0
    tree.drop()


def test_a_plan_commits_to_each_exclusion(spark):
    plan = spark.createDataFrame([("development", 1, "PMC1"), ("validation", 2, "PMC2")], "split string, order int, identifier string")
    left_out = spark.range(300).select(F.col("id").alias("position"), F.concat(F.lit("PMC"), "id").alias("document_id"), F.lit("full_text_unavailable").alias("reason"))
    one = sampling.commitment(plan, left_out, {"seed": 3997})
    assert one == sampling.commitment(plan.repartition(3), left_out.repartition(11), {"seed": 3997})
    changed = [left_out.withColumn("reason", F.when(F.col("position") == 299, "x").otherwise(F.col("reason"))), left_out.filter("position < 299"), left_out.limit(0)]
    assert one not in [sampling.commitment(plan, x, {"seed": 3997}) for x in changed]
    assert one != sampling.commitment(plan.filter("order = 1"), left_out, {"seed": 3997}) and one != sampling.commitment(plan, left_out, {"seed": 1})


def test_manifests_and_lines(spark, tmp_path):
    rows = spark.range(50).select(F.concat(F.lit("PMC"), "id").alias("document_id"), F.lit("validation").alias("split"))
    stored = sampling.manifest_root(rows)
    assert sampling.manifest_intact(rows.repartition(7), stored) and not sampling.manifest_intact(rows, None)
    assert not sampling.manifest_intact(rows.withColumn("split", F.lit("development")), stored) and not sampling.manifest_intact(rows.filter("document_id <> 'PMC7'"), stored)
    written = files.write_jsonl(rows.repartition(4), f"file://{tmp_path}/lines", ["document_id"])
    lines = [x for p in sorted((tmp_path / "lines").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == sorted(lines) and len(lines) == 50
    back = spark.read.schema("document_id string, split string").json(f"file://{tmp_path}/lines")
    assert files.jsonl_intact(back, ["document_id"], written) and not files.jsonl_intact(back.limit(49), ["document_id"], written)
