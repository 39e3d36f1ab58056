"""The log-structured store: what a write touches, what readers see, and what a search opens."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import storage


def records(spark, ids, version, pdb=None):
    ids = spark.createDataFrame([(d,) for d in ids], "document_id string")
    none = lambda *cs: [F.lit(None).cast("string").alias(c) for c in cs]
    value = F.lit(pdb) if pdb else F.concat(F.lit("1A"), F.substring(F.md5("document_id"), 1, 2))
    return {
        "articles": ids.select("document_id", *none("title", "doi", "source_uri", "full_text_sha256"), F.concat(F.lit(f'{{"v":{version},"id":"'), "document_id", F.lit('"}')).alias("record_json")),
        "literature_facts": ids.select("document_id", F.lit("starting_pdb_id").alias("field"), F.upper(value).alias("value"), F.lit("p").alias("paragraph_id"), F.lit(0).alias("start_char"), F.lit(4).alias("end_char"), F.upper(value).alias("quote")),
        "residue_mappings": ids.select("document_id", F.upper(value).alias("pdb_id"), F.lit("P12345").alias("uniprot_accession"), F.lit("A").alias("chain_id"), *(F.lit(k).alias(c) for k, c in enumerate(("pdb_start", "pdb_end", "uniprot_start", "uniprot_end")))),
    }


def files(folder, kind):
    return {(p.parent.parent.name, p.parent.name) for p in (folder / "log" / f"kind_={kind}").rglob("*.parquet")}


def test_one_record_writes_one_bucket(spark, tmp_path):
    store = storage.Store(spark, f"file://{tmp_path}/store")
    store.write(records(spark, [f"PMC{k}" for k in range(300)], 1))
    first = files(tmp_path / "store", "articles")
    assert len(first) > 50 and len({s for s, _ in first}) == 1
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "log").rglob("*.parquet")}
    store.write(records(spark, ["PMC7"], 2))
    for kind in ("articles", "literature_facts", "residue_mappings", "ids"):
        assert len(files(tmp_path / "store", kind) - first) == 1 or kind != "articles"
    added = {p for p in (tmp_path / "store" / "log").rglob("*.parquet")} - set(before)
    assert len([p for p in added if "kind_=articles" in str(p)]) == 1 and len(added) <= 7
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())  # what is there isn't written again
    assert store.count() == 300 and json.loads(store.get("pmc7"))["v"] == 2 and json.loads(store.get("PMC8"))["v"] == 1


def test_readers_keep_their_snapshot(spark, tmp_path):
    store = storage.Store(spark, f"file://{tmp_path}/store")
    assert store.count() == 0 and store.table("md_assets").count() == 0
    store.write(records(spark, ["PMC1", "PMC2"], 1, "1abc"))
    old = store.view()
    store.write(records(spark, ["PMC1"], 2, "2xyz"))
    new = store.view()
    found = lambda v, p: [r[0] for r in v.search(pdb_id=p).collect()]
    assert (found(old, "1abc"), found(old, "2XYZ")) == (["PMC1", "PMC2"], []) and json.loads(old.get("PMC1"))["v"] == 1
    assert (found(new, "1abc"), found(new, "2XYZ")) == (["PMC2"], ["PMC1"]) and json.loads(new.get("PMC1"))["v"] == 2
    assert [r[0] for r in new.search(accession="p12345").collect()] == ["PMC1", "PMC2"]
    # a record without mappings loses those it had
    bare = records(spark, ["PMC2"], 3)
    store.write({"articles": bare["articles"]})
    assert found(store, "1abc") == [] and store.table("residue_mappings").count() == 1 and store.count() == 2
    store.compact()
    assert found(store, "2xyz") == ["PMC1"] and json.loads(store.get("PMC2"))["v"] == 3 and store.count() == 2 and found(new, "1abc") == ["PMC2"]
    store.clean()
    assert len({s for s, _ in files(tmp_path / "store", "ids")}) == 1 and found(store, "2xyz") == ["PMC1"] and store.count() == 2
    store.compact()
    assert len(store._numbers()) == 1
    with pytest.raises(storage.NotFound):
        store.get("PMC3")


def test_a_write_that_fails_or_comes_second(spark, tmp_path):
    store = storage.Store(spark, f"file://{tmp_path}/store")
    store.write(records(spark, ["PMC1"], 1))
    broken = records(spark, ["PMC1"], 2)
    broken["articles"] = broken["articles"].withColumn("title", F.raise_error(F.lit("no more")).cast("string"))
    with pytest.raises(Exception, match="no more"):
        store.write(broken)
    assert json.loads(store.get("PMC1"))["v"] == 1 and store.count() == 1
    with pytest.raises(RuntimeError, match="write again"):
        store._commit(1, [])
    assert store.count() == 1
    store.clean()  # the failed write's segment goes
    assert len({s for s, _ in files(tmp_path / "store", "ids")}) == 1


def test_a_search_opens_the_buckets_of_its_values(spark, tmp_path):
    store = storage.Store(spark, f"file://{tmp_path}/store")
    store.write(records(spark, [f"PMC{k}" for k in range(400)], 1))
    view = store.view()
    value = view.table("literature_facts").first()["value"]
    opened = view.entries(pdb_id=value).select(F.col("segment"), F.col("bucket")).distinct().collect()
    assert len(opened) == 1
    inputs = view.entries(pdb_id=value).inputFiles()
    assert inputs and all(f"/kind_=index/" in f and f"/bucket={view.bucket(value)}/" in f for f in inputs)
    assert all(f"/bucket={view.bucket('PMC9')}/" in f for f in view.table("articles", [view.bucket("PMC9")]).inputFiles())
    want = sorted(r["document_id"] for r in view.table("literature_facts").filter(F.col("value") == value).collect())
    assert [r[0] for r in view.search(pdb_id=value).collect()] == want


def test_answers_of_the_service(spark, tmp_path):
    store = storage.Store(spark, f"file://{tmp_path}/store")
    assert storage.answer(store, "/health") == (200, {"status": "ok", "article_count": 0})
    store.write(records(spark, ["PMC2", "PMC1"], 1, "1abc"))
    assert storage.answer(store, "/records/pmc1") == (200, {"v": 1, "id": "PMC1"})
    assert storage.answer(store, "/records/PMC9") == (404, {"detail": "record not found"})
    assert storage.answer(store, "/search") == (400, {"detail": "supply pdb_id or uniprot_accession"})
    assert storage.answer(store, "/search", pdb_id="12")[0] == 422 and storage.answer(store, "/search", uniprot_accession="P")[0] == 422
    found = {"count": 2, "records": [{"v": 1, "id": "PMC1"}, {"v": 1, "id": "PMC2"}]}
    assert storage.answer(store, "/search", pdb_id="1abc") == storage.answer(store.view(), "/search", uniprot_accession="P12345") == (200, found)
    assert storage.answer(store, "/search", pdb_id="9zzz") == (200, {"count": 0, "records": []}) and storage.answer(store, "/nowhere")[0] == 404
