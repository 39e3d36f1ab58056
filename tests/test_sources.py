"""Sources, sinks and small operators on hand-made rows."""

import hashlib
import json

from pyspark.sql import functions as F

from siltstone.operators import articles, candidates, comparison, residues, validation
from siltstone.sources import files, remote

EVENTS = "document_id string, event_type string, duration_ps double, temperature_k double"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_article_counts_keep_documents_without_attributes(spark):
    p = spark.createDataFrame([("A", "production", 5.0, 300.0), ("B", "heating", None, None)], EVENTS)
    r = spark.createDataFrame([("A", "production", 5.0, 310.0), ("C", "heating", 1.0, None)], EVENTS)
    got = {x["document_id"]: (x["tp"], x["fp"], x["fn"]) for x in comparison.article_counts(p, r).collect()}
    assert got == {"A": (1, 1, 1), "B": (0, 0, 0), "C": (0, 0, 1)}
    assert comparison.attribute_keys(p).count() == 2


def test_freeze_gives_the_first_reason(spark):
    rows = [(str(k), "development") for k in range(5)]
    plan = spark.createDataFrame(rows, "document_id string, split string")
    screen = spark.createDataFrame([(str(k), f"h{k}") for k in range(1, 5)], "document_id string, full_text_sha256 string")
    own = spark.createDataFrame([("2", "other"), ("3", "h3"), ("4", "h4")], "document_id string, sha256 string")
    read = spark.createDataFrame([("2", None), ("3", "bad"), ("4", None), ("4", None)], "document_id string, error string")
    events = spark.createDataFrame([("4",)], "document_id string")
    got = {r["document_id"]: tuple(r)[2:] for r in articles.frozen(plan, screen, own, read, events).collect()}
    assert got == {"0": ("missing_screen_record", None, None), "1": ("missing_source", None, None), "2": ("source_hash_mismatch", None, None), "3": ("not_well_formed", None, None), "4": (None, 2, 1)}
    assert articles.frozen(plan.limit(0), screen, own, read, events).count() == 0


def test_cache_keeps_what_is_intact(spark):
    kind = "endpoint string, http_status int, payload string, response_received boolean"
    answers = spark.createDataFrame([("u1", 200, "{}", True), ("u2", 404, '{"a": 1}', True), ("u3", None, None, False)], kind)
    rows = validation.cache_rows(answers)
    assert {tuple(r)[:2] + (r["cache_key"],) for r in rows.collect()} == {("u1", 200, sha("u1")), ("u2", 404, sha("u2"))}
    changed = rows.withColumn("payload", F.when(F.col("endpoint") == "u2", "{}").otherwise(F.col("payload")))
    assert [r["endpoint"] for r in validation.cached(answers, changed).collect()] == ["u1"]
    assert [r["payload"] for r in validation.compact(answers).collect()] == [None] * 3
    assert validation.compact(answers, retain_payload=True) is answers


def test_provenance_problems(spark):
    kind = "local_path string, availability string, sha256 string"
    assets = spark.createDataFrame([("a", "verified_local", "1"), ("b", "verified_local", "1"), ("c", "verified_local", "1"), (None, "verified_local", None), ("d", "declared", None)], kind)
    found = validation.provenance(assets, spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string"))
    assert {r["local_path"]: r["problem"] for r in found.collect()} == {"a": None, "b": "hash_mismatch", "c": "file_not_found", None: "verified_asset_needs_path_and_hash", "d": None}


def test_chains_and_acceptance(spark):
    rows = spark.createDataFrame([("A", 2, "HSD"), ("A", 1, "ala"), ("A", 3, "POPC"), ("A", 4, "GLY"), ("B", 1, "TIP3")], "chain_id string, residue_order int, residue_name string")
    own = residues.protein_chains(rows)
    assert sorted((r["residue_order"], r["sequence_index"], r["one_letter"]) for r in own.collect()) == [(1, 1, "A"), (2, 2, "H"), (4, 3, "G")]
    assert [tuple(r) for r in residues.sequences(own).collect()] == [("A", "AHG")]
    audits = spark.createDataFrame([("review", 0.99, 0.99, 0.99), ("review", 0.5, 0.99, 0.99), ("failed", 1.0, 1.0, 1.0)], "status string, identity double, pdb_coverage double, uniprot_coverage double")
    assert [r["status"] for r in residues.accepted(audits).collect()] == ["verified_with_construct_variants", "review", "failed"]


def test_listings(spark, tmp_path):
    residue = lambda n, name: {"residue_number": n, "author_residue_number": n + 10, "residue_name": name}
    chain = {"chain_id": "A", "struct_asym_id": "B", "residues": [residue(k, "ALA") for k in range(1, 5)]}
    payload = {"1abc": {"molecules": [{"entity_id": 1, "molecule_name": "m", "chains": [chain, {"chain_id": "C", "residues": []}]}]}}
    answers = spark.createDataFrame([("1abc", json.dumps(payload))], "pdb_id string, payload string")
    listed = files.residue_listing(answers)
    assert [(r["residue_order"], r["residue_number"], r["author_number"]) for r in listed.orderBy("residue_order").collect()] == [(0, 1, 11), (1, 2, 12), (2, 3, 13), (3, 4, 14)]
    assert [(r["n_residues"], len(r["first"]), len(r["last"])) for r in files.residue_summary(listed).collect()] == [(4, 3, 3)]
    got = {r["chain_id"]: r for r in files.residue_schema(answers).collect()}
    assert got["A"]["pdb_id"] == "1ABC" and got["A"]["n_residues"] == 4 and got["A"]["entity_id"] == "1"
    assert got["A"]["chain_keys"] == ["chain_id", "residues", "struct_asym_id"] and got["A"]["residue_keys"] == ["author_residue_number", "residue_name", "residue_number"]
    assert got["C"]["n_residues"] == 0 and got["C"]["residue_keys"] == []


def test_file_rows(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"articles": [{"document_id": "PMC1", "title": "t", "year": 2016, "full_text_available": True}]}))
    (tmp_path / "v.jsonl").write_text(json.dumps({"identifier_type": "pdb", "query": "1ABC", "state": "validated", "reason": "entry_exists", "attempts": 1}))
    assert [(r["document_id"], r["year"]) for r in files.read_candidates(spark, f"file://{tmp_path}/c.json").collect()] == [("PMC1", 2016)]
    assert [(r["query"], r["attempts"]) for r in files.read_validations(spark, f"file://{tmp_path}/v.jsonl").collect()] == [("1ABC", 1)]
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml/pmc7.xml").write_text("<a/>")
    plan = spark.createDataFrame([("PMC7",), ("PMC8",)], "document_id string")
    assert [r[0] for r in files.missing_articles(plan, files.read_articles(spark, f"file://{tmp_path}/xml")).collect()] == ["PMC8"]
    assert [(r["bytes"], r["sha256"]) for r in remote.hashed_files(spark, f"file://{tmp_path}/xml").collect()] == [(4, sha("<a/>"))]
    files.write_workpack(spark.createDataFrame([("b", 1), ("a", 2), ("a", 1)], "split string, split_order int"), f"file://{tmp_path}/pack")
    pack = spark.read.csv(f"file://{tmp_path}/pack/articles", header=True)
    assert [(r["split"], r["split_order"], r["reviewer_a_eligible"], r["adjudicator_note"]) for r in pack.collect()] == [("a", "1", None, None), ("a", "2", None, None), ("b", "1", None, None)]
    text = lambda name: "\n".join(r[0] for r in spark.read.text(f"file://{tmp_path}/pack/{name}").collect())
    about = json.loads(text("pack"))
    assert about["article_count"] == 3 and about["split_counts"] == {"a": 2, "b": 1} and about["eligibility_values"] == ["yes", "no", "uncertain"]
    assert {f["name"]: f["type"] for f in json.loads(text("schema"))}["start_char"] == "int" and "annotator" in text("guide") and text("facts") == text("facts_b") == ""


def test_backend_sees_all_paragraphs_of_a_document(spark):
    rows = spark.createDataFrame([("D", "p2", "Methods", "two"), ("D", "p1", "Methods", "one"), ("E", "p1", "Results", "none")], "document_id string, paragraph_id string, section string, text string")
    complete = lambda prompt: [{"quote": prompt[prompt.index("[paragraph_id=p1") :]}] if "two" in prompt else []
    got = candidates.proposed(rows, complete, "document_id string, quote string").collect()
    assert [tuple(r) for r in got] == [("D", "[paragraph_id=p1; section=Methods]\none\n\n[paragraph_id=p2; section=Methods]\ntwo")]


def test_project_descriptors(spark):
    project = json.dumps({"published": True, "metadata": {"NAME": "n", "PDBIDS": ["1ABC"], "atomCount": 12, "OTHER": 1}})
    listed = {"files": [{"filename": "a.pdb", "length": 5}, {"name": "b.xtc", "size": 7, "contentType": "x"}]}
    by_name = {"one": {"filename": "c.inp"}}
    rows = [("A", project, json.dumps(listed)), ("B", json.dumps({}), json.dumps(listed["files"])), ("C", None, json.dumps(by_name)), ("D", "no json", None)]
    got = {r["project"]: r for r in files.project_descriptors(spark.createDataFrame(rows, "project string, project_payload string, files_payload string")).collect()}
    assert got["A"]["published"] and got["A"]["metadata"] == {"NAME": "n", "PDBIDS": '["1ABC"]', "atomCount": "12"} and got["A"]["descriptor_count"] == 2
    assert [(f["filename"], f["roles"], f["bytes"], f["content_type"]) for f in got["A"]["files"]] == [("a.pdb", ["topology_or_structure"], 5, None), ("b.xtc", ["trajectory"], 7, "x")]
    assert got["B"]["published"] is None and got["B"]["metadata"] == {} and got["B"]["descriptor_count"] == 2
    assert [f["roles"] for f in got["C"]["files"]] == [["workflow_or_parameters"]] and got["D"]["descriptor_count"] == 0
