import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import comparison, residues, sampling, storage, validation
from siltstone.plans import analysis
from siltstone.sources import files, web

EVENTS = "document_id string, event_type string, duration_ps double, temperature_k double"


def test_multisets_keep_repeats(spark):
    p = spark.createDataFrame([("A", "production", 100.0, 300.0)], EVENTS)
    r = spark.createDataFrame([("A", "production", 100.0, 300.0)] * 2, EVENTS)
    rows = {x["level"]: x for x in comparison.evaluated(p, r).collect()}
    assert (rows["event"]["tp"], rows["event"]["fn"], rows["event"]["f1"]) == (1, 1, pytest.approx(2 / 3))
    assert {(x["reference_phase"], x["predicted_phase"], x["n"]) for x in comparison.confusion(p, r).collect()} == {("production", "production", 1), ("production", comparison.MISSED, 1)}
    empty = p.limit(0)
    assert [x["f1"] for x in comparison.evaluated(empty, empty).collect()] == [0.0] * 3


def test_confusion_equals_pairing_one_by_one(spark):
    rng = random.Random(3)
    make = lambda n: [(f"D{rng.randrange(3)}", rng.choice("abcd"), float(rng.randrange(2)), None) for _ in range(n)]
    p, r = make(60), make(50)
    want = Counter()
    for key in {(d, x) for d, _, x, _ in p + r}:
        a, b = (Counter(t for d, t, x, _ in rows if (d, x) == key) for rows in (p, r))
        both = a & b
        for phase, n in both.items():
            want[phase, phase] += n
        left, ref = sorted((a - both).elements()), sorted((b - both).elements())
        for k in range(max(len(left), len(ref))):
            want[ref[k] if k < len(ref) else comparison.SPURIOUS, left[k] if k < len(left) else comparison.MISSED] += 1
    got = comparison.confusion(spark.createDataFrame(p, EVENTS), spark.createDataFrame(r, EVENTS)).collect()
    assert {(x["reference_phase"], x["predicted_phase"]): x["n"] for x in got} == dict(want)


@pytest.mark.parametrize(("n", "places", "group"), [(1, 4, 8), (7, 4, 8), (64, 16, 32), (150, 16, 32), (3000, 1 << 16, 1 << 24)])
def test_resamples_on_executors(spark, monkeypatch, n, places, group):
    """Draws by ranges of iterations and groups of places are those of Python's generator, whatever the block."""
    monkeypatch.setattr(comparison, "BLOCK", 257)
    states = comparison.generator_states(spark, n, 50, 8)
    rows = comparison.packed_draws(states, n, 7, places, group).collect()
    got = [(r["iteration"], r["range"] * places + at, int(times)) for r in rows for at, times in enumerate(np.frombuffer(r["times"], np.int32)) if times]
    assert sorted(got) == sorted(comparison.resamples(n, iterations=50))
    assert len(rows) == 50 * -(-n // places)


def test_seeded_bootstrap(spark):
    per = [(k, k % 5, k % 3, k % 7) for k in range(300)]
    df = spark.createDataFrame(per, "place long, tp long, fp long, fn long").repartition(5)
    sums = {k: [0, 0, 0] for k in range(40)}
    for k, at, times in comparison.resamples(300, iterations=40):
        sums[k] = [a + times * b for a, b in zip(sums[k], per[at][1:], strict=True)]
    rows = comparison.seeded_bootstrap(df, 300, iterations=40, places=32, group=64)
    assert {r["iteration"]: [r["tp"], r["fp"], r["fn"]] for r in rows.collect()} == sums
    assert comparison.seeded_bootstrap(df.limit(0), 0).count() == 0


def test_draws_stay_in_their_tasks(spark):
    """packed draws, by their plan a small side of a join, were broadcast through the driver: 4 bytes a document and iteration."""
    df = spark.createDataFrame([(k, 1, 300 * k, 70_000 * k) for k in range(90)], "place long, tp long, fp long, fn long")
    rows = comparison.seeded_bootstrap(df, 90, iterations=20, per_task=3, places=16, group=32)
    plans = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plans and "times" not in plans
    draws = comparison.resamples(90, iterations=20)
    assert {(r["iteration"], r["tp"], r["fp"], r["fn"]) for r in rows.collect()} == {(k, 90, *(sum(x * at * n for j, at, n in draws if j == k) for x in (300, 70_000))) for k in range(20)}


def test_interval_draws_documents(spark, tmp_path):
    """More documents than 60, each with a weight of its own."""
    rows = [(k, 1 + j, "ANR"[k % 3], float(1 + k * j % 5), 4, 2, k % 5) for k in range(100, 190) for j in range(3)]
    columns = "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double, l_partkey long, l_suppkey long, n int"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    attributes = ("duration_ps", "temperature_k", "ensemble", "replicates")
    sides = [Counter((r["document_id"], r["event_type"], a, r[a]) for r in x.collect() for a in attributes if r[a] is not None) for x in analysis._events(spark, f"{tmp_path}")]
    counts = {d: dict.fromkeys(("tp", "fp", "fn"), 0) for d in sorted({k[0] for x in sides for k in x})}
    for c, x in (("tp", sides[0] & sides[1]), ("fp", sides[0] - sides[1]), ("fn", sides[1] - sides[0])):
        for key, n in x.items():
            counts[key[0]][c] += n
    per = [counts[d] for d in sorted(counts)]
    values = {}
    for k, at, times in comparison.resamples(len(per)):
        sums = values.setdefault(k, [0, 0, 0])
        for i, c in enumerate(("tp", "fp", "fn")):
            sums[i] += per[at][c] * times
    f1 = sorted(2 * tp / (2 * tp + fp + fn) for tp, fp, fn in values.values())
    got = analysis.ev_interval(spark, f"{tmp_path}").first()
    assert len(per) == 90 and got["low"] == pytest.approx(f1[int(1999 * 0.025)]) and got["high"] == pytest.approx(f1[int(1999 * 0.975)])


def test_bootstrap_interval(spark):
    draws = comparison.resamples(4, iterations=50)
    rng = random.Random(comparison.SEED)
    assert Counter(rng.choice(range(4)) for _ in range(4)) == {p: n for k, p, n in draws if k == 0}
    per = spark.createDataFrame([(0, 1, 0, 0), (1, 0, 1, 1), (2, 2, 1, 0), (3, 0, 0, 2)], "place int, tp int, fp int, fn int")
    rows = comparison.bootstrap(per, spark.createDataFrame(draws, "iteration int, place int, times int"))
    values = sorted(r["f1"] for r in rows.collect())
    got = comparison.interval(rows).first()
    assert (got["low"], got["high"]) == (values[int(0.025 * 49)], values[int(0.975 * 49)])


def test_annotations_keep_json_values_apart(spark):
    schema = "document_id string, field_name string, normalized_value string, unit string, event_type string, paragraph_id string, start_char int, end_char int, quote string"
    a = spark.createDataFrame([("A", "t", "300", None, "x", "p", 0, 3, "300")], schema)
    b = spark.createDataFrame([("A", "t", "300", None, "x", "p", 1, 4, "300"), ("A", "t", "300.0", None, "x", "p", 1, 4, "300")], schema)
    rows = {r["level"]: r for r in comparison.compared(a, b.limit(1)).collect()}
    assert (rows["semantic"]["agreement"], rows["exact"]["agreement"]) == (1.0, 0.0)
    assert comparison.disagreements(a, b).count() == 3 and comparison.span_errors(b).count() == 0


def candidates(spark, n=200):
    rows = [(k, f"PMC{k}", True, 2018, f"s{k % 4}") for k in range(n)] + [(n, "pmc3", True, 2018, "s0"), (n + 1, "X1", True, 2018, "s0"), (n + 2, "PMC900", False, 2018, "s0"), (n + 3, "PMC901", True, None, ""), (n + 4, "PMC901", True, 2018, "")]
    return spark.createDataFrame(rows, "position long, document_id string, full_text_available boolean, year int, stratum string")


def test_plan(spark):
    excluded = spark.createDataFrame([("pmc5",)], "document_id string")
    rows = sampling.with_reasons(candidates(spark), excluded, require_year=True)
    reasons = {r["position"]: r["reason"] for r in rows.filter("reason is not null").collect()}
    assert reasons == {5: "previous_development_article", 200: "duplicate_document_id", 201: "missing_pmc_identifier", 202: "full_text_unavailable", 203: "missing_publication_year"}
    plan = sampling.create_plan(candidates(spark), excluded, require_year=True).collect()
    assert Counter(r["split"] for r in plan) == {"development": 30, "validation": 10, "locked_test": 20} and len({r["identifier"] for r in plan}) == 60
    again = sampling.create_plan(candidates(spark).repartition(7), excluded, require_year=True)
    assert sampling.commitment(again, rows.filter("reason is not null"), {"seed": 3997}) == sampling.commitment(sampling.create_plan(candidates(spark), excluded, require_year=True), rows.filter("reason is not null"), {"seed": 3997})
    with pytest.raises(sampling.TooFew):
        sampling.create_plan(candidates(spark, 40), excluded)
    assert sampling.gate_plan(excluded, lock=True, temporal=True) == ["too_few_prior_identifiers", "missing_publication_year_max", "known_year_not_required"]


def test_rounds_equal_the_loop(spark):
    own = [(k, f"PMC{k}", f"s{k * k % 5}") for k in range(90)]
    got = [r["identifier"] for r in sampling.selected(spark.createDataFrame(own, "position long, identifier string, stratum string"), 40).orderBy("round", "stratum").collect()]
    import hashlib

    strata = {}
    for _, d, s in own:
        strata.setdefault(s, []).append(d)
    for rows in strata.values():
        rows.sort(key=lambda d: hashlib.sha256(f"3997|{d}".encode()).hexdigest())
    want = []
    while len(want) < 40:
        for s in sorted(strata):
            if strata[s] and len(want) < 40:
                want.append(strata[s].pop(0))
    assert got == want


def test_retrieval_and_states(spark):
    rows = [("e1", 1, None, "timeout", None, None), ("e1", 2, 503, None, None, None), ("e1", 3, 200, None, '{"1abc": []}', None), ("e1", 4, 404, None, None, None), ("e2", 1, 404, None, "{}", None), ("e3", 1, None, "timeout", None, None), ("e3", 2, None, "timeout", None, None), ("e3", 3, None, "reset", None, None), ("e4", 1, 429, None, None, 60.0), ("e4", 2, 200, None, "{}", None), ("e5", 1, 500, None, None, None), ("e5", 2, 500, None, None, None), ("e5", 3, 500, None, None, None)]
    answers = validation.retrieved(spark.createDataFrame(rows, "endpoint string, attempt int, status int, error string, payload string, retry_after double"))
    got = {r["endpoint"]: r for r in answers.collect()}
    assert [(got[e]["attempts"], got[e]["http_status"]) for e in ("e1", "e2", "e3", "e4", "e5")] == [(3, 200), (1, 404), (3, None), (2, 200), (3, 500)]
    assert got["e4"]["waited"] == 5.0 and got["e1"]["waited"] == 0.75
    asked = spark.createDataFrame([("1ABC", f"e{k}") for k in range(1, 7)], "pdb_id string, endpoint string")
    states = sorted((r["state"], r["reason"]) for r in validation.validate_pdb(asked, answers).collect())
    assert states == [("conflict", "response_does_not_contain_requested_entry"), ("conflict", "successful_service_response_identifier_not_found"), ("unresolved", "non_success_service_response"), ("unresolved", "request_failed"), ("unresolved", "reset"), ("validated", "entry_exists")]


def test_mapping_states(spark):
    payload = json.dumps({"1abc": {"UniProt": {"P1": {"mappings": [{"chain_id": "", "struct_asym_id": "B", "start": {"residue_number": 1}, "end": {"residue_number": 2}, "unp_start": 3, "unp_end": 4}]}}}})
    answers = spark.createDataFrame([("e", 1, 200, payload, True, None), ("f", 1, 404, "{}", True, None)], "endpoint string, attempts long, http_status int, payload string, response_received boolean, terminal_error string")
    asked = spark.createDataFrame([("1abc", "P1", None, "e"), ("1abc", "P1", "A", "e"), ("1abc", "P2", None, "e"), ("1abc", "P1", None, "f")], "pdb_id string, accession string, chain_id string, endpoint string")
    assert sorted(r["reason"] for r in validation.validate_mapping(asked, answers).collect()) == ["accession_present_but_chain_absent", "mapping_response_unavailable", "mapping_supported", "successful_mapping_response_relation_absent"]
    assert validation.segments(answers).first()["chain_id"] == "B"


def slow_alignment(md, pdb):
    """Scores of the whole table cell by cell, as a check of the vector rows."""
    n, m = len(md), len(pdb)
    s = [[-2 * j for j in range(m + 1)]] + [[0] * (m + 1) for _ in range(n)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            s[i][j] = max(s[i - 1][j - 1] + (2 if md[i - 1] == pdb[j - 1] else -1), s[i - 1][j] - 2, s[i][j - 1] - 2)
    return max(s[i][m] for i in range(n + 1))


def test_alignment():
    assert residues.fitted("XXABCDEYY", "ABCDE") == (10, [(3, 1), (4, 2), (5, 3), (6, 4), (7, 5)])
    assert residues.fitted("", "AB") == (-4, [(None, 1), (None, 2)]) and residues.fitted("AB", "") == (0, [])
    rng = random.Random(1)
    for _ in range(40):
        md, pdb = ("".join(rng.choice("ABC") for _ in range(rng.randrange(12))) for _ in range(2))
        score, pairs = residues.fitted(md, pdb)
        assert score == slow_alignment(md, pdb) and [j for _, j in pairs if j] == list(range(1, len(pdb) + 1))
        assert score == sum(-2 if None in p else 2 if md[p[0] - 1] == pdb[p[1] - 1] else -1 for p in pairs)


def test_assignment_and_composition(spark):
    scored = spark.createDataFrame([("S", "A", "A", 10), ("S", "A", "B", 10), ("S", "B", "A", 10), ("S", "B", "B", 10), ("S", "C", "A", 3), ("S", "C", "B", 3)], "structure_id string, md_chain string, pdb_chain string, score int")
    got = {r["md_chain"]: (r["pdb_chain"], r["ambiguous"]) for r in residues.assigned(scored).collect()}
    assert got == {"A": ("A", True), "B": ("B", True), "C": ("A", True)}
    segments = spark.createDataFrame([("A", "P1", 1, 10, 101, 110), ("A", "P2", 5, 10, 1, 6), ("A", "P3", 20, 30, 1, 5), ("A", "P4", 40, 50, None, 5)], "chain_id string, uniprot_accession string, pdb_start int, pdb_end int, uniprot_start int, uniprot_end int")
    pairs = spark.createDataFrame([("M", k, "A", "A", n, letter) for k, (n, letter) in enumerate([(2, "A"), (6, "A"), (25, "A"), (45, "A"), (3, "C"), (None, "A")])], "md_chain string, md_resid int, md_letter string, pdb_chain string, pdb_number int, pdb_letter string")
    rows = {r["md_resid"]: r for r in residues.composed(pairs, segments).collect()}
    assert [rows[k]["status"] for k in range(6)] == ["verified_md_to_pdb_to_uniprot", "ambiguous_sifts_segment", "sifts_segment_length_conflict", "no_sifts_mapping_for_pdb_residue", "md_to_pdb_sequence_mismatch", "md_to_pdb_only"]
    assert rows[0]["uniprot_number"] == 102


def test_store(spark, tmp_path):
    store = storage.Store(spark, f"file://{tmp_path}/store")
    article = lambda d, t: spark.createDataFrame([(d, t, None, "u", "h", json.dumps({"id": d, "t": t}))], storage.TABLES["articles"])
    fact = lambda d, v: spark.createDataFrame([(d, "starting_pdb_id", v, "p", 0, 4, v)], storage.TABLES["literature_facts"])
    assert store.count() == 0
    store.write({"articles": article("PMC1", "a"), "literature_facts": fact("PMC1", "1ABC")})
    store.write({"articles": article("PMC2", "b"), "literature_facts": fact("PMC2", "1ABC")})
    store.write({"articles": article("PMC1", "c"), "literature_facts": fact("PMC1", "2XYZ")})
    assert store.count() == 2 and json.loads(store.get("pmc1"))["t"] == "c"
    assert [r[0] for r in store.search(pdb_id="1abc").collect()] == ["PMC2"] and [r[0] for r in store.search(pdb_id="2XYZ").collect()] == ["PMC1"]
    with pytest.raises(storage.NotFound):
        store.get("PMC9")
    for bad in ({}, {"pdb_id": "12"}, {"accession": "P"}):
        with pytest.raises(ValueError, match="."):
            store.search(**bad)


def test_file_sources(spark, tmp_path):
    fact = {"annotation_id": "1", "document_id": "D", "annotator_id": "a", "field_name": "t", "normalized_value": 300, "unit": None, "event_type": "x", "paragraph_id": "p", "start_char": 0, "end_char": 3, "quote": "300"}
    (tmp_path / "a.jsonl").write_text(json.dumps(fact) + "\n\n" + json.dumps(fact))
    (tmp_path / "b.json").write_text(json.dumps([fact]))
    (tmp_path / "c.json").write_text(json.dumps({"facts": [fact, fact]}, indent=1))
    assert [files.read_annotations(spark, f"file://{tmp_path}/{n}").count() for n in ("a.jsonl", "b.json", "c.json")] == [2, 1, 2]
    (tmp_path / "d.json").write_text(json.dumps([fact | {"odd": 1}]))
    with pytest.raises(Exception, match="unknown keys: odd"):
        files.read_annotations(spark, f"file://{tmp_path}/d.json").collect()
    (tmp_path / "e.json").write_text(json.dumps({"documents": {"D": [{"event_id": "1", "event_type": "production", "duration_ps": 5}]}}))
    (tmp_path / "f.json").write_text(json.dumps({"D": [{"event_id": "1", "event_type": "production", "duration_ps": 5}]}))
    assert [files.read_events(spark, f"file://{tmp_path}/{n}").first()["duration_ps"] for n in ("e.json", "f.json")] == [5.0, 5.0]
    (tmp_path / "x.txt").write_text("# all\nPMC1\n\n pmc2 # two\nPMC1\n")
    assert sorted(r[0] for r in files.read_exclusions(spark, f"file://{tmp_path}/x.txt").collect()) == ["PMC1", "PMC2"]
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml/pmc7.xml").write_text("<a/>")
    assert files.read_articles(spark, f"file://{tmp_path}/xml").first()["document_id"] == "PMC7"
    files.write_jsonl(spark.createDataFrame([(2, "b"), (1, None)], "z int, a string"), f"file://{tmp_path}/out", ["z"])
    assert [json.loads(r[0]) for r in spark.read.text(f"file://{tmp_path}/out").collect()] == [{"a": None, "z": 1}, {"a": "b", "z": 2}]
    listing = spark.createDataFrame([('[{"filename": "a.pdb", "length": 3}]',), ('{"k": {"name": "b.xtc", "size": 4}}',)], "p string").select(files.file_listing(F.col("p")).alias("f")).collect()
    assert [(r["f"][0]["filename"], r["f"][0]["bytes"]) for r in listing] == [("a.pdb", 3), ("b.xtc", 4)]


def test_search_pages_and_retries():
    waits, calls = [], []
    answers = iter([(429, {"Retry-After": "99"}, b""), (500, {}, b""), (200, {}, json.dumps({"nextCursorMark": "c", "resultList": {"result": [{"pmcid": "PMC1"}, {"pmcid": "PMC2"}]}}).encode()), OSError("net"), (200, {}, json.dumps({"nextCursorMark": "c", "resultList": {"result": [{"pmcid": "PMC3"}]}}).encode())])

    def fetch(url):
        calls.append(url)
        answer = next(answers)
        if isinstance(answer, OSError):
            raise answer
        return answer

    assert [r["pmcid"] for r in web.pages("q", 10, fetch, waits.append)] == ["PMC1", "PMC2", "PMC3"]
    assert waits == [30.0, 2.0, 1.0] and len(calls) == 5
    with pytest.raises(OSError, match="status 404"):
        web.with_retries("u", lambda u: (404, {}, b""), waits.append)
    assert web.wait_seconds(9, None) == 20.0 and web.wait_seconds(0, {"Retry-After": "-4"}) == 0.0


@pytest.mark.parametrize("n", [1, 7, 23_000])
def test_hashed_bootstrap(spark, n):
    """draws were a row each, grouped and joined. Whatever the tasks and groups, they are those of the hash."""
    import hashlib

    df = spark.range(n).select(F.col("id").alias("place"), (F.col("id") % 5).alias("tp"), (F.col("id") % 3 * 300).alias("fp"), F.col("id").alias("fn"))
    rows = comparison.hashed_bootstrap(df, n, iterations=3, tasks=5, places=16, group=4096)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    drawn = [[int(hashlib.md5(f"{k}|{i}".encode()).hexdigest()[:12], 16) % n for i in range(n)] for k in range(3)]
    assert {(r["iteration"], r["tp"], r["fp"], r["fn"]) for r in rows.collect()} == {(k, sum(x % 5 for x in d), sum(x % 3 * 300 for x in d), sum(d)) for k, d in enumerate(drawn)}
    assert comparison.hashed_bootstrap(df.limit(0), 0, iterations=3).count() == 0


def test_articles_without_attributes_count(spark):
    """A document whose events have no value is one all the same; nulls are no values."""
    schema = "document_id string, event_type string, duration_ps double, ensemble string"
    p = spark.createDataFrame([("A", "x", None, None), ("B", "x", 1.0, "NPT"), ("B", "x", 1.0, None), (None, "x", 2.0, None)], schema)
    r = spark.createDataFrame([("B", "x", 1.0, "NVT"), ("C", "y", None, None)], schema)
    assert {tuple(x) for x in comparison.article_counts(p, r).collect()} == {("A", 0, 0, 0), ("B", 1, 2, 1), ("C", 0, 0, 0), (None, 0, 1, 0)}
