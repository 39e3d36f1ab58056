import pytest
from pyspark.sql import functions as F

from siltstone.functions.matching import matches
from siltstone.operators import articles, candidates, events, facts, screening

CASES = [
    ("The system was equilibrated for 100 ps at 300 K and 1 bar in the NPT ensemble with a 2 fs time step.", [dict(event_type="equilibration", duration_ps=100.0, temperature_k=300.0, pressure_bar=1.0, ensemble="NPT", timestep_fs=2.0)]),
    ("The system was equilibrated for 5 ps at 0 K before the heating stage.", [dict(event_type="equilibration", temperature_k=0.0)]),
    ("Cells were incubated for 24 h at 37 °C before imaging.", []),
    ("Production MD simulations were run for 500 ns in three independent runs.", [dict(event_type="production", replicates=3, duration_ps=500_000.0)]),
    ("The final 100 ns trajectory was used for further analysis.", [dict(event_type="analysis_window")]),
    ("Coordinates were saved every 10 ps during the production simulation.", [dict(event_type="sampling_interval", duration_ps=10.0)]),
    ("The simulations produced a total aggregate sampling time of 5 µs.", [dict(event_type="unknown", confidence=0.65)]),
    ("Production MD simulations ran for 2 µs.", [dict(duration_ps=2_000_000.0)]),
    ("Production MD simulations ran for 2 μs.", [dict(duration_ps=2_000_000.0)]),
    ("Production MD simulations ran for 2 us.", [dict(duration_ps=2_000_000.0)]),
    ("The production trajectory starts at 0.0 ns and continues for 100 ns.", [dict(duration_ps=100_000.0)]),
    ("😀 production for 1,000 ns, then 7 ns", [dict(duration_ps=7000.0, start_char=32)]),
    ("Production MD simulations ran for ٣٠ ns at ３００ K in ५ runs.", [dict(duration_ps=30_000.0, temperature_k=300.0, replicates=5)]),
    ("Production MD simulations ran for " + "9" * 400 + " ns in 99999999999 runs.", [dict(duration_ps=float("inf"), replicates=None)]),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_events(spark, text, want):
    rows = events.extract_events(spark.createDataFrame([("PMC1", "Methods", "P1", text)], "document_id string, section string, paragraph_id string, text string")).orderBy("start_char").collect()
    assert len(rows) == len(want)
    for k, (row, values) in enumerate(zip(rows, want, strict=True)):
        assert row["event_id"] == f"PMC1:P1:event-{k + 1}"
        assert text[row["start_char"] : row["end_char"]] == row["quote"]
        assert {c: row[c] for c in values} == values


def test_offsets_count_code_points(spark):
    text = "é😀 7 ns μ 12.5 ps\n3 NS"
    found = spark.createDataFrame([(text,)], "t string").select(matches(F.col("t"), events.DURATION).alias("m")).first()["m"]
    assert [(x["quote"], text[x["start"] : x["end"]]) for x in found] == [("7 ns", "7 ns"), ("12.5 ps", "12.5 ps"), ("3 NS", "3 NS")]


def test_private_characters_stay_in_quotes(spark):
    """A text that holds the separator has quotes that are its own, at its own places."""
    text = "x\ue000 7\ue0007 ns and\ue000 12\u00a0ps"
    found = spark.createDataFrame([(text,)], "t string").select(matches(F.col("t"), r"\S*7 ns|12.ps").alias("m")).first()["m"]
    assert [(x["quote"], text[x["start"] : x["end"]]) for x in found] == [("7\ue0007 ns", "7\ue0007 ns"), ("12\u00a0ps", "12\u00a0ps")]


def test_digits_of_any_script(spark):
    """Whatever a pattern takes for a number is read as one or is null, in candidates as in events."""
    from siltstone.functions import units

    texts = ["٣٠", "३.५", "３００", "𝟗", "12", "1.5", "x", "", None, "٣٠x", "²"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(units.number(F.col("t")), units.count_of(F.col("t"))).collect()
    assert [r[0] for r in rows] == [30.0, 3.5, 300.0, 9.0, 12.0, 1.5, None, None, None, None, None]
    assert [r[1] for r in rows] == [30, None, 300, 9, 12, None, None, None, None, None, None]
    own = "Production ran for ٣٠ ns."
    change = {"quote": own, "end_char": len(own), "duration": ("٣٠ ns", 30.0, "ns"), "temperature": None, "pressure": None, "timestep": None, "ensemble": None, "replicates": None}
    proposals = spark.createDataFrame([tuple((GOOD | change).values())], SCHEMA)
    row = candidates.judged(proposals, spark.createDataFrame([("D", "P", own)], "document_id string, paragraph_id string, text string")).first()
    assert (row["reject_reason"], row["duration_ps"]) == (None, 30_000.0)


def test_evidence_errors(spark):
    own = spark.createDataFrame([("D", "S", "P", "A production run of 5 ns.")], "document_id string, section string, paragraph_id string, text string")
    rows = events.extract_events(own)
    assert events.evidence_errors(rows, own).count() == 0
    assert events.evidence_errors(rows.withColumn("quote", F.lit("x")), own).count() == 1
    assert events.evidence_errors(rows, own.limit(0)).count() == 1


def test_facts(spark):
    rows = [("D", "Results", "p1", 1, "PDB IDs: 1abc, 2XYZ and 1ABC in a lipid bilayer; GROMACS and gromacs. ff14SB, TIP3P."), ("D", "Results", "p2", 2, "Structure PDB 3QRS with membrane.")]
    got = facts.extract_facts(spark.createDataFrame(rows, "document_id string, section string, paragraph_id string, ordinal int, text string")).collect()
    assert {(r["field"], r["value"]) for r in got} == {("starting_pdb_id", "1ABC"), ("starting_pdb_id", "2XYZ"), ("starting_pdb_id", "3QRS"), ("system_contains_membrane", "true"), ("simulation_engine", "GROMACS"), ("force_field", "ff14SB"), ("water_model", "TIP3P")}
    texts = {r[2]: r[4] for r in rows}
    assert all(texts[r["paragraph_id"]][r["start_char"] : r["end_char"]] == r["quote"] for r in got)


@pytest.mark.parametrize(("text", "kind", "status", "eligible"), [("Molecular dynamics of a protein with GROMACS, NPT at 300 K", "research-article", screening.STRONG, True), ("MD simulations of a ligand, NPT at 300 K", "research-article", screening.GENERIC, True), ("MD simulations of a ligand, NPT at 300 K", "review-article", screening.GENERIC, False), ("poems", None, screening.WEAK, False), (None, None, screening.WEAK, False)])
def test_screen(spark, text, kind, status, eligible):
    r = screening.screened(spark.createDataFrame([(text, kind)], "text string, article_type string")).first()
    assert (r["status"], r["eligible"]) == (status, eligible)


@pytest.mark.parametrize(("name", "want"), [("HN", "H"), ("OT1", "O"), ("OT2", "OXT"), ("1HB", "HB1"), ("CA", "CA"), ("C1'", "C1"), ("12H*", "H12")])
def test_atom_names(spark, name, want):
    assert spark.range(1).select(screening.atom_name(F.lit(name))).first()[0] == want


@pytest.mark.parametrize(("name", "want"), [("a/b.PDB", ["topology_or_structure"]), ("trajectory.xtc", ["trajectory"]), ("input_topology.json", ["topology_or_structure", "workflow_or_parameters"]), ("note.txt", ["other"]), (".pdb", ["other"])])
def test_file_roles(spark, name, want):
    assert spark.range(1).select(screening.file_roles(F.lit(name))).first()[0] == want


def test_articles(spark):
    xml = b"<article article-type='x'><front><article-id pub-id-type='doi'>10.1/a</article-id><article-title> A  <i>b</i></article-title></front><body><sec><title>M</title><p>One <b>two</b>three</p><p id='q'>q</p><sec><p>in</p><p id='q'>q</p><p> </p></sec></sec></body></article>"
    df = spark.createDataFrame([("A", bytearray(xml)), ("B", bytearray(b"<a><b></a>")), ("C", None), ("D", bytearray(b"<!DOCTYPE x SYSTEM 'http://nowhere.invalid/x'><x/>"))], "document_id string, content binary")
    rows = articles.paragraphs(df).collect()
    assert [(r["section"], r["paragraph_id"], r["text"], r["ordinal"]) for r in rows if r["document_id"] == "A"] == [("M", "sec-1-p-1", "One twothree", 1), ("M", "q", "q", 2), ("section-2", "sec-2-p-1", "in", 3)]
    assert sorted(r["document_id"] for r in rows if r["error"]) == ["B", "C"]
    assert articles.paragraphs(df, piecewise=True).filter("document_id = 'A'").first()["text"] == "One two three"
    m = {r["document_id"]: r for r in articles.metadata(df).collect()}
    assert (m["A"]["title"], m["A"]["doi"], m["A"]["article_type"]) == ("A b", "10.1/a", "x") and m["B"]["error"] and m["D"]["error"] is None


TEXT = "Production ran for 100 ns at 300 K and 1 bar with a 2 fs step in the NPT ensemble, three runs."
Q = "struct<raw_text:string,value:double,unit:string>"
SCHEMA = f"candidate_id string, document_id string, paragraph_id string, start_char int, end_char int, quote string, event_type string, duration {Q}, temperature {Q}, pressure {Q}, timestep {Q}, ensemble string, restraints string, replicates struct<raw_text:string,value:int>"
GOOD = dict(candidate_id="a", document_id="D", paragraph_id="P", start_char=0, end_char=len(TEXT), quote=TEXT, event_type="production", duration=("100 ns", 100.0, "ns"), temperature=("300 K", 300.0, "kelvin"), pressure=("1 bar", 1.0, "bar"), timestep=("2 fs", 2.0, "fs"), ensemble="NPT", restraints=None, replicates=("three", 3))
NONE = dict.fromkeys(("duration", "temperature", "pressure", "timestep", "ensemble", "replicates"))


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None), ({"start_char": 1}, "evidence quote does not match source offsets"), ({"duration": ("100 ns", 200.0, "ns")}, "quantity value disagrees with raw_text"),
        ({"pressure": ("2 bar", 2.0, "bar")}, "quantity raw_text is not present in the evidence quote"), ({"paragraph_id": "missing"}, "unknown paragraph_id"), (NONE, "event has no protocol attribute"),
        ({"end_char": 500}, "evidence range exceeds paragraph length"), ({"ensemble": "NVT"}, "ensemble text is not present in the evidence quote"), ({"ensemble": "step"}, "unsupported ensemble"),
        ({"temperature": ("2 fs", 2.0, "fs")}, "unsupported temperature unit"), ({"timestep": ("2 fs", 2.0, "ps")}, "quantity unit disagrees with raw_text"), ({"replicates": ("three", 4)}, "replicate value disagrees with raw_text"), ({"restraints": "none"}, "restraints text is not present in the evidence quote"),
    ],
)
def test_candidates(spark, change, reason):
    texts = spark.createDataFrame([("D", "P", TEXT)], "document_id string, paragraph_id string, text string")
    proposals = spark.createDataFrame([tuple((GOOD | change).values())], SCHEMA)
    row = candidates.judged(proposals, texts).first()
    assert row["reject_reason"] == reason
    if reason is None:
        assert (row["duration_ps"], row["temperature_k"], row["pressure_bar"], row["timestep_fs"], row["replicate_count"]) == (100_000.0, 300.0, 1.0, 2.0, 3)
        assert candidates.accepted(proposals.union(proposals), texts).count() == 1
    else:
        with pytest.raises(candidates.Unsupported, match=reason):
            candidates.strict(proposals, texts)


def judged_plan(spark, of) -> str:
    texts = spark.createDataFrame([("D", "P", TEXT)], "document_id string, paragraph_id string, text string")
    proposals = spark.createDataFrame([tuple(GOOD.values())], SCHEMA)
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        return of(proposals, texts)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)


def test_quantities_are_matched_once(spark):
    """each reason and each value matched the quantities' pattern anew."""
    assert judged_plan(spark, candidates.judged).count("regexp_extract(") == 8


def test_proposals_are_judged_once(spark):
    """the filter for accepted proposals took the whole judgement with it, and the values had it again."""
    assert judged_plan(spark, candidates.accepted).count("evidence range exceeds paragraph length") == 1


def test_ids_of_proposals(spark):
    """Ids are those of Python's print of the values, whatever else the batch holds."""
    import hashlib

    texts = spark.createDataFrame([("D", "P", TEXT)], "document_id string, paragraph_id string, text string")
    some = GOOD | {"candidate_id": "b", "temperature": None, "pressure": None, "timestep": None, "replicates": None, "ensemble": None}
    rows = candidates.accepted(spark.createDataFrame([tuple(GOOD.values()), tuple(some.values())], SCHEMA), texts).orderBy("candidate_id").collect()
    for r, values, ensemble in zip(rows, ((100_000.0, 1.0, 3, 300.0, 2.0), (100_000.0, None, None, None, None)), ("NPT", ""), strict=True):
        pairs = list(zip(("duration_ps", "pressure_bar", "replicates", "temperature_k", "timestep_fs"), values, strict=True))
        assert r["event_id"] == "llm-event-" + hashlib.sha256(f"D|P|0|{len(TEXT)}|production|{pairs!r}|{ensemble}|".encode()).hexdigest()[:16]
