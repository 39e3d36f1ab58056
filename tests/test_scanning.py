"""Columns scanned by Arrow against Python's `re`, text by text; what the queries' plans may hold."""

import random
import re

import pyarrow as pa
import pytest

from siltstone.functions.scanning import Texts, by_pieces
from siltstone.operators import events, facts
from siltstone.plans import analysis, extraction

PIECES = ["equilibrated for ", "production ", "md  run ", "heated ", "last 20 ns ", "100 ps", "1,000 ns", "2.5 µs", "3 μs", "٣٠ ns", "7 NS", "0 ns", "310 K", "1.5 bar", "2 atm", "time step of 2 fs", "0.002 ps as timestep", "three independent replicates", "4 runs", "NVT", "npt ", "saved ", "simulation ", "Dynamics", "😀é", "\x0b", "\x01\x02", "K", "\n", ". ", "; ", " ", "x" * 30, "word " * 12]
PATTERNS = [events.DURATION, events.TEMPERATURE, events.PRESSURE, events.TIMESTEP, events.REPLICATES, events.ENSEMBLE, "|".join(events.PHASES.values()), facts.PDB_BLOCK, *(p for _, _, p in facts.FACTS)]
SCHEMA = "document_id string, section string, paragraph_id string, text string"
TESTDATA = "/root/testdata/sf0.001"


def texts(n: int, seed: int = 7) -> list:
    rng = random.Random(seed)
    plain = [p for p in PIECES if p.isascii() and p.isprintable()]
    return [None, "", *("".join(rng.choices(PIECES if k % 3 else plain, k=rng.randint(1, 40))) for k in range(n))]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("pattern", PATTERNS)
def test_spans(pattern):
    rows = texts(200)
    got = Texts(pa.array(rows, pa.string()).slice(1)).spans(pattern)
    want = [(k, m.start(), m.end(), m.group()) for k, t in enumerate(rows[1:]) for m in re.finditer(pattern, t, re.I)]
    assert list(zip(got.row.tolist(), got.start.tolist(), got.end.tolist(), got.quote.to_pylist(), strict=True)) == want


def test_pieces():
    rows = pa.array(["a" * k for k in range(9)] * 1_000_000)
    sizes = []
    assert by_pieces(lambda c: sizes.append(c.nbytes) or c)(rows).equals(rows) and len(sizes) > 4


def by_hand(text: str) -> list[tuple]:
    """Anchors of a text with all that is asked of them, pattern by pattern and window by window."""
    out = []
    for m in re.finditer(events.DURATION, text, re.I):
        a, b = m.span()
        step = re.search(events.STEP_BEFORE, text[max(0, a - 32) : a].lower()) or re.search(events.STEP_AFTER, text[b : b + 24].lower())
        left = max(0, a - 100)
        words = [(abs((x.start() + x.end()) // 2 + left - (a + b) // 2), n) for n, p in events.PHASES.items() for x in re.finditer(p, text[left : b + 100], re.I)]
        kind = min(words, default=(0, events.UNKNOWN))[1]
        gate = kind != events.UNKNOWN or any(w in text[max(0, a - 80) : b + 80].lower() for w in events.UNKNOWN_WORDS)
        left = max(0, a - 180)
        local = text[left : b + 180]
        near = [min(re.finditer(p, local, re.I), key=lambda x: abs(left + x.start() - a), default=None) for p in (events.TEMPERATURE, events.PRESSURE, events.TIMESTEP, events.REPLICATES)]
        t, p, s, r = (x and x.groups() for x in near)
        e = re.search(events.ENSEMBLE, local, re.I)
        of = {"fs": 1e-3, "ps": 1.0, "ns": 1e3, "us": 1e6, "µs": 1e6, "μs": 1e6, "ms": 1e9}
        count = r and (int(r[0]) if r[0].isdigit() else {"three": 3}[r[0].lower()])
        out.append((a, b, m.group(), bool(step), float(m[1]) * of[m[2].lower()], kind, gate, t and float(t[0]), p and float(p[0]) * (1.01325 if p[1].lower() == "atm" else 1), s and float(s[0] or s[2]) * (1000 if (s[1] or s[3]).lower() == "ps" else 1), count, e and e[1].upper()))
    return out


def test_anchors_by_hand(spark):
    rows = texts(600)
    own = spark.createDataFrame([(str(k), "S", "P", t) for k, t in enumerate(rows)], SCHEMA)
    columns = ["start", "end", "quote", *(c for p in events.FIELDS for c in events.FIELDS[p])]
    got = {}
    for r in events.anchors(own, *events.FIELDS).orderBy("document_id", "pos").collect():
        got.setdefault(int(r["document_id"]), []).append(tuple(r[c] for c in columns))
    want = {k: x for k, t in enumerate(rows) if t and (x := by_hand(t))}
    assert got == want and sum(map(len, want.values())) > 500
    emitted = {(int(r["document_id"]), r["pos"], r["start"]) for r in events.emitted(own).collect()}
    assert emitted == {(k, i, x[0]) for k, a in want.items() for i, x in enumerate(x for x in a if not x[3] and x[4] > 0 and x[6])}


def test_events_need_no_shuffle(spark):
    """numbers of events come from the paragraph's own list; a window over all events carried every text through a shuffle."""
    own = spark.createDataFrame([("D", "S", "P", "A production run of 5 ns at 300 K.")], SCHEMA)
    assert not re.search("Exchange|Window|aggregate\\(", plan(events.extract_events(own)))
    assert plan(extraction.extract_events(spark, TESTDATA)).count("ArrowEvalPython") == 2  # once in each of the two plans


def scans_arrow_once(df) -> bool:
    return "aggregate(" not in plan(df) and df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_freeze_counts_scan_once(spark):
    """every window was scanned up to seven times and its matches put together by an interpreted aggregation."""
    assert scans_arrow_once(extraction.freeze_counts(spark, TESTDATA))


def test_conditions_scan_once(spark):
    """F3"""
    assert scans_arrow_once(extraction.link_nearest(spark, TESTDATA))


def test_phases_scan_once(spark):
    """F8"""
    assert scans_arrow_once(extraction.phase_nearest(spark, TESTDATA))


def test_facts_by_hand(spark):
    """the facts of a paragraph come from one function; two scans of the table and a union took the texts twice."""
    rng = random.Random(3)
    pieces = ["PDB ID: 1abc, 2XYZ and 3qrs ", "pdb (4XYZ", "PDB entry 6aLU/7b2c ", "GROMACS ", "ambertools ", "CHARMM36m ", "lipid bilayer ", "glycans, ", "TIP3P-Ew ", "é😀 ", "x", "K ", "\x1c", "\n"]
    rows = [("D", "S", f"P{k}", k, "".join(rng.choices(pieces, k=rng.randint(0, 9)))) for k in range(300)] + [("D", "S", "none", 300, None)]
    own = spark.createDataFrame(rows, SCHEMA.replace("text", "ordinal int, text"))
    want = []
    for _, _, p, _, text in rows[:-1]:
        for b in re.finditer(facts.PDB_BLOCK, text, re.I):
            want += [(p, 0, "starting_pdb_id", m[0].upper(), m[0], b.start(1) + m.start(), b.start(1) + m.end()) for m in re.finditer(facts.PDB_ID, b[1], re.I)]
        want += [(p, k + 1, field, value or m[0], m[0], *m.span()) for k, (field, value, pattern) in enumerate(facts.FACTS) for m in re.finditer(pattern, text, re.I)]
    got = facts.all_facts(own).select("paragraph_id", "rule", "field", "value", "quote", "start_char", "end_char").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 500
    first = {}
    for x in sorted(want, key=lambda x: (int(x[0][1:]), x[1], x[5])):
        first.setdefault((x[2], x[3].lower()), (x[0], x[5]))
    assert {(r["field"], r["value"].lower()): (r["paragraph_id"], r["start_char"]) for r in facts.extract_facts(own).collect()} == first
    assert scans_arrow_once(extraction.fact_dedup(spark, TESTDATA))


def test_summary_reads_paragraphs_once(spark):
    """three passes over the paragraphs were joined row by row."""
    p = analysis.integ_summary(spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    assert p.count("Scan parquet") == p.count("ArrowEvalPython") == 1 and "Join" not in p


def test_summary_counts_what_is_there(spark, tmp_path):
    spark.read.parquet(f"{TESTDATA}/lineitem.parquet").limit(0).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert set(analysis.integ_summary(spark, str(tmp_path)).first()) == {0}


def test_evidence_is_checked_without_conditions(spark):
    """texts were scanned by interpreted aggregations; the check needs no conditions, and a text's hash is taken once."""
    p = extraction.evidence_check(spark, TESTDATA)
    assert scans_arrow_once(p) and plan(p).count("sha2(") == 4  # once for a paragraph on either side, in each of the two plans
