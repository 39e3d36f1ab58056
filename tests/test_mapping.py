"""The binned interval join against nested loops, and structures audited from end to end."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.operators import residues

PAIR = "md_chain string, md_resid int, md_letter string, pdb_chain string, pdb_number int, pdb_letter string"
SEGMENT = "chain_id string, uniprot_accession string, pdb_start int, pdb_end int, uniprot_start int, uniprot_end int"


def status(pair, segments):
    _, _, letter, chain, number, other = pair
    if letter is None or letter != other:
        return "md_to_pdb_sequence_mismatch"
    if number is None:
        return "md_to_pdb_only"
    own = [s for s in segments if chain is not None and s[0] == chain and None not in s[2:] and s[2] <= number <= s[3]]
    valid = [s for s in own if s[3] - s[2] == s[5] - s[4]]
    if len(valid) == 1:
        return f"verified_md_to_pdb_to_uniprot {valid[0][1]} {valid[0][4] + number - valid[0][2]}"
    return "ambiguous_sifts_segment" if valid else "sifts_segment_length_conflict" if own else "no_sifts_mapping_for_pdb_residue"


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_join(spark, seed):
    r = random.Random(seed)
    segments = []
    for k in range(150):
        a = r.randint(-300, 5000)
        n = r.choice([0, 1, 5, 60, 64, 65, 700, 4000, 100_000, 2_000_000_000])
        segments.append((r.choice("ABC"), f"P{k}", a, min(a + n, 2_147_483_000), 1, 1 + min(a + n, 2_147_483_000) - a + (k % 9 == 0)))
    segments += [("A", "x", None, 5, 1, 2), ("A", "y", 9, 3, 1, -5), (None, "z", 1, 9, 1, 9)]
    pairs = [("M", k, "A", r.choice("ABCD"), r.choice([None, *range(-310, 6000, 7), 2_000_000]), r.choice("AAAG")) for k in range(400)]
    pairs += [pairs[5], ("M", 1, None, "A", 5, "A"), ("M", 2, "A", None, 5, "A")]
    got = residues.composed(spark.createDataFrame(pairs, PAIR), spark.createDataFrame(segments, SEGMENT)).collect()
    text = lambda r: r["status"] + (f" {r['uniprot_accession']} {r['uniprot_number']}" if r["uniprot_accession"] else "")
    assert Counter((r["md_resid"], text(r)) for r in got) == Counter((p[1], status(p, segments)) for p in pairs)
    assert residues.composed(spark.createDataFrame(pairs, PAIR), spark.createDataFrame([], SEGMENT)).count() == len(pairs)


def test_one_chain_of_many_segments(spark):
    """No task has the chain: its 200,000 segments and residues are dealt by bin, a few rows to each key."""
    n = 200_000
    segments = spark.range(n).selectExpr("'A' AS chain_id", "'P' AS uniprot_accession", "CAST(id * 10 AS INT) AS pdb_start", "CAST(id * 10 + 9 AS INT) AS pdb_end", "CAST(id AS INT) AS uniprot_start", "CAST(id + 9 AS INT) AS uniprot_end")
    pairs = spark.range(n).selectExpr("'M' AS md_chain", "CAST(id AS INT) AS md_resid", "'A' AS md_letter", "'A' AS pdb_chain", "CAST(id * 10 + id % 10 AS INT) AS pdb_number", "'A' AS pdb_letter")
    out = residues.composed(pairs, segments)
    assert out.groupBy("status").count().collect() == [("verified_md_to_pdb_to_uniprot", n)]
    joined = residues.covering(pairs, segments.dropna(), F.lit(True))
    keys = joined.groupBy(F.col("pdb_start").cast("long").bitwiseAND(~63)).count().agg(F.max("count")).first()[0]
    assert keys <= 64 and joined.count() == n


def test_structures_from_end_to_end(spark):
    """Two structures: one verified but for its overhang, one with a variant residue and two equal chains."""
    md = [("S1", "A", "XXACDEFGHIK"), ("S2", "A", "MKVLAAGIV"), ("S2", "B", "MKVLAAGIV")]
    pdb = [("S1", "A", "ACDEFGHIK"), ("S2", "A", "MKVLSAGIV"), ("S2", "B", "MKVLSAGIV")]
    frame = lambda rows: spark.createDataFrame(rows, "structure_id string, chain_id string, sequence string")
    scored = residues.aligned(residues.chain_pairs(frame(md), frame(pdb)))
    letters = lambda rows: spark.createDataFrame([(s, c, k + 1, x, k + 1) for s, c, seq in rows for k, x in enumerate(seq)], "structure_id string, chain_id string, sequence_index int, one_letter string, number int")
    segments = spark.createDataFrame([("S1", "A", "P1", 1, 9, 101, 109), ("S2", "A", "P2", 1, 9, 1, 9), ("S2", "B", "P2", 1, 6, 1, 6), ("S3", "A", "P9", 1, 9, 1, 9)], f"structure_id string, {SEGMENT}")
    rows = {r["structure_id"]: r for r in residues.accepted(residues.structure_audits(scored, letters(md), letters(pdb), segments)).collect()}
    one, two = rows["S1"], rows["S2"]
    assert (one["status"], one["identity"], one["pdb_coverage"], one["uniprot_coverage"], one["ambiguous_chains"], one["n_chains"]) == ("verified", 1.0, 1.0, 1.0, 0, 1)
    assert (two["mapped_md_to_pdb"], two["sequence_mismatches"], two["mapped_to_uniprot"], two["ambiguous_chains"], two["n_chains"], two["pdb_residues"]) == (18, 2, 8 + 5, 2, 2, 18)
    assert two["identity"] == pytest.approx(16 / 18) and two["least_identity"] == pytest.approx(8 / 9) and two["status"] == "review"
    audits = {(r["structure_id"], r["md_chain"]): r for r in residues.chain_audits(scored, residues.assigned(scored), letters(pdb).groupBy("structure_id", "chain_id").agg(F.count(F.lit(1)).alias("n"))).collect()}
    assert audits["S1", "A"]["identity"] == 1.0 and audits["S1", "A"]["pdb_residue_coverage"] == 1.0 and audits["S2", "B"]["ambiguous"]
