"""PDB and PSF files read in many splits, against plain Python; the audit takes everything from the files."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import residues
from siltstone.sources import structures

NAMES = [("N", "ALA"), ("CA", "ALA"), ("HN", "GLY"), ("OT1", "GLY"), ("C13", "POPC")]


def atoms(n):
    """index, name, resname, resid, segment: residues of two or three atoms, numbers that repeat from segment to segment."""
    return [(k + 1, *NAMES[k % 5], k // 5 % 50 * 2 + (k % 5 > 1) + (k % 5 > 3), f"S{k // 400}") for k in range(n)]


def pdb(rows, models=1, broken=None, segment=True):
    out = ["REMARK   made for a test"]
    for m in range(models):
        out += [f"MODEL     {9 - m % 9:4d}"] if models > 1 else []
        for i, name, resname, resid, seg in rows:
            z = "     nan" if broken == (m, i) else f"{i / 10 + m:8.3f}"
            line = f"{'ATOM  ' if i % 7 else 'HETATM'}{i % 100000:5d} {name:>4} {resname:<4}{seg[-1]}{resid:4d}    {1.5:8.3f}{-2.25:8.3f}{z}  1.00  0.00"
            out.append(f"{line:<72}{seg if segment else '':<4}")
        out += ["ENDMDL"] if models > 1 else ["TER"]
    return "\n".join([*out, "END", ""])


def psf(rows):
    body = [f"{i:8d} {seg:<4} {resid:<4} {resname:<4} {name:<4} CT1   -0.270000  12.0110   0" for i, name, resname, resid, seg in rows]
    return "\n".join(["PSF CMAP", "", "       2 !NTITLE", " REMARKS 3 !NATOM comes later", " REMARKS x", "", f"{len(rows):8d} !NATOM", *body, "", "       1 !NBOND: bonds", "       1       2", ""])


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)


def residue_indexes(rows):
    out, last = [], None
    for _, _, resname, resid, seg in rows:
        out.append((out[-1] + (last != (resname, resid, seg))) if out else 0)
        last = (resname, resid, seg)
    return out


def test_frames_over_many_splits(spark, tmp_path, small_splits):
    rows = atoms(230)
    (tmp_path / "a.pdb").write_text(pdb(rows, models=4, broken=(2, 17)))
    (tmp_path / "b.pdb").write_text(pdb(rows[:31], segment=False))
    (tmp_path / "empty.pdb").write_text("REMARK nothing\nEND\n")
    frames = structures.pdb_frames(spark, str(tmp_path))
    assert structures.read_lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 10
    got = {(r["file"][-5:], r["frame"], r["atom_index"]): r for r in frames.collect()}
    assert len(got) == 4 * 230 + 31
    for m in range(4):
        for i, name, resname, resid, seg in rows:
            r = got["a.pdb", m + 1, i]
            assert (r["name"], r["resname"], r["resid"], r["segid"], r["x"], r["y"]) == (name, resname, resid, seg, 1.5, -2.25)
            assert r["z"] == pytest.approx(i / 10 + m) or ((m, i) == (2, 17) and r["z"] != r["z"])
    assert got["b.pdb", 1, 31]["segid"] == "0"  # the chain, as there is no segment
    facts = residues.frame_counts(frames.filter(F.col("file").endswith("a.pdb"))).first()
    assert tuple(facts) == (4, 230, False)
    assert residues.frame_counts(frames.filter(F.col("file").endswith("b.pdb"))).first()["finite"]
    topology = structures.pdb_atoms(frames, stretch=17).filter(F.col("file").endswith("a.pdb")).orderBy("atom_index").collect()
    assert [r["resindex"] for r in topology] == residue_indexes(rows) and len(set(residue_indexes(rows))) > 90


def test_psf_over_many_splits(spark, tmp_path, small_splits):
    rows = atoms(450)
    (tmp_path / "a.psf").write_text(psf(rows))
    (tmp_path / "b.psf").write_text(psf(rows[:3]))
    got = structures.psf_atoms(spark, str(tmp_path), stretch=50).orderBy("file", "atom_index").collect()
    own = [r for r in got if r["file"].endswith("a.psf")]
    assert [(r["atom_index"], r["name"], r["resname"], r["resid"], r["segid"]) for r in own] == rows
    assert [r["resindex"] for r in own] == residue_indexes(rows)
    assert len(got) == 453


def audit(spark, folder, expected, metadata=None):
    a = structures.psf_atoms(spark, f"{folder}/t.psf").drop("file")
    frames = structures.pdb_frames(spark, f"{folder}/t.pdb")
    moving = structures.pdb_frames(spark, f"{folder}/x.pdb")
    return residues.audit_failures(residues.file_audit(a, structures.pdb_atoms(frames).drop("file"), moving, moving, expected, metadata)).first()["failures"]


def test_audit_from_files(spark, tmp_path):
    rows = atoms(120)
    (tmp_path / "t.psf").write_text(psf(rows))
    # the structure names atoms its own way: HN is H, OT1 is O
    (tmp_path / "t.pdb").write_text(pdb([(i, {"HN": "H", "OT1": "O"}.get(n, n), *rest) for i, n, *rest in rows]))
    (tmp_path / "x.pdb").write_text(pdb(rows, models=3))
    assert audit(spark, tmp_path, 3, 120) == []
    assert audit(spark, tmp_path, 4, 121) == ["atom_count_mismatch:[120, 120, 120, 120, 121]", "trajectory_frame_count:expected=4,pdb=3,psf=3"]
    (tmp_path / "x.pdb").write_text(pdb(rows[:-1], models=2, broken=(1, 5)))
    (tmp_path / "t.pdb").write_text(pdb([(i, n, r, resid + (i > 100), s) for i, n, r, resid, s in rows if i < 119]))
    found = audit(spark, tmp_path, 2)
    assert found[0] == "atom_count_mismatch:[120, 118, 119, 119]" and found[1].startswith("residue_count_mismatch:psf=")
    assert found[-1] == "trajectory_contains_non_finite_coordinates:pdb=False,psf=False"
