"""Residues: sequence alignment, chain assignment, composition with mapped segments, and audits of atom tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.screening import atom_name, one_letter

#: Scores of the alignment.
MATCH, MISMATCH, GAP = 2, -1, -2
#: Limits of the audits.
MIN_IDENTITY, MIN_CHAIN_IDENTITY, MIN_PDB_COVERAGE, MIN_UNIPROT_COVERAGE, EXAMPLES = 0.999, 0.95, 0.95, 0.90, 30
#: Positions of the narrowest bins of segments, as a power of two.
FIRST_BITS = 6
ALIGNED = "score int, pairs array<struct<md:int,pdb:int>>, matches int, mismatches int, md_insertions int, pdb_deletions int"


def _rows(own: np.ndarray, other: np.ndarray, row: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of the table below `row`, one for each letter of own.

    The gap that runs along a row is a running maximum, so a row is vector operations.
    """
    gaps = GAP * np.arange(len(other) + 1, dtype=np.int32)
    for letter in own:
        new = np.empty_like(row)
        new[0] = 0
        new[1:] = np.maximum(row[:-1] + np.where(other == letter, MATCH, MISMATCH), row[1:] + GAP)
        row = np.maximum.accumulate(new - gaps) + gaps
        yield row


def _fitted(md: str, pdb: str) -> tuple[int, np.ndarray, np.ndarray]:
    """The score and the places of the best alignment, 0 for none.

    Rows are kept at square-root distance, and those between two of them are made again when the path comes there, up to the
    column it comes at. So memory is n ** 0.5 rows and time twice that of the scores.
    """
    own, other = np.frombuffer(md.encode("utf-32-le"), "<u4"), np.frombuffer(pdb.encode("utf-32-le"), "<u4")
    n, m = len(own), len(other)
    step = max(1, math.isqrt(n))
    row = GAP * np.arange(m + 1, dtype=np.int32)
    kept, last = [row], np.empty(n + 1, np.int32)
    last[0] = row[m]
    for i, row in enumerate(_rows(own, other, row), 1):
        last[i] = row[m]
        if i % step == 0:
            kept.append(row)
    i, j = int(np.argmax(last)), m
    score, a, b = int(last[i]), [], []
    while j:
        base = (i - 1) // step * step if i else 0
        block = [kept[base // step][: j + 1], *_rows(own[base:i], other[:j], kept[base // step][: j + 1])]
        while j and (i > base or not i):
            here, above = block[i - base][j], block[i - base - 1] if i else None
            if i and here == above[j - 1] + (MATCH if own[i - 1] == other[j - 1] else MISMATCH):
                a.append(i)
                b.append(j)
                i, j = i - 1, j - 1
            elif i and here == above[j] + GAP:
                a.append(i)
                b.append(0)
                i -= 1
            else:
                a.append(0)
                b.append(j)
                j -= 1
    return score, np.array(a[::-1], np.int32), np.array(b[::-1], np.int32)


def fitted(md: str, pdb: str) -> tuple[int, list[tuple[int | None, int | None]]]:
    """The best alignment of all of pdb to a stretch of md, with 1-based places.

    Ties go to a pair, then to a gap in pdb, then to one in md; of equal ends the first.
    """
    score, a, b = _fitted(md, pdb)
    return score, [(i or None, j or None) for i, j in zip(a.tolist(), b.tolist(), strict=True)]


def _alignments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_key and ALIGNED of pairs of sequences; a row at a time, so that no batch of long paths is held."""
    for batch in batches:
        for key, md, pdb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            score, a, b = _fitted(md or "", pdb or "")
            both = (a > 0) & (b > 0)
            letters = [np.frombuffer((x or "").encode("utf-32-le"), "<u4") for x in (md, pdb)]
            same = int((letters[0][a[both] - 1] == letters[1][b[both] - 1]).sum())
            places = pa.StructArray.from_arrays([pa.array(x, pa.int32(), mask=x == 0) for x in (a, b)], ["md", "pdb"])
            counts = [same, int(both.sum()) - same, int((b == 0).sum()), int((a == 0).sum())]
            columns = [pa.array([key]), pa.array([score], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), places), *(pa.array([x], pa.int32()) for x in counts)]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "score", "pairs", "matches", "mismatches", "md_insertions", "pdb_deletions"])


def aligned(pairs: DataFrame) -> DataFrame:
    """Adds the columns of ALIGNED to rows with md_sequence and pdb_sequence; null reads as empty.

    Chains of many structures are the same, so each pair of sequences is aligned once and its rows share the outcome.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    keyed = pairs.withColumn("_key", F.sha2(F.concat(F.length(text("md_sequence")).cast("string"), F.lit("|"), text("md_sequence"), text("pdb_sequence")), 256))
    distinct = keyed.groupBy("_key").agg(F.any_value("md_sequence").alias("md_sequence"), F.any_value("pdb_sequence").alias("pdb_sequence"))
    found = distinct.mapInArrow(_alignments, f"_key string, {ALIGNED}").withColumnRenamed("_key", "_found")
    return keyed.join(found, F.col("_key") == F.col("_found")).drop("_key", "_found")


def chain_pairs(md: DataFrame, pdb: DataFrame) -> DataFrame:
    """Every chain of a structure's simulation with every chain of its entry. md, pdb: structure_id, chain_id, sequence."""
    return md.select("structure_id", F.col("chain_id").alias("md_chain"), F.col("sequence").alias("md_sequence")).join(pdb.select("structure_id", F.col("chain_id").alias("pdb_chain"), F.col("sequence").alias("pdb_sequence")), "structure_id")


def assigned(scored: DataFrame) -> DataFrame:
    """structure_id, md_chain, pdb_chain, score, ambiguous, method: chains in order take the best-scoring chain; ties
    prefer the same name if unused, then the first unused, then the first. One structure's chains are one group."""

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        unused, out = set(rows.pdb_chain), []
        for name, own in rows.sort_values(["md_chain", "pdb_chain"]).groupby("md_chain", sort=True):
            best = own[own.score == own.score.max()].pdb_chain.tolist()
            if name in best and name in unused:
                chosen, method = name, "sequence_score_then_same_chain_id_tiebreak"
            elif free := [c for c in best if c in unused]:
                chosen, method = free[0], "sequence_score_then_unused_chain_tiebreak"
            else:
                chosen, method = best[0], "sequence_score_lexical_tiebreak"
            unused.discard(chosen)
            out.append((rows.structure_id.iloc[0], name, chosen, int(own.score.max()), len(best) > 1, method))
        return pd.DataFrame(out, columns=["structure_id", "md_chain", "pdb_chain", "score", "ambiguous", "method"])

    kind = "structure_id string, md_chain string, pdb_chain string, score int, ambiguous boolean, method string"
    return scored.select("structure_id", "md_chain", "pdb_chain", "score").groupBy("structure_id").applyInPandas(assign, kind)


def protein_chains(residues: DataFrame) -> DataFrame:
    """Protein residues with one_letter and sequence_index from 1 in their chain. residues: chain_id, residue_order, residue_name."""
    rows = residues.withColumn("one_letter", one_letter(F.col("residue_name"))).filter("one_letter is not null")
    return rows.withColumn("sequence_index", F.row_number().over(Window.partitionBy("chain_id").orderBy("residue_order")))


def sequences(chains: DataFrame) -> DataFrame:
    return chains.groupBy("chain_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence_index", "one_letter"))), lambda x: x["one_letter"]), "").alias("sequence"))


def usable_segments(segments: DataFrame) -> DataFrame:
    return segments.dropna(subset=["pdb_start", "pdb_end", "uniprot_start", "uniprot_end"])


def _shift() -> Column:
    """The width, as a power of two, of the bins in which a segment touches two at most: FIRST_BITS, then three bits more each."""
    fits = lambda bits: F.shiftright(F.col("pdb_end").cast("long"), bits) - F.shiftright(F.col("pdb_start").cast("long"), bits) <= 1
    return F.coalesce(*(F.when(fits(b), b) for b in range(FIRST_BITS, 40, 3)))


def covering(pairs: DataFrame, segments: DataFrame, condition: Column) -> DataFrame:
    """Pairs, left-joined with the segments of their chain that cover their number, under a further condition.

    A range condition alone would put a chain in one task. So segments go to bins of positions, each to the two at most that it touches at
    the width that suits its length, and a pair to its bin at each width in use. Chain, width and bin are the key, the
    range is checked in full, and no match is found twice, as a pair is in one bin of a segment's width.
    """
    binned = segments.filter("pdb_start <= pdb_end").withColumn("_bits", _shift())
    edges = lambda bits: F.array_distinct(F.array(F.expr(f"shiftright(CAST(pdb_start AS BIGINT), {bits})"), F.expr(f"shiftright(CAST(pdb_end AS BIGINT), {bits})")))
    binned = binned.withColumn("_bin", F.explode(edges("_bits")))
    widths = sorted(r["_bits"] for r in binned.select("_bits").distinct().collect()) or [FIRST_BITS]  # a dozen at most
    rows = pairs.withColumn("_width", F.explode(F.array(*map(F.lit, widths)))).withColumn("_at", F.expr("shiftright(CAST(pdb_number AS BIGINT), _width)"))
    on = condition & (F.col("pdb_chain") == F.col("chain_id")) & (F.col("_width") == F.col("_bits")) & (F.col("_at") == F.col("_bin")) & F.col("pdb_number").between(F.col("pdb_start"), F.col("pdb_end"))
    return rows.join(binned, on, "left").drop("_width", "_at", "_bits", "_bin")


def composed(pairs: DataFrame, segments: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Adds n_matching, uniprot_accession, uniprot_number and status to aligned residue pairs.

    pairs: md_chain, md_resid, md_letter, pdb_chain, pdb_number, pdb_letter.
    """
    own = usable_segments(segments)
    if expected:
        own = own.filter(F.col("uniprot_accession").isin(*expected))
    rows = pairs.withColumn("_row", F.monotonically_increasing_id()).withColumn("sequence_match", F.coalesce(F.col("md_letter") == F.col("pdb_letter"), F.lit(False)))
    keys = ["md_chain", "md_resid", "md_letter", "pdb_chain", "pdb_number", "pdb_letter", "sequence_match"]
    valid = F.col("pdb_end") - F.col("pdb_start") == F.col("uniprot_end") - F.col("uniprot_start")
    rows = covering(rows, own, F.col("sequence_match")).groupBy("_row", *keys).agg(
        F.count("chain_id").alias("n_matching"), F.count_if(valid).alias("n_valid"),
        F.min(F.when(valid, F.struct("uniprot_accession", (F.col("uniprot_start") + F.col("pdb_number") - F.col("pdb_start")).alias("number")))).alias("_one"),
    )
    one = F.col("n_valid") == 1
    status = (
        F.when(~F.col("sequence_match"), "md_to_pdb_sequence_mismatch").when(F.col("pdb_number").isNull(), "md_to_pdb_only").when(one, "verified_md_to_pdb_to_uniprot")
        .when(F.col("n_valid") > 1, "ambiguous_sifts_segment").when(F.col("n_matching") > 0, "sifts_segment_length_conflict").otherwise("no_sifts_mapping_for_pdb_residue")
    )
    return rows.select(*keys, "n_matching", F.when(one, F.col("_one.uniprot_accession")).alias("uniprot_accession"), F.when(one, F.col("_one.number")).alias("uniprot_number"), status.alias("status"))


def chain_audits(scored: DataFrame, assignments: DataFrame, pdb_sizes: DataFrame) -> DataFrame:
    """The chosen alignments with identity and coverage. scored: structure_id, md_chain, pdb_chain and the columns of ALIGNED;
    assignments: as `assigned` gives them; pdb_sizes: structure_id, chain_id, n."""
    chosen = assignments.select("structure_id", "md_chain", "pdb_chain", "ambiguous", "method")
    rows = scored.join(chosen, ["structure_id", "md_chain", "pdb_chain"]).join(pdb_sizes.select("structure_id", F.col("chain_id").alias("pdb_chain"), F.col("n").alias("_n")), ["structure_id", "pdb_chain"], "left")
    both = F.col("matches") + F.col("mismatches")
    n = F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1))
    return rows.withColumns({"identity": F.col("matches") / F.greatest(both, F.lit(1)), "pdb_residue_coverage": both / n}).drop("_n")


def mapped_pairs(chosen: DataFrame, md: DataFrame, pdb: DataFrame) -> DataFrame:
    """The residue pairs of chosen alignments, as `composed` takes them, with structure_id. md, pdb: structure_id, chain_id,
    sequence_index (from 1), one_letter, number."""
    rows = chosen.select("structure_id", "md_chain", "pdb_chain", F.explode("pairs").alias("p")).filter("p.md is not null and p.pdb is not null").select("structure_id", "md_chain", "pdb_chain", F.col("p.md").alias("_i"), F.col("p.pdb").alias("_j"))
    side = lambda df, s, at: df.select("structure_id", F.col("chain_id").alias(f"{s}_chain"), F.col("sequence_index").alias(at), F.col("one_letter").alias(f"{s}_letter"), F.col("number").alias("md_resid" if s == "md" else "pdb_number"))
    return rows.join(side(md, "md", "_i"), ["structure_id", "md_chain", "_i"]).join(side(pdb, "pdb", "_j"), ["structure_id", "pdb_chain", "_j"]).drop("_i", "_j")


def residue_audit(rows: DataFrame, n_pdb: DataFrame, n_ambiguous: DataFrame) -> DataFrame:
    """One row of counts, coverages and status over composed residues. n_pdb, n_ambiguous: a row and column each, the residues of
    the entry and the chains with several best partners."""
    verified, wrong = F.count_if(F.col("status") == "verified_md_to_pdb_to_uniprot"), F.count_if(~F.col("sequence_match"))
    out = rows.agg(F.count(F.lit(1)).alias("mapped_md_to_pdb"), verified.alias("mapped_to_uniprot"), wrong.alias("sequence_mismatches"))
    out = out.crossJoin(n_pdb.toDF("pdb_residues")).crossJoin(n_ambiguous.toDF("ambiguous_chains"))  # one row each
    return _audited(out)


def _audited(out: DataFrame) -> DataFrame:
    total = F.greatest("pdb_residues", F.lit(1))
    status = F.when((F.col("mapped_to_uniprot") > 0) & (F.col("sequence_mismatches") == 0), "verified").when(F.col("mapped_to_uniprot") > 0, "review").otherwise("failed")
    return out.withColumns({"pdb_coverage": F.col("mapped_md_to_pdb") / total, "uniprot_coverage": F.col("mapped_to_uniprot") / total, "status": status})


def structure_audits(scored: DataFrame, md: DataFrame, pdb: DataFrame, segments: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """A row for each structure: its chains' assignment, identity and coverage, what maps, and the status that `accepted` judges.

    scored: all pairs of chains with the columns of ALIGNED; segments: structure_id, chain_id and the rest. Structures are
    told apart in the chains' names, so one join serves all.
    """
    sizes = pdb.groupBy("structure_id", "chain_id").agg(F.count(F.lit(1)).alias("n"))
    chains = chain_audits(scored, assigned(scored), sizes)
    named = lambda c: F.concat_ws("\x1f", "structure_id", c)
    pairs = mapped_pairs(chains, md, pdb).withColumns({"md_chain": named("md_chain"), "pdb_chain": named("pdb_chain")}).drop("structure_id")
    rows = composed(pairs, segments.withColumn("chain_id", named("chain_id")).drop("structure_id"), expected).withColumn("structure_id", F.split_part("md_chain", F.lit("\x1f"), F.lit(1)))
    verified, wrong = F.count_if(F.col("status") == "verified_md_to_pdb_to_uniprot"), F.count_if(~F.col("sequence_match"))
    counts = rows.groupBy("structure_id").agg(F.count(F.lit(1)).alias("_mapped"), verified.alias("_verified"), wrong.alias("_wrong"))
    all_pdb = sizes.groupBy("structure_id").agg(F.sum("n").alias("pdb_residues"))
    same = lambda: F.sum("matches") / F.greatest(F.sum(F.col("matches") + F.col("mismatches")), F.lit(1))
    by = chains.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_chains"), F.count_if("ambiguous").alias("ambiguous_chains"), same().alias("identity"), F.min("identity").alias("least_identity"))
    out = by.join(all_pdb, "structure_id", "left").join(counts, "structure_id", "left").na.fill(0)
    return _audited(out.withColumnsRenamed({"_mapped": "mapped_md_to_pdb", "_verified": "mapped_to_uniprot", "_wrong": "sequence_mismatches"}))


def accepted(audit: DataFrame) -> DataFrame:
    """A review with few variants is accepted. audit: status, identity, pdb_coverage, uniprot_coverage."""
    enough = (F.col("identity") >= MIN_CHAIN_IDENTITY) & (F.col("pdb_coverage") >= MIN_PDB_COVERAGE) & (F.col("uniprot_coverage") >= MIN_UNIPROT_COVERAGE)
    return audit.withColumn("status", F.when((F.col("status") == "review") & enough, "verified_with_construct_variants").otherwise(F.col("status")))


def paired_atoms(a: DataFrame, b: DataFrame) -> DataFrame:
    """Atoms of both tables by index with what agrees. a, b: atom_index, name, resname, resid, segid, resindex."""
    own = a.select("atom_index", *(F.col(c).alias(f"a_{c}") for c in a.columns if c != "atom_index")).join(b.select("atom_index", *(F.col(c).alias(f"b_{c}") for c in b.columns if c != "atom_index")), "atom_index")
    side = lambda s: {f"{s}_name": F.trim(f"{s}_name"), f"{s}_resname": F.upper(F.trim(f"{s}_resname")), f"{s}_segid": F.trim(f"{s}_segid")}
    own = own.withColumns(side("a") | side("b"))
    own = own.withColumns({f"{s}_letter": one_letter(F.col(f"{s}_resname")) for s in "ab"} | {f"{s}_norm": atom_name(F.col(f"{s}_name")) for s in "ab"})
    same = lambda *cs: [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in cs]
    every = lambda cs: cs[0] if len(cs) == 1 else cs[0] & every(cs[1:])
    named = F.coalesce("a_letter", "a_resname").eqNullSafe(F.coalesce("b_letter", "b_resname"))
    return own.withColumns(
        {
            "exact": every(same("name", "resname", "resid", "segid")), "normalized": every(same("norm", "resid", "segid")) & named,
            "same_segment": every(same("segid")), "same_partition": every(same("resindex")),
            "in_protein": F.col("a_letter").isNotNull() | F.col("b_letter").isNotNull(), "same_letter": every(same("letter")),
        }
    )


def atom_audit(paired: DataFrame) -> DataFrame:
    """One row: the fractions of paired atoms that agree."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    protein = F.count_if("in_protein")
    return paired.agg(
        F.count(F.lit(1)).alias("n_atoms"), (F.count_if("exact") / n).alias("exact_fraction"), (F.count_if("normalized") / n).alias("normalized_fraction"),
        (F.count_if("same_segment") / n).alias("segment_fraction"), (F.count_if("same_partition") / n).alias("partition_fraction"),
        protein.alias("protein_atoms"), (F.count_if(F.col("in_protein") & F.col("normalized") & F.col("same_letter")) / F.greatest(protein, F.lit(1))).alias("protein_identity"),
    )


def mismatch_examples(paired: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """The first mismatches of the protein and of the rest, by atom index: a report of `most` rows each."""
    right = F.col("normalized") & (~F.col("in_protein") | F.col("same_letter"))
    wrong = paired.filter(~right)
    scopes = [wrong.filter(F.col("in_protein") == flag).orderBy("atom_index").limit(most).withColumn("scope", F.lit(name)) for flag, name in ((True, "protein"), (False, "other"))]
    return scopes[0].unionByName(scopes[1])


def residue_atoms(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: residues in both tables by index, and how many have as many atoms in both."""
    count = lambda df, c: df.groupBy("resindex").agg(F.count(F.lit(1)).alias(c))
    rows = count(a, "n_a").join(count(b, "n_b"), "resindex")
    return rows.agg(F.count(F.lit(1)).alias("n_residues"), F.count_if(F.col("n_a") == F.col("n_b")).alias("n_equal"))


def _finite() -> Column:
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(F.bool_and(good("x") & good("y") & good("z")), F.lit(True))


def finite(frames: DataFrame) -> DataFrame:
    """frames: x, y, z. One row: whether every coordinate is a finite number."""
    return frames.agg(_finite().alias("finite"))


def frame_counts(frames: DataFrame) -> DataFrame:
    """frames: frame and atom_index, both from 1, x, y, z. One row: frames, frame_atoms and finite; 0, 0 and true without rows."""
    return frames.agg(F.coalesce(F.max("frame"), F.lit(0)).alias("frames"), F.coalesce(F.max("atom_index"), F.lit(0)).alias("frame_atoms"), _finite().alias("finite"))


def file_audit(a: DataFrame, b: DataFrame, frames_a: DataFrame, frames_b: DataFrame, expected_frames: int, metadata_atoms: int | None = None) -> DataFrame:
    """One row with all that `audit_failures` judges, from the atoms of two files of a system (a as topology, b as
    structure) and the trajectory as read with each. Every part is one row, so joining them makes one."""
    side = lambda df, s: df.agg(F.count(F.lit(1)).alias(f"atoms_{s}"), F.count_distinct("resindex").alias(f"residues_{s}"))
    moving = lambda df, s: frame_counts(df).withColumnsRenamed({c: f"{c}_{s}" for c in ("frames", "frame_atoms", "finite")})
    residue = residue_atoms(a, b).select((F.col("n_equal") / F.greatest("n_residues", F.lit(1))).alias("residue_atom_fraction"))
    out = atom_audit(paired_atoms(a, b))
    for part in (side(a, "a"), side(b, "b"), moving(frames_a, "a"), moving(frames_b, "b"), residue):
        out = out.crossJoin(part)
    counts = [F.col(c).cast("long") for c in ("atoms_a", "atoms_b", "frame_atoms_b", "frame_atoms_a")] + ([F.lit(metadata_atoms).cast("long")] if metadata_atoms is not None else [])
    return out.withColumns({"atom_counts": F.array(*counts), "expected_frames": F.lit(expected_frames)})


def audit_failures(audit: DataFrame) -> DataFrame:
    """Adds failures. audit: atom_counts (array), residues_a, residues_b, the fractions of atom_audit,
    residue_atom_fraction, frames_a, frames_b, expected_frames, finite_a, finite_b."""
    text = lambda name, c: F.concat(F.lit(name + ":"), F.format_string("%.6f", F.col(c)))
    below = lambda c, limit, name: F.when(F.col(c) < limit, text(name, c))
    # fixed values: the failures' texts
    found = F.array_compact(
        F.array(
            F.when(F.size(F.array_distinct("atom_counts")) > 1, F.concat(F.lit("atom_count_mismatch:["), F.array_join("atom_counts", ", "), F.lit("]"))),
            F.when(F.col("residues_a") != F.col("residues_b"), F.format_string("residue_count_mismatch:psf=%d,pdb=%d", "residues_a", "residues_b")),
            below("segment_fraction", 1.0, "segment_by_atom_fraction_below_1"),
            below("partition_fraction", 1.0, "residue_partition_fraction_below_1"),
            below("residue_atom_fraction", 1.0, "per_residue_atom_count_fraction_below_1"),
            below("protein_identity", MIN_IDENTITY, "protein_atom_identity_fraction_below_0.999"),
            F.when((F.col("frames_a") != F.col("expected_frames")) | (F.col("frames_b") != F.col("expected_frames")), F.format_string("trajectory_frame_count:expected=%d,pdb=%d,psf=%d", "expected_frames", "frames_b", "frames_a")),
            F.when(~(F.col("finite_a") & F.col("finite_b")), F.concat(F.lit("trajectory_contains_non_finite_coordinates:pdb="), F.initcap(F.col("finite_b").cast("string")), F.lit(",psf="), F.initcap(F.col("finite_a").cast("string")))),
        )
    )
    return audit.withColumn("failures", found)


def acceptance_failures(rows: DataFrame) -> DataFrame:
    """Adds failures: why a case isn't accepted. rows: published, consistency_failures (array), mapping_status,
    pdb_coverage, uniprot_coverage."""
    low = lambda c, limit, name: F.when(F.col(c) < limit, F.format_string(f"{name}:%.6f", F.col(c)))
    # fixed values: the failures' texts
    own = F.array_compact(
        F.array(
            F.when(F.col("mapping_status").startswith("verified"), None).otherwise(F.concat(F.lit("residue_mapping_not_verified:"), F.coalesce("mapping_status", F.lit("none")))),
            low("pdb_coverage", MIN_PDB_COVERAGE, "pdb_mapping_coverage_below_0.95"),
            low("uniprot_coverage", MIN_UNIPROT_COVERAGE, "uniprot_mapping_coverage_below_0.90"),
        )
    )
    first = F.when(F.col("published"), F.array().cast("array<string>")).otherwise(F.array(F.lit("project_not_published")))
    return rows.withColumn("failures", F.concat(first, F.coalesce("consistency_failures", F.array().cast("array<string>")), own))

