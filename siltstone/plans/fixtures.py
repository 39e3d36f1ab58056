"""Derived tables with the vocabulary of the domain, as SQL that Spark and DuckDB both read.

The base tables hold no protocol sentences, identifiers or attempts, so each derived table states them from a base
table's columns. FIXTURES maps a name to the tables it reads and its SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import staging

VIEW = "siltstone_base_"
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _candidates(position: str) -> str:
    return f"""SELECT {position} AS position, CASE WHEN k % 23 = 0 THEN 'X' ELSE CASE WHEN again = 1 THEN 'pmc' ELSE 'PMC' END END || {text('k')} AS document_id,
          CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(2014 + k % 9 AS INT) END AS year, CASE WHEN k % 31 = 0 THEN ' ' ELSE source END AS stratum, k % 13 <> 0 AS full_text_available
        FROM (SELECT doc_id AS k, source, 0 AS again FROM documents UNION ALL SELECT doc_id AS k, source, 1 AS again FROM documents WHERE doc_id % 10 = 0) q"""


FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {
    "paragraphs": (
        ("lineitem",),
        f"""SELECT {text('l_orderkey')} AS document_id, CASE WHEN l_linenumber % 3 = 0 THEN 'Simulation methods' ELSE 'Results' END AS section,
          'p' || {text('n')} AS paragraph_id, CAST(n AS INT) AS ordinal,
          CASE WHEN l_returnflag = 'A' THEN 'The system was equilibrated for ' WHEN n % 4 = 3 THEN 'The trajectory covers ' WHEN l_returnflag = 'N' THEN 'A production simulation was run for ' ELSE 'Coordinates were saved every ' END
          || {text('CAST(l_quantity AS INT)')} || CASE WHEN l_linestatus = 'O' THEN ' ns' ELSE ' ps' END
          || ' at ' || {text('280 + 5 * l_linenumber')} || ' K and 1' || CASE WHEN l_linenumber % 2 = 0 THEN ' atm' ELSE '.5 bar' END
          || CASE WHEN l_linenumber % 3 = 0 THEN ' in the NVT ensemble' WHEN l_linenumber % 3 = 1 THEN ' in the npt ensemble' ELSE '' END
          || CASE WHEN l_suppkey % 4 = 0 THEN ' with a time step of 2 fs' WHEN l_suppkey % 4 = 1 THEN ' using 0.002 ps as timestep' ELSE '' END
          || CASE WHEN l_partkey % 5 = 0 THEN ' in three independent replicates' WHEN l_partkey % 5 = 1 THEN ' in 4 runs' ELSE '' END || '.'
          || CASE WHEN l_partkey % 3 = 0 THEN ' Energy minimisation preceded heating over 100 ps to 310 K.' WHEN l_partkey % 3 = 1 THEN ' The last 20 ns were used for further analysis.' ELSE '' END
          || CASE WHEN l_partkey % 7 = 0 THEN ' The model PDB ID: 1A' || {text('l_suppkey % 10')} || 'B, 2XYZ and 3qrs was embedded in a lipid bilayer with glycans.' WHEN l_partkey % 7 = 1 THEN ' See PDB entry 6' || {text('l_suppkey % 10')} || 'LU and molecular dynamics of it.' ELSE '' END
          || CASE WHEN l_partkey % 6 = 0 THEN ' GROMACS with CHARMM36m and TIP3P water was used.' WHEN l_partkey % 6 = 1 THEN ' Amber with ff14SB and OPC, then amber again.' ELSE '' END AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem) q""",
    ),
    "articles": (
        ("documents",),
        f"""SELECT {text('doc_id')} AS document_id, CASE WHEN doc_id % 9 = 0 THEN 'review-article' ELSE 'research-article' END AS article_type,
          coalesce(text, '') || CASE WHEN doc_id % 4 = 0 THEN ' Molecular dynamics of the protein used GROMACS, a force field and TIP3P in the NPT ensemble at 300 K and 1 bar for 10 ns.' WHEN doc_id % 4 = 1 THEN ' MD simulations of a ligand: production run of 5 ns, equilibration at 310.5 K.' WHEN doc_id % 4 = 2 THEN ' AmberTools and NAMD on lipids.' ELSE '' END AS text
        FROM documents""",
    ),
    "candidates": (("documents",), _candidates("CAST(2 * k + again + 1 AS BIGINT)")),
    "numbered_candidates": (("documents",), _candidates("CAST(row_number() OVER (ORDER BY k, again) AS BIGINT)")),
    "exclusions": (("documents",), f"SELECT 'pmc' || {text('doc_id')} AS document_id FROM documents WHERE doc_id % 25 = 0"),
    "predictions": (
        ("lineitem",),
        f"""SELECT {text('l_orderkey')} AS document_id, l_returnflag AS event_type, l_quantity AS duration_ps, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(280 + l_linenumber AS DOUBLE) END AS temperature_k,
          CASE WHEN l_partkey % 3 = 0 THEN 'NPT' ELSE NULL END AS ensemble, CAST(l_suppkey % 3 AS INT) AS replicates FROM lineitem WHERE l_linenumber <= 2""",
    ),
    "references_": (
        ("lineitem",),
        f"""SELECT {text('l_orderkey')} AS document_id, CASE WHEN l_partkey % 11 = 0 THEN 'A' ELSE l_returnflag END AS event_type, l_quantity AS duration_ps, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(280 + l_linenumber AS DOUBLE) END AS temperature_k,
          CASE WHEN l_partkey % 3 = 0 THEN 'NPT' ELSE NULL END AS ensemble, CAST(l_suppkey % 3 AS INT) AS replicates FROM lineitem WHERE l_linenumber >= 2""",
    ),
    "annotations_a": (
        ("orders",),
        f"""SELECT {text('o_orderkey')} AS document_id, 'field' || {text('o_custkey % 5')} AS field_name, {text('o_custkey % 50')} AS normalized_value, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'ns' END AS unit, o_orderpriority AS event_type,
          'p1' AS paragraph_id, CAST(o_custkey % 100 AS INT) AS start_char, CAST(o_custkey % 100 + 5 AS INT) AS end_char FROM orders""",
    ),
    "annotations_b": (
        ("orders",),
        f"""SELECT {text('o_orderkey')} AS document_id, 'field' || {text('o_custkey % 5')} AS field_name, CASE WHEN o_orderkey % 7 = 0 THEN {text('o_custkey % 50')} || '.0' ELSE {text('o_custkey % 50')} END AS normalized_value, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'ns' END AS unit, o_orderpriority AS event_type,
          'p1' AS paragraph_id, CAST(o_custkey % 100 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS INT) AS start_char, CAST(o_custkey % 100 + 5 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS INT) AS end_char FROM orders WHERE o_orderkey % 11 <> 0""",
    ),
    "attempts": (
        ("events",),
        f"""SELECT 'https://service/' || {text('user_id')} AS endpoint, {text('user_id')} AS identifier, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS attempt,
          CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 404 WHEN 'signup' THEN 503 WHEN 'purchase' THEN 429 ELSE 200 END AS status, CASE WHEN event_type = 'error' THEN 'timeout' ELSE NULL END AS error,
          CASE WHEN event_type = 'purchase' THEN CAST(event_id % 9 AS DOUBLE) ELSE NULL END AS retry_after,
          CASE WHEN event_id % 3 = 0 THEN '{{"' || {text('user_id')} || '": {{"UniProt": {{"P0' || {text('user_id % 7')} || '": {{"mappings": [{{"chain_id": "A", "start": {{"residue_number": 1}}, "end": {{"residue_number": 9}}, "unp_start": 11, "unp_end": 19}}, {{"struct_asym_id": "B", "start": {{"residue_number": null}}, "unp_start": 3}}]}}}}}}}}'
               WHEN event_id % 3 = 1 THEN '{{"primaryAccession": "' || {text('user_id')} || '"}}' ELSE '{{}}' END AS payload
        FROM events""",
    ),
    "segments": (
        ("part",),
        """SELECT p_partkey AS segment_id, 'C' || CAST(CAST(floor(p_partkey / 40.0) AS BIGINT) AS STRING) AS chain_id, 'P' || CAST(p_partkey % 6 AS STRING) AS uniprot_accession, CAST(p_size * 40 + p_partkey % 37 AS INT) AS pdb_start, CAST(p_size * 40 + p_partkey % 37 + 10 AS INT) AS pdb_end,
          CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST(p_size + 100 AS INT) END AS uniprot_start, CAST(p_size + 110 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS INT) AS uniprot_end FROM part""",
    ),
    "residue_pairs": (
        ("lineitem",),
        """SELECT 'M' || CAST(l_linenumber AS STRING) AS md_chain, CAST(l_orderkey AS INT) AS md_resid, substr('ARNDC', CAST(l_partkey % 5 + 1 AS INT), 1) AS md_letter, 'C' || CAST(CAST(floor(l_partkey / 40.0) AS BIGINT) AS STRING) AS pdb_chain, CAST((l_orderkey * 7 + l_partkey) % 2100 AS INT) AS pdb_number,
          substr('ARNDC', CAST(l_partkey % 5 + 1 + CASE WHEN l_orderkey % 10 = 0 AND l_partkey % 5 < 4 THEN 1 ELSE 0 END AS INT), 1) AS pdb_letter FROM lineitem""",
    ),
    "atoms_a": (
        ("part",),
        """SELECT p_partkey AS atom_index, CASE p_partkey % 5 WHEN 0 THEN 'HN' WHEN 1 THEN 'CA' WHEN 2 THEN '1HB' WHEN 3 THEN ' ot1 ' ELSE 'C1''' END AS name, CASE p_partkey % 4 WHEN 0 THEN 'ALA' WHEN 1 THEN 'hsd' WHEN 2 THEN 'POPC' ELSE 'GLY' END AS resname,
          CAST(floor(p_partkey / 10.0) AS INT) AS resid, 'S' || CAST(p_partkey % 3 AS STRING) AS segid, CAST(floor(p_partkey / 10.0) AS INT) AS resindex FROM part""",
    ),
    "atoms_b": (
        ("part",),
        """SELECT p_partkey AS atom_index, CASE WHEN p_partkey % 6 = 0 THEN 'X9' ELSE CASE p_partkey % 5 WHEN 0 THEN 'H' WHEN 1 THEN 'CA' WHEN 2 THEN 'HB1' WHEN 3 THEN 'O' ELSE 'C1''' END END AS name, CASE p_partkey % 4 WHEN 0 THEN 'ALA' WHEN 1 THEN 'HIS' WHEN 2 THEN 'POPE' ELSE 'GLY' END AS resname,
          CAST(floor(p_partkey / 10.0) AS INT) AS resid, 'S' || CAST(CASE WHEN p_partkey % 50 = 0 THEN 9 ELSE p_partkey % 3 END AS STRING) AS segid, CAST(floor((p_partkey + CASE WHEN p_partkey % 40 = 9 THEN 1 ELSE 0 END) / 10.0) AS INT) AS resindex FROM part""",
    ),
    "frames_a": (("lineitem",), "SELECT l_linenumber AS frame, l_partkey AS atom_index, l_quantity AS x, l_tax AS y, l_discount AS z FROM lineitem"),
    "frames_b": (
        ("lineitem",),
        "SELECT l_linenumber AS frame, l_partkey AS atom_index, l_quantity AS x, l_tax AS y, CASE WHEN l_partkey % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_discount END AS z FROM lineitem WHERE l_linenumber < 7",
    ),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the tables of a folder; views of the session keep their names."""
    reads, sql = FIXTURES[name]
    return _derived(spark, sf_dir, reads, sql)


def numbered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`numbered_candidates` without its window over all rows: places in ranges of k and again, null keys last as DuckDB has them."""
    reads, _ = FIXTURES["numbered_candidates"]
    rows = _derived(spark, sf_dir, reads, _candidates("k IS NULL AS last, k, again, NULL"))
    keys = ["last", "k", "again"]
    return staging.numbered(rows.drop("position"), keys).withColumn("position", F.col("ordinal") + 1).drop(*keys, "ordinal")


def _derived(spark: SparkSession, sf_dir: str, reads: tuple[str, ...], sql: str) -> DataFrame:
    for table in reads:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"{VIEW}{table}")
        sql = re.sub(rf"\bFROM {table}\b", f"FROM {VIEW}{table}", sql)
    return spark.sql(sql)


def with_fixtures(names: list[str], select: str, **other: str) -> str:
    """The same tables before a DuckDB query; other: for a name, the table that stands under it."""
    return "WITH " + ",\n".join(f"{n} AS ({FIXTURES[other.get(n, n)][1]})" for n in names) + f"\n{select}"
