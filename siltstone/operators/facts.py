"""Literature facts: structure identifiers, system contents, engines, force fields and water models."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.matching import arrow_scan, found
from siltstone.functions.scanning import Texts, compiled, lists

#: The patterns. A structure block ends with its identifiers.
PDB_BLOCK = (
    r"\bPDB(?:\s+(?:ID(?:s)?|entry|entries|code(?:s)?|structure(?:s)?))?\s*(?:\))?\s*(?:[:=#]\s*)?"
    r"([0-9][A-Za-z0-9]{3}(?:\s*(?:,|/|and|or)\s*[0-9][A-Za-z0-9]{3})*)"
)
PDB_ID = r"\b[0-9][A-Za-z0-9]{3}\b"
FACTS = [
    ("system_contains_membrane", "true", r"\b(?:viral\s+)?membrane\b|\blipid\s+bilayer\b"),
    ("system_contains_glycans", "true", r"\bglycans?\b|\bglycosylat(?:ed|ion)\b"),
    ("simulation_engine", "GROMACS", r"\bGROMACS\b"),
    ("simulation_engine", "AMBER", r"\bAMBER(?:TOOLS)?\b"),
    ("simulation_engine", "NAMD", r"\bNAMD\b"),
    ("simulation_engine", "OpenMM", r"\bOpenMM\b"),
    ("simulation_engine", "CHARMM", r"\bCHARMM\b"),
    ("simulation_engine", "Desmond", r"\bDesmond\b"),
    ("force_field", None, r"\b(?:CHARMM(?:19|22|27|36m?|\d{2}[a-z]?)|ff(?:99|03|12|14|19)SB|OPLS(?:-AA)?|GROMOS(?:\s*\d+[A-Za-z0-9]*)?)\b"),
    ("water_model", None, r"\b(?:TIP[345]P(?:-Ew)?|SPC(?:/E)?|OPC)\b"),
]
PDB_CONFIDENCE, FACT_CONFIDENCE = 0.99, 0.9
TITLE_TERMS = ("method", "simulation", "computational", "molecular dynamics", "system preparation")
PROTOCOL_SIGNAL = r"molecular dynamics|\bMD\b|equilibrat|production simulation|force field|\bNPT\b|\bNVT\b"


FACT = "struct<field:string,value:string,quote:string,start_char:int,end_char:int,rule:int>"
#: Field and value by rule; rule 0 are the identifiers.
FIELDS = pa.array(["starting_pdb_id", *(f for f, _, _ in FACTS)])
VALUES = pa.array([None, *(v for _, v, _ in FACTS)], pa.string())


@lru_cache(maxsize=1 << 14)
def _identifiers(block: str) -> list[tuple[int, int, str]]:
    """Start, end and text of each identifier of a block."""
    ids = compiled(PDB_BLOCK).match(block)[1]
    first = len(block) - len(ids)
    return [(first + m.start(), first + m.end(), m[0]) for m in compiled(PDB_ID).finditer(ids)]


def listed(text: Column, identifiers: bool = True, patterns: bool = True) -> Column:
    """The facts of a text as an array of FACT, by rule and place; a scan of the whole column for each pattern."""

    def scan(column: pa.Array) -> pa.Array:
        texts, found = Texts(column), []
        if identifiers:
            blocks = texts.spans(PDB_BLOCK)
            ids = [(r, a + x, a + y, q) for r, a, block in zip(blocks.row.tolist(), blocks.start.tolist(), blocks.quote.to_pylist(), strict=True) for x, y, q in _identifiers(block)]
            row, start, end, quote = zip(*ids, strict=True) if ids else ((),) * 4
            found.append((0, *(np.array(x, np.int64) for x in (row, start, end)), pa.array(quote, pa.string())))
        if patterns:
            for k, (_, _, pattern) in enumerate(FACTS):
                spans = texts.spans(pattern)
                found.append((k + 1, spans.row, spans.start, spans.end, spans.quote))
        rules, rows, starts, ends, quotes = zip(*found, strict=True)
        order = np.argsort(row := np.concatenate(rows), kind="stable")
        number = lambda x: pa.array(np.concatenate(x)[order].astype(np.int32))
        rule = number([np.full(len(r), k) for k, r in zip(rules, rows, strict=True)])
        quote = pa.concat_arrays(quotes).take(pa.array(order))
        value = pc.if_else(pc.equal(rule, 0), pc.utf8_upper(quote), pc.coalesce(VALUES.take(rule), quote))
        return lists(len(column), row[order], {"field": FIELDS.take(rule), "value": value, "quote": quote, "start_char": number(starts), "end_char": number(ends), "rule": rule})

    return arrow_scan(scan, f"array<{FACT}>")(text)


def _found(paragraphs: DataFrame, **which: bool) -> DataFrame:
    # outer: from an inner explosion Spark infers a filter that would look for the matches a first time
    rows = paragraphs.select("document_id", "section", "paragraph_id", "ordinal", "text", F.explode_outer(listed(F.col("text"), **which)).alias("f")).filter("f is not null")
    return rows.select("document_id", "section", "paragraph_id", "ordinal", "text", "f.*")


def pdb_ids(paragraphs: DataFrame) -> DataFrame:
    """A row for every identifier in every block; value in upper case."""
    return _found(paragraphs, patterns=False)


def pattern_facts(paragraphs: DataFrame) -> DataFrame:
    """A row for every match of FACTS."""
    return _found(paragraphs, identifiers=False)


def all_facts(paragraphs: DataFrame) -> DataFrame:
    return _found(paragraphs)


def extract_facts(paragraphs: DataFrame) -> DataFrame:
    """The first fact of each field and value of a document: by paragraph, identifiers first, then rule and place."""
    order = Window.partitionBy("document_id", "field", F.lower("value")).orderBy("ordinal", "rule", "start_char")
    # a text's hash goes through the window, not the text
    rows = all_facts(paragraphs).withColumn("context_sha256", F.sha2("text", 256)).drop("text").withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    method = F.when(F.col("rule") == 0, F.lit("explicit_pdb_context_regex_v1")).otherwise(F.concat(F.lit("explicit_"), "field", F.lit("_regex_v1")))
    return rows.select("document_id", "section", "paragraph_id", "field", "value", "quote", "start_char", "end_char", "context_sha256", method.alias("extraction_method"), F.when(F.col("rule") == 0, PDB_CONFIDENCE).otherwise(FACT_CONFIDENCE).alias("confidence"))


def protocol_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs of a methods section, or with a protocol signal."""
    title = F.lit(False)
    for term in TITLE_TERMS:
        title = title | F.lower("section").contains(term)
    return paragraphs.filter(F.coalesce(title, F.lit(False)) | found(F.col("text"), PROTOCOL_SIGNAL))
