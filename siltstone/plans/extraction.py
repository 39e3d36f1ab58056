"""Queries of extraction and screening, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import events, facts, screening
from siltstone.plans.fixtures import fixture, with_fixtures


def duration_anchor(spark: SparkSession, sf: str) -> DataFrame:
    rows = events.anchors(fixture(spark, sf, "paragraphs"))
    return rows.select("document_id", "paragraph_id", "pos", "quote", F.col("start").alias("start_char"), F.col("end").alias("end_char"))


def timestep_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    return events.anchors(fixture(spark, sf, "paragraphs"), "timestep").select("document_id", "paragraph_id", "pos", "is_timestep")


def unit_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return events.anchors(fixture(spark, sf, "paragraphs"), "duration").select("document_id", "paragraph_id", "pos", "duration_ps")


def phase_nearest(spark: SparkSession, sf: str) -> DataFrame:
    rows = events.anchors(fixture(spark, sf, "paragraphs"), "phase")
    return rows.select("document_id", "paragraph_id", "pos", "event_type", "passes_gate")


def link_nearest(spark: SparkSession, sf: str) -> DataFrame:
    rows = events.anchors(fixture(spark, sf, "paragraphs"), "conditions")
    return rows.select("document_id", "paragraph_id", "pos", "temperature_k", "pressure_bar", "timestep_fs", "replicates", "ensemble")


def extract_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = events.extract_events(fixture(spark, sf, "paragraphs"))
    return rows.select("event_id", "document_id", "event_type", "duration_ps", "temperature_k", "pressure_bar", "timestep_fs", "ensemble", "replicates", "start_char", "end_char", "context_sha256", "confidence")


def freeze_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events by phase, and how many have each attribute."""
    rows = events.extract_events(fixture(spark, sf, "paragraphs"))
    cols = ["duration_ps", "temperature_k", "pressure_bar", "timestep_fs", "ensemble", "replicates"]
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(f"with_{c}") for c in cols))


def evidence_check(spark: SparkSession, sf: str) -> DataFrame:
    own = fixture(spark, sf, "paragraphs")
    return events.evidence_errors(events.extract_events(own, conditions=False), own).agg(F.count(F.lit(1)).alias("n_errors"))


def pdb_ids(spark: SparkSession, sf: str) -> DataFrame:
    return facts.pdb_ids(fixture(spark, sf, "paragraphs")).select("document_id", "paragraph_id", "value", "start_char", "end_char")


def fact_regex(spark: SparkSession, sf: str) -> DataFrame:
    return facts.pattern_facts(fixture(spark, sf, "paragraphs")).select("document_id", "paragraph_id", "field", "value", "start_char", "end_char")


def fact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return facts.extract_facts(fixture(spark, sf, "paragraphs")).select("document_id", "field", "value", "paragraph_id", "start_char", "confidence")


def proto_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return facts.protocol_paragraphs(fixture(spark, sf, "paragraphs")).select("document_id", "paragraph_id")


def evidence_hash(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("sha"))


def text_norm(spark: SparkSession, sf: str) -> DataFrame:
    """White space collapsed, over whole texts."""
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.trim(F.regexp_replace("text", "[ \\t\\n\\r\\f]+", " ")).alias("plain"))


def software_family(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "articles").select("document_id", screening.software_family(F.col("text")).alias("software_family"))


def screen_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = screening.screened(fixture(spark, sf, "articles"))
    return rows.select("document_id", *(f"hits_{n}" for n in screening.PROTOCOL), *(f"domain_{n}" for n in screening.DOMAIN))


def screen_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = screening.screened(fixture(spark, sf, "articles"))
    return rows.select("document_id", F.array_join("engine_mentions", "+").alias("engines"), "positive_fields", "status", "eligible")


def screen_plan(spark: SparkSession, sf: str) -> DataFrame:
    return screening.screened(fixture(spark, sf, "articles")).groupBy("status", "eligible").agg(F.count(F.lit(1)).alias("n"))


def section_select(spark: SparkSession, sf: str) -> DataFrame:
    return screening.selected_sections(fixture(spark, sf, "paragraphs")).select("document_id", "paragraph_id", "selection_reason")


def file_role(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.concat("url", F.element_at(F.array(*map(F.lit, (".pdb", "/trajectory.xtc", "_config.yml", ".html", "/input.top"))), (F.col("page_id") % 5 + 1).cast("int"))).alias("name"))
    return names.select("page_id", F.array_join(screening.file_roles(F.col("name")), "+").alias("roles"))


def atom_name_norm(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixture(spark, sf, "atoms_a")
    return rows.select("atom_index", screening.atom_name(F.col("name")).alias("atom_name"), screening.one_letter(F.col("resname")).alias("letter"))


QUERIES = {f.__name__: f for f in (duration_anchor, timestep_exclusion, unit_normalize, phase_nearest, link_nearest, extract_events, freeze_counts, evidence_check, pdb_ids, fact_regex, fact_dedup, proto_paragraphs, evidence_hash, text_norm, software_family, screen_counts, screen_status, screen_plan, section_select, file_role, atom_name_norm)}


def spans(text: str, pattern: str) -> str:
    """DuckDB: a list of quote q and place s of each match."""
    m, g = f"regexp_extract_all({text}, '{pattern}', 0, 'i')", f"string_split_regex({text}, '(?i){pattern}')"
    before = lambda x, to: f"coalesce(list_sum(list_transform({x}[1:{to}], lambda y: length(y))), 0)"
    return f"list_transform(range(1, len({m}) + 1), lambda i: {{'s': CAST({before(g, 'i')} + {before(m, 'i - 1')} AS INTEGER), 'q': {m}[i]}})"


def hit(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}', 'i')"


_PARTS = f"""anchors AS (SELECT document_id, paragraph_id, text, CAST(i - 1 AS INTEGER) AS pos, l[i].q AS quote, l[i].s AS start_char, CAST(l[i].s + length(l[i].q) AS INTEGER) AS end_char
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, {spans('text', events.DURATION)} AS l FROM paragraphs) a) b),
timed AS (SELECT *, {hit("lower(substr(text, greatest(start_char - 32, 0) + 1, least(start_char, 32)))", events.STEP_BEFORE)} OR {hit("lower(substr(text, end_char + 1, 24))", events.STEP_AFTER)} AS is_timestep,
  CAST(regexp_extract(quote, '{events.DURATION}', 1, 'i') AS DOUBLE) * CASE lower(regexp_extract(quote, '{events.DURATION}', 2, 'i')) WHEN 'fs' THEN 1e-3 WHEN 'ps' THEN 1.0 WHEN 'ns' THEN 1e3 WHEN 'us' THEN 1e6 WHEN 'ms' THEN 1e9 END AS duration_ps FROM anchors),
near AS (SELECT *, greatest(start_char - 100, 0) AS lft, substr(text, greatest(start_char - 100, 0) + 1, end_char + 100 - greatest(start_char - 100, 0)) AS w FROM timed),
phased AS (SELECT *, coalesce(list_min(list_concat({", ".join(f"list_transform({spans('w', p)}, lambda m: {{'d': abs((m.s + m.s + length(m.q)) // 2 + lft - (start_char + end_char) // 2), 'p': '{n}'}})" for n, p in events.PHASES.items())})).p, 'unknown') AS event_type FROM near),
gated AS (SELECT *, event_type <> 'unknown' OR {" OR ".join(f"contains(lower(substr(text, greatest(start_char - 80, 0) + 1, end_char + 80 - greatest(start_char - 80, 0))), '{x}')" for x in events.UNKNOWN_WORDS)} AS passes_gate FROM phased),
local_ AS (SELECT *, greatest(start_char - 180, 0) AS lf, substr(text, greatest(start_char - 180, 0) + 1, end_char + 180 - greatest(start_char - 180, 0)) AS o FROM gated),
best AS (SELECT *, {", ".join(f"list_min(list_transform({spans('o', p)}, lambda m: {{'d': abs(lf + m.s - start_char), 's': m.s, 'q': m.q}})).q AS {n}" for n, p in (("qt", events.TEMPERATURE), ("qp", events.PRESSURE), ("qs", events.TIMESTEP), ("qr", events.REPLICATES)))} FROM local_),
linked AS (SELECT *, CAST(nullif(regexp_extract(qt, '{events.TEMPERATURE}', 1, 'i'), '') AS DOUBLE) AS temperature_k,
  CAST(nullif(regexp_extract(qp, '{events.PRESSURE}', 1, 'i'), '') AS DOUBLE) * CASE lower(regexp_extract(qp, '{events.PRESSURE}', 2, 'i')) WHEN 'atm' THEN 1.01325 ELSE 1.0 END AS pressure_bar,
  CAST(coalesce(nullif(regexp_extract(qs, '{events.TIMESTEP}', 1, 'i'), ''), nullif(regexp_extract(qs, '{events.TIMESTEP}', 3, 'i'), '')) AS DOUBLE) * CASE lower(coalesce(nullif(regexp_extract(qs, '{events.TIMESTEP}', 2, 'i'), ''), regexp_extract(qs, '{events.TIMESTEP}', 4, 'i'))) WHEN 'ps' THEN 1000.0 ELSE 1.0 END AS timestep_fs,
  CAST(CASE lower(regexp_extract(qr, '{events.REPLICATES}', 1, 'i')) WHEN 'three' THEN '3' ELSE nullif(regexp_extract(qr, '{events.REPLICATES}', 1, 'i'), '') END AS INTEGER) AS replicates,
  upper(nullif(regexp_extract(o, '{events.ENSEMBLE}', 1, 'i'), '')) AS ensemble FROM best),
found AS (SELECT *, row_number() OVER (PARTITION BY document_id, paragraph_id ORDER BY pos) AS k FROM linked WHERE NOT is_timestep AND duration_ps > 0 AND passes_gate)"""


def _events(select: str) -> str:
    return with_fixtures(["paragraphs"], "").rstrip() + ",\n" + _PARTS + "\n" + select


_BLOCK = facts.PDB_BLOCK
FACT_TABLES = f"""blocks AS (SELECT *, unnest({spans('text', _BLOCK)}) AS b FROM paragraphs),
bodies AS (SELECT *, regexp_extract(b.q, '{_BLOCK}', 1, 'i') AS ids FROM blocks),
inner_ AS (SELECT *, unnest({spans('ids', facts.PDB_ID)}) AS m, b.s + length(b.q) - length(ids) AS base FROM bodies),
pdb AS (SELECT document_id, paragraph_id, ordinal, 'starting_pdb_id' AS field, upper(m.q) AS value, CAST(base + m.s AS INTEGER) AS start_char, CAST(base + m.s + length(m.q) AS INTEGER) AS end_char, 0 AS rule FROM inner_),
pattern AS ({" UNION ALL ".join(f"SELECT document_id, paragraph_id, ordinal, '{f}' AS field, " + ("m.q" if v is None else f"'{v}'") + f" AS value, m.s AS start_char, CAST(m.s + length(m.q) AS INTEGER) AS end_char, {k + 1} AS rule FROM (SELECT *, unnest({spans('text', p)}) AS m FROM paragraphs) q{k}" for k, (f, v, p) in enumerate(facts.FACTS))})"""


def _facts(select: str) -> str:
    return with_fixtures(["paragraphs"], "").rstrip() + ",\n" + FACT_TABLES + "\n" + select


def _number(p: str) -> str:
    return f"CAST(coalesce(len(regexp_extract_all(text, '{p}', 0, 'i')), 0) AS BIGINT)"


_HITS = ", ".join([f"{_number(p)} AS hits_{n}" for n, p in screening.PROTOCOL.items()] + [f"{_number(p)} AS domain_{n}" for n, p in screening.DOMAIN.items()])
_ENGINES = "[" + ", ".join(f"CASE WHEN {hit('text', p)} THEN '{n}' END" for n, p in screening.ENGINES.items()) + "]"
_POSITIVE = " + ".join(f"CAST(hits_{n} > 0 AS BIGINT)" for n in screening.PROTOCOL if n != "molecular_dynamics")
_GENERIC = f"hits_molecular_dynamics > 0 AND ({_POSITIVE}) >= 2 AND greatest({', '.join(f'domain_{n}' for n in screening.DOMAIN)}) > 0"
_STATUS = f"""SELECT document_id, array_to_string(list_sort(list_filter(eng, lambda x: x IS NOT NULL)), '+') AS engines, {_POSITIVE} AS positive_fields, CASE WHEN {_GENERIC} AND len(list_filter(eng, lambda x: x IS NOT NULL)) > 0 THEN '{screening.STRONG}' WHEN {_GENERIC} THEN '{screening.GENERIC}' ELSE '{screening.WEAK}' END AS status, article_type
FROM (SELECT document_id, article_type, {_ENGINES} AS eng, {_HITS} FROM articles) h"""


def _is_role(suffixes: tuple, words: tuple) -> str:
    return f"regexp_matches(lower(name), '[^/]\\.({'|'.join(suffixes)})$')" + "".join(f" OR contains(lower(name), '{w}')" for w in words)


ORACLES = {
    "duration_anchor": _events("SELECT document_id, paragraph_id, pos, quote, start_char, end_char FROM anchors"),
    "timestep_exclusion": _events("SELECT document_id, paragraph_id, pos, is_timestep FROM timed"),
    "unit_normalize": _events("SELECT document_id, paragraph_id, pos, duration_ps FROM timed"),
    "phase_nearest": _events("SELECT document_id, paragraph_id, pos, event_type, passes_gate FROM gated"),
    "link_nearest": _events("SELECT document_id, paragraph_id, pos, temperature_k, pressure_bar, timestep_fs, replicates, ensemble FROM linked"),
    "extract_events": _events("SELECT document_id || ':' || paragraph_id || ':event-' || k AS event_id, document_id, event_type, duration_ps, temperature_k, pressure_bar, timestep_fs, ensemble, replicates, start_char, end_char, sha256(text) AS context_sha256, CASE WHEN event_type = 'unknown' THEN 0.65 ELSE 0.92 END::DOUBLE AS confidence FROM found"),
    "freeze_counts": _events("SELECT event_type, count(*) AS n, count(duration_ps) AS with_duration_ps, count(temperature_k) AS with_temperature_k, count(pressure_bar) AS with_pressure_bar, count(timestep_fs) AS with_timestep_fs, count(ensemble) AS with_ensemble, count(replicates) AS with_replicates FROM found GROUP BY event_type"),
    "evidence_check": _events("SELECT count(*) AS n_errors FROM found WHERE substr(text, start_char + 1, end_char - start_char) <> quote"),
    "pdb_ids": _facts("SELECT document_id, paragraph_id, value, start_char, end_char FROM pdb"),
    "fact_regex": _facts("SELECT document_id, paragraph_id, field, value, start_char, end_char FROM pattern"),
    "fact_dedup": _facts("SELECT document_id, field, value, paragraph_id, start_char, CASE WHEN rule = 0 THEN 0.99 ELSE 0.9 END::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY document_id, field, lower(value) ORDER BY ordinal, rule, start_char) AS n FROM (SELECT * FROM pdb UNION ALL SELECT * FROM pattern) u) v WHERE n = 1"),
    "proto_paragraphs": with_fixtures(["paragraphs"], f"SELECT document_id, paragraph_id FROM paragraphs WHERE {' OR '.join(f'''contains(lower(section), '{t}')''' for t in facts.TITLE_TERMS)} OR {hit('text', facts.PROTOCOL_SIGNAL)}"),
    "evidence_hash": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "text_norm": "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS plain FROM documents",
    "software_family": with_fixtures(["articles"], f"SELECT document_id, coalesce(nullif(array_to_string(list_filter({_ENGINES}, lambda x: x IS NOT NULL), '+'), ''), 'unknown') AS software_family FROM articles"),
    "screen_counts": with_fixtures(["articles"], f"SELECT document_id, {_HITS} FROM articles"),
    "screen_status": with_fixtures(["articles"], f"SELECT document_id, engines, positive_fields, status, status <> '{screening.WEAK}' AND article_type <> 'review-article' AS eligible FROM ({_STATUS}) s"),
    "screen_plan": with_fixtures(["articles"], f"SELECT status, status <> '{screening.WEAK}' AND article_type <> 'review-article' AS eligible, count(*) AS n FROM ({_STATUS}) s GROUP BY 1, 2"),
    "section_select": with_fixtures(["paragraphs"], f"SELECT * FROM (SELECT document_id, paragraph_id, CASE WHEN {hit('section', screening.PACKET_TITLE)} THEN 'section_title' WHEN {hit('text', screening.RICH_SIGNAL)} AND {' + '.join(f'CAST({hit('text', p)} AS INTEGER)' for p in screening.RICH_GROUPS)} >= 2 THEN 'protocol_rich_content' END AS selection_reason FROM paragraphs) s WHERE selection_reason IS NOT NULL"),
    "file_role": f"SELECT page_id, coalesce(nullif(array_to_string(list_filter([CASE WHEN {_is_role(*screening.TOPOLOGY)} THEN 'topology_or_structure' END, CASE WHEN {_is_role(*screening.TRAJECTORY)} THEN 'trajectory' END, CASE WHEN {_is_role(*screening.WORKFLOW)} THEN 'workflow_or_parameters' END], lambda x: x IS NOT NULL), '+'), ''), 'other') AS roles FROM (SELECT page_id, url || ['.pdb', '/trajectory.xtc', '_config.yml', '.html', '/input.top'][page_id % 5 + 1] AS name FROM pages) p",
    "atom_name_norm": with_fixtures(["atoms_a"], "SELECT atom_index, regexp_replace(CASE n WHEN 'HN' THEN 'H' WHEN 'OT1' THEN 'O' WHEN 'OT2' THEN 'OXT' ELSE n END, '^([0-9]+)(.*)$', '\\2\\1') AS atom_name, CASE upper(trim(resname)) WHEN 'ALA' THEN 'A' WHEN 'HSD' THEN 'H' WHEN 'GLY' THEN 'G' END AS letter FROM (SELECT *, regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') AS n FROM atoms_a) a"),
}
