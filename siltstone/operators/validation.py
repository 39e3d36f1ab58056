"""Identifier validation over stored request attempts, as a state machine in expressions.

Attempts are rows: endpoint, attempt (order), status (null for a transport error), error, payload (JSON), retry_after.
A retrieval is decided by an endpoint's attempts up to its first final one; network failure is never a conflict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALIDATED, CONFLICT, UNRESOLVED = "validated", "conflict", "unresolved"
#: Statuses that are tried again, retries, and waits in seconds.
RETRYABLE, RETRIES, BACKOFF, BACKOFF_CAP = (429, 500, 502, 503, 504), 2, 0.25, 5.0
MAPPING_JSON = (
    "map<string, struct<UniProt: map<string, struct<mappings: array<struct<chain_id: string, struct_asym_id: string, "
    "start: struct<residue_number: int>, end: struct<residue_number: int>, unp_start: int, unp_end: int>>>>>>"
)
#: Where the services answer.
URLS = {
    "pdb": "https://www.ebi.ac.uk/pdbe/api/pdb/entry/summary/{}",
    "pdb_uniprot_mapping": "https://www.ebi.ac.uk/pdbe/api/mappings/uniprot/{}",
    "uniprot": "https://rest.uniprot.org/uniprotkb/{}.json",
}
SEGMENT = ["pdb_id", "uniprot_accession", "chain_id", "pdb_start", "pdb_end", "uniprot_start", "uniprot_end"]


def endpoint(kind: str, identifier: Column) -> Column:
    """The URL that an identifier is asked at; structures are asked in lower case."""
    before, after = URLS[kind].split("{}")
    return F.concat(F.lit(before), identifier if kind == "uniprot" else F.lower(identifier), F.lit(after))


def retrieved(attempts: DataFrame, retries: int = RETRIES) -> DataFrame:
    """A row for each endpoint: attempts made, response_received, http_status, payload, terminal_error, waited seconds.

    Transport errors and retryable statuses are tried again while retries are left; the last attempt's status counts as
    a response whatever it is.
    """
    order = Window.partitionBy("endpoint").orderBy("attempt")
    rows = attempts.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= retries + 1)
    failed = F.col("status").isNull() | F.col("status").isin(*RETRYABLE)
    rows = rows.withColumn("_again", failed & (F.col("n") <= retries))
    # attempts after the first final one were never made
    stops = F.sum((~F.col("_again")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_stops", F.coalesce(stops, F.lit(0))).filter("_stops = 0")
    wait = F.least(F.coalesce(F.when(F.col("status").isNotNull(), F.col("retry_after")), BACKOFF * F.pow(F.lit(2.0), F.col("n") - 1)), F.when(F.col("status").isNull(), F.lit(float("inf"))).otherwise(BACKOFF_CAP))
    rows = rows.withColumn("_wait", F.when(F.col("_again"), wait).otherwise(0.0))
    last = lambda c: F.max_by(c, "n")
    out = rows.groupBy("endpoint").agg(F.count(F.lit(1)).alias("attempts"), last("status").alias("http_status"), last("payload").alias("payload"), last(F.coalesce("error", F.lit("request_failed"))).alias("_error"), F.sum("_wait").alias("waited"))
    received = F.col("http_status").isNotNull()
    return out.withColumn("response_received", received).withColumn("terminal_error", F.when(~received, F.col("_error"))).drop("_error")


def cached(responses: DataFrame, cache: DataFrame) -> DataFrame:
    """Endpoints whose cached response is intact: its key is the endpoint's hash and its hash is the payload's."""
    rows = responses.select("endpoint").join(cache, "endpoint")
    return rows.filter((F.col("cache_key") == F.sha2("endpoint", 256)) & (F.col("response_sha256") == F.sha2("payload", 256)))


def cache_rows(responses: DataFrame) -> DataFrame:
    """Rows for a cache: endpoint, http_status, payload, cache_key and response_sha256. Only answers with a payload are kept."""
    rows = responses.filter("response_received and payload is not null")
    return rows.select("endpoint", "http_status", "payload", F.sha2("endpoint", 256).alias("cache_key"), F.sha2("payload", 256).alias("response_sha256"))


def compact(records: DataFrame, retain_payload: bool = False) -> DataFrame:
    """Records whose payload is null unless it is retained."""
    return records if retain_payload else records.withColumn("payload", F.lit(None).cast(records.schema["payload"].dataType))


def _state(received: Column, status: Column, error: Column, supported: Column, yes: str, no: str) -> Column:
    # fixed values: the states and reasons, here and below
    state = lambda s, r: F.struct(F.lit(s).alias("state"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    return (
        F.when(~F.coalesce(received, F.lit(False)), state(UNRESOLVED, F.coalesce(error, F.lit("request_failed"))))
        .when(status == 404, state(CONFLICT, "successful_service_response_identifier_not_found"))
        .when(status != 200, state(UNRESOLVED, "non_success_service_response"))
        .when(F.coalesce(supported, F.lit(False)), state(VALIDATED, yes))
        .otherwise(state(CONFLICT, no))
    )


def _answered(queries: DataFrame, responses: DataFrame) -> DataFrame:
    return queries.join(responses, "endpoint", "left")


def validate_pdb(queries: DataFrame, responses: DataFrame) -> DataFrame:
    """queries: pdb_id, endpoint. An entry exists if the response has its identifier as a key."""
    rows = _answered(queries, responses)
    has = F.array_contains(F.json_object_keys("payload"), F.lower("pdb_id"))
    s = _state(F.col("response_received"), F.col("http_status"), F.col("terminal_error"), has, "entry_exists", "response_does_not_contain_requested_entry")
    return rows.select(F.lit("pdb").alias("identifier_type"), F.upper("pdb_id").alias("query"), s["state"].alias("state"), s["reason"].alias("reason"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


def validate_uniprot(queries: DataFrame, responses: DataFrame) -> DataFrame:
    """queries: accession, endpoint."""
    rows = _answered(queries, responses)
    same = F.get_json_object("payload", "$.primaryAccession") == F.col("accession")
    s = _state(F.col("response_received"), F.col("http_status"), F.col("terminal_error"), same, "accession_matches", "accession_mismatch")
    return rows.select(F.lit("uniprot").alias("identifier_type"), F.col("accession").alias("query"), s["state"].alias("state"), s["reason"].alias("reason"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


def segments(responses: DataFrame) -> DataFrame:
    """Every mapping of every response as a row of SEGMENT, with its position. responses: payload."""
    by_pdb = responses.select(F.explode(F.from_json("payload", MAPPING_JSON)).alias("pdb", "entry"))
    by_accession = by_pdb.select("pdb", F.explode("entry.UniProt").alias("accession", "a"))
    rows = by_accession.select("pdb", "accession", F.posexplode("a.mappings").alias("position", "m"))
    chain = F.coalesce(F.nullif("m.chain_id", F.lit("")), F.nullif("m.struct_asym_id", F.lit("")), F.lit(""))
    return rows.select(F.upper("pdb").alias("pdb_id"), F.col("accession").alias("uniprot_accession"), chain.alias("chain_id"), F.col("m.start.residue_number").alias("pdb_start"), F.col("m.end.residue_number").alias("pdb_end"), F.col("m.unp_start").alias("uniprot_start"), F.col("m.unp_end").alias("uniprot_end"), "position")


def distinct_segments(rows: DataFrame) -> DataFrame:
    """Segments once each, on all seven columns; nulls are equal."""
    return rows.select(*SEGMENT).distinct()


def discovered(queries: DataFrame, responses: DataFrame) -> DataFrame:
    """A row for each structure: state, segments and sorted accessions. Any answer but 200 is unresolved."""
    found = segments(responses.filter("http_status = 200")).groupBy("pdb_id").agg(F.count(F.lit(1)).alias("n_segments"), F.array_sort(F.collect_set("uniprot_accession")).alias("accessions"))
    rows = _answered(queries.withColumn("pdb_id", F.upper("pdb_id")), responses).join(found, "pdb_id", "left")
    ok = F.coalesce(F.col("response_received") & (F.col("http_status") == 200), F.lit(False))
    state = F.when(~ok, UNRESOLVED).when(F.coalesce("n_segments", F.lit(0)) > 0, VALIDATED).otherwise(CONFLICT)
    return rows.select("pdb_id", state.alias("state"), F.when(ok, F.coalesce("n_segments", F.lit(0))).otherwise(0).alias("n_segments"), F.when(ok, F.col("accessions")).alias("accessions"))


def validate_mapping(queries: DataFrame, responses: DataFrame) -> DataFrame:
    """queries: pdb_id, accession, chain_id (null or empty: any), endpoint. Any answer but 200 is unresolved."""
    held = segments(responses.filter("http_status = 200")).groupBy("pdb_id", "uniprot_accession").agg(F.count(F.lit(1)).alias("n_segments"), F.collect_set("chain_id").alias("chains"))
    rows = _answered(queries.withColumn("pdb_id", F.upper("pdb_id")), responses).join(held.withColumnRenamed("uniprot_accession", "accession"), ["pdb_id", "accession"], "left")
    ok = F.coalesce(F.col("response_received") & (F.col("http_status") == 200), F.lit(False))
    chain = F.coalesce("chain_id", F.lit(""))
    n = F.when(ok, F.coalesce("n_segments", F.lit(0))).otherwise(0)
    absent = (chain != "") & ~F.array_contains("chains", chain)
    state = F.when(~ok, UNRESOLVED).when((n == 0) | absent, CONFLICT).otherwise(VALIDATED)
    reason = F.when(~ok, F.coalesce("terminal_error", F.lit("mapping_response_unavailable"))).when(n == 0, "successful_mapping_response_relation_absent").when(absent, "accession_present_but_chain_absent").otherwise("mapping_supported")
    return rows.select(F.lit("pdb_uniprot_mapping").alias("identifier_type"), F.concat_ws("|", "pdb_id", "accession", chain).alias("query"), state.alias("state"), reason.alias("reason"), F.coalesce("attempts", F.lit(0)).alias("attempts"), n.alias("n_segments"))


def cascade(facts: DataFrame, pdb_states: DataFrame, discoveries: DataFrame) -> DataFrame:
    """document_id, pdb_id, accession: discoveries of a document's validated structures only."""
    ids = facts.filter("field = 'starting_pdb_id'").select("document_id", F.upper("value").alias("pdb_id")).distinct()
    good = pdb_states.filter(F.col("state") == VALIDATED).select(F.col("query").alias("pdb_id"))
    return ids.join(good, "pdb_id", "left_semi").join(discoveries, "pdb_id").select("document_id", "pdb_id", F.explode("accessions").alias("accession"))


def completeness(states: DataFrame, key: str) -> DataFrame:
    """key, n and status of each group of states."""
    is_ = lambda s: F.count_if(F.col("state") == s)
    n = F.count("state")
    status = F.when(n == 0, "not_applicable").when(is_(VALIDATED) == n, "complete").when(is_(VALIDATED) > 0, "partial").when(is_(UNRESOLVED) > 0, "unresolved").otherwise("conflict")
    return states.groupBy(key).agg(n.alias("n"), status.alias("status"))


def record_completeness(records: DataFrame) -> DataFrame:
    """Adds the six status fields. records: n_facts, n_segments, md_mapping_status, assets (array of availabilities), and
    pdb_status, uniprot_status, mapping_status from `completeness`."""
    scope = F.when(F.col("n_segments") == 0, "not_computable").when(F.col("md_mapping_status") == "verified", "md_to_pdb_to_uniprot_verified").otherwise("pdb_to_uniprot_only")
    files = F.when(F.size(F.coalesce("assets", F.array().cast("array<string>"))) == 0, "not_provided").when(F.forall("assets", lambda a: a == "verified_local"), "verified").otherwise("declared_not_fully_verified")
    none = lambda c: F.coalesce(c, F.lit("not_applicable"))
    return records.withColumns(
        {
            "literature_extraction": F.when(F.col("n_facts") > 0, "complete").otherwise("no_supported_fact"),
            "pdb_validation": none("pdb_status"), "uniprot_enrichment": none("uniprot_status"), "sifts_mapping": none("mapping_status"),
            "residue_mapping_scope": scope, "md_file_provenance": files,
        }
    )


def cascade_records(links: DataFrame, responses: DataFrame, accession_endpoint: Column, mapping_endpoint: Column) -> DataFrame:
    """document_id and the records of every link of `cascade`: its accession and its mapping, each validated once however
    many documents name it. The endpoints are expressions over pdb_id and accession."""
    accessions = links.select("accession").distinct().select("accession", accession_endpoint.alias("endpoint"))
    mappings = links.select("pdb_id", "accession").distinct().select("pdb_id", "accession", F.lit(None).cast("string").alias("chain_id"), mapping_endpoint.alias("endpoint"))
    known = links.select("document_id", F.explode(F.array(F.col("accession"), F.concat_ws("|", "pdb_id", "accession", F.lit("")))).alias("query")).distinct()
    records = validate_uniprot(accessions, responses).unionByName(validate_mapping(mappings, responses).drop("n_segments"))
    return known.join(records, "query").select("document_id", "identifier_type", "query", "state", "reason", "attempts")


def summary(records: DataFrame) -> DataFrame:
    """kind, name, n: counts by state, type and reason, and the sums; one pass over the records."""
    sets = records.groupingSets([["state"], ["identifier_type"], ["reason"], []], "state", "identifier_type", "reason")
    wrong = F.count_if(F.col("state").isin(UNRESOLVED, CONFLICT))
    rows = sets.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("attempts")), F.lit(0)).cast("long").alias("tries"), wrong.alias("wrong"))
    one = lambda kind, name, n: F.struct(F.lit(kind).alias("kind"), name.alias("name"), n.alias("n"))
    totals = F.array(*(one("total", F.lit(name), F.col(c)) for name, c in (("record_count", "n"), ("total_network_attempts", "tries"), ("unresolved_or_conflict_count", "wrong"))))
    # the set of a row is told by the columns it leaves out
    by = lambda c: F.array(one(c, F.col(c), F.col("n")))
    kinds = F.when(F.col("g") == 3, by("state")).when(F.col("g") == 5, by("identifier_type")).when(F.col("g") == 6, by("reason")).otherwise(totals)
    return rows.select(F.explode(kinds).alias("x")).select("x.*")


def integration_counts(pdb_records: DataFrame, mapping_records: DataFrame, records: DataFrame) -> DataFrame:
    """kind, name, n: structures' and mappings' records by state, and integrated records by md_file_provenance."""
    of = lambda rows, c, kind: rows.select(F.lit(kind).alias("kind"), F.col(c).alias("name"))
    rows = of(pdb_records, "state", "pdb_state").union(of(mapping_records, "state", "mapping_state")).union(of(records, "md_file_provenance", "md_file_provenance"))
    return rows.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def provenance(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Adds problem to each asset: a verified local file must exist and have the declared hash. files: path, sha256."""
    rows = assets.join(files.select(F.col("path").alias("local_path"), F.col("sha256").alias("_actual")), "local_path", "left")
    local = F.col("availability") == "verified_local"
    problem = F.when(local & (F.col("local_path").isNull() | F.col("sha256").isNull()), "verified_asset_needs_path_and_hash").when(local & F.col("_actual").isNull(), "file_not_found").when(local & (F.col("_actual") != F.col("sha256")), "hash_mismatch")
    return rows.withColumn("problem", problem).drop("_actual")
