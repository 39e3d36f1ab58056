"""File sources and sinks: JSON in its several layouts, exclusion lists, article folders, annotation packs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.staging import Scratch
from siltstone.operators.commitment import root_of
from siltstone.operators.screening import file_roles

ANNOTATION = "annotation_id string, document_id string, annotator_id string, field_name string, normalized_value string, unit string, event_type string, paragraph_id string, start_char int, end_char int, quote string, note string"
CANDIDATE = "document_id string, title string, source_uri string, doi string, year int, software_family string, licence string, full_text_available boolean, source_sha256 string"
EVENT = "event_id string, event_type string, duration_ps double, temperature_k double, pressure_bar double, timestep_fs double, ensemble string, restraints string, replicates int, confidence double"
VALIDATION = "identifier_type string, query string, state string, reason string, attempts long"


def whole_json(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one string."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")


def listed(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Rows of JSON lines, of a JSON list, or of a list under a key of a JSON object. Raises on keys the schema lacks."""
    if path.endswith(".jsonl"):
        rows = spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("item"))
    else:
        text = whole_json(spark, path)
        inner = F.when(F.ltrim("json").startswith("["), F.col("json")).otherwise(F.get_json_object("json", f"$.{key}"))
        rows = text.select(F.explode(F.from_json(inner, "array<string>")).alias("item"))
    names = [f.split()[0] for f in schema.split(", ")]
    extra = F.array_except(F.json_object_keys("item"), F.array(*map(F.lit, names)))
    checked = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown keys: "), F.array_join(extra, ", ")))).otherwise(F.col("item"))
    return rows.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return listed(spark, path, ANNOTATION, "facts")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return listed(spark, path, CANDIDATE, "articles")


def read_validations(spark: SparkSession, path: str) -> DataFrame:
    return listed(spark, path, VALIDATION, "records")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of {"documents": {id: [event]}} or {id: [event]}, with document_id."""
    text = whole_json(spark, path)
    inner = F.coalesce(F.get_json_object("json", "$.documents"), F.col("json"))
    schema = "map<string, array<struct<" + ", ".join(f.replace(" ", ": ", 1) for f in EVENT.split(", ")) + ">>>"
    by = text.select(F.explode(F.from_json(inner, schema)).alias("document_id", "events"))
    return by.select("document_id", F.inline("events"))


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Identifiers in upper case, once each; comments and blank lines are skipped."""
    rows = spark.read.text(path).select(F.upper(F.trim(F.split_part("value", F.lit("#"), F.lit(1)))).alias("document_id"))
    return rows.filter("document_id <> ''").distinct()


def read_articles(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, content and sha256 of a folder's XML files; the id is the file's name in upper case."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(folder)
    return rows.select(F.upper(F.regexp_extract("path", r"([^/]+)\.xml$", 1)).alias("document_id"), "content", F.sha2("content", 256).alias("sha256"))


def missing_articles(plan: DataFrame, articles: DataFrame) -> DataFrame:
    return plan.join(articles.select("document_id"), "document_id", "left_anti")


def valid_article_id(name: Column) -> Column:
    """Whether a name may become a file's name."""
    return name.rlike("(?i)^PMC[0-9]+$")


def sorted_json(df: DataFrame) -> DataFrame:
    """One column: each row as JSON with its keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> str | None:
    """JSON lines with sorted keys. With an order the files follow each other in it by name, a range of it in each, and the
    root of the lines' tree is returned, which doesn't depend on where one file ends and the next begins."""
    if not order:
        sorted_json(df).write.mode("overwrite").text(path)
        return None
    scratch = Scratch(df.sparkSession, "jsonl")
    staged = scratch.stage(df, "rows")
    sorted_json(staged.repartitionByRange(*order).sortWithinPartitions(*order)).write.mode("overwrite").text(path)
    root = root_of(staged, order)
    scratch.drop()
    return root


def jsonl_intact(df: DataFrame, order: list[str], root: str) -> bool:
    """Whether rows read back are those that were written."""
    return root_of(df, order) == root


#: What a reviewer may answer about an article.
ELIGIBILITY = ("yes", "no", "uncertain")
GUIDE = """# Review and annotation

Two reviewers fill in their own columns of `articles` without seeing each other's, and settle what differs before anyone annotates.
Facts go to each annotator's own file, a JSON object a line with the fields of `schema`: the quote must be the paragraph's text
from start_char up to end_char. The screen's status is triage and no decision; predictions aren't shown in this pass.
"""


def write_workpack(rows: DataFrame, folder: str, settings: dict | None = None) -> None:
    """A folder for annotators: the table with empty columns for two reviewers and an adjudicator, the counts and settings of the
    pack, the schema of a fact, a guide, and a file without lines for each annotator. A pack has as many rows as a plan."""
    spark = rows.sparkSession
    empty = {f"{who}_{what}": F.lit("") for who in ("reviewer_a", "reviewer_b") for what in ("eligible", "reason", "note")} | {c: F.lit("") for c in ("adjudicated_eligible", "adjudicated_reason", "adjudicator_note")}
    rows.withColumns(empty).orderBy("split", "split_order").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/articles")
    counts = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    fields = [dict(zip(("name", "type"), f.split(), strict=True)) for f in ANNOTATION.split(", ")]
    pack = {"article_count": sum(counts.values()), "split_counts": counts, "eligibility_values": ELIGIBILITY, **(settings or {})}
    lines = {"facts": "", "facts_b": "", "guide": GUIDE, "schema": json.dumps(fields, indent=1), "pack": json.dumps(pack, sort_keys=True, indent=1)}
    for name, text in lines.items():
        own = [(line,) for line in text.splitlines()]
        spark.createDataFrame(own, "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


#: What a project's descriptor tells of its metadata.
PROJECT_KEYS = ("NAME", "PROGRAM", "VERSION", "LENGTH", "TIMESTEP", "SNAPSHOTS", "FF", "TEMP", "ENSEMBLE", "atomCount", "frameCount", "PDBIDS", "REFERENCES", "TOPOREF", "LICENSE", "CITATION")


def project_descriptors(responses: DataFrame) -> DataFrame:
    """project, published, metadata (the keys of PROJECT_KEYS that it has, as JSON text), descriptor_count and files.

    responses: project, project_payload, files_payload, both JSON. A file list may be under the key "files", and may be an
    object by name. A payload that is no JSON gives nulls and no files.
    """
    value = lambda k: F.get_json_object("project_payload", f"$.metadata.{k}")
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), value(k).alias("value")) for k in PROJECT_KEYS)), lambda x: x["value"].isNotNull())
    listed = F.coalesce(F.get_json_object("files_payload", "$.files"), F.col("files_payload"))
    files = F.coalesce(file_listing(listed), F.array().cast("array<struct<filename:string,bytes:bigint,content_type:string>>"))
    roles = F.transform(files, lambda f: F.struct(f["filename"].alias("filename"), file_roles(f["filename"]).alias("roles"), f["bytes"].alias("bytes"), f["content_type"].alias("content_type")))
    return responses.select("project", F.get_json_object("project_payload", "$.published").try_cast("boolean").alias("published"), F.map_from_entries(entries).alias("metadata"), F.size(files).alias("descriptor_count"), roles.alias("files"))


def file_listing(payload: Column) -> Column:
    """Files of a project as structs of name, size and content type, from a JSON list or a JSON object by name."""
    item = "struct<filename: string, name: string, file: string, length: long, size: long, contentType: string, content_type: string>"
    rows = F.when(F.ltrim(payload).startswith("["), F.from_json(payload, f"array<{item}>")).otherwise(F.map_values(F.from_json(payload, f"map<string, {item}>")))
    some = lambda x, *names: F.coalesce(*(F.nullif(x[n].cast("string"), F.lit("")) for n in names))
    return F.transform(rows, lambda x: F.struct(F.coalesce(some(x, "filename", "name", "file"), F.lit("")).alias("filename"), some(x, "length", "size").cast("long").alias("bytes"), some(x, "contentType", "content_type").alias("content_type")))


def residue_listing(responses: DataFrame) -> DataFrame:
    """chain_id, residue_order, residue_number, author_number and residue_name from JSON of molecules, chains and residues."""
    residue = "struct<residue_number: int, author_residue_number: int, residue_name: string>"
    schema = f"map<string, struct<molecules: array<struct<chains: array<struct<chain_id: string, residues: array<{residue}>>>>>>>"
    rows = responses.select(F.explode(F.from_json("payload", schema)).alias("pdb_id", "e")).select("pdb_id", F.explode("e.molecules").alias("m")).select("pdb_id", F.explode("m.chains").alias("c"))
    rows = rows.select("pdb_id", "c.chain_id", F.posexplode("c.residues").alias("residue_order", "r"))
    return rows.select("pdb_id", "chain_id", "residue_order", "r.residue_number", F.col("r.author_residue_number").alias("author_number"), "r.residue_name")


def residue_summary(residues: DataFrame) -> DataFrame:
    """Each chain's length and its first and last three residues."""
    own = residues.groupBy("chain_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("residue_order", "residue_name"))), lambda x: x["residue_name"]).alias("names"))
    n = F.size("names")
    return own.select("chain_id", n.alias("n_residues"), F.slice("names", 1, 3).alias("first"), F.slice("names", F.greatest(n - 2, F.lit(1)), 3).alias("last"))


def residue_schema(responses: DataFrame) -> DataFrame:
    """What each chain of a residue listing holds: its molecule, its number of residues, and the keys of the chain and of
    its first residue. responses: pdb_id, payload."""
    molecule = "struct<entity_id: string, molecule_name: string, chains: array<string>>"
    rows = responses.select(F.upper("pdb_id").alias("pdb_id"), F.explode(F.from_json("payload", f"map<string, struct<molecules: array<{molecule}>>>")).alias("_key", "e"))
    rows = rows.select("pdb_id", F.explode("e.molecules").alias("m")).select("pdb_id", "m.entity_id", "m.molecule_name", F.explode("m.chains").alias("_chain"))
    rows = rows.withColumn("c", F.from_json("_chain", "struct<chain_id: string, struct_asym_id: string, residues: array<string>>"))
    keys = lambda x: F.coalesce(F.array_sort(F.json_object_keys(x)), F.array().cast("array<string>"))
    return rows.select("pdb_id", "entity_id", "molecule_name", "c.chain_id", "c.struct_asym_id", F.coalesce(F.size("c.residues"), F.lit(0)).alias("n_residues"), keys(F.col("_chain")).alias("chain_keys"), keys(F.get(F.col("c.residues"), F.lit(0))).alias("residue_keys"))
