"""Queries of sampling, comparison, validation, residues and storage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import staging
from siltstone.operators import articles, candidates, commitment, comparison, events, facts, residues, sampling, storage, validation
from siltstone.plans.extraction import ORACLES as _EXTRACTION
from siltstone.plans.extraction import FACT_TABLES as _FACTS
from siltstone.plans.fixtures import fixture, numbered_candidates, with_fixtures
from siltstone.sources import structures

YEARS = {"year_min": 2016, "year_max": 2020, "require_year": True}
DRAWS = 50


def _reasons(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.with_reasons(fixture(spark, sf, "candidates"), fixture(spark, sf, "exclusions"), **YEARS)


def plan_exclude(spark: SparkSession, sf: str) -> DataFrame:
    rows = sampling.with_reasons(numbered_candidates(spark, sf), fixture(spark, sf, "exclusions"), **YEARS)
    return rows.select("position", "document_id", F.coalesce("reason", F.lit("eligible")).alias("reason"))


def plan_rank(spark: SparkSession, sf: str) -> DataFrame:
    return numbered_candidates(spark, sf).select("position", sampling.rank(sampling.SEED, F.upper("document_id")).alias("rank"))


def _chosen(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.selected(_reasons(spark, sf).filter("reason is null"), sum(sampling.SIZES))


def plan_roundrobin(spark: SparkSession, sf: str) -> DataFrame:
    return _chosen(spark, sf).select("identifier", "stratum", "round")


def plan_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split(_chosen(spark, sf)).select("identifier", "order", "split")


def _pool(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    plan = sampling.split(_chosen(spark, sf)).select(F.col("identifier").alias("document_id"), "order")
    k = F.substring("document_id", 4, 20).cast("long")
    screen = plan.filter(k % 8 != 0).select("document_id", (k % 3 != 0).alias("eligible"), F.when(k % 3 != 0, "strong").otherwise("weak").alias("status"), F.lit("research-article").alias("article_type"))
    return plan, screen


def finalize(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.finalized(*_pool(spark, sf), sizes=(6, 2, 4)).select("document_id", "order", "split", "reason")


def workpack(spark: SparkSession, sf: str) -> DataFrame:
    pool, screen = _pool(spark, sf)
    return sampling.workpack(sampling.finalized(pool, screen, sizes=(6, 2, 4)), screen)


def manifest_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = sampling.split(_chosen(spark, sf)).select(F.col("identifier").alias("document_id"), "split")
    return sampling.manifest_errors(rows)


def plan_commit(spark: SparkSession, sf: str) -> DataFrame:
    """What commits a plan to the candidates that it left out: how many there are, and the root of their tree in order of position."""
    rows = _reasons(spark, sf).filter("reason is not null").select("position", "document_id", "reason")
    tree = commitment.Tree(rows, ["position"])
    return tree.levels[-1].select(F.lit(tree.n).cast("long").alias("n"), F.sha2(F.concat(F.lit(f"{tree.n}:"), "digest"), 256).alias("root"))


def _annotations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return fixture(spark, sf, "annotations_a"), fixture(spark, sf, "annotations_b")


def ann_compare(spark: SparkSession, sf: str) -> DataFrame:
    return comparison.compared(*_annotations(spark, sf))


def ann_by_field(spark: SparkSession, sf: str) -> DataFrame:
    return comparison.compared_by_field(*_annotations(spark, sf))


def ann_adjudicate(spark: SparkSession, sf: str) -> DataFrame:
    return comparison.disagreements(*_annotations(spark, sf))


def _events(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return fixture(spark, sf, "predictions"), fixture(spark, sf, "references_")


def ev_attr_counter(spark: SparkSession, sf: str) -> DataFrame:
    own = [comparison.attribute_counts(df).withColumn("side", F.lit(side)) for df, side in zip(_events(spark, sf), ("predicted", "reference"), strict=True)]
    return own[0].unionByName(own[1]).groupBy("side", "event_type", "attribute").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n"))


def ev_metric(spark: SparkSession, sf: str) -> DataFrame:
    return comparison.evaluated(*_events(spark, sf))


def ev_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return comparison.confusion(*_events(spark, sf))


def _placed(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Documents' counts by place in the order of ids, and how many there are."""
    scratch = staging.Scratch(spark, "bootstrap")
    counts = scratch.stage(comparison.article_counts(*_events(spark, sf)), "counts")
    return staging.numbered(counts, ["document_id"], "place", scratch=scratch).drop("document_id"), counts.count()


def ev_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return comparison.pivoted(comparison.confusion(*_events(spark, sf)), ["A", "N", "R"])


def ev_report(spark: SparkSession, sf: str) -> DataFrame:
    return comparison.report(*_events(spark, sf), ev_interval(spark, sf))


def ev_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """The attributes' F1 over DRAWS resamples of all documents with replacement, drawn by a hash that SQL has too; `ev_interval` has the seeded
    generator's."""
    per, n = _placed(spark, sf)
    rows = comparison.hashed_bootstrap(per, n, iterations=DRAWS)
    return rows.select(F.col("iteration").cast("long").alias("iteration"), "tp", "fp", "fn", "f1")


def ev_interval(spark: SparkSession, sf: str) -> DataFrame:
    """The interval of the attributes' F1 over draws of Python's generator; the places are documents in order of id."""
    per, n = _placed(spark, sf)
    return comparison.interval(comparison.seeded_bootstrap(per, n))


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    return validation.retrieved(fixture(spark, sf, "attempts"))


def _asked(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return fixture(spark, sf, "attempts").select("endpoint", F.col("identifier").alias(name)).distinct()


def val_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    return _responses(spark, sf).select("endpoint", "attempts", "http_status", "response_received", "terminal_error", "waited")


def val_pdb(spark: SparkSession, sf: str) -> DataFrame:
    return validation.validate_pdb(_asked(spark, sf, "pdb_id"), _responses(spark, sf))


def val_uniprot(spark: SparkSession, sf: str) -> DataFrame:
    return validation.validate_uniprot(_asked(spark, sf, "accession"), _responses(spark, sf))


def val_mapping(spark: SparkSession, sf: str) -> DataFrame:
    asked = _asked(spark, sf, "pdb_id").select("endpoint", "pdb_id", F.concat(F.lit("P0"), (F.col("pdb_id").cast("long") % 7).cast("string")).alias("accession"), F.element_at(F.array(F.lit("A"), F.lit("Z"), F.lit("")), (F.col("pdb_id").cast("long") % 3 + 1).cast("int")).alias("chain_id"))
    return validation.validate_mapping(asked, _responses(spark, sf))


def val_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = validation.segments(_responses(spark, sf).filter("http_status = 200"))
    return validation.distinct_segments(rows)


def val_discover(spark: SparkSession, sf: str) -> DataFrame:
    rows = validation.discovered(_asked(spark, sf, "pdb_id"), _responses(spark, sf))
    return rows.select("pdb_id", "state", "n_segments", F.array_join("accessions", "+").alias("accessions"))


def val_cascade(spark: SparkSession, sf: str) -> DataFrame:
    responses, asked = _responses(spark, sf), _asked(spark, sf, "pdb_id")
    named = fixture(spark, sf, "attempts").select((F.col("identifier").cast("long") % 50).cast("string").alias("document_id"), F.lit("starting_pdb_id").alias("field"), F.col("identifier").alias("value"))
    return validation.cascade(named, validation.validate_pdb(asked, responses), validation.discovered(asked, responses))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return val_pdb(spark, sf).unionByName(val_uniprot(spark, sf)).unionByName(val_mapping(spark, sf).drop("n_segments"))


def val_cascade_records(spark: SparkSession, sf: str) -> DataFrame:
    """The accessions and mappings of the cascade, validated. An accession is asked at the endpoint of its digits."""
    at = lambda c: F.concat(F.lit("https://service/"), c)
    return validation.cascade_records(val_cascade(spark, sf), _responses(spark, sf), at(F.substring("accession", 3, 9)), at(F.lower("pdb_id")))


def val_completeness(spark: SparkSession, sf: str) -> DataFrame:
    rows = _records(spark, sf).filter("identifier_type <> 'pdb_uniprot_mapping'").withColumn("document_id", (F.col("query").cast("long") % 50).cast("string"))
    return validation.completeness(rows, "document_id")


def val_summary(spark: SparkSession, sf: str) -> DataFrame:
    return validation.summary(_records(spark, sf))


def record_completeness(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (k % 3).alias("n_facts"), (k % 4).alias("n_segments"), F.when(k % 5 == 0, "verified").otherwise("declared").alias("md_mapping_status"), F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 7 == 1, F.array(F.lit("verified_local"), F.lit("verified_local"))).otherwise(F.array(F.lit("verified_local"), F.lit("declared"))).alias("assets"), F.when(k % 2 == 0, "complete").alias("pdb_status"), F.lit("partial").alias("uniprot_status"), F.lit(None).cast("string").alias("mapping_status"))
    return validation.record_completeness(rows).select("p_partkey", "literature_extraction", "pdb_validation", "uniprot_enrichment", "sifts_mapping", "residue_mapping_scope", "md_file_provenance")


def integ_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Articles, articles with events and with structures, events, distinct phases and structures of the extraction."""
    own = fixture(spark, sf, "paragraphs").select("document_id", events.listed(F.col("text"), "phase", emitted=True).alias("events"), facts.listed(F.col("text"), patterns=False).alias("ids"))
    # one pass: what is counted once each meets in one grouping, a document with its paragraphs' sums
    key = lambda kind, value, *sums: F.struct(F.lit(kind).alias("kind"), value.alias("value"), *(x.cast("long").alias(c) for c, x in zip(("paragraphs", "events", "ids"), sums or (F.lit(0),) * 3, strict=True)))
    each = lambda kind, items: F.transform(F.array_distinct(items), lambda x: key(kind, x))
    keys = F.concat(F.array(key("document", F.col("document_id"), F.lit(1), F.size("events"), F.size("ids"))), each("phase", F.col("events.event_type")), each("structure", F.col("ids.value")))
    rows = own.select(F.explode(keys).alias("k")).groupBy("k.kind", "k.value").agg(*(F.sum(f"k.{c}").alias(c) for c in ("paragraphs", "events", "ids")))
    n = lambda kind, also=F.lit(True): F.count_if((F.col("kind") == kind) & F.col("value").isNotNull() & also)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(
        n("document").alias("n_articles"), total("paragraphs").alias("n_paragraphs"), n("document", F.col("events") > 0).alias("n_with_events"), total("events").alias("n_events"), n("phase").alias("n_phases"),
        n("document", F.col("ids") > 0).alias("n_with_structure"), n("structure").alias("n_structures"),
    )


def sifts_rows(spark: SparkSession, sf: str) -> DataFrame:
    return residues.usable_segments(fixture(spark, sf, "segments"))


def _composed(spark: SparkSession, sf: str) -> DataFrame:
    return residues.composed(fixture(spark, sf, "residue_pairs"), fixture(spark, sf, "segments"))


def residue_compose(spark: SparkSession, sf: str) -> DataFrame:
    rows = _composed(spark, sf)
    return rows.groupBy("pdb_chain", "pdb_number", "status", "uniprot_accession", "uniprot_number").agg(F.count(F.lit(1)).alias("n"), F.sum("n_matching").alias("n_matching"))


def residue_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The entry's residues are the distinct ones of its chains; a chain is ambiguous if a simulation's chain pairs with more than one."""
    pairs = fixture(spark, sf, "residue_pairs")
    several = pairs.groupBy("pdb_chain").agg(F.count_distinct("md_chain").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    return residues.residue_audit(_composed(spark, sf), pairs.agg(F.count_distinct("pdb_chain", "pdb_number").alias("n")), several)


def _atoms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return fixture(spark, sf, "atoms_a"), fixture(spark, sf, "atoms_b")


def atom_audit(spark: SparkSession, sf: str) -> DataFrame:
    return residues.atom_audit(residues.paired_atoms(*_atoms(spark, sf)))


def atom_examples(spark: SparkSession, sf: str) -> DataFrame:
    return residues.mismatch_examples(residues.paired_atoms(*_atoms(spark, sf))).select("scope", "atom_index", "a_norm", "b_norm", "a_resname", "b_resname")


def residue_atoms(spark: SparkSession, sf: str) -> DataFrame:
    return residues.residue_atoms(*_atoms(spark, sf))


def audit_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Atoms, residues, frames and finiteness of both files judged, 8 frames being expected."""
    audit = residues.file_audit(*_atoms(spark, sf), fixture(spark, sf, "frames_a"), fixture(spark, sf, "frames_b"), 8)
    return residues.audit_failures(audit).select(F.array_join("failures", ";").alias("failures"))


def structure_read(spark: SparkSession, sf: str) -> DataFrame:
    """Trajectories as PDB text from every row of lineitem, one file for each group of suppliers and one model for each line number, read back:
    the atoms and residues of each frame, and what its coordinates add up to."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_suppkey") % 10).alias("f"), F.col("l_linenumber").alias("m"), F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), "l_quantity", "l_discount", "l_tax")
    atom = F.concat(F.lit("ATOM  "), F.lpad((F.col("k") % 100000).cast("string"), 5, " "), F.lit("  CA  ALA A"), F.lpad((F.col("p") % 1000).cast("string"), 4, " "), F.lit("    "), *(F.format_string("%8.3f", c) for c in ("l_quantity", "l_discount", "l_tax")))
    lines = rows.select("f", "m", F.lit(1).alias("place"), "k", "p", atom.alias("value")).unionByName(rows.select("f", "m").distinct().select("f", "m", F.lit(0).alias("place"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("p"), F.concat(F.lit("MODEL     "), F.lpad((F.col("m") * 5).cast("string"), 4, " ")).alias("value")))
    scratch = staging.Scratch(spark, "structures")
    lines.repartition("f").sortWithinPartitions("f", "m", "place", "k", "p", "value").select("f", "value").write.partitionBy("f").text(f"{scratch.path}/pdb")
    frames = structures.pdb_frames(spark, f"{scratch.path}/pdb").withColumn("f", F.regexp_extract("file", "/f=([0-9]+)/", 1).cast("long"))
    return frames.groupBy("f", "frame").agg(F.count(F.lit(1)).alias("n_atoms"), F.max("atom_index").alias("last_atom"), F.count_distinct("resid").alias("n_resids"), F.round(F.sum("x"), 3).alias("x"), F.round(F.sum("z"), 3).alias("z"))


def finite_traj(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"), F.when(F.col("l_returnflag") == "A", F.col("l_discount") / 0.0001).otherwise(F.col("l_discount")).alias("z"))
    return residues.finite(rows)


def _chains(spark: SparkSession, sf: str) -> DataFrame:
    """Two sets of chains from the letters of whole benchmark items, four to a structure; the second set lacks the first
    four letters and every 13th of the rest, and every 29th is another one."""
    letters = lambda c: F.translate(F.upper(F.coalesce(c, F.lit(""))), " .,!?\n|", "")
    rows = spark.read.parquet(f"{sf}/benchmark.parquet")
    key = [F.floor(F.col("item_id") / 4).cast("string").alias("structure_id"), F.col("item_id").cast("string").alias("chain_id")]
    edited = F.regexp_replace(F.regexp_replace(F.substring(letters(F.col("text")), 5, 1 << 30), "(.{12}).", "$1"), "(.{28}).", "$1X")
    return residues.aligned(residues.chain_pairs(rows.select(*key, letters(F.col("text")).alias("sequence")), rows.select(*key, edited.alias("sequence"))))


def align_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _chains(spark, sf).select("structure_id", "md_chain", "pdb_chain", "score", "matches", "mismatches", "md_insertions", "pdb_deletions")


def align_assign(spark: SparkSession, sf: str) -> DataFrame:
    return residues.assigned(_chains(spark, sf))


def structure_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The chains of the benchmark's letters mapped from end to end: alignment, assignment, composition with one segment a chain that covers its
    residues from the tenth on, audit and acceptance."""
    scored = _chains(spark, sf)
    letters = lambda side: scored.select("structure_id", F.col(f"{side}_chain").alias("chain_id"), F.col(f"{side}_sequence").alias("s")).distinct()
    at = lambda df: df.select("structure_id", "chain_id", F.posexplode(F.regexp_extract_all("s", F.lit("(?s)."), F.lit(0))).alias("i", "one_letter")).select("structure_id", "chain_id", (F.col("i") + 1).alias("sequence_index"), "one_letter", (F.col("i") + 1).alias("number"))
    n = F.length("s")
    segments = letters("pdb").select("structure_id", "chain_id", F.lit("P00001").alias("uniprot_accession"), F.lit(10).alias("pdb_start"), n.alias("pdb_end"), F.lit(110).alias("uniprot_start"), (n + 100).alias("uniprot_end"))
    return residues.accepted(residues.structure_audits(scored, at(letters("md")), at(letters("pdb")), segments))


def sink_store(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a tenth of the ids; the last write stays."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice")
    writes = rows.withColumn("version", F.lit(1)).unionByName(rows.filter("o_orderkey % 10 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(2).alias("version")))
    return storage.last_writes(writes, "o_orderkey", "version")


def _store(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    own = fixture(spark, sf, "segments").select((F.col("segment_id") % 97).cast("string").alias("document_id"), F.concat(F.lit("1A"), (F.col("segment_id") % 10).cast("string"), F.lit("B")).alias("pdb_id"), "uniprot_accession")
    return own.select("document_id", F.lit("starting_pdb_id").alias("field"), F.upper("pdb_id").alias("value")).filter(F.col("document_id").cast("int") % 2 == 0), own


def store_search(spark: SparkSession, sf: str) -> DataFrame:
    return storage.search(*_store(spark, sf), pdb_id="1a3b", accession="p4")


def store_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The store after two writes: every segment's document, and then those of even number again with other structures. What a search finds, and
    how many rows of each table count."""
    store = storage.Store(spark, f"{staging.Scratch(spark, 'store').path}/store")
    own = fixture(spark, sf, "segments").withColumn("document_id", F.concat(F.lit("D"), (F.col("segment_id") % 97).cast("string")))
    rows = lambda df, shift: {
        "articles": df.select("document_id").distinct().select("document_id", *(F.lit(None).cast("string").alias(c) for c in ("title", "doi", "source_uri", "full_text_sha256")), F.concat(F.lit(f'{{"version":{shift}}}')).alias("record_json")),
        "residue_mappings": df.select("document_id", F.concat(F.lit("1A"), ((F.col("segment_id") + shift) % 10).cast("string"), F.lit("B")).alias("pdb_id"), F.concat("uniprot_accession", F.lit("0000")).alias("uniprot_accession"), "chain_id", "pdb_start", "pdb_end", "uniprot_start", "uniprot_end"),
    }
    store.write(rows(own, 0))
    store.write(rows(own.filter("segment_id % 97 % 2 = 0"), 5))
    view = store.view()
    found = view.search(pdb_id="1a3b").select(F.lit("found").alias("kind"), F.col("document_id").alias("name"), F.lit(1).cast("long").alias("n"))
    held = view.table("residue_mappings").groupBy("pdb_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("mappings").alias("kind"), F.col("pdb_id").alias("name"), "n")
    return found.union(held).union(view.table("articles").groupBy("record_json").agg(F.count(F.lit(1)).alias("n")).select(F.lit("articles").alias("kind"), F.col("record_json").alias("name"), "n"))


def store_count(spark: SparkSession, sf: str) -> DataFrame:
    return _store(spark, sf)[1].agg(F.count_distinct("document_id").alias("n"))


def _xml(spark: SparkSession, sf: str) -> DataFrame:
    """Article XML around the lines of each document, one kind with a DOCTYPE and one not well-formed."""
    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.array_join(F.transform(F.split(safe(F.coalesce("text", F.lit(""))), "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit(" <b>bold</b></p>"))), "")
    k = F.col("doc_id")
    head = F.when(k % 10 == 0, '<!DOCTYPE article SYSTEM "http://nowhere.invalid/a.dtd">').otherwise("")
    tail = F.when(k % 50 == 7, "</wrong>").otherwise("</article>")
    body = F.concat(F.lit("<body><sec><title>Methods</title>"), lines, F.lit("<sec>"), lines, F.lit("</sec></sec></body>"))
    front = F.concat(F.lit('<front><article-id pub-id-type="doi">10.1/'), k, F.lit("</article-id><article-title>Title  "), k, F.lit("</article-title></front>"))
    xml = F.concat(head, F.lit('<article article-type="research-article">'), front, body, tail)
    return spark.read.parquet(f"{sf}/documents.parquet").select(k.cast("string").alias("document_id"), xml.cast("binary").alias("content"))


def xml_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return articles.paragraphs(_xml(spark, sf)).select("document_id", "section", "paragraph_id", "ordinal", F.length("text").alias("n_chars"), F.col("error").isNotNull().alias("failed"))


def xml_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return articles.metadata(_xml(spark, sf)).select("document_id", "title", "doi", "article_type", F.col("error").isNotNull().alias("failed"))


def method_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    rows = articles.method_paragraphs(articles.paragraphs(_xml(spark, sf))).filter("error is null")
    return rows.groupBy("document_id", "section").agg(F.count(F.lit(1)).alias("n"))


def search_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a search from the documents, with and without identifier, year and title."""
    k = F.col("doc_id")
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.when(k % 11 == 0, None).when(k % 7 == 0, F.concat(F.lit("MED"), k)).otherwise(F.concat(F.lit("pmc"), k)).alias("pmcid"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("  A  study of NAMD\tand "), k)).alias("title"),
        F.when(k % 3 == 0, "We used GROMACS and  AmberTools.").alias("abstractText"), F.when(k % 4 == 0, "n.d.").otherwise((2000 + k % 25).cast("string")).alias("pubYear"), F.concat(F.lit("10.1/"), k).alias("doi"), F.lit("cc by").alias("license"),
    )
    return articles.from_search(rows)


def packet_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").alias("k"), F.sha2("text", 256).alias("sha"))
    screen = rows.filter("k % 9 <> 0").select("document_id", F.when(F.col("k") % 4 == 0, F.sha2("document_id", 256)).otherwise(F.col("sha")).alias("full_text_sha256"))
    return articles.packet_errors(rows, screen, rows.filter("k % 10 <> 0").select("document_id", F.col("sha").alias("source_sha256")))


def freeze_articles(spark: SparkSession, sf: str) -> DataFrame:
    """The freeze of all documents' articles, some without screen record or file, changed since, or not well-formed."""
    k = F.col("document_id").cast("long")
    xml = _xml(spark, sf)
    files = xml.select("document_id", F.sha2("content", 256).alias("sha256"))
    screen = files.filter(k % 9 != 0).select("document_id", F.when(k % 4 == 0, F.sha2("document_id", 256)).otherwise(F.col("sha256")).alias("full_text_sha256"))
    plan = files.select("document_id", F.when(k % 3 == 0, "validation").otherwise("development").alias("split"))
    rows = articles.method_paragraphs(articles.paragraphs(xml))
    found = events.extract_events(rows.filter("error is null"))
    return articles.frozen(plan, screen, files.filter(k % 10 != 0), rows, found).select("document_id", "split", "reason", "method_paragraph_count")


def integ_counts(spark: SparkSession, sf: str) -> DataFrame:
    return validation.integration_counts(val_pdb(spark, sf), val_mapping(spark, sf), record_completeness(spark, sf))


def accept_gate(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{sf}/part.parquet").select(
        "p_partkey", (k % 3 != 0).alias("published"), F.when(k % 5 == 0, F.array(F.lit("atom_count_mismatch"))).alias("consistency_failures"), F.when(k % 4 == 0, "review").otherwise("verified").alias("mapping_status"),
        ((k % 40 + 64) / 104.0).alias("pdb_coverage"), ((k % 23 + 64) / 96.0).alias("uniprot_coverage"),
    )
    return residues.acceptance_failures(rows).select("p_partkey", F.array_join("failures", ";").alias("failures"))


def packet(spark: SparkSession, sf: str) -> DataFrame:
    rows = articles.paragraphs(_xml(spark, sf), piecewise=True).filter("error is null").withColumn("selection_reason", F.lit("section_title"))
    plan = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").alias("order"))
    return articles.packet(plan, rows).select("document_id", "order", "paragraph_count")


def _proposals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """One proposal a paragraph: right, or wrong in one of several ways."""
    own = fixture(spark, sf, "paragraphs")
    k, quote = F.col("document_id").cast("long") * 3 + F.col("ordinal"), F.col("quote")
    raw = lambda p: F.regexp_extract(quote, p, 0)
    struct = lambda r, v, u: F.struct(r.alias("raw_text"), v.alias("value"), u.alias("unit"))
    duration, temperature = F.col("duration"), F.col("temperature")
    start = F.instr("text", quote) - 1
    # a column that others use is one of its own, so that its pattern is looked for once
    stated = own.withColumn("quote", F.regexp_extract("text", "[0-9]+ [np]s at [0-9]+ K", 0)).withColumns({"duration": raw("[0-9]+ [np]s"), "temperature": raw("[0-9]+ K")})
    rows = stated.select(
        F.concat_ws("|", "document_id", "paragraph_id").alias("candidate_id"), "document_id", F.when(k % 5 == 1, "p-none").otherwise(F.col("paragraph_id")).alias("paragraph_id"),
        (start + F.when(k % 7 == 1, 1).otherwise(0)).cast("int").alias("start_char"), (start + F.length(quote) + F.when(k % 7 == 1, 1).otherwise(0)).cast("int").alias("end_char"), quote.alias("quote"), F.lit("production").alias("event_type"),
        struct(duration, F.regexp_extract(duration, "[0-9]+", 0).cast("double") + F.when(k % 11 == 1, 1).otherwise(0), F.when(k % 13 == 1, "fs").otherwise(F.regexp_extract(duration, "[np]s", 0))).alias("duration"),
        struct(temperature, F.regexp_extract(temperature, "[0-9]+", 0).cast("double"), F.lit("kelvin")).alias("temperature"),
        F.lit(None).cast("struct<raw_text:string,value:double,unit:string>").alias("pressure"), F.lit(None).cast("struct<raw_text:string,value:double,unit:string>").alias("timestep"),
        F.when(k % 17 == 1, "NVT").alias("ensemble"), F.lit(None).cast("string").alias("restraints"), F.lit(None).cast("struct<raw_text:string,value:int>").alias("replicates"),
    )
    return rows, own


def llm_accept(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.judged(*_proposals(spark, sf)).select("candidate_id", "reject_reason", "duration_ps", "temperature_k")


#: The part of a derived paragraph that states pressure, ensemble, time step and replicates; Spark and DuckDB read it alike.
_CONDITIONS = r"and 1(\.5)? (atm|bar)( in the (NVT|npt) ensemble)?( with a time step of 2 fs| using 0\.002 ps as timestep)?( in three independent replicates| in 4 runs)?"


def llm_quantities(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals of pressure, time step and replicates from every paragraph, right or wrong in one of several ways."""
    own = fixture(spark, sf, "paragraphs")
    k, quote = F.col("document_id").cast("long") * 3 + F.col("ordinal"), F.col("quote")
    raw = lambda p, g: F.nullif(F.regexp_extract(quote, p, g), F.lit(""))
    stated = own.withColumn("quote", F.regexp_extract("text", _CONDITIONS, 0)).withColumns({"pressure": raw("1(\\.5)? (atm|bar)", 0), "step": raw("2 fs|0\\.002 ps", 0), "runs": raw("in (three|4) ", 1)})
    pressure, step, runs = F.col("pressure"), F.col("step"), F.col("runs")
    none = "struct<raw_text:string,value:double,unit:string>"
    rows = stated.select(
        F.concat_ws("|", "document_id", "paragraph_id").alias("candidate_id"), "document_id", "paragraph_id", (F.instr("text", quote) - 1).cast("int").alias("start_char"),
        (F.instr("text", quote) - 1 + F.length(quote)).cast("int").alias("end_char"), quote.alias("quote"), F.lit("production").alias("event_type"),
        F.lit(None).cast(none).alias("duration"), F.lit(None).cast(none).alias("temperature"),
        F.struct(pressure.alias("raw_text"), (F.split_part(pressure, F.lit(" "), F.lit(1)).cast("double") + F.when(k % 5 == 1, 1).otherwise(0)).alias("value"), F.split_part(pressure, F.lit(" "), F.lit(2)).alias("unit")).alias("pressure"),
        F.when(step.isNotNull(), F.struct(step.alias("raw_text"), F.split_part(step, F.lit(" "), F.lit(1)).cast("double").alias("value"), F.when(k % 7 == 1, "ns").otherwise(F.split_part(step, F.lit(" "), F.lit(2))).alias("unit"))).alias("timestep"),
        F.when(k % 13 == 1, "NVE").alias("ensemble"), F.lit(None).cast("string").alias("restraints"),
        F.when(runs.isNotNull(), F.struct(runs.alias("raw_text"), (F.when(runs == "4", 4).otherwise(3) + F.when(k % 11 == 1, 1).otherwise(0)).cast("int").alias("value"))).alias("replicates"),
    )
    return candidates.judged(rows, own).select("candidate_id", "reject_reason", "pressure_bar", "timestep_fs", "replicate_count")


def llm_id_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.accepted(*_proposals(spark, sf)).select("event_id", "candidate_id", "duration_ps")


QUERIES = {f.__name__: f for f in (plan_exclude, plan_rank, plan_roundrobin, plan_split, finalize, workpack, manifest_check, ann_compare, ann_by_field, ann_adjudicate, ev_attr_counter, ev_metric, ev_confusion, ev_bootstrap, ev_interval, val_retrieve, val_pdb, val_uniprot, val_mapping, val_segments, val_discover, val_cascade, val_cascade_records, val_completeness, val_summary, record_completeness, integ_summary, sifts_rows, residue_compose, residue_audit, atom_audit, atom_examples, residue_atoms, audit_gate, finite_traj, align_fit, align_assign, sink_store, store_search, store_count, xml_paragraphs, xml_metadata, method_paragraphs, search_candidates, packet_check, freeze_articles, integ_counts, accept_gate, packet, llm_accept, llm_id_dedup, structure_read, plan_commit, store_versions, structure_audit, ev_pivot, ev_report, llm_quantities)}

_EXCLUDE = """reasoned AS (SELECT *, CASE WHEN ok_before < position THEN 'duplicate_document_id' ELSE own END AS reason FROM (SELECT *, min(CASE WHEN own IS NULL THEN position END) OVER (PARTITION BY identifier) AS ok_before FROM
 (SELECT *, upper(document_id) AS identifier, CASE WHEN upper(document_id) IN (SELECT upper(document_id) FROM exclusions) THEN 'previous_development_article' WHEN NOT full_text_available THEN 'full_text_unavailable' WHEN NOT starts_with(upper(document_id), 'PMC') THEN 'missing_pmc_identifier' WHEN year IS NULL THEN 'missing_publication_year' WHEN year < 2016 THEN 'publication_year_below_window' WHEN year > 2020 THEN 'publication_year_above_window' END AS own FROM candidates) a) b),
strata AS (SELECT *, coalesce(nullif(lower(trim(stratum)), ''), 'unknown') AS st FROM reasoned WHERE reason IS NULL),
rounds AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY sha256('3997|' || identifier), position) AS round FROM strata),
chosen AS (SELECT *, row_number() OVER (ORDER BY sha256('3998|' || identifier), position) AS "order" FROM (SELECT * FROM rounds ORDER BY round, st LIMIT 60) c),
plan AS (SELECT *, CASE WHEN "order" <= 30 THEN 'development' WHEN "order" <= 40 THEN 'validation' ELSE 'locked_test' END AS split FROM chosen),
screen AS (SELECT identifier, k % 3 <> 0 AS eligible FROM (SELECT identifier, CAST(substr(identifier, 4) AS BIGINT) AS k FROM plan) s WHERE k % 8 <> 0),
final AS (SELECT p.identifier AS document_id, "order", s.eligible, CASE WHEN coalesce(s.eligible, false) THEN sum(CASE WHEN coalesce(s.eligible, false) THEN 1 ELSE 0 END) OVER (ORDER BY "order") END AS place FROM plan p LEFT JOIN screen s ON p.identifier = s.identifier),
named AS (SELECT *, CASE WHEN place <= 6 THEN 'development' WHEN place <= 8 THEN 'validation' WHEN place <= 12 THEN 'locked_test' END AS split FROM final)"""


def _plan(select: str, **other: str) -> str:
    return with_fixtures(["candidates", "exclusions"], "", **other).rstrip() + ",\n" + _EXCLUDE + "\n" + select


def _agree(keys: list[str], by: str = "") -> str:
    k = ", ".join(keys)
    group = f"{by}, " if by else ""
    return f"SELECT {group}count(*) FILTER (a = 1 AND b = 1) AS agreed, count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b FROM (SELECT {k}, max(a) AS a, max(b) AS b FROM (SELECT {k}, 1 AS a, 0 AS b FROM annotations_a UNION ALL SELECT {k}, 0 AS a, 1 AS b FROM annotations_b) u GROUP BY {k}) g" + (f" GROUP BY {by}" if by else "")


_AGREEMENT = "CASE WHEN agreed + only_a + only_b = 0 THEN 1.0 ELSE agreed / (agreed + only_a + only_b) END::DOUBLE AS agreement"
_ATTRS = ["CAST(duration_ps AS VARCHAR)", "CAST(temperature_k AS VARCHAR)", "ensemble", "CAST(replicates AS VARCHAR)"]


def _unpivoted(table: str) -> str:
    return " UNION ALL ".join(f"SELECT document_id, event_type, '{n}' AS attribute, {e} AS value FROM {table} WHERE {e} IS NOT NULL" for n, e in zip(("duration_ps", "temperature_k", "ensemble", "replicates"), _ATTRS, strict=True))


def _level(name: str, p: str, r: str, keys: str) -> str:
    side = lambda t, a: f"SELECT {keys}, count(*) AS n, '{a}' AS s FROM ({t}) {a}0 GROUP BY {keys}"
    return f"SELECT '{name}' AS level, CAST(sum(least(p, r)) AS BIGINT) AS tp, CAST(sum(greatest(p - r, 0)) AS BIGINT) AS fp, CAST(sum(greatest(r - p, 0)) AS BIGINT) AS fn FROM (SELECT {keys}, coalesce(sum(n) FILTER (s = 'p'), 0) AS p, coalesce(sum(n) FILTER (s = 'r'), 0) AS r FROM ({side(p, 'p')} UNION ALL {side(r, 'r')}) u GROUP BY {keys}) x"


_DP = "document_id, event_type, duration_ps"
_AV = "document_id, event_type, attribute, value"
_SHARE = lambda a, b: f"CASE WHEN tp + {b} > 0 THEN tp / (tp + {b}) ELSE 0.0 END::DOUBLE AS {a}"
_METRIC = f"SELECT level, tp, fp, fn, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM (SELECT level, tp, fp, fn, {_SHARE('precision', 'fp')}, {_SHARE('recall', 'fn')} FROM levels) m"
_LEVELS = "levels AS (" + " UNION ALL ".join([_level("event", "SELECT * FROM predictions", "SELECT * FROM references_", "document_id, event_type, duration_ps, temperature_k, ensemble, replicates"), _level("attribute", _unpivoted("predictions"), _unpivoted("references_"), "document_id, event_type, attribute, value"), _level("duration_phase", "SELECT * FROM predictions", "SELECT * FROM references_", _DP)]) + ")"
_CONFUSION = f"""counts AS (SELECT {_DP}, count(*) FILTER (s = 'p') AS p, count(*) FILTER (s = 'r') AS r FROM (SELECT {_DP}, 'p' AS s FROM predictions UNION ALL SELECT {_DP}, 'r' AS s FROM references_) u GROUP BY {_DP}),
pl AS (SELECT document_id, duration_ps, event_type, row_number() OVER (PARTITION BY document_id, duration_ps ORDER BY event_type) AS k FROM (SELECT *, unnest(range(0, p - least(p, r))) FROM counts) a),
rl AS (SELECT document_id, duration_ps, event_type, row_number() OVER (PARTITION BY document_id, duration_ps ORDER BY event_type) AS k FROM (SELECT *, unnest(range(0, r - least(p, r))) FROM counts) a)
SELECT reference_phase, predicted_phase, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type AS reference_phase, event_type AS predicted_phase, least(p, r) AS n FROM counts WHERE least(p, r) > 0
 UNION ALL SELECT coalesce(rl.event_type, '__spurious__'), coalesce(pl.event_type, '__missed__'), 1 FROM rl FULL JOIN pl ON rl.document_id = pl.document_id AND rl.duration_ps = pl.duration_ps AND rl.k = pl.k) z GROUP BY 1, 2"""
_TRIES = """seen AS (SELECT *, attempt AS n, (status IS NULL OR status IN (429, 500, 502, 503, 504)) AND attempt <= 2 AS again FROM attempts WHERE attempt <= 3),
stops AS (SELECT endpoint, identifier, min(n) FILTER (NOT again) AS last_n, max(n) AS most FROM seen GROUP BY endpoint, identifier),
answers AS (SELECT s.endpoint, s.identifier, coalesce(last_n, most) AS attempts, e.status AS http_status, e.status IS NOT NULL AS response_received, CASE WHEN e.status IS NULL THEN coalesce(e.error, 'request_failed') END AS terminal_error, e.payload FROM stops s JOIN seen e ON s.endpoint = e.endpoint AND e.n = coalesce(last_n, most)),
waits AS (SELECT e.endpoint, sum(CASE WHEN again THEN CASE WHEN status IS NULL THEN 0.25 * pow(2, n - 1) ELSE least(coalesce(retry_after, 0.25 * pow(2, n - 1)), 5.0) END ELSE 0.0 END)::DOUBLE AS waited FROM seen e JOIN stops s ON e.endpoint = s.endpoint WHERE e.n <= coalesce(last_n, most) GROUP BY e.endpoint),
maps AS (SELECT identifier, endpoint, http_status, unnest(CASE WHEN http_status = 200 AND json_extract(payload, '$."' || identifier || '".UniProt') IS NOT NULL THEN [1, 2] ELSE [] END) AS i FROM answers),
segs AS (SELECT identifier AS pdb_id, 'P0' || CAST(CAST(identifier AS BIGINT) % 7 AS VARCHAR) AS uniprot_accession, CASE i WHEN 1 THEN 'A' ELSE 'B' END AS chain_id, CASE i WHEN 1 THEN 1 END AS pdb_start, CASE i WHEN 1 THEN 9 END AS pdb_end, CASE i WHEN 1 THEN 11 ELSE 3 END AS uniprot_start, CASE i WHEN 1 THEN 19 END AS uniprot_end FROM maps)"""
_PDB = "pdbs AS (SELECT 'pdb' AS identifier_type, identifier AS query, CASE WHEN NOT response_received THEN 'unresolved' WHEN http_status = 404 THEN 'conflict' WHEN http_status <> 200 THEN 'unresolved' WHEN json_extract(payload, '$.\"' || identifier || '\"') IS NOT NULL THEN 'validated' ELSE 'conflict' END AS state, CASE WHEN NOT response_received THEN terminal_error WHEN http_status = 404 THEN 'successful_service_response_identifier_not_found' WHEN http_status <> 200 THEN 'non_success_service_response' WHEN json_extract(payload, '$.\"' || identifier || '\"') IS NOT NULL THEN 'entry_exists' ELSE 'response_does_not_contain_requested_entry' END AS reason, CAST(attempts AS BIGINT) AS attempts FROM answers)"
_UNI = "unis AS (SELECT 'uniprot' AS identifier_type, identifier AS query, CASE WHEN NOT response_received THEN 'unresolved' WHEN http_status = 404 THEN 'conflict' WHEN http_status <> 200 THEN 'unresolved' WHEN json_extract_string(payload, '$.primaryAccession') = identifier THEN 'validated' ELSE 'conflict' END AS state, CASE WHEN NOT response_received THEN terminal_error WHEN http_status = 404 THEN 'successful_service_response_identifier_not_found' WHEN http_status <> 200 THEN 'non_success_service_response' WHEN json_extract_string(payload, '$.primaryAccession') = identifier THEN 'accession_matches' ELSE 'accession_mismatch' END AS reason, CAST(attempts AS BIGINT) AS attempts FROM answers)"
_MAP = "mapped AS (SELECT 'pdb_uniprot_mapping' AS identifier_type, identifier || '|' || 'P0' || CAST(k % 7 AS VARCHAR) || '|' || chain AS query, CASE WHEN NOT ok THEN 'unresolved' WHEN n = 0 OR absent THEN 'conflict' ELSE 'validated' END AS state, CASE WHEN NOT ok THEN coalesce(terminal_error, 'mapping_response_unavailable') WHEN n = 0 THEN 'successful_mapping_response_relation_absent' WHEN absent THEN 'accession_present_but_chain_absent' ELSE 'mapping_supported' END AS reason, CAST(attempts AS BIGINT) AS attempts, CAST(n AS BIGINT) AS n_segments FROM (SELECT *, chain = 'Z' AS absent FROM (SELECT a.*, CAST(identifier AS BIGINT) AS k, ['A', 'Z', ''][CAST(identifier AS BIGINT) % 3 + 1] AS chain, coalesce(response_received AND http_status = 200, false) AS ok, (SELECT count(*) FROM segs s WHERE s.pdb_id = a.identifier) AS n FROM answers a) b) c)"


def _val(select: str) -> str:
    return with_fixtures(["attempts"], "").rstrip() + ",\n" + ",\n".join([_TRIES, _PDB, _UNI, _MAP]) + "\n" + select


_RECORDS = "(SELECT * FROM pdbs UNION ALL SELECT * FROM unis UNION ALL SELECT identifier_type, query, state, reason, attempts FROM mapped)"
_COMPOSED = """joined AS (SELECT p.*, md_letter = pdb_letter AS same, s.chain_id, s.uniprot_accession AS acc, s.pdb_end - s.pdb_start = s.uniprot_end - s.uniprot_start AS valid, s.uniprot_start + pdb_number - s.pdb_start AS num FROM (SELECT *, row_number() OVER () AS rid FROM residue_pairs) p
 LEFT JOIN (SELECT * FROM segments WHERE pdb_start IS NOT NULL AND pdb_end IS NOT NULL AND uniprot_start IS NOT NULL AND uniprot_end IS NOT NULL) s ON md_letter = pdb_letter AND pdb_chain = s.chain_id AND pdb_number BETWEEN s.pdb_start AND s.pdb_end),
composed AS (SELECT rid, pdb_chain, pdb_number, same, count(chain_id) AS n_matching, count(*) FILTER (valid) AS n_valid, min(acc) FILTER (valid) AS acc, min(num) FILTER (valid) AS num FROM joined GROUP BY rid, pdb_chain, pdb_number, same),
status AS (SELECT *, CASE WHEN NOT same THEN 'md_to_pdb_sequence_mismatch' WHEN n_valid = 1 THEN 'verified_md_to_pdb_to_uniprot' WHEN n_valid > 1 THEN 'ambiguous_sifts_segment' WHEN n_matching > 0 THEN 'sifts_segment_length_conflict' ELSE 'no_sifts_mapping_for_pdb_residue' END AS status FROM composed)"""
_LETTER = lambda c: f"CASE {c} WHEN 'ALA' THEN 'A' WHEN 'HSD' THEN 'H' WHEN 'HIS' THEN 'H' WHEN 'GLY' THEN 'G' END"
_NORM = lambda c: f"regexp_replace(CASE regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g') WHEN 'HN' THEN 'H' WHEN 'OT1' THEN 'O' WHEN 'OT2' THEN 'OXT' ELSE regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g') END, '^([0-9]+)(.*)$', '\\2\\1')"
_ATOMS = f"""sides AS (SELECT a.atom_index, trim(a.name) AS an, trim(b.name) AS bn, upper(trim(a.resname)) AS ar, upper(trim(b.resname)) AS br, a.resid AS aid, b.resid AS bid, a.segid AS asg, b.segid AS bsg, a.resindex AS ax, b.resindex AS bx FROM atoms_a a JOIN atoms_b b ON a.atom_index = b.atom_index),
lettered AS (SELECT *, {_LETTER('ar')} AS al, {_LETTER('br')} AS bl, {_NORM('an')} AS am, {_NORM('bn')} AS bm FROM sides),
atoms AS (SELECT *, an = bn AND ar = br AND aid = bid AND asg = bsg AS exact, am = bm AND coalesce(al, ar) = coalesce(bl, br) AND aid = bid AND asg = bsg AS normal, al IS NOT NULL OR bl IS NOT NULL AS protein, al IS NOT DISTINCT FROM bl AS letter FROM lettered),
audit AS (SELECT count(*) AS n_atoms, count(*) FILTER (exact) / count(*) AS exact_fraction, count(*) FILTER (normal) / count(*) AS normalized_fraction, count(*) FILTER (asg = bsg) / count(*) AS segment_fraction, count(*) FILTER (ax = bx) / count(*) AS partition_fraction, count(*) FILTER (protein) AS protein_atoms, count(*) FILTER (protein AND normal AND letter) / greatest(count(*) FILTER (protein), 1) AS protein_identity FROM atoms),
per_residue AS (SELECT count(*) AS n_residues, count(*) FILTER (x.n = y.n) AS n_equal FROM (SELECT resindex, count(*) AS n FROM atoms_a GROUP BY 1) x JOIN (SELECT resindex, count(*) AS n FROM atoms_b GROUP BY 1) y ON x.resindex = y.resindex)"""


def _atom(select: str) -> str:
    return with_fixtures(["atoms_a", "atoms_b"], "").rstrip() + ",\n" + _ATOMS + "\n" + select


def _below(c: str, limit: str, name: str) -> str:
    return f"CASE WHEN {c} < {limit} THEN '{name}:' || printf('%.6f', {c}) END"


ORACLES = {
    "plan_exclude": _plan("SELECT position, document_id, coalesce(reason, 'eligible') AS reason FROM reasoned", candidates="numbered_candidates"),
    "plan_rank": with_fixtures(["candidates"], "SELECT position, sha256('3997|' || upper(document_id)) AS rank FROM candidates", candidates="numbered_candidates"),
    "plan_roundrobin": _plan("SELECT identifier, st AS stratum, round FROM chosen"),
    "plan_split": _plan('SELECT identifier, "order", split FROM plan'),
    "finalize": _plan("""SELECT document_id, "order", split, CASE WHEN split IS NULL THEN CASE WHEN eligible = false THEN 'not_machine_eligible' ELSE 'eligible_reserve_not_selected' END END AS reason FROM named"""),
    "workpack": _plan("""SELECT document_id, split, row_number() OVER (PARTITION BY split ORDER BY "order") AS split_order, 'research-article' AS article_type, 'strong' AS status, false AS missing_screen FROM named WHERE split IS NOT NULL"""),
    "manifest_check": _plan("SELECT count(*) AS n_articles, count(*) = 60 AS size_ok, count(*) FILTER (split = 'development') = 30 AND count(*) FILTER (split = 'validation') = 10 AND count(*) FILTER (split = 'locked_test') = 20 AS splits_ok, count(DISTINCT identifier) = count(*) AS ids_ok FROM plan"),
    "plan_commit": _plan("SELECT (SELECT count(*) FROM out) AS n, sha256((SELECT count(*) FROM out) || ':' || d) AS root FROM t6").replace("\nSELECT (SELECT", """,
out AS (SELECT position, document_id, reason FROM reasoned WHERE reason IS NOT NULL),
t0 AS (SELECT row_number() OVER (ORDER BY position) - 1 AS p, sha256('leaf:{"document_id":"' || document_id || '","position":' || position || ',"reason":"' || reason || '"}') AS d FROM out),
""" + ",\n".join(f"t{k} AS (SELECT p // {commitment.FAN} AS p, CASE WHEN (SELECT count(*) FROM t{k - 1}) > 1 THEN sha256('node:' || string_agg(d, '' ORDER BY p)) ELSE min(d) END AS d FROM t{k - 1} GROUP BY p // {commitment.FAN})" for k in range(1, 7)) + "\nSELECT (SELECT", 1),
    "ann_compare": with_fixtures(["annotations_a", "annotations_b"], f"SELECT *, {_AGREEMENT} FROM (SELECT 'semantic' AS level, * FROM ({_agree(comparison.SEMANTIC)}) s UNION ALL SELECT 'exact' AS level, * FROM ({_agree(comparison.EXACT)}) e) l"),
    "ann_by_field": with_fixtures(["annotations_a", "annotations_b"], f"SELECT *, {_AGREEMENT} FROM ({_agree(comparison.SEMANTIC, 'field_name')}) f"),
    "ann_adjudicate": with_fixtures(["annotations_a", "annotations_b"], " UNION ALL ".join(f"SELECT *, '{s}' AS source, 'pending' AS status FROM (SELECT {', '.join(comparison.EXACT)} FROM annotations_{s} EXCEPT SELECT {', '.join(comparison.EXACT)} FROM annotations_{o}) {s}1" for s, o in ("ab", "ba"))),
    "ev_attr_counter": with_fixtures(["predictions", "references_"], " UNION ALL ".join(f"SELECT '{side}' AS side, event_type, attribute, count(DISTINCT (document_id, value)) AS n_keys, count(*) AS n FROM ({_unpivoted(t)}) {t[0]} GROUP BY 2, 3" for side, t in (("predicted", "predictions"), ("reference", "references_")))),
    "ev_metric": with_fixtures(["predictions", "references_"], "").rstrip() + ",\n" + _LEVELS + "\n" + _METRIC,
    "ev_confusion": with_fixtures(["predictions", "references_"], "").rstrip() + ",\n" + _CONFUSION,
    "ev_pivot": with_fixtures(["predictions", "references_"], "").rstrip() + ",\n" + _CONFUSION.rpartition("\nSELECT")[0] + ",\ncells AS (SELECT" + _CONFUSION.rpartition("\nSELECT")[2] + ") SELECT reference_phase, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (predicted_phase = '{x}'), 0) AS BIGINT) AS \"{x}\"" for x in ("A", "N", "R", comparison.MISSED)) + " FROM cells GROUP BY 1",
    "ev_bootstrap": with_fixtures(["predictions", "references_"], "").rstrip() + f""",
counts AS (SELECT {_AV}, count(*) FILTER (s = 'p') AS p, count(*) FILTER (s = 'r') AS r FROM (SELECT *, 'p' AS s FROM ({_unpivoted('predictions')}) a UNION ALL SELECT *, 'r' AS s FROM ({_unpivoted('references_')}) b) u GROUP BY {_AV}),
per AS (SELECT row_number() OVER (ORDER BY document_id) - 1 AS place, sum(least(p, r)) AS tp, sum(greatest(p - r, 0)) AS fp, sum(greatest(r - p, 0)) AS fn FROM counts GROUP BY document_id),
drawn AS (SELECT i, CAST(('0x' || substr(md5(i || '|' || place), 1, 12)) AS BIGINT) % (SELECT count(*) FROM per) AS place FROM per, range({DRAWS}) AS g(i)),
levels AS (SELECT i AS level, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM drawn JOIN per ON drawn.place = per.place GROUP BY i)
SELECT level AS iteration, tp, fp, fn, f1 FROM ({_METRIC}) y""",
    "val_retrieve": _val("SELECT a.endpoint, CAST(attempts AS BIGINT) AS attempts, http_status, response_received, terminal_error, waited FROM answers a JOIN waits w ON a.endpoint = w.endpoint"),
    "val_pdb": _val("SELECT * FROM pdbs"),
    "val_uniprot": _val("SELECT * FROM unis"),
    "val_mapping": _val("SELECT * FROM mapped"),
    "val_segments": _val("SELECT DISTINCT * FROM segs"),
    "val_discover": _val("SELECT a.identifier AS pdb_id, CASE WHEN NOT coalesce(http_status = 200, false) THEN 'unresolved' WHEN n > 0 THEN 'validated' ELSE 'conflict' END AS state, CAST(n AS BIGINT) AS n_segments, accessions FROM (SELECT *, (SELECT count(*) FROM segs s WHERE s.pdb_id = answers.identifier) AS n, (SELECT string_agg(DISTINCT uniprot_accession, '+' ORDER BY uniprot_accession) FROM segs s WHERE s.pdb_id = answers.identifier) AS accessions FROM answers) a"),
    "val_cascade": _val("SELECT DISTINCT CAST(CAST(query AS BIGINT) % 50 AS VARCHAR) AS document_id, query AS pdb_id, uniprot_accession AS accession FROM pdbs JOIN segs ON query = pdb_id WHERE state = 'validated'"),
    "val_cascade_records": _val("""SELECT DISTINCT document_id, identifier_type, query, state, reason, attempts FROM (
 SELECT document_id, 'uniprot' AS identifier_type, accession AS query, CASE WHEN coalesce(response_received, false) = false THEN 'unresolved' WHEN http_status = 404 THEN 'conflict' WHEN http_status <> 200 THEN 'unresolved' WHEN json_extract_string(payload, '$.primaryAccession') = accession THEN 'validated' ELSE 'conflict' END AS state,
  CASE WHEN coalesce(response_received, false) = false THEN coalesce(terminal_error, 'request_failed') WHEN http_status = 404 THEN 'successful_service_response_identifier_not_found' WHEN http_status <> 200 THEN 'non_success_service_response' WHEN json_extract_string(payload, '$.primaryAccession') = accession THEN 'accession_matches' ELSE 'accession_mismatch' END AS reason, CAST(coalesce(attempts, 0) AS BIGINT) AS attempts
 FROM (SELECT DISTINCT CAST(CAST(query AS BIGINT) % 50 AS VARCHAR) AS document_id, uniprot_accession AS accession FROM pdbs JOIN segs ON query = pdb_id WHERE state = 'validated') l LEFT JOIN answers ON endpoint = 'https://service/' || substr(accession, 3)
 UNION ALL SELECT CAST(CAST(query AS BIGINT) % 50 AS VARCHAR), 'pdb_uniprot_mapping', pdb_id || '|' || uniprot_accession || '|', 'validated', 'mapping_supported', CAST(attempts AS BIGINT) FROM pdbs JOIN segs ON query = pdb_id WHERE state = 'validated') z"""),
    "method_paragraphs": "SELECT CAST(doc_id AS VARCHAR) AS document_id, 'Methods' AS section, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n FROM documents WHERE doc_id % 50 <> 7",
    "search_candidates": """SELECT upper(pmcid) AS document_id, title, 'https://europepmc.org/articles/' || upper(pmcid) AS source_uri, doi, year, CASE WHEN k % 3 = 0 THEN 'gromacs+amber' ELSE '' END || CASE WHEN k % 5 = 0 THEN CASE WHEN k % 3 = 0 THEN '' ELSE 'unknown' END WHEN k % 3 = 0 THEN '+namd' ELSE 'namd' END AS software_family, 'cc by' AS licence, true AS full_text_available
 FROM (SELECT doc_id AS k, 'pmc' || doc_id AS pmcid, CASE WHEN doc_id % 5 = 0 THEN 'PMC' || doc_id ELSE 'A study of NAMD and ' || doc_id END AS title, '10.1/' || doc_id AS doi, CASE WHEN doc_id % 4 <> 0 THEN CAST(2000 + doc_id % 25 AS INTEGER) END AS year FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0) d""",
    "packet_check": "SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id % 9 = 0 THEN 'missing_screen_record' WHEN doc_id % 10 = 0 OR text IS NULL THEN 'missing_source' ELSE 'source_hash_mismatch' END AS problem FROM documents WHERE doc_id % 9 = 0 OR doc_id % 10 = 0 OR doc_id % 4 = 0 OR text IS NULL",
    "accept_gate": "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'project_not_published' END, CASE WHEN p_partkey % 5 = 0 THEN 'atom_count_mismatch' END, CASE WHEN p_partkey % 4 = 0 THEN 'residue_mapping_not_verified:review' END, " + _below("pc", "0.95", "pdb_mapping_coverage_below_0.95") + ", " + _below("uc", "0.90", "uniprot_mapping_coverage_below_0.90") + "], lambda x: x IS NOT NULL), ';') AS failures FROM (SELECT p_partkey, (p_partkey % 40 + 64) / 104.0 AS pc, (p_partkey % 23 + 64) / 96.0 AS uc FROM part) q",
    "val_completeness": _val("SELECT CAST(CAST(query AS BIGINT) % 50 AS VARCHAR) AS document_id, count(*) AS n, CASE WHEN count(*) FILTER (state = 'validated') = count(*) THEN 'complete' WHEN count(*) FILTER (state = 'validated') > 0 THEN 'partial' WHEN count(*) FILTER (state = 'unresolved') > 0 THEN 'unresolved' ELSE 'conflict' END AS status FROM (SELECT * FROM pdbs UNION ALL SELECT * FROM unis) u GROUP BY 1"),
    "val_summary": _val(f"SELECT 'total' AS kind, 'record_count' AS name, count(*) AS n FROM {_RECORDS} a UNION ALL SELECT 'total', 'total_network_attempts', CAST(sum(attempts) AS BIGINT) FROM {_RECORDS} b UNION ALL SELECT 'total', 'unresolved_or_conflict_count', count(*) FROM {_RECORDS} c WHERE state <> 'validated' UNION ALL " + " UNION ALL ".join(f"SELECT '{k}', {k}, count(*) FROM {_RECORDS} x{i} GROUP BY {k}" for i, k in enumerate(("state", "identifier_type", "reason")))),
    "record_completeness": "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'complete' ELSE 'no_supported_fact' END AS literature_extraction, CASE WHEN p_partkey % 2 = 0 THEN 'complete' ELSE 'not_applicable' END AS pdb_validation, 'partial' AS uniprot_enrichment, 'not_applicable' AS sifts_mapping, CASE WHEN p_partkey % 4 = 0 THEN 'not_computable' WHEN p_partkey % 5 = 0 THEN 'md_to_pdb_to_uniprot_verified' ELSE 'pdb_to_uniprot_only' END AS residue_mapping_scope, CASE p_partkey % 7 WHEN 0 THEN 'not_provided' WHEN 1 THEN 'verified' ELSE 'declared_not_fully_verified' END AS md_file_provenance FROM part",
    "integ_summary": _EXTRACTION["extract_events"].rpartition("\n")[0] + ",\n" + _FACTS + "\nSELECT (SELECT count(DISTINCT document_id) FROM paragraphs) AS n_articles, (SELECT count(*) FROM paragraphs) AS n_paragraphs, count(DISTINCT document_id) AS n_with_events, count(*) AS n_events, count(DISTINCT event_type) AS n_phases, (SELECT count(DISTINCT document_id) FROM pdb) AS n_with_structure, (SELECT count(DISTINCT value) FROM pdb) AS n_structures FROM found",
    "llm_accept": with_fixtures(["paragraphs"], """SELECT candidate_id, reject_reason, CASE WHEN reject_reason IS NULL THEN CAST(regexp_extract(q, '([0-9]+) ([np])s', 1) AS DOUBLE) * CASE regexp_extract(q, '([0-9]+) ([np])s', 2) WHEN 'n' THEN 1000.0 ELSE 1.0 END END AS duration_ps, CASE WHEN reject_reason IS NULL THEN CAST(regexp_extract(q, '([0-9]+) K', 1) AS DOUBLE) END AS temperature_k
FROM (SELECT document_id || '|' || paragraph_id AS candidate_id, q, CASE WHEN k % 5 = 1 THEN 'unknown paragraph_id' WHEN k % 7 = 1 AND instr(text, q) + length(q) > length(text) THEN 'evidence range exceeds paragraph length' WHEN k % 7 = 1 THEN 'evidence quote does not match source offsets' WHEN k % 17 = 1 THEN 'ensemble text is not present in the evidence quote' WHEN k % 11 = 1 THEN 'quantity value disagrees with raw_text' WHEN k % 13 = 1 THEN 'quantity unit disagrees with raw_text' END AS reject_reason
 FROM (SELECT *, CAST(document_id AS BIGINT) * 3 + ordinal AS k, regexp_extract(text, '[0-9]+ [np]s at [0-9]+ K') AS q FROM paragraphs) a) b"""),
    "llm_quantities": with_fixtures(["paragraphs"], f"""SELECT candidate_id, reject_reason, CASE WHEN reject_reason IS NULL THEN CASE WHEN u = 'atm' THEN v * 1.01325 ELSE v END END AS pressure_bar, CASE WHEN reject_reason IS NULL AND step <> '' THEN CAST(2.0 AS DOUBLE) END AS timestep_fs, CASE WHEN reject_reason IS NULL THEN CASE runs WHEN 'three' THEN 3 WHEN '4' THEN 4 END END AS replicate_count
FROM (SELECT *, CASE WHEN k % 13 = 1 THEN 'ensemble text is not present in the evidence quote' WHEN k % 5 = 1 THEN 'quantity value disagrees with raw_text' WHEN step <> '' AND k % 7 = 1 THEN 'quantity unit disagrees with raw_text' WHEN runs <> '' AND k % 11 = 1 THEN 'replicate value disagrees with raw_text' END AS reject_reason
 FROM (SELECT document_id || '|' || paragraph_id AS candidate_id, CAST(document_id AS BIGINT) * 3 + ordinal AS k, CAST(regexp_extract(q, '1(\\.5)?') AS DOUBLE) AS v, regexp_extract(q, 'atm|bar') AS u, regexp_extract(q, '2 fs|0\\.002 ps') AS step, regexp_extract(q, 'in (three|4) ', 1) AS runs FROM (SELECT *, regexp_extract(text, '{_CONDITIONS}') AS q FROM paragraphs) a) b) c"""),
    "sifts_rows": with_fixtures(["segments"], "SELECT * FROM segments WHERE pdb_start IS NOT NULL AND pdb_end IS NOT NULL AND uniprot_start IS NOT NULL AND uniprot_end IS NOT NULL"),
    "residue_compose": with_fixtures(["residue_pairs", "segments"], "").rstrip() + ",\n" + _COMPOSED + "\nSELECT pdb_chain, pdb_number, status, CASE WHEN n_valid = 1 THEN acc END AS uniprot_accession, CASE WHEN n_valid = 1 THEN num END AS uniprot_number, count(*) AS n, CAST(sum(n_matching) AS BIGINT) AS n_matching FROM status GROUP BY 1, 2, 3, 4, 5",
    "residue_audit": with_fixtures(["residue_pairs", "segments"], "").rstrip() + ",\n" + _COMPOSED + "\nSELECT q.*, pdb_residues, ambiguous_chains, mapped_md_to_pdb / greatest(pdb_residues, 1) AS pdb_coverage, mapped_to_uniprot / greatest(pdb_residues, 1) AS uniprot_coverage, CASE WHEN mapped_to_uniprot > 0 AND sequence_mismatches = 0 THEN 'verified' WHEN mapped_to_uniprot > 0 THEN 'review' ELSE 'failed' END AS status FROM (SELECT count(*) AS mapped_md_to_pdb, count(*) FILTER (status = 'verified_md_to_pdb_to_uniprot') AS mapped_to_uniprot, count(*) FILTER (NOT same) AS sequence_mismatches FROM status) q, (SELECT count(DISTINCT (pdb_chain, pdb_number)) AS pdb_residues FROM residue_pairs) e, (SELECT count(*) FILTER (n > 1) AS ambiguous_chains FROM (SELECT count(DISTINCT md_chain) AS n FROM residue_pairs GROUP BY pdb_chain) f) g",
    "atom_audit": _atom("SELECT * FROM audit"),
    "atom_examples": _atom("SELECT * FROM (SELECT 'protein' AS scope, atom_index, am AS a_norm, bm AS b_norm, ar AS a_resname, br AS b_resname FROM atoms WHERE protein AND NOT (normal AND letter) ORDER BY atom_index LIMIT 30) p UNION ALL SELECT * FROM (SELECT 'other', atom_index, am, bm, ar, br FROM atoms WHERE NOT protein AND NOT normal ORDER BY atom_index LIMIT 30) o"),
    "residue_atoms": _atom("SELECT * FROM per_residue"),
    "audit_gate": _atom("SELECT array_to_string(list_filter([CASE WHEN len(list_distinct(counts)) > 1 THEN 'atom_count_mismatch:[' || array_to_string(counts, ', ') || ']' END, CASE WHEN ra <> rb THEN 'residue_count_mismatch:psf=' || ra || ',pdb=' || rb END, " + ", ".join([_below("segment_fraction", "1.0", "segment_by_atom_fraction_below_1"), _below("partition_fraction", "1.0", "residue_partition_fraction_below_1"), _below("(n_equal / n_residues)", "1.0", "per_residue_atom_count_fraction_below_1"), _below("protein_identity", "0.999", "protein_atom_identity_fraction_below_0.999")]) + """,
  CASE WHEN fa <> 8 OR fb <> 8 THEN 'trajectory_frame_count:expected=8,pdb=' || fb || ',psf=' || fa END, CASE WHEN NOT (ga AND gb) THEN 'trajectory_contains_non_finite_coordinates:pdb=' || CASE WHEN gb THEN 'True' ELSE 'False' END || ',psf=' || CASE WHEN ga THEN 'True' ELSE 'False' END END], lambda x: x IS NOT NULL), ';') AS failures FROM audit, per_residue,
  (SELECT [(SELECT count(*) FROM atoms_a), (SELECT count(*) FROM atoms_b), max(b), max(a)] AS counts, (SELECT count(DISTINCT resindex) FROM atoms_a) AS ra, (SELECT count(DISTINCT resindex) FROM atoms_b) AS rb, max(fa) AS fa, max(fb) AS fb, bool_and(ga) AS ga, bool_and(gb) AS gb
   FROM (SELECT max(l_partkey) AS a, max(l_linenumber) AS fa, bool_and(isfinite(l_quantity) AND isfinite(l_tax) AND isfinite(l_discount)) AS ga FROM lineitem) x, (SELECT max(l_partkey) AS b, max(l_linenumber) AS fb, bool_and(l_partkey % 97 <> 0) AS gb FROM lineitem WHERE l_linenumber < 7) y) files"""),
    "finite_traj": "SELECT bool_and(isfinite(l_quantity) AND isfinite(l_tax) AND isfinite(l_discount)) AS finite FROM lineitem",
    "structure_read": """SELECT f, frame, count(*) AS n_atoms, count(*) AS last_atom, count(DISTINCT p % 1000) AS n_resids, round(sum(round(q, 3)), 3) AS x, round(sum(round(t, 3)), 3) AS z
 FROM (SELECT l_suppkey % 10 AS f, dense_rank() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_linenumber) AS frame, l_partkey AS p, l_quantity AS q, l_tax AS t FROM lineitem) r GROUP BY 1, 2""",
    "sink_store": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS version FROM orders",
    "store_search": with_fixtures(["segments"], "SELECT DISTINCT CAST(segment_id % 97 AS VARCHAR) AS document_id FROM segments WHERE segment_id % 10 = 3 OR uniprot_accession = 'P4'"),
    "store_versions": with_fixtures(["segments"], "").rstrip() + """,
own AS (SELECT 'D' || segment_id % 97 AS d, '1A' || (segment_id + CASE WHEN segment_id % 97 % 2 = 0 THEN 5 ELSE 0 END) % 10 || 'B' AS p FROM segments)
SELECT DISTINCT 'found' AS kind, d AS name, 1 AS n FROM own WHERE p = '1A3B' UNION ALL SELECT 'mappings', p, count(*) FROM own GROUP BY 2
UNION ALL SELECT 'articles', '{"version":' || CASE WHEN CAST(substr(d, 2) AS INT) % 2 = 0 THEN 5 ELSE 0 END || '}', count(DISTINCT d) FROM own GROUP BY 2""",
    "store_count": with_fixtures(["segments"], "SELECT count(DISTINCT segment_id % 97) AS n FROM segments"),
}
ORACLES["integ_counts"] = _val(f"SELECT 'pdb_state' AS kind, state AS name, count(*) AS n FROM pdbs GROUP BY 2 UNION ALL SELECT 'mapping_state', state, count(*) FROM mapped GROUP BY 2 UNION ALL SELECT 'md_file_provenance', md_file_provenance, count(*) FROM ({ORACLES['record_completeness']}) c GROUP BY 2")
ORACLES["freeze_articles"] = """SELECT document_id, split, reason, CASE WHEN reason IS NULL THEN n END AS method_paragraph_count FROM (SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'validation' ELSE 'development' END AS split,
 CASE WHEN doc_id % 9 = 0 THEN 'missing_screen_record' WHEN doc_id % 10 = 0 THEN 'missing_source' WHEN doc_id % 4 = 0 THEN 'source_hash_mismatch' WHEN doc_id % 50 = 7 THEN 'not_well_formed' END AS reason, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n FROM documents) d"""
