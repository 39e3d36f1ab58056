"""Article XML: paragraphs, sections and metadata, with an error column in place of exceptions."""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.matching import found
from siltstone.operators.facts import TITLE_TERMS
from siltstone.operators.screening import METHOD_TITLE, screened, software_family

#: Fixed value: where an article is read.
ARTICLE_URL = "https://europepmc.org/articles/"

PARAGRAPHS = "document_id string, section_index int, section string, paragraph_id string, text string, ordinal int, error string"
FULL_TEXTS = "document_id string, text string, title string, article_type string, section_titles array<string>, full_text_sha256 string, xml_size_bytes long, error_type string, message string"
METADATA = "document_id string, title string, doi string, article_type string, full_text_sha256 string, error string"


def joined_text(node: ET.Element | None) -> str:
    """All text of a node with white space collapsed."""
    return "" if node is None else " ".join("".join(node.itertext()).split())


def piecewise_text(node: ET.Element | None) -> str:
    """The stripped pieces of text joined by spaces: other offsets than joined_text's."""
    return "" if node is None else " ".join(x.strip() for x in node.itertext() if x.strip())


def sections_of(root: ET.Element, text) -> Iterator[tuple[int, str, str, str]]:
    """Section number and title, paragraph id and text; sections in order, nested ones too, with their own paragraphs."""
    for k, section in enumerate(root.iterfind(".//body//sec"), start=1):
        title = text(section.find("title")) or f"section-{k}"
        for n, paragraph in enumerate(section.findall("p"), start=1):
            if own := text(paragraph):
                yield k, title, paragraph.get("id") or f"sec-{k}-p-{n}", own


def parsed(xml: bytes | None) -> tuple[ET.Element | None, str | None]:
    try:
        return ET.fromstring(bytes(xml or b"")), None
    except ET.ParseError as e:
        return None, f"not well-formed: {e}"


def paragraphs(articles: DataFrame, *, piecewise: bool = False) -> DataFrame:
    """Rows of PARAGRAPHS from document_id and content (bytes); a repeated (id, text) of a document counts once.

    An article that can't be parsed gives one row with its error.
    """
    text = piecewise_text if piecewise else joined_text

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, xml in zip(batch["document_id"], batch["content"], strict=True):
                root, error = parsed(xml)
                if error:
                    rows.append((name, None, None, None, None, None, error))
                    continue
                seen = set()
                for k, title, paragraph, own in sections_of(root, text):
                    if (paragraph, own) not in seen:
                        seen.add((paragraph, own))
                        rows.append((name, k, title, paragraph, own, len(seen), None))
            out = pd.DataFrame(rows, columns=["document_id", "section_index", "section", "paragraph_id", "text", "ordinal", "error"])
            yield out.astype({"section_index": "Int32", "ordinal": "Int32"})

    return articles.select("document_id", "content").mapInPandas(read, PARAGRAPHS)


def method_paragraphs(rows: DataFrame) -> DataFrame:
    """Paragraphs of sections whose own title names methods; unreadable articles keep their row with the error."""
    title = F.lower("section")
    named = F.lit(False)
    for term in TITLE_TERMS:
        named = named | title.contains(term)
    return rows.filter(F.coalesce(named, F.lit(False)) | F.col("error").isNotNull())


def from_search(rows: DataFrame) -> DataFrame:
    """Candidate articles from rows of a paged search: pmcid, title, abstractText, pubYear, doi, license. Rows without an
    identifier that begins with PMC are left out."""
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", " "))
    own = rows.withColumn("document_id", F.upper(F.coalesce("pmcid", F.lit("")))).filter(F.col("document_id").startswith("PMC"))
    title = plain(F.coalesce(F.nullif("title", F.lit("")), F.col("document_id")))
    return own.select(
        "document_id", title.alias("title"), F.concat(F.lit(ARTICLE_URL), "document_id").alias("source_uri"), "doi",
        F.when(F.col("pubYear").rlike("^[0-9]+$"), F.col("pubYear").try_cast("int")).alias("year"),
        software_family(F.concat(title, F.lit(" "), plain(F.col("abstractText")))).alias("software_family"), F.col("license").alias("licence"), F.lit(True).alias("full_text_available"),
    )


def full_texts(articles: DataFrame) -> DataFrame:
    """Rows of FULL_TEXTS: the body's text, the titles of its sections, and what an article failed for, if it did.

    An article without content failed to be fetched; one that can't be parsed, to be read. Either is a row and stops nothing.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, xml in zip(batch["document_id"], batch["content"], strict=True):
                if xml is None:
                    rows.append((name, None, None, None, None, None, None, "missing_source", "no content"))
                    continue
                root, error = parsed(xml)
                digest, size = hashlib.sha256(bytes(xml)).hexdigest(), len(xml)
                if error:
                    rows.append((name, None, None, None, None, digest, size, "not_well_formed", error))
                    continue
                titles = [t for s in root.iterfind(".//body//sec") if (t := joined_text(s.find("title")))]
                rows.append((name, joined_text(root.find(".//body")), joined_text(root.find(".//article-title")), root.get("article-type"), titles, digest, size, None, None))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in FULL_TEXTS.split(", ")])
            yield out.astype({"xml_size_bytes": "Int64"})

    return articles.select("document_id", "content").mapInPandas(read, FULL_TEXTS)


def screened_plan(plan: DataFrame, articles: DataFrame) -> DataFrame:
    """Every planned article with its split and what the screen says, or with error_type and message in place of it.

    plan: document_id, split; articles: document_id, content, one row an article. A planned article without a row failed too.
    """
    rows = plan.select("document_id", "split").join(articles.select("document_id", "content"), "document_id", "left")
    own = screened(full_texts(rows))
    titles = F.filter("section_titles", lambda t: found(t, METHOD_TITLE))
    failed = F.col("error_type").isNotNull()
    judged = lambda c: F.when(~failed, F.col(c)).alias(c)
    own = own.select("document_id", "title", "article_type", "full_text_sha256", "xml_size_bytes", *(judged(c) for c in own.columns if c.startswith(("hits_", "domain_"))), judged("engine_mentions"), judged("status"), judged("eligible"), titles.alias("method_section_titles"), "error_type", "message")
    return plan.select("document_id", "split").join(own, "document_id")


def screen_report(rows: DataFrame) -> DataFrame:
    """One row over screened_plan: how many were asked, screened and failed, how many are eligible, and the histograms of
    status and of engines as maps; both have as many keys as there are patterns."""
    failed = F.col("error_type").isNotNull()
    out = rows.agg(F.count(F.lit(1)).alias("requested_articles"), F.count_if(~failed).alias("screened_articles"), F.count_if(failed).alias("failure_count"), F.count_if("eligible").alias("machine_eligible_count"))
    histogram = lambda df, c, name: df.groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))
    engines = rows.filter(~failed).select(F.explode("engine_mentions").alias("engine"))
    return out.crossJoin(histogram(rows.filter(~failed), "status", "status_counts")).crossJoin(histogram(engines, "engine", "engine_mention_counts"))  # one row each


def packet_errors(plan: DataFrame, screen: DataFrame, files: DataFrame) -> DataFrame:
    """document_id and problem of each planned article that has no screen record or whose file isn't the one screened.
    screen: document_id, full_text_sha256; files: document_id, source_sha256."""
    rows = plan.select("document_id").join(screen.select("document_id", "full_text_sha256", F.lit(True).alias("_seen")), "document_id", "left").join(files.select("document_id", "source_sha256"), "document_id", "left")
    problem = F.when(F.col("_seen").isNull(), "missing_screen_record").when(F.col("source_sha256").isNull(), "missing_source").when(~F.coalesce(F.col("source_sha256") == F.col("full_text_sha256"), F.lit(False)), "source_hash_mismatch")
    return rows.select("document_id", problem.alias("problem")).filter("problem is not null")


def frozen(plan: DataFrame, screen: DataFrame, files: DataFrame, rows: DataFrame, events: DataFrame) -> DataFrame:
    """Every planned article with its split, the reason it can't be frozen or null, and its method paragraphs and events.

    plan: document_id, split; screen: document_id, full_text_sha256; files: document_id, sha256; rows: method paragraphs
    with error; events: document_id. The reasons are checked in order; an article with one has no counts.
    """
    seen = screen.select("document_id", "full_text_sha256", F.lit(True).alias("_seen"))
    read = rows.groupBy("document_id").agg(F.count_if(F.col("error").isNull()).alias("_paragraphs"), F.max("error").alias("_error"))
    found = events.groupBy("document_id").agg(F.count(F.lit(1)).alias("_events"))
    own = plan.select("document_id", "split")
    for side in (seen, files.select("document_id", F.col("sha256").alias("_sha")), read, found):
        own = own.join(side, "document_id", "left")
    same = F.coalesce(F.col("_sha") == F.col("full_text_sha256"), F.lit(False))
    reason = F.when(F.col("_seen").isNull(), "missing_screen_record").when(F.col("_sha").isNull(), "missing_source").when(~same, "source_hash_mismatch").when(F.col("_error").isNotNull(), "not_well_formed")
    count = lambda c: F.when(reason.isNull(), F.coalesce(c, F.lit(0)))
    return own.select("document_id", "split", reason.alias("reason"), count("_paragraphs").alias("method_paragraph_count"), count("_events").alias("event_count"))


def metadata(articles: DataFrame) -> DataFrame:
    """Rows of METADATA; the hash is over the whole file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, xml in zip(batch["document_id"], batch["content"], strict=True):
                root, error = parsed(xml)
                digest = hashlib.sha256(bytes(xml or b"")).hexdigest()
                if error:
                    rows.append((name, None, None, None, digest, error))
                else:
                    doi = joined_text(root.find(".//article-id[@pub-id-type='doi']")) or None
                    rows.append((name, joined_text(root.find(".//article-title")), doi, root.get("article-type"), digest, None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in METADATA.split(", ")])

    return articles.select("document_id", "content").mapInPandas(read, METADATA)


def packet(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each selected document: its sections in order as an array of paragraphs, and how many. plan: document_id,
    order; rows: selected paragraphs with selection_reason."""
    item = F.struct("ordinal", "paragraph_id", "section", "text", F.sha2("text", 256).alias("text_sha256"), F.length("text").alias("character_count"), "selection_reason")
    own = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("paragraphs"))
    return plan.join(own, "document_id", "left").select("document_id", "order", "paragraphs", F.coalesce(F.size("paragraphs"), F.lit(0)).alias("paragraph_count"))
