"""Secret scans with a ledger of blobs.

Every row of the source is a version of a path. A version's text is addressed by its SHA-256; the ledger holds, for
each blob and version of the rules, what was found. A scan reads the ledger, scans one copy of each blob that it
doesn't hold for these rules, appends the findings, and joins them back to all paths with that blob. So a second scan
of the same texts scans nothing, a new version of the rules scans each blob once, and copies cost one scan. Two scans
at once, or one that is run again after a failure, may append a blob's row twice; reading takes one of them.

A very long text is whole in a task. Null texts are empty; repeated rows get the same findings each; a null path is a path; other columns are ignored;
an empty table gives no rows and adds nothing to the ledger.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common

RULES_VERSION = "1"
#: The rules. Kind, pattern, and the least length of the group that must have it.
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
KEYWORDS = ("passw", "secret", "token", "api")
FINDINGS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rules string, findings {FINDINGS}"
BATCH_ROWS = 256


def findings(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of each match, by start and then by kind as listed. Patterns take whole runs, so a run that is
    too short fails as a whole."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def scanned(blobs: DataFrame, rules: str) -> DataFrame:
    """Rows of LEDGER for blobs with the columns blob and text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                rows = batch.slice(at, BATCH_ROWS)
                found = [[{"kind": k, "start": a, "end": b} for k, a, b in findings(t)] for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([rules] * len(found)), pa.array(found, kind)], names=["blob", "rules", "findings"])

    return blobs.select("blob", "text").mapInArrow(scan, LEDGER)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def written(docs: DataFrame, ledger: str, *, rules: str = RULES_VERSION) -> DataFrame:
    """Scans what the ledger doesn't hold and appends it; doc_id and blob of every row, staged."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "secret-scan")
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(ledger)
    known = spark.read.schema(LEDGER).parquet(ledger) if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) else empty_ledger(spark)
    paths = scratch.stage(own.select("doc_id", "blob"), "paths")
    # the path that stands for an unseen blob; a blob of any number of copies passes through partial sums
    unseen = paths.groupBy("blob").agg(F.min("doc_id").alias("_id")).join(known.filter(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    unseen = scratch.stage(unseen.withColumnRenamed("blob", "_blob"), "unseen")
    # by path and blob, so copies lie apart; repeated rows of one path are told apart by nothing and one is taken
    texts = own.join(unseen, own["doc_id"].eqNullSafe(F.col("_id")) & (own["blob"] == F.col("_blob"))).select("blob", "text")
    scanned(texts, rules).dropDuplicates(["blob", "rules"]).write.option("compression", "zstd").mode("append").parquet(ledger)
    return paths


def scan(docs: DataFrame, ledger: str, *, rules: str = RULES_VERSION) -> DataFrame:
    """doc_id, blob and findings of every row; the ledger is a folder of Parquet that this call appends to."""
    paths = written(docs, ledger, rules=rules)
    # rows of one blob and rules are equal, whoever wrote them
    held = docs.sparkSession.read.schema(LEDGER).parquet(ledger).filter(F.col("rules") == rules).select("blob", "findings").dropDuplicates(["blob"])
    return paths.join(held, "blob", "left").select("doc_id", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first scan puts the documents of even ids on the ledger; the second, of all, scans what is new."""
    docs, ledger = common.table(spark, sf_dir, "documents"), f"{common.Scratch(spark, 'secret-ledger').path}/ledger"
    written(docs.filter(F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))), ledger)
    rows = scan(docs, ledger)
    spans = F.array_join(F.transform("findings", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long")
    rows = rows.select("doc_id", *(number(k).alias(f"n_{k}") for k in KINDS), spans.alias("spans"), "blob")
    return rows.withColumn("base_sha256", F.sha2("spans", 256)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob")
