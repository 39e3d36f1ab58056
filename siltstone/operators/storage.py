"""The record store: five tables in a folder, last write wins, search by identifiers, and record lookup.

The store is a log. A write adds a segment, which holds the new rows and the ids it replaces, filed by BUCKETS of the ids' hash; an
id's rows are those of the last segment that names it. So writing one record writes one bucket and reads none, and reading
a record opens its bucket of each segment. A segment also files the documents of each structure and accession by the
hash of those, which a search opens instead of the tables.

The segments that count, and the order of writes, are a snapshot: a numbered file that a rename puts in place at the end of a
write. Readers keep the snapshot they opened; a failed write leaves nothing that a reader would find. `compact` makes one
segment of all, and `clean` deletes segments that the last snapshots don't name.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = {
    "articles": "document_id string, title string, doi string, source_uri string, full_text_sha256 string, record_json string",
    "literature_facts": "document_id string, field string, value string, paragraph_id string, start_char int, end_char int, quote string",
    "validations": "document_id string, identifier_type string, query string, state string, reason string, attempts long",
    "residue_mappings": "document_id string, pdb_id string, uniprot_accession string, chain_id string, pdb_start int, pdb_end int, uniprot_start int, uniprot_end int",
    "md_assets": "document_id string, role string, identifier string, availability string, source_uri string, sha256 string",
}
SNAPSHOT, BUCKETS = "snapshot", 64
#: The ids that a segment replaces, and its index; both are filed like the tables.
IDS, INDEX = "document_id string", "kind string, value string, document_id string"


class NotFound(LookupError):
    """No record has this id."""


def last_writes(records: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return records.withColumn("_n", newest).filter("_n = 1").drop("_n")


def search(facts: DataFrame, mappings: DataFrame, *, pdb_id: str | None = None, accession: str | None = None) -> DataFrame:
    """document_ids with the structure (as a fact or in a mapping) or the accession, sorted."""
    found = None
    parts = []
    if pdb_id:
        parts.append(facts.filter((F.col("field") == "starting_pdb_id") & (F.col("value") == pdb_id.upper())).select("document_id"))
        parts.append(mappings.filter(F.col("pdb_id") == pdb_id.upper()).select("document_id"))
    if accession:
        parts.append(mappings.filter(F.col("uniprot_accession") == accession.upper()).select("document_id"))
    if not parts:
        raise ValueError("a search needs a structure or an accession")
    for part in parts:
        found = part if found is None else found.union(part)
    return found.distinct().orderBy("document_id")


def bucket_of(value: Column) -> Column:
    """Where an id, or an indexed value, is filed."""
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


def index_entries(facts: DataFrame, mappings: DataFrame) -> DataFrame:
    """kind, value, document_id: the structures and accessions by which documents are found."""
    of = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("value"), "document_id").filter("value is not null")
    named = facts.filter(F.col("field") == "starting_pdb_id")
    return of(named, "pdb", "value").union(of(mappings, "pdb", "pdb_id")).union(of(mappings, "accession", "uniprot_accession")).distinct()


class View:
    """The tables as a snapshot has them. It stays as it is whatever is written later, until `clean` drops its segments."""

    def __init__(self, spark: SparkSession, folder: str, segments: list[str]):
        self.spark, self.folder, self.segments = spark, folder, segments

    def _rows(self, name: str, schema: str, buckets: list[int] | None) -> DataFrame:
        """Rows of a kind in all segments with the number of their segment; with buckets only those folders are opened."""
        paths = [f"{self.folder}/log/kind_={name}/segment={s}" for s in self.segments]
        if buckets is not None:
            paths = [f"{p}/bucket={b}" for p in paths for b in buckets]
        paths = [p for p in paths if self._exists(p)]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, segment string, bucket int, _at int")
        rows = self.spark.read.schema(f"{schema}, segment string, bucket int").option("basePath", f"{self.folder}/log/kind_={name}").parquet(*paths)
        order = F.create_map(*(F.lit(x) for k, s in enumerate(self.segments) for x in (s, k)))
        return rows.withColumn("_at", order[F.col("segment")])

    def _exists(self, path: str) -> bool:
        of = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return of.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(of)

    def newest(self, buckets: list[int] | None = None) -> DataFrame:
        """_id, _bucket, _newest: the last segment that names each id."""
        return self._rows("ids", IDS, buckets).groupBy(F.col("document_id").alias("_id"), F.col("bucket").alias("_bucket")).agg(F.max("_at").alias("_newest"))

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows; they are those of their id's last segment."""
        rows = self._rows(name, TABLES[name], buckets)
        names = [f.split()[0] for f in TABLES[name].split(", ")]
        if len(self.segments) == 1:
            return rows.select(*names)
        last = self.newest(buckets)
        return rows.join(last, (F.col("bucket") == F.col("_bucket")) & (F.col("document_id") == F.col("_id")) & (F.col("_at") == F.col("_newest")), "left_semi").select(*names)

    def bucket(self, value: str) -> int:
        return self.spark.range(1).select(bucket_of(F.lit(value))).first()[0]

    def get(self, document_id: str) -> str:
        """The record's JSON; ids are in upper case."""
        key = document_id.upper()
        rows = self.table("articles", [self.bucket(key)]).filter(F.col("document_id") == key).select("record_json").limit(1).collect()
        if not rows:
            raise NotFound(document_id)
        return rows[0][0]

    def entries(self, *, pdb_id: str | None = None, accession: str | None = None) -> DataFrame:
        """Entries of the index for these, in any segment; only the buckets of the asked values are opened."""
        asked = [(k, v.upper()) for k, v in (("pdb", pdb_id), ("accession", accession)) if v]
        if not asked:
            raise ValueError("a search needs a structure or an accession")
        wanted = F.lit(False)
        for kind, value in asked:
            wanted |= (F.col("kind") == kind) & (F.col("value") == value)
        return self._rows("index", INDEX, sorted({self.bucket(v) for _, v in asked})).filter(wanted)

    def search(self, *, pdb_id: str | None = None, accession: str | None = None) -> DataFrame:
        """document_ids with the structure (as a fact or in a mapping) or the accession, sorted."""
        if pdb_id is not None and len(pdb_id) != 4:
            raise ValueError("a structure id has four characters")
        if accession is not None and not 6 <= len(accession) <= 10:
            raise ValueError("an accession has six to ten characters")
        found = self.entries(pdb_id=pdb_id, accession=accession)
        if len(self.segments) > 1:  # an entry counts if no later segment names its document
            last = self.newest([r[0] for r in found.select(bucket_of(F.col("document_id"))).distinct().collect()])  # BUCKETS at most
            found = found.join(last, (F.col("document_id") == F.col("_id")) & (F.col("_at") == F.col("_newest")), "left_semi")
        return found.select("document_id").distinct().orderBy("document_id")

    def records(self, ids: DataFrame) -> DataFrame:
        """document_id and record_json of these documents, in order of id. ids: document_id."""
        return self.table("articles").join(ids.select("document_id").distinct(), "document_id").select("document_id", "record_json").orderBy("document_id")

    def count(self) -> int:
        return self.table("articles").count()


class Store:
    """The five tables under a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _numbers(self) -> list[int]:
        """Numbers of the snapshots, lowest first."""
        if not self.files.exists(self._path("")):
            return []
        names = [x.getPath().getName() for x in self.files.listStatus(self._path(""))]
        return sorted(int(n.removeprefix(f"{SNAPSHOT}-")) for n in names if n.startswith(f"{SNAPSHOT}-") and n.removeprefix(f"{SNAPSHOT}-").isdigit())

    def _segments(self, number: int) -> list[str]:
        return json.loads(self.spark.read.text(f"{self.folder}/{SNAPSHOT}-{number}", wholetext=True).first()[0])

    def view(self) -> View:
        """The tables as they are now."""
        numbers = self._numbers()
        return View(self.spark, self.folder, self._segments(numbers[-1]) if numbers else [])

    def table(self, name: str) -> DataFrame:
        return self.view().table(name)

    def _add(self, segment: str, kind: str, rows: DataFrame, by: str) -> None:
        """File rows under a segment by the bucket of a column; an empty kind leaves nothing."""
        filed = rows.withColumn("bucket", bucket_of(F.col(by)))
        filed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/log/kind_={kind}/segment={segment}")

    def _segment(self, rows: dict[str, DataFrame]) -> str:
        segment = f"s-{uuid.uuid4().hex}"
        ids = rows["articles"].select("document_id").distinct()
        self._add(segment, "ids", ids, "document_id")
        own = {name: rows[name].select(*(f.split()[0] for f in schema.split(", "))) for name, schema in TABLES.items() if rows.get(name) is not None}
        for name, df in own.items():
            self._add(segment, name, df, "document_id")
        empty = lambda name: self.spark.createDataFrame([], TABLES[name])
        self._add(segment, "index", index_entries(own.get("literature_facts", empty("literature_facts")), own.get("residue_mappings", empty("residue_mappings"))), "value")
        return segment

    def _commit(self, number: int, segments: list[str]) -> None:
        """The highest number counts, so there is a snapshot at all times; a number is taken once, by a rename."""
        staged = f"_{SNAPSHOT}-{number}-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(segments),)], "value string").coalesce(1).write.text(f"{self.folder}/{staged}")
        if self.files.exists(self._path(f"{SNAPSHOT}-{number}")) or not self.files.rename(self._path(staged), self._path(f"{SNAPSHOT}-{number}")):
            self.files.delete(self._path(staged), True)
            raise RuntimeError("another write came first; write again")

    def write(self, rows: dict[str, DataFrame]) -> None:
        """Replace all rows of the documents in rows["articles"] in all tables."""
        numbers = self._numbers()
        number, before = (numbers or [0])[-1] + 1, self._segments(numbers[-1]) if numbers else []
        self._commit(number, [*before, self._segment(rows)])

    def compact(self) -> None:
        """Make one segment of all; readers see the same before and after."""
        numbers = self._numbers()
        if numbers and len(before := self._segments(numbers[-1])) > 1:
            view = View(self.spark, self.folder, before)
            self._commit(numbers[-1] + 1, [self._segment({name: view.table(name) for name in TABLES})])

    def clean(self, keep: int = 1) -> None:
        """Delete all but the last `keep` snapshots and the segments they don't name, when no reader is left on them."""
        numbers = self._numbers()
        named = {s for n in numbers[-keep:] for s in self._segments(n)}
        for number in numbers[:-keep]:
            self.files.delete(self._path(f"{SNAPSHOT}-{number}"), True)
        for kind in (x.getPath() for x in self.files.listStatus(self._path("log"))):
            for segment in self.files.listStatus(kind):
                if segment.getPath().getName().removeprefix("segment=") not in named:
                    self.files.delete(segment.getPath(), True)

    def get(self, document_id: str) -> str:
        return self.view().get(document_id)

    def search(self, *, pdb_id: str | None = None, accession: str | None = None) -> DataFrame:
        return self.view().search(pdb_id=pdb_id, accession=accession)

    def count(self) -> int:
        return self.view().count()

    def health(self) -> dict:
        return {"status": "ok", "records": self.count()}


#: What a caller is told whose request has no answer.
NOT_FOUND, NO_IDENTIFIER = "record not found", "supply pdb_id or uniprot_accession"


def answer(store: Store | View, path: str, **query: str | None) -> tuple[int, dict]:
    """Status and body of a request for /health, /records/{id} or /search; a handler of any web framework may call it."""
    if path == "/health":
        return 200, {"status": "ok", "article_count": store.count()}
    if path.startswith("/records/"):
        try:
            return 200, json.loads(store.get(path.removeprefix("/records/")))
        except NotFound:
            return 404, {"detail": NOT_FOUND}
    if path == "/search":
        pdb_id, accession = query.get("pdb_id"), query.get("uniprot_accession")
        if pdb_id is None and accession is None:
            return 400, {"detail": NO_IDENTIFIER}
        try:
            view = store.view() if isinstance(store, Store) else store
            rows = view.records(view.search(pdb_id=pdb_id, accession=accession)).collect()  # an answer's size
        except ValueError as e:
            return 422, {"detail": str(e)}
        return 200, {"count": len(rows), "records": [json.loads(r["record_json"]) for r in rows]}
    return 404, {"detail": "Not Found"}
