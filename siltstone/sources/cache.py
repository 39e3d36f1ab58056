"""Content-addressed folders: answers of services and article snapshots that later runs read instead of asking again.

An entry is filed under the hash of its key, by the first two digits of that hash, so a read opens only the prefixes it asks
for. A batch of entries is written aside and appears by one rename; a batch that is there already isn't written again, so a
job may be repeated after any failure. Entries prove themselves: one whose key or content doesn't fit its hash isn't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.staging import Scratch
from siltstone.sources.files import valid_article_id
from siltstone.sources.web import Answer

ENTRY = "key string, status int, content binary, cache_key string, content_sha256 string"
PREFIX_DIGITS = 2


class ContentCache:
    """A folder of batches. Keys are strings: endpoints, or identifiers of articles."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def batches(self) -> list[str]:
        """Names of the committed batches in order."""
        if not self.files.exists(self._path("")):
            return []
        names = [x.getPath().getName() for x in self.files.listStatus(self._path(""))]
        return sorted(n for n in names if n.startswith("batch="))

    def _stored(self, prefixes: list[str] | None = None) -> DataFrame:
        """Entries of all batches as they are, with their prefix; with prefixes only the folders of those are opened."""
        schema = f"{ENTRY}, batch string, prefix string"
        if not self.batches():
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self.folder)
        return rows if prefixes is None else rows.filter(F.col("prefix").isin(prefixes))

    @staticmethod
    def _sound() -> Column:
        return (F.col("cache_key") == F.sha2("key", 256)) & (F.col("content_sha256") == F.sha2("content", 256))

    @staticmethod
    def _filed(keys: DataFrame) -> DataFrame:
        """Distinct keys with the hash and the prefix they are filed under; null keys have none."""
        rows = keys.select(F.col("key").cast("string").alias("_key")).filter("_key is not null").distinct()
        return rows.withColumn("_prefix", F.substring(F.sha2("_key", 256), 1, PREFIX_DIGITS))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """key, status and content of the keys that have a sound entry. keys: key."""
        asked = self._filed(keys)
        prefixes = [r[0] for r in asked.select("_prefix").distinct().collect()]  # 256 at most
        own = self._stored(prefixes).filter(self._sound())
        rows = own.join(asked, (F.col("prefix") == F.col("_prefix")) & (F.col("key") == F.col("_key")))
        # an entry that was damaged is there once more; copies of a sound one are equal or the first by hash
        return rows.groupBy("key").agg(F.min_by(F.struct("status", "content"), "content_sha256").alias("e")).select("key", "e.status", "e.content")

    def missing(self, keys: DataFrame) -> DataFrame:
        """Keys without a sound entry, once each."""
        return self._filed(keys).join(self.lookup(keys).select("key"), F.col("_key") == F.col("key"), "left_anti").select(F.col("_key").alias("key"))

    def append(self, entries: DataFrame, batch: str | None = None) -> bool:
        """Add entries (key, status, content; rows without key or content are left out) as a batch; False if it is there already.

        A key's entry of the batch is the one with the least hash. Name the batch to make a repeated job harmless.
        """
        name = f"batch={batch or uuid.uuid4().hex}"
        if self.files.exists(self._path(name)):
            return False
        rows = entries.filter("key is not null and content is not null").select(F.col("key").cast("string").alias("key"), F.col("status").cast("int").alias("status"), F.col("content").cast("binary").alias("content"))
        rows = rows.withColumns({"cache_key": F.sha2("key", 256), "content_sha256": F.sha2("content", 256)})
        one = rows.groupBy("cache_key").agg(F.min_by(F.struct("key", "status", "content", "cache_key", "content_sha256"), F.struct("content_sha256", "status")).alias("e"))
        staged = f"_staged-{uuid.uuid4().hex}"
        filed = one.select("e.*", F.substring("cache_key", 1, PREFIX_DIGITS).alias("prefix"))
        filed.repartition("prefix").write.partitionBy("prefix").parquet(f"{self.folder}/{staged}")
        if self.files.exists(self._path(name)) or not self.files.rename(self._path(staged), self._path(name)):
            self.files.delete(self._path(staged), True)
            return False
        return True

    def through(self, keys: DataFrame, fetch: Callable[[str], Answer], batch: str | None = None) -> DataFrame:
        """key, status and content of all keys: from the folder where it has them, else fetched by the executors and kept.

        Only answers are kept, so a key whose fetch raises OSError is asked again by the next run; it has null here.
        """
        asked = self._filed(keys).select(F.col("_key").alias("key"))

        def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for key in rows.column(0).to_pylist():
                    try:
                        status, _, body = fetch(key)
                    except OSError:
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([status], pa.int32()), pa.array([body], pa.binary())], ["key", "status", "content"])

        scratch = Scratch(self.spark, "fetched")
        new = scratch.stage(self.missing(keys).mapInArrow(fetched, "key string, status int, content binary"), "answers")
        if not new.isEmpty():
            self.append(new, batch)
        scratch.drop()
        return asked.join(self.lookup(keys), "key", "left")

    def compact(self) -> None:
        """Make one batch of all sound entries, and drop the others when it is there; for times without readers."""
        names = self.batches()
        if len(names) > 1 and self.append(self._stored().filter(self._sound())):
            for name in names:
                self.files.delete(self._path(name), True)


class ArticleCache(ContentCache):
    """Snapshots of articles by identifier, in upper case; names that could not be file names are refused."""

    def append(self, entries: DataFrame, batch: str | None = None) -> bool:
        key = F.upper("key")
        checked = F.when(valid_article_id(key), key).otherwise(F.raise_error(F.concat(F.lit("not an article id: "), F.coalesce(key, F.lit("null")))))
        return super().append(entries.withColumn("key", checked), batch)

    def articles(self, plan: DataFrame) -> DataFrame:
        """document_id, content and sha256 of the plan's articles that have a sound snapshot. plan: document_id."""
        rows = self.lookup(plan.select(F.upper("document_id").alias("key")))
        return rows.select(F.col("key").alias("document_id"), "content", F.sha2("content", 256).alias("sha256"))
