"""Token ids in binary files: one shared frequency table, groups of documents in range-coded blocks.

1. Documents are dealt by ranges of doc_id, hash of the text and row, and sorted; each text is encoded and its ids are
   staged with their place in the range. So a doc_id of any number of rows spreads, and the order is total.
2. The ids are counted over all documents into one frequency table (a row for each id of the vocabulary).
3. Whole documents in a row form groups of about GROUP_TOKENS ids. A group is one binary value: header, document
   index, block table, then blocks as in `rans`. Groups are written in ascending doc_id order as Parquet rows
   (segment, group, first doc_id, documents, ids, data), so that any store Spark reads can hold them.
4. Reading decodes groups independently. Where a document starts in all ids follows from the sums of the groups
   before it: sums within a segment (a run of staged rows, named by its range and its first place there, so no two
   runs share a name), then over segments (one row for each writing task).

Null and empty texts hold the end id alone; null doc_ids come first; rows with equal doc_id are in order of a hash of
their text, and rows equal in both are the same; other columns are ignored; an empty table gives an empty file and no
rows. A group is one binary value of about GROUP_TOKENS ids and at least one document, so a text's ids must fit in 2 GB.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import common, rans, tokens

GROUP_TOKENS, BATCH_ROWS, BATCH_BYTES, SHARD_ROWS = 4_000_000, 512, 4_000_000, 50_000
GROUP_HEAD = struct.Struct("<4sIII")  # mark, documents, blocks, bytes of the index
GROUP_MARK = b"TOKG"
STAGED = "shard int, row long, doc_id long, n long, ids binary"
GROUPS = "segment string, group int, first_id long, n_docs long, n_ids long, data binary"
READ = "segment string, group int, row int, doc_id long, n_tokens long, ids_crc32 long, before long"


def packed(groups_of: list[tuple[int | None, np.ndarray]], table: rans.Table) -> bytes:
    """One group: the index holds each document's id, whether it is null, and its number of ids."""
    ids = np.concatenate([x for _, x in groups_of])
    blocks = rans.encode(ids, table)
    names = np.array([0 if d is None else d for d, _ in groups_of], "<i8").tobytes()
    nulls = np.array([d is None for d, _ in groups_of], np.uint8).tobytes()
    sizes = np.array([len(x) for _, x in groups_of], "<u4").tobytes()
    index = names + nulls + sizes + np.array([len(b) for b in blocks], "<u4").tobytes()
    head = GROUP_HEAD.pack(GROUP_MARK, len(groups_of), len(blocks), len(index))
    return head + index + struct.pack("<I", zlib.crc32(index)) + b"".join(blocks)


def unpacked(data: bytes, table: rans.Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids of a group."""
    mark, docs, blocks, size = GROUP_HEAD.unpack_from(data)
    at = GROUP_HEAD.size
    index = data[at : at + size]
    if mark != GROUP_MARK or struct.unpack_from("<I", data, at + size)[0] != zlib.crc32(index):
        raise rans.Damaged("group index")
    names = np.frombuffer(index, "<i8", docs)
    nulls = np.frombuffer(index, np.uint8, docs, docs * 8)
    sizes = np.frombuffer(index, "<u4", docs, docs * 9)
    lengths = np.frombuffer(index, "<u4", blocks, docs * 13).astype(np.int64)
    at += size + 4
    ends = at + np.concatenate(([0], np.cumsum(lengths)))
    parts = rans.decode([data[ends[k] : ends[k + 1]] for k in range(blocks)], table)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return [None if z else int(d) for d, z in zip(names, nulls, strict=True)], sizes.astype(np.int64), ids


def some_documents(data: bytes, table: rans.Table, wanted: set[int | None]) -> list[tuple[int | None, int, np.ndarray]]:
    """doc_id, place in the group and ids of the wanted documents of a group. Only blocks that hold a part of them are decoded,
    and the first of those from the last checkpoint before the document; payloads are checked whole all the same."""
    mark, docs, blocks, size = GROUP_HEAD.unpack_from(data)
    index = data[GROUP_HEAD.size : GROUP_HEAD.size + size]
    at = GROUP_HEAD.size + size + 4
    if mark != GROUP_MARK or struct.unpack_from("<I", data, at - 4)[0] != zlib.crc32(index):
        raise rans.Damaged("group index")
    names, nulls, sizes = np.frombuffer(index, "<i8", docs), np.frombuffer(index, np.uint8, docs, docs * 8), np.frombuffer(index, "<u4", docs, docs * 9).astype(np.int64)
    lengths = np.frombuffer(index, "<u4", blocks, docs * 13).astype(np.int64)
    offsets = at + np.concatenate(([0], np.cumsum(lengths)))
    held = [data[offsets[b] : offsets[b + 1]] for b in range(blocks)]
    first = np.concatenate(([0], np.cumsum([rans.size_of(x) for x in held]))).astype(np.int64)
    ends, out = np.cumsum(sizes), []
    for k in range(docs):
        name = None if nulls[k] else int(names[k])
        if name in wanted:
            start, end = int(ends[k] - sizes[k]), int(ends[k])
            parts = []
            for b in range(int(np.searchsorted(first, start, "right")) - 1, blocks):
                if first[b] >= end:
                    break
                low = max(start - int(first[b]), 0)
                own = rans.decode([held[b]], table, low // rans.LANES)[0]
                skipped = int(first[b + 1] - first[b]) - len(own)
                parts.append(own[low - skipped : end - int(first[b]) - skipped])
            out.append((name, k, np.concatenate(parts)))
    return out


def read_documents(spark: SparkSession, to: str, wanted: list[int | None]) -> DataFrame:
    """doc_id, segment, group, row and ids of the documents with these ids, from a written folder; as many rows as have them."""
    freq, asked = read_table(spark, to), set(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(freq)
        for batch in batches:
            for segment, group, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for name, row, ids in some_documents(data.as_py(), table, asked):
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([segment]), pa.array([group], pa.int32()), pa.array([row], pa.int32()), pa.array([ids.tolist()], pa.list_(pa.int32()))], ["doc_id", "segment", "group", "row", "ids"])

    groups = spark.read.schema(GROUPS).parquet(f"{to}/groups")
    if asked and None not in asked:  # a group begins with its first id, and later ones have larger ids
        groups = groups.filter(F.col("first_id").isNull() | (F.col("first_id") <= max(asked)))
    return groups.select("segment", "group", "data").mapInArrow(read, "doc_id long, segment string, group int, row int, ids array<int>")


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of BATCH_ROWS rows and about BATCH_BYTES of this column at most, and one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = min(at + BATCH_ROWS, max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right"))))
        yield batch.slice(at, to - at)
        at = to


def staged_ids(docs: DataFrame, path: str, end_id: int, words: bool, n_shards: int) -> DataFrame:
    """Rows of STAGED in doc_id order within each shard; ids are little-endian, 16 bits where the vocabulary allows it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens.encoder(path, words)
        kind = np.dtype("<u2") if max(own.whole.get_vocab_size(), end_id + 1) <= 1 << 16 else np.dtype("<u4")
        row = 0
        for batch in batches:
            for rows in slices(batch, 2):
                ids, sizes = own.encode([x or "" for x in rows.column(2).to_pylist()])
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype(kind)
                sizes = sizes + 1
                offsets = np.concatenate(([0], np.cumsum(sizes * kind.itemsize)))
                data = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.arange(row, row + len(sizes)), pa.int64()), rows.column(1), pa.array(sizes, pa.int64()), data], names=["shard", "row", "doc_id", "n", "ids"])
                row += len(sizes)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # the row only deals out rows that are equal in both, which may change places
    rows = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(n_shards, "doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash")
    return dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(encode, STAGED)


def counted_ids(staged: DataFrame) -> DataFrame:
    """How often each id occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            data = b"".join(batch.column(0).to_pylist())
            own = np.bincount(np.frombuffer(data, "<u2" if len(data) == 2 * (pc.sum(batch.column(1)).as_py() or 0) else "<u4"), minlength=len(total))
            own[: len(total)] += total
            total = own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return staged.select("ids", "n").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def coded_groups(staged: DataFrame, freq: np.ndarray, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Rows of GROUPS. A segment is a run of staged rows in ascending doc_id order, as one task reads them."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(freq)
        held: list[tuple[int | None, np.ndarray]] = []
        size, number, segment, last = 0, 0, "", None

        def group() -> pa.RecordBatch:
            ids = [x for x, _ in held if x is not None]
            row = {"segment": [segment], "group": [number], "first_id": [ids[0] if len(ids) == len(held) else None], "n_docs": [len(held)], "n_ids": [size], "data": [packed(held, table)]}
            return pa.RecordBatch.from_arrays([pa.array(row["segment"]), pa.array(row["group"], pa.int32()), pa.array(row["first_id"], pa.int64()), pa.array(row["n_docs"], pa.int64()), pa.array(row["n_ids"], pa.int64()), pa.array(row["data"], pa.binary())], names=list(row))

        for batch in batches:
            for shard, row, doc, n, ids in zip(*(batch.column(k).to_pylist() if k != 4 else batch.column(k) for k in range(5)), strict=True):
                if last != (shard, row - 1):
                    if held:
                        yield group()
                    held, size, number = [], 0, 0
                    segment = f"{shard:09d}:{row:019d}"
                last = (shard, row)
                data = ids.as_buffer()
                held.append((doc, np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype(np.uint32)))
                size += n
                if size >= group_tokens:
                    yield group()
                    held, size, number = [], 0, number + 1
        if held:
            yield group()

    return staged.select("shard", "row", "doc_id", "n", "ids").mapInArrow(code, GROUPS)


def read_groups(groups: DataFrame, freq: np.ndarray) -> DataFrame:
    """A row for each document, from the decoded ids; before: ids of the group before it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(freq)
        for batch in batches:
            for segment, group, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                names, sizes, ids = unpacked(data.as_py(), table)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                k = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment] * k), pa.array([group] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array(ends - sizes, pa.int64())],
                    names=["segment", "group", "row", "doc_id", "n_tokens", "ids_crc32", "before"],
                )

    return groups.select("segment", "group", "data").mapInArrow(read, READ)


def group_starts(groups: DataFrame) -> DataFrame:
    """Ids before each group: sums within its segment, and over the segments before it."""
    within = Window.partitionBy("segment").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each task that wrote, so this order over all segments is small at any size
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = groups.groupBy("segment").agg(F.sum("n_ids").alias("all_ids")).select("segment", F.coalesce(F.sum("all_ids").over(before), F.lit(0)).alias("segment_start"))
    own = groups.select("segment", "group", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("group_start"))
    return own.join(segments, "segment").select("segment", "group", (F.col("segment_start") + F.col("group_start")).alias("group_start"))


def write_ids(docs: DataFrame, to: str, path: str, *, end_id: int, words: bool = False, n_shards: int | None = None, group_tokens: int = GROUP_TOKENS) -> tuple[DataFrame, np.ndarray]:
    """Write all documents' ids to the folder `to`; the groups as read back, and the table they were coded with."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "token-output")
    # counted without reading a column
    n_shards = n_shards or common.partitions(spark, -(-docs.count() // SHARD_ROWS))
    staged = scratch.stage(staged_ids(docs, path, end_id, words, n_shards), "ids")
    counts = counted_ids(staged).collect()  # a row for each id of the vocabulary at most
    total = np.zeros(max([end_id, *(r["id"] for r in counts)]) + 1, np.int64)
    for r in counts:
        total[r["id"]] = r["n"]
    freq = rans.frequencies(total)
    # the staged ids are read in splits of any order; each range has a file of its own, and files follow each other as ids do
    coded = coded_groups(staged, freq, group_tokens).withColumn("_shard", F.split_part("segment", F.lit(":"), F.lit(1)).cast("int"))
    in_order = coded.repartitionById(n_shards, "_shard").sortWithinPartitions("segment", "group").drop("_shard")
    in_order.write.option("compression", "none").mode("overwrite").parquet(f"{to}/groups")
    spark.createDataFrame([(k, int(n)) for k, n in enumerate(freq) if n], "id int, freq int").coalesce(1).write.mode("overwrite").parquet(f"{to}/table")
    scratch.drop()
    return spark.read.schema(GROUPS).parquet(f"{to}/groups"), freq


def read_table(spark: SparkSession, to: str) -> np.ndarray:
    """The frequency table of a written folder."""
    rows = spark.read.schema("id int, freq int").parquet(f"{to}/table").collect()  # a row for each id at most
    freq = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint32)
    for r in rows:
        freq[r["id"]] = r["freq"]
    return freq


def read_ids(spark: SparkSession, to: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files."""
    groups = spark.read.schema(GROUPS).parquet(f"{to}/groups")
    rows = read_groups(groups, read_table(spark, to)).join(group_starts(groups.drop("data")), ["segment", "group"])
    return rows.select("doc_id", (F.col("group_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.Scratch(spark, "token-files").path
    write_ids(common.table(spark, sf_dir, "documents"), out, tokens.vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_ids(spark, out)
