"""Best-fit packing by minimum bin slack, over the counts of piece lengths.

1. Each text is encoded, the end id follows, and only documents longer than a sequence are cut.
2. Pieces are counted by length: a table of `capacity` rows at most, whatever the corpus. The driver plans on it:
   the longest piece left opens a sequence, dynamic programming over bitsets of reachable sums finds the lengths
   that fill it best, and the combination is used as often as the counts allow. So a plan entry stands for any
   number of sequences, and each piece of the corpus is in exactly one.
3. Pieces are ranked within their length in parallel (ranks within hash buckets plus the buckets before), and a
   piece's rank finds its sequence and place in the plan.

Null and empty texts hold the end id alone. Repeated rows are packed once each; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import common, tokens

CAPACITY, END_ID, BATCH_ROWS, BUCKET_ROWS = 4096, 1, 128, 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Lengths and how many of each that fill `room` best, by subset sums over bitsets, longest first."""
    reach, goal, every = 1, 1 << room, (1 << room + 1) - 1
    layers = []
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left:
            take = min(step, left)
            layers.append((reach, length, take))
            reach |= reach << length * take & every
            left, step = left - take, step * 2
        if reach & goal:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(layers):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations (length, copies) and for how many sequences each stands; every piece is used once."""
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = dict(fullest(left, capacity - longest))
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        out.append((sorted(chosen.items(), reverse=True), times))
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def entries(combinations: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Sorted rows (length, first rank, first sequence, offset): the piece of a rank r from the first on is in sequence first + r - first rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for chosen, times in combinations:
        offset = 0
        for length, copies in chosen:
            for _ in range(copies):
                rows.append((length, used.get(length, 0), sequence, offset))
                used[length] = used.get(length, 0) + times
                offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, path: str, *, words: bool = True, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows of PIECES: every document's ids with the end id, cut only where longer than a sequence."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens.encoder(path, words)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                rows = batch.slice(at, BATCH_ROWS)
                ids, sizes = own.encode([x or "" for x in rows.column(1).to_pylist()])
                raw = memoryview(np.insert(ids, np.cumsum(sizes), end_id).astype("<u4").tobytes())
                out: list[tuple] = []
                first = 0
                for doc, row, size in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), (sizes + 1).tolist(), strict=True):
                    for k, start in enumerate(range(0, size, capacity)):
                        length = min(capacity, size - start)
                        out.append((doc, k, start, length, zlib.crc32(raw[4 * (first + start) : 4 * (first + start + length)]), row))
                    first += size
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(cut, PIECES)


def ranked(staged: DataFrame, n_buckets: int) -> DataFrame:
    """Each piece's rank among those of its length; no length is gathered in one task."""
    bucketed = staged.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(n_buckets)))
    sums = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row", "piece"))
    return bucketed.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1)


def packed(docs: DataFrame, path: str, *, words: bool = True, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows of PLACED: each piece, its sequence and its place there."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "packing")
    staged = scratch.stage(pieces(docs, path, words=words, capacity=capacity, end_id=end_id), "pieces")
    counts = {r["length"]: r["n"] for r in staged.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `capacity` rows at most
    rows = entries(plan(counts, capacity))
    held = spark.sparkContext.broadcast(rows)  # bounded by the capacity, not by the corpus
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset = held.value.T
        keys = length << 48 | first
        for batch in batches:
            own, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, own << 48 | rank, "right") - 1
            columns = [*(batch.column(k) for k in range(5)), pa.array(sequence[at] + rank - first[at], pa.int64()), pa.array(offset[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(staged, buckets).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PLACED)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"))
