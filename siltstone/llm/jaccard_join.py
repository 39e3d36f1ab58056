"""Exact n-gram Jaccard join by grouped prefixes, and the components of its links.

1. A sketch counts all documents' shingles in cells; cells far over the mean are common. Shingles are ordered by
   (common, hash): any order gives right results, this one keeps what many documents share out of prefixes.
2. A document's prefix is its first n - ceil(3n/4) + 1 shingles: two documents that link share one there. Documents
   with equal prefixes and size form one group, and only groups are indexed; equal sets are one class.
3. The index is dealt by shingle. First round: in each list of groups every group is paired with the list's smallest
   group of matching size, and in each group every class with the group's first. Parity signatures, a fraction of a byte for
   each byte of text, bound the difference of two sets; pairs that they leave are verified on whole texts.
4. Strays: a group that shares a list with a large component but isn't in it is compared with random members of it.
5. Last round: lists and groups that still hold several components go to the bucket of their smallest group, expanded
   to classes. There every two of different components and matching size are compared. First only signatures travel: a
   class stays if any other of its bucket may link with it. The texts of those then meet, wider signatures and sets are
   compared, and only links become rows. So a family of thousands of near copies costs a few pairs a member, and one just under the limit costs no rows.

Two documents link when 100 * intersection >= 75 * union of their sets of five-word shingles. Documents without words
link with nothing; a long text is whole in a task and its shingles take eight bytes each there. Rows with one doc_id are one document, linked if any of its texts is; a null doc_id links with
nothing and has a null component. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common, shingles
from siltstone.llm.components import components

#: One sketch cell for sixteen shingles, between these bounds; the most makes a bitmap of 8 MB, the only thing broadcast.
LEAST_CELLS, MOST_CELLS, CELL_SHINGLES, CHUNKS, HELD = 1 << 18, 1 << 26, 16, 64, 40_000
BATCH_ROWS, MEMBERS, FLUSH = 512, 200, 1_000_000
#: Rounds that compare what is apart from a family with random members of it, and the least size of a family in a list.
ROUNDS, FAMILY = 2, 8
#: A bucket beyond these is dealt in blocks: rows, and shingles of all of them.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 2_000_000
#: Rows of one or two ids that are broadcast at most, counted before, to leave what they are joined with where it is.
MOST_IDS = 500_000
#: Bytes of text whose prefixes one task indexes.
PART_BYTES = 1 << 27
SETS = "doc_id long, n long, set_digest binary, prefix_digest binary, prefix binary, signature binary"
LISTS = "h long, g long, n int, pivot long"


def prefix_length(n: np.ndarray | int) -> np.ndarray | int:
    return n - (3 * n + 3) // 4 + 1


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, BATCH_ROWS):
        yield batch.slice(at, BATCH_ROWS)


def sketched(docs: DataFrame, cells: int, n_parts: int, scratch: common.Scratch) -> np.ndarray:
    """A bitmap of the cells whose count is far over the mean. Tasks' sketches are summed in two steps, first by about the
    square root of their number; a task counts a cell up to HELD, sums have no bound, so that the order still tells
    common shingles at any size."""
    width, sums_of = cells // CHUNKS, max(4, min(64, math.isqrt(n_parts)))
    pack = lambda x: zstandard.ZstdCompressor(level=1).compress(_planes(x))
    unpack = lambda data, kind: _from_planes(zstandard.ZstdDecompressor().decompress(data.as_py()), kind)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, since = np.zeros(cells, np.uint16), 0
        for batch in batches:
            for rows in slices(batch):
                if sets := shingles.sets_of(rows.column(0).to_pylist()):
                    np.add.at(total, (np.concatenate(sets) & np.uint64(cells - 1)).astype(np.int64), 1)
                since += rows.num_rows  # a cell's shingles may be in each of these, and several times by collisions
                if since >= 4096:
                    np.minimum(total, HELD, out=total)
                    since = 0
        np.minimum(total, HELD, out=total)
        if total.any():
            data = [pack(total[k * width : (k + 1) * width].astype("<u2")) for k in range(CHUNKS)]
            task = TaskContext.get().partitionId() % sums_of
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([task] * CHUNKS, pa.int32()), pa.array(data, pa.binary())], names=["chunk", "part", "data"])

    def added(kind: str):
        def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width, np.uint64)
            for batch in batches:
                for data in batch.column("data"):
                    total += unpack(data, kind)
            data = pack(total.astype("<u8"))
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([data], pa.binary())], names=["chunk", "part", "data"])

        return add

    kind = "chunk int, part int, data binary"
    first = docs.select("text").mapInArrow(count, kind).groupBy("chunk", "part").applyInArrow(added("<u2"), kind)
    sums = scratch.stage(first.groupBy("chunk").applyInArrow(added("<u8"), kind), "sketch")

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(unpack(x, "<u8").sum()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])

    mean = (sums.select("data").mapInArrow(facts, "n long").agg(F.sum("n")).first()[0] or 0) / cells
    most = mean + 4 * math.sqrt(mean) + 4

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(unpack(x, "<u8") > most, bitorder="little").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["chunk", "bits"])

    bitmap = np.zeros(cells // 8, np.uint8)
    for r in sums.select("chunk", "data").mapInArrow(over, "chunk int, bits binary").collect():  # MOST_CELLS bits at most
        bitmap[r["chunk"] * width // 8 : (r["chunk"] + 1) * width // 8] = np.frombuffer(r["bits"], np.uint8)
    return bitmap


def document_sets(docs: DataFrame, bitmap, cells: int) -> DataFrame:
    """Rows of SETS; the prefix is stored in order of hash, which its digest needs."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            for rows in slices(batch):
                sets = shingles.sets_of(rows.column(1).to_pylist())
                prefixes = []
                for own in sets:
                    cell = (own & np.uint64(cells - 1)).astype(np.int64)
                    is_common = bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1
                    p = prefix_length(len(own)) if len(own) else 0
                    rare = own[is_common == 0]
                    prefixes.append(rare[:p] if len(rare) >= p else np.sort(np.concatenate((rare, own[is_common == 1][: p - len(rare)]))))
                digest = lambda x: hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                columns = [rows.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(map(digest, sets), pa.binary()), pa.array(map(digest, prefixes), pa.binary()), pa.array([x.tobytes() for x in prefixes], pa.binary()), pa.array([signature(x) for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SETS.split(", ")])

    return docs.mapInArrow(build, SETS)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal place together: the high ones of ids and sizes are nearly all alike and compress away."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(wide, -1).T).view(kind).ravel()


def prefix_lists(groups: DataFrame, n_parts: int) -> DataFrame:
    """Rows of LISTS: the groups of each prefix shingle that more than one group has. groups: g, n, prefix.

    Postings travel packed, a row for each task and part of the hash range.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            h = np.concatenate([x for x, _, _ in held])
            sizes = [len(x) for x, _, _ in held]
            g, n = np.repeat(np.array([x for _, x, _ in held], np.int64), sizes), np.repeat(np.array([x for _, _, x in held], np.int32), sizes)
            part = ((h >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            h, g, n, part = h[order], g[order], n[order], part[order]
            used, firsts = np.unique(part, return_index=True)
            spans = list(zip(firsts, [*firsts[1:], len(h)], strict=True))
            columns = [pa.array(used, pa.int32()), *(pa.array([_planes(x[a:b]) for a, b in spans], pa.binary()) for x in (h, g, n))]
            return pa.RecordBatch.from_arrays(columns, names=["part", "h", "g", "n"])

        for batch in batches:
            for g, n, prefix in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.append((np.frombuffer(prefix, np.uint64), g, n))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(_from_planes(h.as_py(), "<u8"), _from_planes(g.as_py(), "<i8"), _from_planes(n.as_py(), "<i4")) for batch in batches for h, g, n in zip(batch.column(1), batch.column(2), batch.column(3), strict=True)]
        if not parts:
            return
        h, g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(h)
        h = h[order]
        same = h[1:] == h[:-1]
        held = np.concatenate((same, [False])) | np.concatenate(([False], same))
        order, h = order[held], h[held]
        g, n = g[order], n[order]
        order = np.lexsort((g, n, h))
        h, g, n = h[order], g[order], n[order]
        pivot, todo = g.copy(), np.arange(len(h))
        while len(todo):  # the first of a list takes all of matching size, the next of the rest takes on, and so on
            first = np.concatenate(([True], h[todo][1:] != h[todo][:-1]))
            lead = todo[np.flatnonzero(first)[np.cumsum(first) - 1]]
            fits = 3 * n[todo].astype(np.int64) <= 4 * n[lead].astype(np.int64)
            pivot[todo[fits]] = g[lead[fits]]
            todo = todo[~fits]
        for at in range(0, len(h), 100_000):
            own = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(h[own].view(np.int64)), pa.array(g[own]), pa.array(n[own]), pa.array(pivot[own])], names=["h", "g", "n", "pivot"])

    kind = "part int, h binary, g binary, n binary"
    return groups.select("g", "n", "prefix").mapInArrow(pack, kind).repartition(n_parts, "part").mapInArrow(lists, LISTS)


def light(df: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """df staged, with a hint to broadcast it if it is counted to have at most MOST_IDS rows, of two ids each."""
    df = scratch.stage(df, name)
    return F.broadcast(df) if df.count() <= MOST_IDS else df


def needed(df: DataFrame, ids: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """The rows of df whose doc_id is among ids, so that no others travel. The ids are broadcast if they are counted to be at
    most MOST_IDS, eight bytes each; beyond that df is left as it is for the join that follows. ids: id."""
    ids = scratch.stage(ids.filter("id is not null").distinct(), name)
    if ids.count() > MOST_IDS:
        return df
    return df.join(F.broadcast(ids.withColumnRenamed("id", "_id")), F.col("doc_id") == F.col("_id"), "left_semi")


def near(pairs: DataFrame, sets: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """The pairs a, b whose sizes and signatures let them link. sets: doc_id, n, signature; an id with several sets passes by any of them."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    own = needed(sets.filter("n > 0").select("doc_id", "n", "signature"), ids, scratch, f"{name}-asked")
    side = lambda s: own.select(F.col("doc_id").alias(f"_{s}"), F.col("n").alias(f"n_{s}"), F.col("signature").alias(f"s_{s}"))
    rows = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b")).filter("3 * greatest(n_a, n_b) <= 4 * least(n_a, n_b)")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) < len(y):
                    x, y = y, x
                while len(x) > len(y):  # sizes that may link are at most one size class apart
                    x = _folded(x[None])[0]
                keep.append(7 * int(np.bitwise_count(x ^ y).sum()) <= m + n)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(bounded, "a long, b long").distinct()


def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, texts, packed: a text goes to several places, and the exchange's own compression is the weaker one."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in slices(batch):
            data = [packer.compress(x or b"") for x in part.columns[-1].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(data, pa.binary())], names=part.schema.names)


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, n_parts: int, scratch: common.Scratch, name: str) -> DataFrame:
    """The pairs a, b that link. Each text goes once to each partner's place; a partner of many is put in several."""
    pairs = scratch.stage(near(pairs, sets, scratch, name), f"{name}-near")
    docs = needed(docs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), scratch, f"{name}-needed")
    counted = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k")).select(F.col("a").alias("_a"), F.ceil(F.col("k") / MEMBERS).cast("int").alias("places"))
    placed = pairs.join(counted, F.col("a") == F.col("_a")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("places")).cast("int").alias("place"))
    heads = counted.select(F.col("_a").alias("a"), F.col("_a").alias("id"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(0).alias("member"))
    targets = heads.unionByName(placed.select("a", F.col("b").alias("id"), "place", F.lit(1).alias("member")))
    # staged, so that the texts are not in two exchanges at a time
    rows = scratch.stage(targets.join(docs, F.col("id") == F.col("doc_id")).select("a", "place", "member", "id", "text"), f"{name}-texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads_sets, unpacker = None, [], zstandard.ZstdDecompressor()
        for batch in batches:
            for rows in slices(batch):
                a, place, member, ids = (rows.column(k).to_pylist() for k in range(4))
                found: list[tuple[int, int]] = []
                for k, own in enumerate(shingles.sets_of([unpacker.decompress(x) for x in rows.column(4).to_pylist()])):
                    if (a[k], place[k]) != key:
                        key, heads_sets = (a[k], place[k]), []
                    if not member[k]:
                        heads_sets.append(own)
                    else:
                        for head in heads_sets:
                            both = shingles.common_count(head, own)
                            if len(own) and 100 * both >= 75 * (len(own) + len(head) - both):
                                found.append((a[k], ids[k]))
                                break
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    dealt = rows.mapInArrow(shrink, "a long, place int, member int, id long, text binary").repartition(n_parts, "a", "place").sortWithinPartitions("a", "place", "member")
    found = scratch.stage(dealt.mapInArrow(compare, "a long, b long"), name)
    scratch.drop(f"{name}-texts")
    return found


def strays(lists: DataFrame, n_parts: int) -> DataFrame:
    """Pairs of a group and a random group of the largest component of a list that it shares but isn't in.

    One family's members are not all near to one of them; each list offers another one. lists: h, g, n, c.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        h, g, n, c = (np.concatenate([b.column(k).to_numpy() for b in parts]) for k in range(4))
        order = np.lexsort((g, n, h))
        h, g, n, c = h[order], g[order], n[order], c[order]
        firsts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        a, b = [], []
        for at, end in zip(firsts.tolist(), [*firsts[1:].tolist(), len(h)], strict=True):
            if end - at <= FAMILY or (c[at:end] == c[at]).all():
                continue
            names, counts = np.unique(c[at:end], return_counts=True)
            if counts.max() < FAMILY:
                continue
            inside = c[at:end] == names[counts.argmax()]
            own, other = np.arange(at, end)[inside], np.arange(at, end)[~inside]
            low, high = np.searchsorted(4 * n[own], 3 * n[other], "left"), np.searchsorted(3 * n[own], 4 * n[other], "right")
            some = high > low
            spread = shingles.mixed(g[other].view(np.uint64) ^ np.uint64(h[at] & 0x7FFFFFFFFFFFFFFF)) >> np.uint64(33)
            chosen = own[low[some] + (spread[some].astype(np.int64) % (high[some] - low[some]))]
            a.append(np.minimum(g[other][some], g[chosen]))
            b.append(np.maximum(g[other][some], g[chosen]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    rows = lists.select("h", "g", F.col("n").cast("long").alias("n"), "c").repartition(n_parts, "h").mapInArrow(pick, "a long, b long")
    return rows.filter("a <> b").distinct()


def seats(lists: DataFrame) -> DataFrame:
    """Groups to be compared in full: lead, g. Every two groups that share a list but not a component share a lead.

    A list with several components is looked after by its smallest group, the lead, so what a family's many lists hold is
    one bucket and not a pair in each list. Two groups alone in a bucket share as many prefix shingles as they have lists
    there (or meet in another bucket), so the bound on their intersection drops them here. lists: h, g, n, c.
    """
    mixed = lists.groupBy("h").agg(F.min("g").alias("lead"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("h", "lead")
    own = lists.join(mixed, "h").groupBy("lead", "g").agg(F.count_distinct("h").alias("shared"), F.min("n").cast("long").alias("n"))
    rest = lambda n: F.expr(f"{n} - ({n} - (3 * {n} + 3) div 4 + 1)")
    own = own.withColumn("other", F.when(F.col("g") != F.col("lead"), F.col("shared"))).withColumn("bound", rest("n"))
    of = own.groupBy("lead").agg(F.count(F.lit(1)).alias("k"), F.max("other").alias("shared"), F.max("bound").alias("bound"), F.sum("n").alias("all_n"), F.min("n").alias("low"), F.max("n").alias("high"))
    alone = (F.col("k") == 2) & ((7 * (F.col("shared") + F.col("bound")) < 3 * F.col("all_n")) | (4 * F.col("low") < 3 * F.col("high")))
    return own.select("lead", "g").join(of.filter(~alone).select("lead"), "lead", "left_semi")


def signatures(sets: list[np.ndarray], width: int) -> np.ndarray:
    """Per set, for each of `width` cells, whether an odd number of its shingles falls there; bits in 64-bit numbers.

    Two sets' signatures differ in at most as many bits as the sets in elements, and halves of a signature can be folded.
    """
    out = np.zeros((len(sets), width // 64), np.uint64)
    for k, own in enumerate(sets):
        odd = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
        out[k] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
    return out


def levels(n: np.ndarray) -> np.ndarray:
    """The size class of a set: 2 ** level > n, and at least 32."""
    return np.maximum(np.int64(5), np.frexp(np.asarray(n, np.float64))[1]).astype(np.int64)


def signature(own: np.ndarray) -> bytes:
    """The narrow signature of a set, two to four bits for each shingle."""
    return signatures([own], 1 << int(levels(len(own))) + 1)[0].tobytes() if len(own) else b""


def may_link(n: np.ndarray, component: np.ndarray, block: np.ndarray, narrow: list[bytes]) -> np.ndarray:
    """For each set whether any other of another component (and block, if there are two) is of matching size and no farther by
    the narrow signatures than a link allows. Whole rows of signatures are compared at once."""
    order = np.argsort(n, kind="stable")
    n, component, block, level = n[order], component[order], block[order], levels(n[order])
    across, out = block.min() != block.max(), np.zeros(len(n), bool)
    last = np.searchsorted(3 * n, 4 * n, "right")
    at, bits = {}, {}
    for q in np.unique(level).tolist():
        at[q] = (int(np.searchsorted(level, q)), int(np.searchsorted(level, q, "right")))
        bits[q, 0] = np.stack([np.frombuffer(narrow[k], np.uint64) for k in order[slice(*at[q])]])
        bits[q, 1] = _folded(bits[q, 0])
    for q, (low, high) in at.items():
        for i in range(low, high):
            for fold, (start, end) in ((0, (i + 1, min(high, last[i]))), (1, (at[q + 1][0], min(at[q + 1][1], last[i])) if q + 1 in at else (0, 0))):
                if end <= start:
                    continue
                apart = component[start:end] != component[i]
                if across:
                    apart &= block[start:end] != block[i]
                js = np.flatnonzero(apart)
                if len(js):
                    first = at[q + fold][0]
                    differ = np.bitwise_count(bits[q + fold, fold][js + (start - first)] ^ bits[q, 0][i - low]).sum(axis=1, dtype=np.int64)
                    near = js[7 * differ <= n[js + start] + n[i]] + start
                    if len(near):
                        out[i] = True
                        out[near] = True
    back = np.empty(len(n), bool)
    back[order] = out
    return back


def _folded(bits: np.ndarray) -> np.ndarray:
    """Signatures of half the width."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def links_between(ids: list[int], component: np.ndarray, block: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join components among these sets, of different blocks if there are two: enough to join all that link.

    Sizes bound the partners, then signatures of two widths bound the difference, then sets are compared. What a link
    has joined isn't compared again.
    """
    n = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(n, kind="stable")
    n, root, block, sets, ids = n[order], component[order].copy(), block[order], [sets[k] for k in order], [ids[k] for k in order]
    across = block.min() != block.max()
    last = np.searchsorted(3 * n, 4 * n, "right")
    level = levels(n)
    found: list[tuple[int, int]] = []
    narrow, wide, at = {}, {}, {}
    for q in np.unique(level).tolist():
        at[q] = (int(np.searchsorted(level, q)), int(np.searchsorted(level, q, "right")))
        own = sets[slice(*at[q])]
        for held, more in ((narrow, 2), (wide, 5)):
            held[q, 0] = signatures(own, 1 << q + more - 1)
            held[q, 1] = _folded(held[q, 0])
    for q, (low, high) in at.items():
        for i in range(low, high):
            for fold, (start, end) in ((0, (i + 1, min(high, last[i]))), (1, (at[q + 1][0], min(at[q + 1][1], last[i])) if q + 1 in at else (0, 0))):
                if end <= start:
                    continue
                apart = root[start:end] != root[i]
                if across:
                    apart &= block[start:end] != block[i]
                js = np.flatnonzero(apart)
                first = at[q + fold][0]
                for held in (narrow, wide):
                    if len(js):
                        differ = np.bitwise_count(held[q + fold, fold][js + (start - first)] ^ held[q, 0][i - low]).sum(axis=1, dtype=np.int64)
                        js = js[7 * differ <= n[js + start] + n[i]]
                for j in (js + start).tolist():
                    if root[j] != root[i]:
                        both = shingles.common_count(sets[i], sets[j])
                        if 100 * both >= 75 * (n[i] + n[j] - both):
                            found.append((ids[i], ids[j]))
                            root[root == root[j]] = root[i]
    return found


def screened(rows: DataFrame, sets: DataFrame, n_parts: int, scratch: common.Scratch, name: str) -> DataFrame:
    """lead, i, j, own, r, c of the classes that may link with another of their bucket. rows: lead, r, c, n; sets: doc_id, n, signature.

    A bucket of many texts is dealt in blocks, and every two of its blocks meet in one place.
    """
    size = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sized = rows.groupBy("lead").agg(size.alias("blocks")).withColumnRenamed("lead", "_lead")
    dealt = rows.join(sized, F.col("lead") == F.col("_lead")).withColumn("own", F.pmod(F.xxhash64("r"), F.col("blocks")).cast("int"))
    dealt = dealt.select("lead", "r", "c", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("lead", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "r", "c")
    own = needed(sets.filter("n > 0").select("doc_id", "n", "signature"), rows.select(F.col("r").alias("id")), scratch, f"{name}-asked")
    placed = dealt.join(own, F.col("r") == F.col("doc_id")).select("lead", "i", "j", "own", "r", "c", "n", "signature")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def near() -> pa.RecordBatch:
            own, r, c, n, bits = zip(*held, strict=True)
            keep = np.flatnonzero(may_link(np.array(n, np.int64), np.array(c, np.int64), np.array(own), list(bits)))
            columns = [pa.array([key[0]] * len(keep), pa.int64()), *(pa.array([k] * len(keep), pa.int32()) for k in key[1:]), pa.array([own[k] for k in keep], pa.int32()), *(pa.array([x[k] for k in keep], pa.int64()) for x in (r, c))]
            return pa.RecordBatch.from_arrays(columns, names=["lead", "i", "j", "own", "r", "c"])

        for batch in batches:
            for part in slices(batch):
                for lead, i, j, *row in zip(*(x.to_pylist() for x in part.columns), strict=True):
                    if (lead, i, j) != key:
                        if len(held) > 1:
                            yield near()
                        key, held = (lead, i, j), []
                    held.append(row)
        if len(held) > 1:
            yield near()

    found = placed.repartition(n_parts, "lead", "i", "j").sortWithinPartitions("lead", "i", "j").mapInArrow(pick, "lead long, i int, j int, own int, r long, c long")
    return scratch.stage(found, name).distinct()


def compared(dealt: DataFrame, docs: DataFrame, n_parts: int, scratch: common.Scratch, name: str) -> DataFrame:
    """Links a, b between components, from every bucket of classes in blocks. dealt: lead, i, j, own, r, c."""
    docs = needed(docs, dealt.select(F.col("r").alias("id")), scratch, f"{name}-needed")
    # staged, so that the texts are not in two exchanges at a time
    placed = scratch.stage(dealt.join(docs, F.col("r") == F.col("doc_id")).select("lead", "i", "j", "own", "r", "c", "text"), f"{name}-texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, unpacker = None, [], zstandard.ZstdDecompressor()

        def links() -> pa.RecordBatch:
            ids, component, block, sets = zip(*held, strict=True)
            found = links_between(list(ids), np.array(component, np.int64), np.array(block), list(sets))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for part in slices(batch):
                columns = [part.column(k).to_pylist() for k in range(6)]
                sets = shingles.sets_of([unpacker.decompress(x) for x in part.column(6).to_pylist()])
                for lead, i, j, own, r, c, words in zip(*columns, sets, strict=True):
                    if (lead, i, j) != key:
                        if len(held) > 1:
                            yield links()
                        key, held = (lead, i, j), []
                    if len(words) and not (held and held[-1][0] == r and np.array_equal(held[-1][3], words)):
                        held.append((r, c, own, words))
        if len(held) > 1:
            yield links()

    packed = placed.mapInArrow(shrink, "lead long, i int, j int, own int, r long, c long, text binary")
    found = scratch.stage(packed.repartition(n_parts, "lead", "i", "j").sortWithinPartitions("lead", "i", "j", "r").mapInArrow(compare, "a long, b long"), name)
    scratch.drop(f"{name}-texts")
    return found


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "jaccard")
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    n_bytes = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = common.partitions(spark, math.ceil(n_bytes / PART_BYTES))
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << max(0, math.ceil(math.log2(max(1, n_bytes / 6 / CELL_SHINGLES))))))
    bitmap = spark.sparkContext.broadcast(sketched(own, cells, n_parts, scratch))
    sets = scratch.stage(document_sets(own, bitmap, cells), "sets")
    known = sets.filter("n > 0 and doc_id is not null")
    # the first of each group and class; hot ones pass through partial sums
    groups = known.groupBy("n", "prefix_digest").agg(F.min("doc_id").alias("g"), F.min_by("prefix", "doc_id").alias("prefix"))
    lists = scratch.stage(prefix_lists(groups, n_parts), "lists")
    classes = scratch.stage(known.groupBy("n", "prefix_digest", "set_digest").agg(F.min("doc_id").alias("r")), "classes")
    leads = classes.groupBy("n", "prefix_digest").agg(F.min("r").alias("g"))
    members = scratch.stage(classes.join(leads, ["n", "prefix_digest"]).select("g", "r"), "members")
    sets = scratch.stage(sets.drop("prefix"), "digests")
    known = sets.filter("n > 0 and doc_id is not null")
    scratch.drop("sets")  # with the prefixes, which the lists now hold
    texts = own.filter("doc_id is not null")
    first = lists.filter("g <> pivot").select(F.col("pivot").alias("a"), F.col("g").alias("b")).union(members.filter("g <> r").select("g", "r")).distinct()
    first = scratch.stage(first, "first")
    # a doc_id with several texts is in several classes
    keys = ["n", "set_digest", "prefix_digest"]
    texts_of = known.select("doc_id", *keys).distinct()
    several = texts_of.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("doc_id")
    repeated = texts_of.join(several, "doc_id").join(classes, keys).select(F.col("doc_id").alias("a"), F.col("r").alias("b"))
    links = scratch.stage(verified(first, sets, texts, n_parts, scratch, "checked1").union(repeated), "links1")
    done = scratch.stage(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "done")

    def labelled(links: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The components so far, and every class with its group and component."""
        found = scratch.stage(components(links, scratch, f"stars{k}"), f"found{k}")
        return found, scratch.stage(members.join(found, F.col("r") == F.col("node"), "left").select("g", "r", F.coalesce("component", F.col("r")).alias("c")), f"labelled{k}")

    found, labels = labelled(links, 1)
    for k in range(ROUNDS):
        picked = scratch.stage(strays(lists.select("h", "g", "n").join(light(labels.select("g", "c").distinct(), scratch, f"light{k}"), "g"), n_parts).join(done, ["a", "b"], "left_anti"), f"picked{k}")
        if not picked.limit(1).count():
            break
        more = verified(picked, sets, texts, n_parts, scratch, f"checked-picked{k}")
        done = done.union(picked)
        found, labels = labelled(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), k + 2)
    # what is still apart, in full
    parts = light(labels.select("g", "c").distinct(), scratch, "parts")
    split = labels.groupBy("g").agg((F.min("c") != F.max("c")).alias("split")).filter("split").select(F.col("g").alias("lead"), "g")
    apart = scratch.stage(seats(lists.select("h", "g", "n").join(parts, "g")).union(split).distinct(), "apart")
    scratch.drop("lists")
    rows = scratch.stage(apart.join(labels.select("g", "r", "c"), "g").select("lead", "r", "c").distinct().join(classes.groupBy("r").agg(F.max("n").alias("n")), "r"), "seats")
    if rows.limit(1).count():
        more = compared(screened(rows, sets, n_parts, scratch, "screened"), texts, n_parts, scratch, "compared")
        found = scratch.stage(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), scratch, "stars9"), "found9")
    named = classes.join(found, F.col("r") == F.col("node"), "left").select(*keys, F.coalesce("component", F.col("r")).alias("component_id"))
    named = scratch.stage(named, "named")
    # rows of one doc_id are one document: its smallest component
    rows = sets.select("doc_id", *keys).join(named, keys, "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(common.table(spark, sf_dir, "documents"))
