"""Sharding by a k-d tree over document metadata.

Every document is a point: its id, the length of its text, its source and its language. A node is split along its
widest dimension (the largest share of that dimension's range over all documents) at the weighted median, so that
both sides' bytes are in proportion to the shards below them, until leaves reach the target.

The median comes from histograms: all open nodes' keys are counted in bins at once, the bin that holds the
median is counted again in finer bins, and so on until one row or key is left. The nodes are a table, one row each, that
rows find by the name of their node, so the tree may have as many shards as the target asks for: nothing of it is held by
the driver. Equal values are told apart by a hash and at last by the row itself, so a hot source, copies and repeated rows
split as well as any.

Null texts weigh the row overhead alone; null ids, sources and languages lie first in their dimension; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import common

ROW_BYTES, SHARDS, SLOT_ROWS = 16, 40, 5_000
#: A key: VALUE_BITS of the value's place in its range, TIE_BITS of a hash; each histogram reads BIN_BITS of it.
VALUE_BITS, TIE_BITS, BIN_BITS = 32, 30, 11
DIMENSIONS = ("by_id", "by_length", "by_source", "by_lang")
#: The nodes of a level are broadcast up to so many, and shuffled beyond.
BROADCAST_NODES = 200_000


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions as numbers, and a row number for ties."""
    text = F.coalesce(F.col("text"), F.lit(""))
    code = lambda c: F.coalesce(F.crc32(F.col(c).cast("binary")), F.lit(-1)).cast("double")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300)).alias("by_id"),
        F.length(text).cast("double").alias("by_length"),
        code("source").alias("by_source"),
        code("lang").alias("by_lang"),
        F.monotonically_increasing_id().alias("row"),
    )


def with_keys(staged: DataFrame, low: dict[str, float], high: dict[str, float]) -> DataFrame:
    """Each dimension as a sortable whole number: place in the range, then a hash of the row."""
    tie = F.shiftrightunsigned(F.xxhash64("doc_id", "row"), 64 - TIE_BITS)

    def key(c: str) -> Column:
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - low[c]) / max(high[c] - low[c], 1e-9)))
        return F.shiftleft(F.floor(share * ((1 << VALUE_BITS) - 1)).cast("long"), TIE_BITS).bitwiseOR(tie)

    return staged.select("doc_id", "size", "text_crc32", "row", *(key(c).alias(c) for c in DIMENSIONS))


def small(nodes: DataFrame, most: int) -> DataFrame:
    """nodes with a hint to broadcast them, if there are at most BROADCAST_NODES."""
    return F.broadcast(nodes) if most <= BROADCAST_NODES else nodes


def widest(rows: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """node, first, shards and the dimension in which each open node is widest, of equal ones the first; none without rows."""
    widths = rows.groupBy("node").agg(*((F.max(c) - F.min(c)).alias(f"_{c}") for c in DIMENSIONS))
    top = F.greatest(*(F.col(f"_{c}") for c in DIMENSIONS))
    dimension = F.coalesce(*(F.when(F.col(f"_{c}") == top, F.lit(c)) for c in DIMENSIONS))
    return widths.join(small(nodes.filter("shards > 1"), most), "node").select("node", "first", "shards", dimension.alias("dimension"))


def refined(keyed: DataFrame, nodes: DataFrame, bits: int, most: int) -> DataFrame:
    """The nodes with the bin of their median among BIN_BITS more bits of the key, of which `bits` are left to read.

    prefix: the bin so far; below: the bytes before it; total: the node's bytes; rows: how many are in the bin; cut: keys up to it go left.
    """
    left = bits - min(BIN_BITS, bits)
    held = keyed.join(small(nodes.select("node", "prefix"), most), "node").filter(F.shiftright("key", bits) == F.col("prefix"))
    bins = held.groupBy("node", F.shiftright("key", left).alias("bin")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    each = Window.partitionBy("node")  # 2**BIN_BITS rows for each node at most
    so_far = F.sum("bytes").over(each.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = bins.withColumn("sum", F.sum("bytes").over(each)).withColumn("before", so_far - F.col("bytes"))
    own = own.join(small(nodes.drop("rows", "cut"), most), "node").withColumn("total", F.coalesce("total", "sum"))
    own = own.withColumn("goal", F.col("total") * (F.floor(F.col("shards") / 2) / F.col("shards"))).withColumn("below", F.col("below") + F.col("before"))
    nearer = F.abs(F.col("below") + F.col("bytes") - F.col("goal")) < F.abs(F.col("goal") - F.col("below"))
    own = own.withColumn("cut", F.shiftleft(F.col("bin") + nearer.cast("long"), left) - 1)
    median = F.min_by(F.struct(F.col("bin").alias("prefix"), "below", "total", "rows", "cut"), "bin")
    return own.filter(F.col("below") + F.col("bytes") > F.col("goal")).groupBy("node", "first", "shards", "dimension").agg(median.alias("m")).select("node", "first", "shards", "dimension", "m.*")


def cuts(scratch: common.Scratch, rows: DataFrame, nodes: DataFrame, level: int, most: int) -> DataFrame:
    """node, first, shards, dimension and cut of each open node. Bins are refined until those with the medians hold one row or key."""
    own = scratch.stage(widest(rows, nodes, most), f"open{level}")
    key = F.coalesce(*(F.when(F.col("dimension") == c, F.col(c)) for c in DIMENSIONS))
    keyed = scratch.stage(rows.join(small(own.select("node", "dimension"), most), "node").select("node", "size", key.alias("key")), f"keyed{level}")
    own = own.withColumns({"prefix": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "total": F.lit(None).cast("long")})
    for bits in range(VALUE_BITS + TIE_BITS, 0, -BIN_BITS):
        own = scratch.stage(refined(keyed, own, bits, most), f"median{level}-{bits}")
        if (own.agg(F.max("rows")).first()[0] or 0) <= 1:
            break
    scratch.drop(f"keyed{level}")
    return own.select("node", "first", "shards", "dimension", "cut")


def tree(docs: DataFrame, n_shards: int) -> DataFrame:
    """doc_id, size, text_crc32, row and shard of every document."""
    scratch = common.Scratch(docs.sparkSession, "kd-shards")
    staged = scratch.stage(points(docs), "points")
    ends = staged.agg(*(f(c).alias(f"{n}_{c}") for c in DIMENSIONS for f, n in ((lambda c: F.min(F.when(F.col(c) > -1e300, F.col(c))), "min"), (F.max, "max")))).first()
    low, high = ({c: ends[f"{n}_{c}"] or 0.0 for c in DIMENSIONS} for n in ("min", "max"))
    rows = scratch.stage(with_keys(staged, low, high).withColumn("node", F.lit(1).cast("long")), "rows0")
    nodes = docs.sparkSession.range(1, 2).select(F.col("id").alias("node"), F.lit(0).alias("first"), F.lit(n_shards).alias("shards"))
    for level in range((n_shards - 1).bit_length()):
        most = min(1 << level, n_shards)
        split = cuts(scratch, rows, nodes, level, most)
        half = F.floor(F.col("shards") / 2).cast("int")
        side = lambda node, first, shards: F.struct(node.alias("node"), first.alias("first"), shards.alias("shards"))
        both = F.array(side(F.col("node") * 2, F.col("first"), half), side(F.col("node") * 2 + 1, F.col("first") + half, F.col("shards") - half))
        nodes = scratch.stage(split.select(F.explode(both).alias("x")).select("x.*").unionByName(nodes.filter("shards = 1")), f"nodes{level}")
        key = F.coalesce(*(F.when(F.col("dimension") == c, F.col(c)) for c in DIMENSIONS))
        node = F.when(F.col("cut").isNull(), F.col("node")).otherwise(F.col("node") * 2 + (key > F.col("cut")).cast("long"))
        rows = scratch.stage(rows.join(small(split.select("node", "dimension", "cut"), most), "node", "left").select(*rows.drop("node").columns, node.alias("node")), f"rows{level + 1}")
        scratch.drop(f"rows{level}")
    return scratch.stage(rows.join(small(nodes.select("node", F.col("first").alias("shard")), n_shards), "node").select("doc_id", "size", "text_crc32", "row", "shard"), "leaves")


def with_slots(placed: DataFrame) -> DataFrame:
    """Adds slot: a row's place in its shard. Shards are cut into parts, so that none is ordered in one task."""
    parts = max(1, -(-placed.count() // SLOT_ROWS))
    own = placed.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    return own.withColumn("within", within).join(sums, ["shard", "part"]).withColumn("slot", F.col("before") + F.col("within") - 1).drop("before", "within", "part")


def shards(docs: DataFrame, *, n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot; as many shards as asked for, or as the target needs."""
    if n_shards is None:
        total = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + ROW_BYTES)).first()[0] or 0
        n_shards = max(1, -(-total // (target_bytes or 1 << 30)))
    return with_slots(tree(docs, n_shards))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards(common.table(spark, sf_dir, "documents"), n_shards=SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
