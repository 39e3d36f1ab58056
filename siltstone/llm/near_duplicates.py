"""One row of each component of near copies: the similarity join applied to a table whose rows may share ids, or have none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import common, jaccard_join


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of texts stays, the one of its document with the smallest id; texts without words all stay.

    A text is judged by itself: where rows share an id, or have none, but differ in their texts, each text gets an id of
    its own for the join. Of rows equal in id and text the one with the least hash of all columns stays, so the outcome
    doesn't depend on partitioning. An empty table gives no rows; a very long text is whole in a task.
    """
    scratch = common.Scratch(docs.sparkSession, "near-duplicates")
    keyed = docs.select(F.struct(*docs.columns).alias("_kept"), "doc_id", "text", F.xxhash64("text").alias("_digest"))
    # ids with several texts, and texts without id: few, each with a number below all ids
    texts = keyed.groupBy("doc_id", "_digest").agg(F.count(F.lit(1)).alias("_rows"))
    several = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1 or doc_id is null").select(F.col("doc_id").alias("_id"))
    least = F.lit(min(0, docs.agg(F.min("doc_id")).first()[0] or 0))
    named = scratch.stage(texts.join(several, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(F.col("doc_id").alias("_id"), F.col("_digest").alias("_text"), (least - 1 - F.monotonically_increasing_id()).alias("_own")), "named")
    nodes = lambda df: df.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_text")), "left").withColumn("_node", F.coalesce("_own", "doc_id"))
    found = jaccard_join.joined(nodes(keyed).select(F.col("_node").alias("doc_id"), "text")).filter("n_shingles > 0").select("doc_id", "component_id").distinct()
    found = found.join(named.withColumnsRenamed({"_id": "_was"}), F.col("doc_id") == F.col("_own"), "left")
    order = F.struct(F.coalesce("_was", F.when(F.col("_own").isNull(), F.col("doc_id")), F.lit((1 << 63) - 1)), F.coalesce("_text", F.lit(0)))
    found = scratch.stage(found.select("doc_id", "component_id", order.alias("order")), "found")
    stays = found.groupBy("component_id").agg(F.min_by("doc_id", "order").alias("stays")).withColumnRenamed("component_id", "_component")
    gone = scratch.stage(found.join(stays, F.col("component_id") == F.col("_component")).filter("doc_id <> stays").select(F.col("doc_id").alias("_gone")), "gone")
    left = lambda df: nodes(df).join(gone, F.col("_node") == F.col("_gone"), "left_anti")
    # equal rows: only ids and texts with several rows are looked at again
    many = scratch.stage(texts.filter("_rows > 1").select(F.col("doc_id").alias("_many"), F.col("_digest").alias("_same")), "many")
    is_many = F.col("doc_id").eqNullSafe(F.col("_many")) & (F.col("_digest") == F.col("_same"))
    has_words = F.length(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "")) > 0
    again = left(keyed.join(many, is_many, "left_semi")).withColumn("_row", F.xxhash64("_kept"))
    least_row = again.groupBy("_node").agg(F.min("_row").alias("_first")).withColumnRenamed("_node", "_of")
    first = again.filter(has_words).join(least_row, (F.col("_node") == F.col("_of")) & (F.col("_row") == F.col("_first")), "left_semi").dropDuplicates(["_node"])
    parts = left(keyed.join(many, is_many, "left_anti")), again.filter(~has_words), first
    return parts[0].select("_kept.*").union(parts[1].select("_kept.*")).union(parts[2].select("_kept.*"))
