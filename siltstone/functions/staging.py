"""Tables staged in the shared folder of the cluster, and ordinals that no single task has to count."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark removes an execution's shuffle files when it ends if this is on.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: monotonically_increasing_id holds the partition above this many bits, the row below.
ROW_BITS = 33


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where driver and executor are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within this block an execution's shuffle files go when it ends, not when the driver collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


class Scratch:
    """Tables staged in the shared folder. They cut lineage, so a lost executor costs a reread and not a rerun."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/siltstone/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def stage(self, df: DataFrame, name: str, *, partition_by: list[str] | None = None) -> DataFrame:
        """Write df and return it as read back."""
        to = f"{self.path}/{name}"
        with shuffles_removed(self.spark):
            writer = df.write.option("compression", "zstd")
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self, name: str = "") -> None:
        """Delete one staged table, or all of them."""
        with contextlib.suppress(Exception):  # at exit the JVM may be gone; what is left then is only a leftover
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, keys: list[str], name: str = "ordinal", *, within: list[str] | None = None, scratch: Scratch | None = None, parts: int | None = None) -> DataFrame:
    """df with the 0-based place of each row in the order of keys, over all rows or within each group of `within`.

    Rows are dealt to ranges of the order and sorted there; a range's rows are counted, and its places follow from the
    counts of the ranges before it. No task sees more than its range, also where one key or one group has most rows: equal
    keys are told apart by the row's place in the input, which must therefore be a table (or a staged one) and not a join.
    Nulls are first and equal to each other. An empty table stays empty.
    """
    spark, groups = df.sparkSession, within or []
    scratch = scratch or Scratch(spark, "numbered")
    taken = {"_again", "_place", "_part", "_first", "_before", name} | {f"_group{k}" for k in range(len(groups))}
    if clash := taken & set(df.columns):
        raise ValueError(f"columns already there: {sorted(clash)}")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*groups, *keys, "_again"]
    ranged = df.withColumn("_again", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = scratch.stage(ranged.drop("_again").withColumn("_place", F.monotonically_increasing_id()), f"{name}-placed")
    part = F.shiftright("_place", ROW_BITS)
    own = [F.col(g).alias(f"_group{k}") for k, g in enumerate(groups)]
    counts = placed.groupBy(part.alias("_part"), *own).agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*(f"_group{k}" for k in range(len(groups))) if groups else [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    if not groups:
        starts = F.broadcast(starts)  # a row for each of `parts` ranges
    same = part == F.col("_part")
    for k, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_group{k}"))
    return placed.join(starts, same).withColumn(name, F.col("_place") - F.col("_first") + F.col("_before")).select(*df.columns, name)
