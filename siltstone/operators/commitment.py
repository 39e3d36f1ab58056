"""Commitments of tables: a hash tree over the rows in a stated order, its root, and proofs that a row is in it.

Rows are numbered by range partitions, so the tree doesn't depend on how they lie. A node is the hash of up to FAN nodes below, so
a level has FAN times fewer rows than the one under it and is one aggregation; only the root reaches the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.staging import Scratch, numbered

FAN = 64
#: What a tree of no rows has for its root.
EMPTY = hashlib.sha256(b"").hexdigest()


def row_json(columns: list[str]) -> Column:
    """A row as JSON: the columns in order of name, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def leaves(rows: DataFrame, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """rows with leaf, the hash of their columns as JSON. Rows that are equal in the order come by their leaf."""
    return rows.withColumn("leaf", F.sha2(F.concat(F.lit("leaf:"), row_json(columns or rows.columns)), 256))


class Tree:
    """The levels of a tree over rows, staged in the shared folder; `drop` it when it has served."""

    def __init__(self, rows: DataFrame, order: list[str], columns: list[str] | None = None, fan: int = FAN):
        if fan < 2:
            raise ValueError("a node has two nodes below at least")
        self.scratch, self.fan = Scratch(rows.sparkSession, "tree"), fan
        staged = self.scratch.stage(leaves(rows, order, columns), "leaves")
        self.rows = self.scratch.stage(numbered(staged, [*order, "leaf"], "place", scratch=self.scratch), "rows")
        self.n = self.rows.count()
        level, size = self.rows.select("place", F.col("leaf").alias("digest")), self.n
        self.levels = [level]
        while size > 1:
            level = self.scratch.stage(self._above(level), f"level-{len(self.levels)}")
            self.levels.append(level)
            size = -(-size // fan)

    def _above(self, level: DataFrame) -> DataFrame:
        run = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])
        joined = F.sha2(F.concat(F.lit("node:"), F.array_join(run, "")), 256)
        return level.groupBy(F.expr(f"place div {self.fan}").alias("place")).agg(joined.alias("digest"))

    def root(self) -> str:
        """The hash over the number of rows and the top node, so that trees of other heights can't stand for each other."""
        top = self.levels[-1].first()["digest"] if self.n else EMPTY
        return hashlib.sha256(f"{self.n}:{top}".encode()).hexdigest()

    def proofs(self, rows: DataFrame | None = None) -> DataFrame:
        """Rows of the tree (or those places) with proof: for each level the digests before and after the row's node in its run."""
        own = (rows if rows is not None else self.rows).withColumn("proof", F.array().cast("array<struct<before:array<string>,after:array<string>>>")).withColumn("_at", F.col("place"))
        for level in self.levels[:-1]:
            runs = level.groupBy(F.expr(f"place div {self.fan}").alias("_run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]).alias("_digests"))
            at = (F.col("_at") % self.fan).cast("int")
            own = own.withColumn("_up", F.expr(f"_at div {self.fan}")).join(runs, F.col("_up") == F.col("_run"))
            step = F.struct(F.slice("_digests", F.lit(1), at).alias("before"), F.slice("_digests", at + 2, F.greatest(F.size("_digests") - at - 1, F.lit(0))).alias("after"))
            own = own.withColumn("proof", F.concat("proof", F.array(step))).withColumn("_at", F.col("_up")).drop("_up", "_run", "_digests")
        return own.drop("_at")

    def drop(self) -> None:
        self.scratch.drop()


def proven(proofs: DataFrame, n: int, root: str) -> DataFrame:
    """Adds verified: whether leaf and proof give the root of a tree of n rows. proofs: leaf, proof."""
    def step(acc: Column, level: Column) -> Column:
        return F.sha2(F.concat(F.lit("node:"), F.array_join(level["before"], ""), acc, F.array_join(level["after"], "")), 256)

    top = F.aggregate("proof", F.col("leaf"), step)
    return proofs.withColumn("verified", F.sha2(F.concat(F.lit(f"{n}:"), top), 256) == root)


def root_of(rows: DataFrame, order: list[str], columns: list[str] | None = None, fan: int = FAN) -> str:
    tree = Tree(rows, order, columns, fan)
    try:
        return tree.root()
    finally:
        tree.drop()
