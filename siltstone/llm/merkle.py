"""Merkle manifest of a dataset: a tree over each source's rows, a tree over the sources, and a proof for each row.

Spark numbers the leaves of a source and cuts them into buckets of ARITY ** LEVELS consecutive ones. A bucket is aligned
with the tree, so its levels need nothing from outside: an executor reduces it with DuckDB, one ordered string_agg and
sha256 a level. The roots of the buckets are the nodes of the next round, until each tree has one node; what a round
learns of a node's siblings is joined to its bucket, and a second pass over the leaves folds them up to the root.

A source of any size is many buckets, so no task holds more than a bucket, and the driver only gets how many rounds there are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.staging import numbered
from siltstone.llm import common

ARITY, LEVELS = 3, 7
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left:string,right:string>>"
_NODES = "tree long, place long, size long, digest string"
_COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def leaf(fields: list[Column]) -> Column:
    """Each field as its UTF-8 byte count, a colon and itself, or as a dash if null; hashed."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)), 256)


def tampered(doc_id: Column, text: Column) -> Column:
    """The text without its line ends where 2 divides the id's checksum; rows without id stay."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"))).otherwise(text)


def _duckdb():
    """This worker's connection: one thread, and no files of its own."""
    global _connection
    if _connection is None:
        import duckdb

        _connection = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    return _connection


_connection = None


def _levels_left(size: int, levels: int) -> int:
    """How many levels of a tree of so many nodes lie within a bucket: none above its root."""
    n = 0
    while n < levels and size > 1:
        size, n = -(-size // ARITY), n + 1
    return n


def _reduced(bucket: pa.Table, levels: int):
    """The levels of one bucket by DuckDB: its root, and the connection that holds the steps of each node in table path.

    bucket: place, size, digest. Each level is one ordered string_agg of the runs; a node's siblings are its run without
    itself, cut out by its place there, as all digests have one length.
    """
    con, width = _duckdb(), 64
    con.register("bucket", bucket)
    con.execute("CREATE OR REPLACE TEMP TABLE level_ AS SELECT place AS node, digest FROM bucket")
    con.execute("CREATE OR REPLACE TEMP TABLE path AS SELECT place, place AS node, []::STRUCT(l VARCHAR, r VARCHAR)[] AS steps FROM bucket")
    for _ in range(_levels_left(bucket.column("size")[0].as_py(), levels)):
        con.execute(f"CREATE OR REPLACE TEMP TABLE runs AS SELECT node // {ARITY} AS run, min(node) AS start, string_agg(digest, '' ORDER BY node) AS joined FROM level_ GROUP BY run")
        con.execute(f"""CREATE OR REPLACE TEMP TABLE path AS SELECT place, run AS node,
            list_append(steps, {{'l': joined[1:{width} * (node - start)], 'r': joined[{width} * (node - start + 1) + 1:]}}) AS steps FROM path JOIN runs ON node // {ARITY} = run""")
        con.execute("CREATE OR REPLACE TEMP TABLE level_ AS SELECT run AS node, sha256(joined) AS digest FROM runs")
    root = con.execute("SELECT digest FROM level_").fetchall()[0][0]
    return root, con


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """tree, place, size, digest of the buckets: the nodes of the next round."""
    whole = ARITY**levels

    def root(key, table):
        size = table.column("size")[0].as_py()
        digest, _ = _reduced(table, levels)
        return pa.table({"tree": [key[0].as_py()], "place": [key[1].as_py()], "size": [-(-size // whole)], "digest": [digest]})

    return nodes.select("tree", "place", "size", "digest").groupBy("tree", _bucket(levels)).applyInArrow(root, _NODES)


def _bucket(levels: int) -> Column:
    return F.expr(f"place div {ARITY**levels}").alias("bucket")


def _steps(nodes: DataFrame, levels: int) -> DataFrame:
    """tree, place and the steps of each node within its bucket."""

    def steps(key, table):
        _, con = _reduced(table, levels)
        found = con.sql("SELECT place, list_transform(steps, lambda s: {'left': s.l, 'right': s.r}) AS steps FROM path").to_arrow_table()
        return pa.table({"tree": pa.array([key[0].as_py()] * found.num_rows, pa.int64()), "place": found.column("place").cast(pa.int64()), "steps": found.column("steps").cast(pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))})

    return nodes.select("tree", "place", "size", "digest").groupBy("tree", _bucket(levels)).applyInArrow(steps, f"tree long, place long, steps {_STEPS}")


def _climbed(nodes: DataFrame, levels: int, scratch: common.Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """The roots (tree, root) of the trees of these nodes, and (tree, place, steps) of every node up to its tree's root."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    rounds = []
    while largest > 1:
        rounds.append(scratch.stage(_steps(nodes, levels), f"{name}-steps-{len(rounds)}"))
        nodes = scratch.stage(_roots(nodes, levels), f"{name}-nodes-{len(rounds)}")
        largest = -(-largest // ARITY**levels)
    roots = nodes.select("tree", F.col("digest").alias("root"))
    if not rounds:
        return roots, nodes.select("tree", "place", F.array().cast(_STEPS).alias("steps"))
    above = rounds[-1]
    for below in reversed(rounds[:-1]):
        upper = above.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"), F.col("steps").alias("_steps"))
        above = below.join(upper, (F.col("tree") == F.col("_tree")) & (F.expr(f"place div {ARITY**levels}") == F.col("_place"))).select("tree", "place", F.concat("steps", "_steps").alias("steps"))
    return roots, above


def _proven(leaves: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """The result's rows: a bucket of leaves meets the one row of what lies above it, and DuckDB folds both."""
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def prove(table, above):
        rows = table.select(["place", "size", "digest"])
        _, con = _reduced(rows, levels)
        con.register("leaves", table)
        con.register("above", above)
        con.execute("CREATE OR REPLACE TEMP TABLE folded AS SELECT place, changed AS digest, '' AS proof, steps FROM leaves JOIN path USING (place)")
        most = con.execute("SELECT max(len(steps)) FROM folded").fetchall()[0][0] or 0
        for k in range(1, most + 1):
            con.execute(f"CREATE OR REPLACE TEMP TABLE folded AS SELECT place, sha256(steps[{k}].l || digest || steps[{k}].r) AS digest, proof || steps[{k}].l || steps[{k}].r AS proof, steps FROM folded")
        for s in above.column("steps")[0].as_py():
            con.execute("CREATE OR REPLACE TEMP TABLE folded AS SELECT place, sha256(? || digest || ?) AS digest, proof, steps FROM folded", [s["left"], s["right"]])
        outer_proof = "".join(s["left"] + s["right"] for s in above.column("steps")[0].as_py())
        query = "SELECT doc_id, l.digest AS leaf, a.subroot, a.root, sha256(f.proof || $outer) AS proof_sha256, f.digest AS folded_root, f.digest = a.root AS verified FROM leaves l JOIN folded f USING (place), above a"
        return con.sql(query, params={"outer": outer_proof}).to_arrow_table().cast(pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in _COLUMNS[1:-1]), ("verified", pa.bool_())]))

    buckets = leaves.select("tree", "place", "size", "digest", "changed", "doc_id").groupBy("tree", _bucket(levels))
    return buckets.cogroup(outer.groupBy("tree", "bucket")).applyInArrow(prove, schema)


def manifest(docs: DataFrame, scratch: common.Scratch, levels: int = LEVELS) -> DataFrame:
    """Per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves ascend by doc_id in their source, rows without id first, rows that share an id by their digest; rows equal in
    all fields have equal leaves and places of their own. Rows without source form a source, which is first. Null and empty
    texts are leaves like others, a very long text is hashed where it is read, columns besides FIELDS are ignored, and an
    empty table has no rows.
    """
    own = docs.select(*(F.col(c) for c in FIELDS))
    digests = own.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        leaf([F.col(c) for c in FIELDS]).alias("digest"), leaf([*(F.col(c) for c in FIELDS[:-1]), tampered(F.col("doc_id"), F.col("text"))]).alias("changed"),
    )
    leaves = scratch.stage(digests, "leaves")
    placed = numbered(leaves, ["doc_id", "digest"], "place", within=["source"], scratch=scratch)
    sizes = scratch.stage(leaves.groupBy("source").agg(F.count(F.lit(1)).alias("size")), "sizes")
    trees = scratch.stage(numbered(sizes, ["source"], "tree", scratch=scratch).withColumnsRenamed({"source": "_source"}), "trees")
    leaves = scratch.stage(placed.join(trees, F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source"), "placed")
    # within the sources, then over them
    buckets = scratch.stage(_roots(leaves, levels), "buckets")
    subroots, inner = _climbed(buckets, levels, scratch, "source")
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(trees.count()).cast("long").alias("size"), F.col("root").alias("digest"))
    tops = scratch.stage(tops, "tops")
    roots, outer = _climbed(tops, levels, scratch, "top")
    up = outer.join(roots.withColumnRenamed("tree", "_t"), F.col("tree") == F.col("_t")).select(F.col("place").alias("_source"), F.col("steps").alias("_outer"), "root")
    up = up.join(subroots.select(F.col("tree").alias("_sub"), F.col("root").alias("subroot")), F.col("_source") == F.col("_sub"))
    above = inner.join(up, F.col("tree") == F.col("_source")).select("tree", F.col("place").alias("bucket"), F.concat("steps", "_outer").alias("steps"), "subroot", "root")
    return _proven(leaves, scratch.stage(above, "above"), levels)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(common.table(spark, sf_dir, "documents"), common.Scratch(spark, "merkle"))


def _oracle(depth: int = 16) -> str:
    """DuckDB SQL of the query, levels written out; ARITY ** depth rows a source at most."""
    fields = lambda text: " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in (*(f"CAST({c} AS VARCHAR)" for c in FIELDS[:-1]), text))
    levels = lambda name, start, by: [f"{name}0 AS ({start})"] + [
        f"""{name}{k} AS (SELECT {by}, min(node) // {ARITY} AS node, CASE WHEN min(n) > 1 THEN sha256(string_agg(d, '' ORDER BY node)) ELSE min(d) END AS d,
        CASE WHEN min(n) > 1 THEN string_agg(d, '' ORDER BY node) ELSE '' END AS run, CAST(ceil(min(n) / {ARITY}.0) AS BIGINT) AS n FROM {name}{k - 1} GROUP BY {by}, node // {ARITY})""" for k in range(1, depth + 1)]  # fmt: skip
    climb = lambda name, tree, start: [f"{name}_p0 AS ({start})"] + [
        f"""{name}_p{k} AS (SELECT p.* REPLACE (p.node // {ARITY} AS node, CASE WHEN q.run = '' THEN p.cur ELSE sha256(q.run[1:64 * (p.node % {ARITY})] || p.cur || q.run[64 * (p.node % {ARITY} + 1) + 1:]) END AS cur,
        p.proof || q.run[1:64 * (p.node % {ARITY})] || q.run[64 * (p.node % {ARITY} + 1) + 1:] AS proof) FROM {name}_p{k - 1} p JOIN {name}{k} q ON p.{tree} = q.{tree} AND p.node // {ARITY} = q.node)""" for k in range(1, depth + 1)]  # fmt: skip
    table = ["t0 AS (SELECT i, i AS c FROM range(256) r(i))", *(f"t{k} AS (SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END AS c FROM t{k - 1})" for k in range(1, 9)), "crc_table AS (SELECT list(c ORDER BY i) AS t FROM t8)"]
    odd = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])) % 2"
    parts = [
        *table,
        f"leaves AS (SELECT doc_id, source, sha256({fields('text')}) AS d, sha256({fields(f'CASE WHEN {odd} = 1 THEN replace(text, chr(10), repeat(chr(10), 0)) ELSE text END')}) AS changed FROM documents, crc_table)",
        "trees AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) AS n FROM leaves GROUP BY source)",
        "placed AS (SELECT l.*, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS node FROM leaves l JOIN trees t ON l.source IS NOT DISTINCT FROM t.source)",
        *levels("s", "SELECT tree, node, d, '' AS run, n FROM placed", "tree"),
        *levels("r", f"SELECT 0 AS top, tree AS node, d, '' AS run, (SELECT count(*) FROM trees) AS n FROM s{depth}", "top"),
        *climb("s", "tree", "SELECT doc_id, d AS leaf, tree, node, changed AS cur, '' AS proof FROM placed"),
        *climb("r", "top", f"SELECT doc_id, leaf, tree, 0 AS top, tree AS node, cur, proof FROM s_p{depth}"),
    ]
    return f"WITH {', '.join(parts)} SELECT p.doc_id, p.leaf, s.d AS subroot, r.d AS root, sha256(p.proof) AS proof_sha256, p.cur AS folded_root, p.cur = r.d AS verified FROM r_p{depth} p JOIN s{depth} s ON p.tree = s.tree, r{depth} r"


ORACLE = _oracle()
