"""Fitting alignments against a whole table in plain Python, in bounded memory, once for each pair of sequences."""

import random
import subprocess
import sys

from pyspark.sql import functions as F

from siltstone.operators import residues

LIMIT = """
import random, resource
from siltstone.operators.residues import _fitted
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
r = random.Random(4)
a = "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(30_000))
score, md, pdb = _fitted(a, a[50:15_000] + a[15_030:])
assert score == 2 * 29_920 - 2 * 30 and len(md) == 29_950 and (pdb == 0).sum() == 30, score
used = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) / 1024
assert used < 200, used
"""


def whole(md, pdb):
    n, m = len(md), len(pdb)
    table = [[0] * (m + 1) for _ in range(n + 1)]
    table[0] = [-2 * j for j in range(m + 1)]
    pair = lambda i, j: table[i - 1][j - 1] + (2 if md[i - 1] == pdb[j - 1] else -1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            table[i][j] = max(pair(i, j), table[i - 1][j] - 2, table[i][j - 1] - 2)
    i = max(range(n + 1), key=lambda i: (table[i][m], -i))
    j, score, path = m, table[i][m], []
    while j:
        if i and table[i][j] == pair(i, j):
            path.append((i, j))
            i, j = i - 1, j - 1
        elif i and table[i][j] == table[i - 1][j] - 2:
            path.append((i, None))
            i -= 1
        else:
            path.append((None, j))
            j -= 1
    return score, path[::-1]


def test_same_paths_as_the_whole_table():
    r = random.Random(7)
    for _ in range(400):
        letters = "ABCD"[: r.choice([1, 2, 4])]
        a, b = ("".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(2))
        assert residues.fitted(a, b) == whole(a, b)
    assert residues.fitted("XXABCDEYY", "ABCDE") == (10, [(3, 1), (4, 2), (5, 3), (6, 4), (7, 5)])


def test_long_chains_in_bounded_memory():
    """30,000 letters against 29,920: the whole table would take 3.6 GB."""
    done = subprocess.run([sys.executable, "-c", LIMIT], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr


def test_equal_pairs_are_aligned_once(spark):
    rows = [(k, "XXABCDEYY" if k % 3 else None, "ABCDE" if k % 5 else "") for k in range(60)]
    df = residues.aligned(spark.createDataFrame(rows, "structure_id long, md_sequence string, pdb_sequence string"))
    for r in df.collect():
        score, path = whole(r["md_sequence"] or "", r["pdb_sequence"] or "")
        assert (r["score"], [(p["md"], p["pdb"]) for p in r["pairs"]]) == (score, path)
        assert r["matches"] == sum(i is not None and j is not None for i, j in path) and r["md_insertions"] == 0 and r["pdb_deletions"] == sum(i is None for i, _ in path)
    assert df.count() == 60
    seen = spark.sparkContext.accumulator(0)
    own = residues._alignments

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield from own(iter([b]))

    residues._alignments = counted
    try:
        residues.aligned(spark.createDataFrame(rows, "structure_id long, md_sequence string, pdb_sequence string")).agg(F.sum("score")).collect()
    finally:
        residues._alignments = own
    assert seen.value == 4
