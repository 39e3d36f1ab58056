"""Runs against a brute force in plain Python, over random words, whole tables and awkward rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from siltstone.llm import periodic_runs
from siltstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def least_period(words):
    """By the borders of the words."""
    border = [0] * len(words)
    for i in range(1, len(words)):
        k = border[i - 1]
        while k and words[i] != words[k]:
            k = border[k - 1]
        border[i] = k + (words[i] == words[k])
    return len(words) - border[-1]


def brute(words):
    found = set()
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(24, 3 * p) and least_period(words[i : j + p]) == p:
                found.add((i, j - i + p, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, repeat=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if repeat and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_random_words():
    r = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(r.randint(1, 5)):
            words, k = [], r.choice([1, 2, 3])
            for _ in range(r.randint(0, 5)):
                words += [r.randint(0, k) for _ in range(r.randint(0, 12))]
                words += ([r.randint(0, k) for _ in range(r.randint(1, 12))] * r.randint(1, 12))[: r.randint(1, 90)]
            texts.append(words)
        sizes = np.array([len(x) for x in texts], np.int64)
        got = periodic_runs.runs_of(np.array([w for x in texts for w in x], np.int64), sizes)
        assert got == [brute(x) for x in texts]


def test_blocks_and_deceiving_hashes(monkeypatch):
    """Small blocks of pairs find the same; words that hash alike are told apart by the words themselves."""
    words = [k % 7 for k in range(60)] + [9, 8] + [k % 3 for k in range(40)] + [5] * 30 + list(range(50))
    ids, sizes = np.array(words * 2, np.int64), np.array([len(words), len(words)])
    want = [brute(words)] * 2
    assert want[0] and periodic_runs.runs_of(ids, sizes) == want
    monkeypatch.setattr(periodic_runs, "BLOCK_PAIRS", 50)
    assert periodic_runs.runs_of(ids, sizes) == want
    monkeypatch.setattr(periodic_runs, "BASE", 1)  # sums of words: any order hashes alike
    assert periodic_runs.runs_of(ids, sizes) == want


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_query_over_the_whole_table(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    rows = sorted(map(tuple, QUERIES["op11_periodic_runs"](spark, SF).collect()))
    assert rows == sorted(expected(d["doc_id"], d["text"]) for d in docs)
    assert sum(r[1] > 0 for r in rows) > 10


def test_awkward_rows(spark, awkward, nothing):
    """Nulls, blank and very long texts, ties, repeated rows and clashing columns; texts whose spaces are not the pattern's."""
    rows = [(1, "a b c " * 30), (2, "x " * 23), (3, "x " * 24), (4, "p q " * 30 + "  \x1c"), (5, "k " * 30 + "a b " * 30), (None, "z " * 40), (7, "w1 w2 w3\n" * 9_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(awkward.select("doc_id", "text"))
    key = lambda r: tuple((x is not None, x) for x in r[:2]) + (r[6], r[7])
    plain = df.collect()
    for repeat in (False, True):
        want = sorted((expected(r["doc_id"], r["text"], repeat) for r in plain if len(r["text"] or "") < 30_000), key=key)
        got = [r for r in map(tuple, periodic_runs.periodic_runs(df, repeat=repeat).collect())]
        assert len(got) == len(plain)
        short = sorted((r for r in got if r[0] not in (7, 103, 104) or r[0] == 7 and (r[3] or 0) < 1000), key=key)
        assert short == want
    assert next(r for r in got if r[0] == 7 and (r[3] or 0) > 1000)[2:5] == (0, 27_000, 3)
    clash = awkward.withColumn("n_runs", awkward["row"]).withColumn("start", awkward["row"])
    assert periodic_runs.periodic_runs(clash).count() == awkward.count()
    assert periodic_runs.periodic_runs(nothing).count() == 0
