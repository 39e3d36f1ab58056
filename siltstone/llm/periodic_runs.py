"""Runs of words that repeat with a period, found on a harmonic grid with prefix hashes.

A run of period p and length 3p or more covers two neighbouring grid points j and j + p (multiples of p), and the words from
the first such j agree with those from j + p over at least LEAST_MATCH places. So each pair (p, j) of a text, n log n of
them, is looked at: those whose next LEAST_MATCH words hash alike are widened to both sides by binary search over prefix
hashes, all at once. What comes out is verified word by word; should a hash have deceived, the text is searched exactly.
A run is found once for each of its grid points and for multiples of its period: the least period of each stretch counts.

Texts are searched in batches, pairs in blocks, so memory is linear in a text's words. No shuffle: rows stay where they are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import common

#: A run has so many words at least, and so many times its period.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: At a run's first grid point at least max(p + 1, 25 - 2p) words agree with those a period later: 9 at p = 8, more elsewhere.
LEAST_MATCH = 9
#: Words of a batch of texts, and pairs (period, grid point) of a block.
BATCH_WORDS, BLOCK_PAIRS = 1 << 18, 1 << 21
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
#: Base of the prefix hashes, odd, so that it has an inverse modulo 2 ** 64; any will do, since runs are verified.
BASE = 0x9E3779B97F4A7C15

Run = tuple[int, int, int]


class _Ids(dict):
    """A number for each word of a batch; a missing one gets the next."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def exact_runs(ids: np.ndarray) -> list[Run]:
    """(start, length, period) of all runs, by comparing the text with itself at each shift; takes n * n / 3 steps."""
    n, found = len(ids), {}
    for p in range(1, n // LEAST_PERIODS + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids[:-p] == ids[p:]).view(np.int8), [0]))))
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a + p >= max(LEAST_WORDS, LEAST_PERIODS * p):
                found.setdefault((a, b - a + p), p)
    return sorted((a, length, p) for (a, length), p in found.items())


def _powers(base: int, count: int) -> np.ndarray:
    """The first powers of an odd number modulo 2 ** 64, from 1 on."""
    factors = np.full(count, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


class _Hashes:
    """Prefix hashes of the texts of a batch in a row; a comparison never leaves a text, so they need no border."""

    def __init__(self, ids: np.ndarray):
        rng = np.random.default_rng(11)
        words = rng.integers(1, 1 << 63, int(ids.max(initial=0)) + 1, dtype=np.uint64)[ids]
        self.powers = _powers(BASE, len(ids) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * self.powers[:-1], dtype=np.uint64)))

    def windows(self, size: int) -> np.ndarray:
        """A hash of the `size` words from each place on that doesn't depend on the place."""
        count = max(len(self.sums) - size, 0)
        return (self.sums[size : size + count] - self.sums[:count]) * _powers(pow(BASE, -1, 1 << 64), count)

    def alike(self, at: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the `length` words from `at` on hash like those a period later."""
        return (self.sums[at + length] - self.sums[at]) * self.powers[period] == self.sums[at + period + length] - self.sums[at + period]

    def extended(self, at: np.ndarray, period: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from `at` on (or before it) agree with those a period later, up to `most`: all pairs in one binary search."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.alike(at - middle if back else at, period, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _grid(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of pairs: text, period and the place of the first of two grid points, of all periods that fit three times."""
    periods = sizes // LEAST_PERIODS
    texts = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(texts)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = np.maximum((sizes[texts] - LEAST_MATCH) // period, 0)  # j = 0, p, ... with j + p + LEAST_MATCH <= n
    done = np.cumsum(points)
    at = 0
    while at < len(texts):
        upto = max(int(np.searchsorted(done, (done[at - 1] if at else 0) + BLOCK_PAIRS, "right")), at + 1)
        k, p, c = texts[at:upto], period[at:upto], points[at:upto]
        place = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        p = np.repeat(p, c)
        yield np.repeat(k, c), p, place * p + np.repeat(starts[k], c)
        at = upto


def runs_of(ids: np.ndarray, sizes: np.ndarray) -> list[list[Run]]:
    """The runs of each of several texts, whose word numbers are in a row: (start, length, period), by start and period."""
    starts = np.cumsum(sizes) - sizes
    found: list[list[Run]] = [[] for _ in sizes]
    searched = np.where(sizes >= LEAST_WORDS, sizes, 0)
    if not searched.any():
        return found
    hashes = _Hashes(ids)
    windows = hashes.windows(LEAST_MATCH)
    stretches = []
    for k, p, at in _grid(searched, starts):
        hit = np.flatnonzero(windows[at] == windows[at + p])
        if len(hit):
            k, p, at = k[hit], p[hit], at[hit]
            ahead = hashes.extended(at, p, starts[k] + sizes[k] - at - p, back=False)
            behind = hashes.extended(at, p, at - starts[k], back=True)
            long = ahead + behind + p >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
            stretches.append(np.unique(np.stack((k, at - behind, ahead + behind + p, p), 1)[long], axis=0))
    if not stretches:
        return found
    rows = np.unique(np.concatenate(stretches), axis=0)  # by text, start, length, period
    least = np.ones(len(rows), bool)
    least[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    doubted = set()
    for k, start, length, p in rows[least].tolist():
        end, first, last = start + length, int(starts[k]), int(starts[k] + sizes[k])
        sound = (ids[start : end - p] == ids[start + p : end]).all() and (start == first or ids[start - 1] != ids[start - 1 + p]) and (end == last or ids[end] != ids[end - p])
        if not sound:
            doubted.add(k)
        found[k].append((start - first, length, p))
    for k in doubted:
        found[k] = exact_runs(ids[starts[k] : starts[k] + sizes[k]])
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]


def repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document, of which each tenth id (by its checksum) repeats a stretch to the end; without id as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _row(words: list[bytes], runs: list[Run]) -> tuple:
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    kept = words
    if runs:
        keep = np.ones(len(words), bool)
        for s, n, p in runs:
            keep[s + p : s + n] = False
        kept = [words[k] for k in np.flatnonzero(keep).tolist()]
    return (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def _searched(doc_ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    number = _Ids()
    sizes = np.array([len(x) for x in texts], np.int64)
    ids = np.fromiter((number[w] for x in texts for w in x), np.int64, int(sizes.sum()))
    rows = [_row(words, runs) for words, runs in zip(texts, runs_of(ids, sizes), strict=True)]
    columns = list(zip(*rows, strict=True))
    types = [pa.int64()] * 5 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *(pa.array(list(c), t) for c, t in zip([columns[0], *columns[1:]], types, strict=True))], names=[f.split()[0] for f in SCHEMA.split(", ")])


def periodic_runs(docs: DataFrame, *, repeat: bool = False) -> DataFrame:
    """Rows of SCHEMA: a row for each row of docs, its number of runs, the run of the highest exponent and two digests.

    repeat makes a tenth of the documents periodic first, see repeated(). Null, empty and blank texts have no words and no
    runs; texts under 24 words have none either; repeated rows are searched each; a row without id is searched as it
    stands; other columns are ignored; an empty table has no rows.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()  # bytes split at the six characters of the word pattern
                ids.append(doc_id)
                texts.append(repeated(words, doc_id) if repeat else words)
                held += len(words)
                if held >= BATCH_WORDS:
                    yield _searched(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield _searched(ids, texts)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(search, SCHEMA)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(common.table(spark, sf_dir, "documents"), repeat=True)
