"""Sets of word shingles as sorted arrays of 64-bit hashes, for whole batches of texts at once.

A word's hash is a polynomial over its bytes, read off running sums over the batch, so its cost doesn't depend on
Python objects. ASCII letters are folded; shingles of five words are hashed in order; a text of fewer words has one
shingle of all its words; a text without words has none.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 19

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: What a byte adds to its word's polynomial.
_VALUE = _FOLD.astype(np.uint64) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of BASE and of its inverse. A worker keeps those that a chunk needs; a longer text has its own."""
    if _powers and len(_powers[0]) >= count:
        return _powers[0][:count], _powers[1][:count]
    made = []
    for base in (BASE, INVERSE):
        factors = np.full(max(count, CHUNK_BYTES + 1), base, np.uint64)
        factors[0] = 1
        made.append(np.cumprod(factors, out=factors))
    if count <= CHUNK_BYTES + 1:
        _powers[:] = made
    return made[0][:count], made[1][:count]


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a buffer that ends in white space."""
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    power, back = powers(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUE[buf] * power, out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mixed((sums[ends] - sums[starts]) * back[starts] + lengths * np.uint64(STEP)), starts


def _folded(hashes: np.ndarray) -> np.uint64:
    out = hashes[:1].copy()
    for k in range(1, len(hashes)):
        out = mixed(out * np.uint64(STEP) + hashes[k : k + 1])
    return mixed(out + np.uint64(len(hashes)))[0]


def sets_of(texts: list[str | bytes | None], words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; bytes are texts in UTF-8."""
    out: list[np.ndarray] = []
    chunk: list[bytes] = []
    size = 0
    for text in texts:
        data = text if isinstance(text, bytes) else (text or "").encode()
        if chunk and size + len(data) > CHUNK_BYTES:
            out += _chunk_sets(chunk, words)
            chunk, size = [], 0
        chunk.append(data)
        size += len(data) + 1
    return out + (_chunk_sets(chunk, words) if chunk else [])


def _chunk_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    hashes, starts = _words(buf)
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    rolled = hashes.copy()
    for k in range(1, words):
        rolled[: len(hashes) - k] = mixed(rolled[: len(hashes) - k] * np.uint64(STEP) + hashes[k:]) if len(hashes) > k else rolled[: len(hashes) - k]
    out, at = [], 0
    for end in ends.tolist():
        n = end - at
        if n >= words:
            own = np.sort(rolled[at : end - words + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            out.append(np.array([_folded(hashes[at:end])], np.uint64) if n else np.zeros(0, np.uint64))
        at = end
    return out


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum()) if len(b) else 0
