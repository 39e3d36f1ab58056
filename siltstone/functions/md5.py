"""MD5 of many short texts at once: NumPy takes each of its steps for a whole block of numbered texts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

#: The function's shifts, constants and first state.
SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
CONSTANTS = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Numbers of a block share all digits but the last four.
BLOCK = 10_000
_LAST = np.frombuffer("".join(f"{k:04}" for k in range(BLOCK)).encode(), np.uint8).reshape(BLOCK, 4)


def _rounds(words: dict[int, np.ndarray | int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the state after one chunk; words that aren't given are 0, and a number is one for all texts."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in STATE)
    f, high = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(64):
        if k < 16:
            at = k
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif k < 32:
            at = (5 * k + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif k < 48:
            at = (3 * k + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            at = 7 * k % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        word = words.get(at, 0)
        f += a
        if isinstance(word, int):
            f += np.uint32(CONSTANTS[k] + word & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(CONSTANTS[k])
        np.left_shift(f, np.uint32(SHIFTS[k]), out=high)
        f >>= np.uint32(32 - SHIFTS[k])
        f |= high
        f += b
        a, b, c, d, f = d, f, b, c, a
    return a + np.uint32(STATE[0]), b + np.uint32(STATE[1])


def numbered(prefix: str, first: int, last: int) -> Iterator[np.ndarray]:
    """The first 48 bits of the MD5 of prefix and number, for the numbers from first up to last, in blocks."""
    if first < (small := min(last, BLOCK)):  # of various lengths, and few
        yield np.array([int.from_bytes(hashlib.md5(f"{prefix}{k}".encode()).digest()[:6]) for k in range(first, small)], np.int64)
        first = small
    while first < last:
        block = first // BLOCK
        low, high = first % BLOCK, min(BLOCK, last - block * BLOCK)
        head = f"{prefix}{block}".encode()
        size = len(head) + 4
        if size > 55:
            raise ValueError("a text and its length must fit one chunk")
        chunk = np.zeros((high - low, size // 4 * 4 + 4), np.uint8)
        chunk[:, : len(head)] = np.frombuffer(head, np.uint8)
        chunk[:, len(head) : size] = _LAST[low:high]
        chunk[:, size] = 0x80
        a, b = _rounds(dict(enumerate(np.ascontiguousarray(chunk.view("<u4").T))) | {14: size * 8}, high - low)
        yield a.byteswap().astype(np.int64) << 16 | (b.byteswap() >> np.uint32(16)).astype(np.int64)
        first = block * BLOCK + high
