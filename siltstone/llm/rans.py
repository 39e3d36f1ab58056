"""Static range asymmetric numeral system over token ids, many lanes at a time.

A block's tokens go to LANES lanes in turn; each lane is a coder of its own with 64-bit state and 32-bit
words, so lanes and blocks are independent. Coding runs over all lanes of all blocks at once, one step for
each token of a lane. Every CHECK_STEPS steps a checkpoint keeps each lane's state and place, so decoding can
begin there. A block is: tokens, words and checkpoints (little-endian), and checksums of payload and ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE_BITS, LANES, BLOCK_TOKENS, CHECK_STEPS = 20, 32, 65_536, 1_024
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sIIIII")  # mark, tokens, checkpoints, words, checksum of payload, checksum of ids
MARK = b"RANS"


class Damaged(ValueError):
    """A block's bytes or ids don't match their checksum."""


def frequencies(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Counts scaled to a sum of 2**bits; every id that occurs keeps 1 at least, ids that don't keep 0."""
    counts = np.asarray(counts, np.float64)
    total, used = counts.sum(), counts > 0
    if not total:
        return np.zeros(len(counts), np.uint32)
    if used.sum() > 1 << bits:
        raise ValueError("more ids than the table has places")
    out = np.where(used, np.maximum(1, np.floor(counts / total * (1 << bits))), 0).astype(np.int64)
    spare = (1 << bits) - int(out.sum())
    order = np.argsort(-out, kind="stable")
    if spare > 0:
        out[order[0]] += spare
    for k in order:
        if spare >= 0:
            break
        take = min(-spare, int(out[k]) - 1)
        out[k] -= take
        spare += take
    return out.astype(np.uint32)


class Table:
    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits, self.freq = np.uint64(bits), np.asarray(freq, np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol


def encode(ids: np.ndarray, table: Table, block_tokens: int = BLOCK_TOKENS) -> list[bytes]:
    """The blocks of one run of ids."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    blocks = -(-n // block_tokens)
    if not blocks:
        return []
    sizes = np.full(blocks, block_tokens)
    sizes[-1] = n - block_tokens * (blocks - 1)
    steps = -(-int(sizes.max()) // LANES)
    grid = np.zeros(blocks * steps * LANES, np.uint32) if blocks == 1 else np.zeros(blocks * block_tokens, np.uint32)
    grid[:n] = ids
    grid = grid.reshape(blocks, -1, LANES).transpose(1, 0, 2).reshape(-1, blocks * LANES)  # step, lane
    block_of, lane = np.repeat(np.arange(blocks), LANES), np.tile(np.arange(LANES), blocks)
    length = np.maximum(0, (sizes[block_of] - lane + LANES - 1) // LANES)
    lanes = blocks * LANES
    state, emitted = np.full(lanes, LOW, np.uint64), np.zeros(lanes, np.int64)
    words, owners = [], []
    checks: list[tuple[int, np.ndarray, np.ndarray]] = []
    shift, low32 = np.uint64(32), np.uint64(0xFFFFFFFF)
    limit = np.uint64((int(LOW) >> int(table.bits)) << 32)
    even = bool((length == length[0]).all())
    for s in range(steps - 1, -1, -1):
        live = None if even else np.flatnonzero(length > s)
        x = state if live is None else state[live]
        symbol = grid[s] if live is None else grid[s][live]
        f, start = table.freq[symbol], table.start[symbol]
        over = np.flatnonzero(x >= limit * f)
        if len(over):
            words.append((x[over] & low32).astype(np.uint32))
            own = over if live is None else live[over]
            owners.append(own)
            emitted[own] += 1
            x[over] >>= shift
        q = x // f
        x = (q << table.bits) + (x - q * f) + start
        if live is None:
            state = x
        else:
            state[live] = x
        if s % CHECK_STEPS == 0:
            checks.append((s, state.copy(), emitted.copy()))
    flat = np.concatenate(words) if words else np.zeros(0, np.uint32)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owner[::-1], kind="stable")  # by lane, last emitted first: as the decoder reads them
    flat = flat[::-1][order]
    per_lane = np.bincount(owner, minlength=lanes)
    ends = np.concatenate(([0], np.cumsum(per_lane)))
    out = []
    checks.reverse()
    for b in range(blocks):
        own = slice(b * LANES, (b + 1) * LANES)
        held = [(s, st[own], per_lane[own] - em[own]) for s, st, em in checks if s * LANES < sizes[b]]
        payload = per_lane[own].astype("<u4").tobytes() + b"".join(struct.pack("<I", s) + st.astype("<u8").tobytes() + read.astype("<u4").tobytes() for s, st, read in held)
        payload += flat[ends[b * LANES] : ends[(b + 1) * LANES]].astype("<u4").tobytes()
        own_ids = ids[b * block_tokens : b * block_tokens + int(sizes[b])]
        out.append(HEAD.pack(MARK, int(sizes[b]), len(held), int(ends[(b + 1) * LANES] - ends[b * LANES]), zlib.crc32(payload), zlib.crc32(own_ids.astype("<u4").tobytes())) + payload)
    return out


def size_of(block: bytes) -> int:
    """How many ids a block holds."""
    return HEAD.unpack_from(block)[1]


def decode(blocks: list[bytes], table: Table, from_step: int = 0) -> list[np.ndarray]:
    """The ids of each block, from the last checkpoint at or before from_step on; all blocks step together."""
    heads, states, places, counts, streams, firsts = [], [], [], [], [], []
    base = 0
    for data in blocks:
        mark, n, checks, n_words, crc, crc_ids = HEAD.unpack_from(data)
        payload = memoryview(data)[HEAD.size :]
        if mark != MARK or zlib.crc32(payload) != crc:
            raise Damaged("payload checksum")
        per_lane = np.frombuffer(payload, "<u4", LANES).astype(np.int64)
        at, size, held = LANES * 4, 4 + LANES * 12, []
        for _ in range(checks):
            held.append((struct.unpack_from("<I", payload, at)[0], np.frombuffer(payload, "<u8", LANES, at + 4), np.frombuffer(payload, "<u4", LANES, at + 4 + LANES * 8)))
            at += size
        step, state, read = max((h for h in held if h[0] <= from_step), key=lambda h: h[0])
        heads.append((n, crc_ids, step))
        states.append(state.astype(np.uint64))
        places.append(base + np.concatenate(([0], np.cumsum(per_lane)[:-1])) + read)
        streams.append(np.frombuffer(payload, "<u4", n_words, at))
        lane = np.arange(LANES)
        counts.append(np.maximum(0, (n - lane + LANES - 1) // LANES) - step)
        firsts.append(step)
        base += n_words
    if not blocks:
        return []
    state, place, left = np.concatenate(states), np.concatenate(places), np.concatenate(counts)
    stream = np.concatenate(streams) if base else np.zeros(1, np.uint32)
    stream = np.concatenate((stream, np.zeros(1, np.uint32))).astype(np.uint64)
    steps, mask, shift = int(left.max(initial=0)), np.uint64((1 << int(table.bits)) - 1), np.uint64(32)
    out = np.zeros((steps, len(state)), np.uint32)
    even = bool((left == left[0]).all())
    for s in range(steps):
        live = None if even else np.flatnonzero(left > s)
        x = state if live is None else state[live]
        slot = x & mask
        symbol = table.symbol[slot]
        x = table.freq[symbol] * (x >> table.bits) + slot - table.start[symbol]
        short = np.flatnonzero(x < LOW)
        if len(short):
            own = short if live is None else live[short]
            x[short] = (x[short] << shift) | stream[place[own]]
            place[own] += 1
        if live is None:
            state, out[s] = x, symbol
        else:
            state[live] = x
            out[s, live] = symbol
    found = []
    for b, (n, crc_ids, step) in enumerate(heads):
        ids = out[:, b * LANES : (b + 1) * LANES].reshape(-1)[: n - step * LANES]
        if step == 0 and zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
            raise Damaged("ids checksum")
        found.append(ids)
    return found
