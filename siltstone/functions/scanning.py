"""Regular-expression matches over Arrow columns of texts, with offsets in code points.

Plain texts (printable ASCII and common white space, nearly all) are scanned by Arrow's RE2, a column at a time; there it finds what
Python's `re` finds, the first readers' engine. The other texts go through `re` one by one. Both ignore case. Patterns must not match
nothing and use what both know.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of plain texts; marks around matches, which no plain text has.
PLAIN = np.zeros(256, bool)
PLAIN[[9, 10, 12, 13, *range(32, 127)]] = True
OPEN, CLOSE = 1, 2
#: Bytes of text that are scanned at once.
PIECE = 1 << 23


@lru_cache(maxsize=256)
def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.IGNORECASE)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins and ends, and the bytes."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int32)
    return offsets.astype(np.int64), np.frombuffer(data or b"", np.uint8)


def _column(texts: Iterable[bytes]) -> pa.Array:
    return pa.array(texts, pa.binary()).view(pa.string())


class Spans:
    """Matches in order: the text's row, start, end (exclusive) and quote of each."""

    def __init__(self, row: np.ndarray, start: np.ndarray, end: np.ndarray, quote: pa.Array):
        self.row, self.start, self.end, self.quote = row, start, end, quote

    def __len__(self) -> int:
        return len(self.row)

    def nearest(self, row: np.ndarray, place: np.ndarray, own: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
        """For each asked row and place the match of that row whose place in `own` is nearest, or -1. `own` grows along a row; of equal
        distances the lower rank, or the earlier match."""
        if not len(self):
            return np.full(len(row), -1)
        key = (self.row << 32) + own
        at = np.searchsorted(key, (row << 32) + place)
        left, right = np.maximum(at - 1, 0), np.minimum(at, len(key) - 1)
        far = np.int64(1) << 40
        before = np.where((at > 0) & (self.row[left] == row), np.abs(place - own[left]), far)
        after = np.where((at < len(key)) & (self.row[right] == row), np.abs(own[right] - place), far)
        later = (after < before) | ((after == before) & (rank[right] < rank[left])) if rank is not None else after < before
        return np.where((before == far) & (after == far), -1, np.where(later, right, left))

    def first(self, row: np.ndarray) -> np.ndarray:
        """The first match of each asked row, or -1."""
        if not len(self):
            return np.full(len(row), -1)
        at = np.minimum(np.searchsorted(self.row, row), len(self) - 1)
        return np.where(self.row[at] == row, at, -1)

    def quotes(self, index: np.ndarray) -> pa.Array:
        """Quotes of the matches; null for -1."""
        return self.quote.take(pa.array(index, mask=index < 0))


class Texts:
    """A column of texts; null is an empty one."""

    def __init__(self, column: pa.Array, plain: bool = False):
        self.column = column = pc.fill_null(column, "")
        self.offsets, self.data = _buffers(column)
        #: texts that aren't plain, by row; bytes that are no text become replacement characters
        self.odd: dict[int, str] = {}
        self.length = np.diff(self.offsets)
        low, high = (self.offsets[0], self.offsets[-1]) if len(column) else (0, 0)
        if not plain and not (good := PLAIN[self.data[low:high]]).all():
            wrong = np.unique(np.searchsorted(self.offsets, np.flatnonzero(~good) + low, "right") - 1)
            self.odd = {int(k): self.data[self.offsets[k] : self.offsets[k + 1]].tobytes().decode("utf-8", "replace") for k in wrong}
            self.length[wrong] = [len(self.odd[int(k)]) for k in wrong]
            mask = np.zeros(len(column), bool)
            mask[wrong] = True
            self.column = pc.if_else(pa.array(mask), "", column)

    def __len__(self) -> int:
        return len(self.column)

    def found(self, pattern: str) -> np.ndarray:
        out = pc.match_substring_regex(self.column, pattern, ignore_case=True).to_numpy(zero_copy_only=False).copy()
        for k, text in self.odd.items():
            out[k] = compiled(pattern).search(text.lower()) is not None
        return out

    def spans(self, pattern: str) -> Spans:
        marked = pc.replace_substring_regex(self.column, pattern=f"(?i){pattern}", replacement="\x01\\0\x02")
        offsets, data = _buffers(marked)
        opened, closed = np.flatnonzero(data == OPEN), np.flatnonzero(data == CLOSE)
        row = np.searchsorted(offsets, opened, "right") - 1
        marks = offsets[row] + 2 * (np.arange(len(row)) - np.searchsorted(row, row))
        raw = data.tobytes() if len(row) else b""
        out = Spans(row, opened - marks, closed - marks - 1, _column([raw[a:b] for a, b in zip((opened + 1).tolist(), closed.tolist(), strict=True)]))
        other = [(k, m.start(), m.end(), m.group()) for k, text in self.odd.items() for m in compiled(pattern).finditer(text)]
        if not other:
            return out
        k, start, end, quote = zip(*other, strict=True)
        order = np.argsort(row := np.concatenate([out.row, np.array(k, np.int64)]), kind="stable")
        both = lambda a, b: np.concatenate([a, np.array(b, np.int64)])[order]
        return Spans(row[order], both(out.start, start), both(out.end, end), pa.concat_arrays([out.quote, pa.array(quote, pa.string())]).take(pa.array(order)))

    def parts(self, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[Texts, np.ndarray]:
        """Characters from start (cut at 0) up to end of the rows; equal ones that follow each other are one text. And the text of each."""
        start, end = np.maximum(start, 0), np.minimum(end, self.length[row])
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        row, start, end = row[new], start[new], end[new]
        raw, first = self.data.tobytes(), self.offsets[row]
        if self.odd:
            texts = [self.odd[r][a:b].encode() if r in self.odd else raw[o + a : o + b] for r, o, a, b in zip(row.tolist(), first.tolist(), start.tolist(), end.tolist(), strict=True)]
        else:
            texts = [raw[a:b] for a, b in zip((first + start).tolist(), (first + end).tolist(), strict=True)]
        return Texts(_column(texts), plain=not self.odd), np.cumsum(new) - 1


def each(column: pa.Array, kind: pa.DataType, value: Callable[[str], object]) -> pa.Array:
    """The value of each text, computed once for each distinct one; null stays null."""
    distinct = column.dictionary_encode()
    return pa.array([value(x) for x in distinct.dictionary.to_pylist()], kind).take(distinct.indices)


def lists(n: int, row: np.ndarray, fields: dict[str, pa.Array | np.ndarray]) -> pa.Array:
    """A list of structs for each of n rows."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in fields.values()], list(fields)))


def by_pieces(f: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """f over so many rows at once that their texts are about PIECE bytes."""

    def over(column: pa.Array) -> pa.Array:
        step = max(1, int(len(column) * PIECE / max(column.nbytes, 1)))
        if len(column) <= step:
            return f(column)
        return pa.concat_arrays([f(column.slice(k, step)) for k in range(0, len(column), step)])

    return over
