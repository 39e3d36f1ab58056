"""Token ids of whole texts, as the tokenizers library gives them.

Both vocabularies never merge across a boundary between words, so a text's ids are the ids of its units
in a row. The library encodes each distinct unit once and a bounded cache in each worker keeps the ids. A
text whose units can't be told apart safely goes to the library whole.

For the vocabulary that keeps white space, Arrow cuts the texts and tells the distinct words of a batch apart, so Python
only sees those; letters and the signs after them are two units, since the signs are a piece of their own.
"""

from __future__ import annotations

import re
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters, numbers and white space among the first 256 code points.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
#: The pre-tokenizer patterns of the two vocabularies, for those code points.
BYTE_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
#: Python calls \x1c to \x1f white space, the vocabularies do not; cuts use \x01.
ODD = re.compile("[\x01\x1c-\x1f]")
#: The same and all white space but a space and a line end.
ODD_OR_SPACE = re.compile("[\x01\x1c-\x1f\t\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CACHED_UNITS = 1_000_000


def byte_alphabet() -> dict[int, str]:
    """Code point for each byte value: printable bytes stand for themselves, the others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Units(dict):
    """Unit to its row in the id table; a missing unit is encoded when it is first asked for."""

    def __init__(self, encode, table: _Units | None = None):
        self.encode = encode
        # units of two kinds may share a table; its first row has no ids
        self.starts, self.sizes, self.ids = (table.starts, table.sizes, table.ids) if table is not None else (array("q", [0]), array("q", [0]), array("I"))

    def __missing__(self, unit: str) -> int:
        ids = self.encode(unit)
        if ids is None:
            self[unit] = -1
            return -1
        row = len(self.starts)
        self.starts.append(len(self.ids))
        self.sizes.append(len(ids))
        self.ids.extend(ids)
        self[unit] = row
        return row

    def ids_of(self, unit: str) -> list[int]:
        row = self[unit]
        return self.ids[self.starts[row] : self.starts[row] + self.sizes[row]].tolist()


class Encoder:
    """Encodes batches of texts; words=True for the vocabulary that drops white space and lower-cases."""

    def __init__(self, path: str, words: bool = False, cached_units: int = CACHED_UNITS):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.words, self.most = self.whole.model, words, cached_units
        self.pieces, self.alphabet = WORD_PIECES if words else BYTE_PIECES, byte_alphabet()
        self.marks = {t.content[:2] for t in self.whole.get_added_tokens_decoder().values()}
        self._forget()

    def _forget(self) -> None:
        self.units = _Units(self._unit if self.words else self._form)
        self.letters, self.signs = _Units(self._letters, self.units), _Units(self._unit, self.units)

    def _letters(self, word: str) -> list[int] | None:
        """Ids of a word of letters, a piece by itself, or None for other words. After \x01: of the word alone; else: of a space and the word."""
        alone = word[:1] == "\x01"
        own = word[1:] if alone else word
        if not own.isalpha():
            return None
        if not own.isascii():
            if max(own) >= "Ā":
                return None
            own = own.encode().decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.model.tokenize(own if alone else "Ġ" + own)]

    def _form(self, word: str) -> list[int]:
        """Ids of any word, marked likewise, or of a line end."""
        return self._unit(word[1:] if word[:1] == "\x01" else word if word == "\n" else " " + word)

    def _unit(self, unit: str) -> list[int]:
        if not unit:
            return []
        if max(unit) >= "Ā":
            return self.whole.encode(unit, add_special_tokens=False).ids
        if self.words:
            unit = unit.lower()
        if self.words and unit[-1] in ".,!?" and unit[:-1].lstrip(" ").isalpha():  # a word and a mark are two pieces
            return self.units.ids_of(unit[:-1]) + self.units.ids_of(unit[-1])
        # a word alone is one piece
        pieces = [unit] if unit[1:].isalpha() and (unit[0] == " " or unit[0].isalpha()) else self.pieces.findall(unit)
        out: list[int] = []
        for piece in pieces:
            if piece.isascii() and piece[1:].isalnum() and (piece[0] == " " or piece[0].isalnum()):
                shown = "Ġ" + piece[1:] if piece[0] == " " else piece
            else:
                shown = piece.encode().decode("latin-1").translate(self.alphabet)
            out += [t.id for t in self.model.tokenize(shown)]
        return out

    def _apart(self, text: str) -> bool:
        """Whether each unit is a word, a space and a word, or a line end between two words; if not, the text must be encoded whole."""
        if not text or any(m in text for m in self.marks) or ODD_OR_SPACE.search(text):
            return False
        return not (text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", " \n", "\n ", "\n\n")))

    def _gathered(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows of the table, and how many each has."""
        sizes, starts, ids = (np.frombuffer(x, kind) if x else np.zeros(0, kind) for x, kind in ((self.units.sizes, np.int64), (self.units.starts, np.int64), (self.units.ids, np.uint32)))
        return _runs(ids, starts[rows], sizes[rows]), sizes[rows]

    def _by_split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        units, counts = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            own = text.split()
            counts[k] = len(own)
            units += own
        ids, sizes = self._gathered(np.fromiter(map(self.units.__getitem__, units), np.int64, len(units)))
        return ids, _sums(sizes, counts)

    def _by_distinct(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """As encode, or None if some text must be encoded whole or is empty."""
        joined = "\n".join(texts)
        if ODD_OR_SPACE.search(joined) or any(m in joined for m in self.marks):
            return None
        # a line end is a word by itself, and a word after it or at the start is marked
        cut = pc.split_pattern(pa.array(["\x01" + x.replace("\n", " \n \x01") for x in texts], pa.large_string()), " ")
        words = cut.flatten().dictionary_encode()
        bare = pc.utf8_rtrim(words.dictionary, characters=string.punctuation)
        forms, letters = (x.to_numpy(zero_copy_only=False).tolist() for x in (words.dictionary, bare))  # to_pylist takes eight times as long
        lengths = pc.binary_length(words.dictionary).to_numpy()
        if any(forms[k] in ("", "\x01") for k in np.flatnonzero(lengths < 2).tolist()):  # white space beside white space, or at an end
            return None
        rows = np.zeros((len(forms), 2), np.int64)  # of the letters or the whole word, and of the signs after letters
        rows[:, 0] = np.fromiter(map(self.letters.__getitem__, letters), np.int64, len(letters))
        other = rows[:, 0] < 0
        rows[other, 0] = [self.units[forms[k]] for k in np.flatnonzero(other).tolist()]
        signs = np.flatnonzero((lengths > pc.binary_length(bare).to_numpy()) & ~other)
        rows[signs, 1] = [self.signs[forms[k][len(letters[k]) :]] for k in signs.tolist()]
        table, parts = self._gathered(rows.reshape(-1))
        sizes = parts.reshape(-1, 2).sum(axis=1)
        starts = np.cumsum(sizes) - sizes
        at = words.indices.to_numpy()
        return _runs(table, starts[at], sizes[at]), _sums(sizes[at], pc.list_value_length(cut).to_numpy())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if len(self.units) + len(self.letters) + len(self.signs) > self.most:
            self._forget()
        if self.words:
            whole = {k: x for k, x in enumerate(texts) if ODD.search(x) or any(m in x for m in self.marks)}
        elif texts and (found := self._by_distinct(texts)):
            return found
        else:
            whole = {k: x for k, x in enumerate(texts) if not self._apart(x)}
        apart = [k for k in range(len(texts)) if k not in whole]
        own, sizes = (self._by_split if self.words else self._by_distinct)([texts[k] for k in apart]) if apart else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if not whole:
            return own, sizes
        ends = np.cumsum(sizes)
        parts = {k: own[e - n : e] for k, n, e in zip(apart, sizes.tolist(), ends.tolist(), strict=True)}
        parts |= {k: np.array(self.whole.encode(x, add_special_tokens=False).ids, np.uint32) for k, x in whole.items()}
        return np.concatenate([parts[k] for k in range(len(texts))]), np.array([len(parts[k]) for k in range(len(texts))], np.int64)


def _runs(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ids in a row."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])] if len(sizes) else ids[:0].copy()


def _sums(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of as many sizes in a row as each count says."""
    return np.diff(np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))])


_loaded: dict[tuple, Encoder] = {}


def encoder(path: str, words: bool = False) -> Encoder:
    """This worker's encoder; its cache outlives a task."""
    if (path, words) not in _loaded:
        _loaded[path, words] = Encoder(path, words)
    return _loaded[path, words]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
