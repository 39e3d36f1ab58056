"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced.

A chunk's ids are right from a position on, if that position starts a pre-token both there and in the chunk
before it: the pre-tokenizer looks only forward from a match's start, and all starts of the first chunk
that lie before its end by more than the longest special token are those of the whole text. So the two
encodings of an overlap are spliced at such a common start. An overlap without one (one word of thousands
of characters) is widened until it has one or the chunk has grown to the text's end.

Null and empty texts have no tokens; repeated rows are counted once each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import common, tokens

CHUNK_CHARS, OVERLAP_CHARS, BATCH_ROWS = 32_768, 512, 256
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int, n_widened int"


class _Chunk:
    """An encoded slice of a text; only what lies from token `first` on counts."""

    def __init__(self, tokenizer, text: str, start: int, end: int, first: int = 0):
        self.start, self.end, self.first = start, min(end, len(text)), first
        self.encoding = tokenizer.encode(text[start : self.end], add_special_tokens=False)

    def starting(self, at: int) -> int | None:
        """The token that starts a pre-token at this position of the text."""
        k = self.encoding.char_to_token(at - self.start)
        if k is None or self.encoding.token_to_chars(k)[0] != at - self.start:
            return None
        while k and self.encoding.token_to_chars(k - 1) == self.encoding.token_to_chars(k):  # bytes of one character
            k -= 1
        return k if k == 0 or self.encoding.token_to_word(k - 1) != self.encoding.token_to_word(k) or self.encoding.token_to_chars(k - 1)[1] != at - self.start else None

    def upto(self, k: int | None = None) -> list[int]:
        return self.encoding.ids[self.first : k]


def spliced(tokenizer, text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> tuple[list[int], int, int]:
    """The ids of a text, the chunks encoded and how often an overlap was widened."""
    longest = max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)
    left, ids, chunks, widened, begin = _Chunk(tokenizer, text, 0, chunk_chars), [], 1, 0, 0
    while left.end < len(text):
        width, found = max(overlap_chars, longest + 2), None
        while found is None and left.end < len(text):
            start = max(begin, left.end - width)
            right = _Chunk(tokenizer, text, start, left.end + chunk_chars)
            chunks += 1
            middle = max(start + 1, left.end - max(longest, width // 2))
            for at in [*range(middle, start, -1), *range(middle + 1, left.end - longest)]:
                # the right chunk's first pre-token may be a part of one, what starts after it is whole
                if (a := left.starting(at)) is not None and a >= left.first and (b := right.starting(at)) is not None:
                    found = (at, a, b)
                    break
            else:
                widened += 1
                width *= 2
                if start == begin:  # the overlap is all that is left of this chunk: let the chunk grow
                    left = _Chunk(tokenizer, text, begin, left.end + width)
                    chunks += 1
        if found:
            begin, a, right.first = found
            ids += left.upto(a)
            left = right
    return ids + left.upto(), chunks, widened


def count_tokens(docs: DataFrame, path: str, limit: int, *, words: bool = False, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Rows of SCHEMA: bytes and tokens of each row's whole text, and whether they are over the limit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens.encoder(path, words)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                rows = batch.slice(at, BATCH_ROWS)
                texts = [x or "" for x in rows.column(1).to_pylist()]
                short = [x if len(x) <= chunk_chars else "" for x in texts]
                n = own.encode(short)[1].tolist()
                chunks, widened = [1] * len(texts), [0] * len(texts)
                for k, text in enumerate(texts):
                    if len(text) > chunk_chars:
                        ids, chunks[k], widened[k] = spliced(own.whole, text, chunk_chars, overlap_chars)
                        n[k] = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n]), pa.array(chunks, pa.int32()), pa.array(widened, pa.int32())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"],
                )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(count, SCHEMA)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"), 1024)
