"""Language of whole texts: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is its letters in lower case, anything else a border; its subwords are the pieces of 2, 3 and 4 characters that hold
a letter and no border inside. Each subword has one of BUCKETS vectors by its hash; a text is the mean of its subwords'
vectors, and a linear layer gives a score for each language. Both are trained together by stochastic gradient descent.

The model is fitted in one task on a bounded sample of the labelled rows (SAMPLE of them, an equal share for each language,
drawn by hash), whole texts and for each a short stretch of it, as short texts occur too. A fifth of the sample isn't
trained on: it gives the temperature of the scores, and the least score at which errors among the accepted stay under
RISK; rows below it are `rejected`. The model, two arrays of a fixed size, is all that reaches the driver; every row is then
scored where it is read.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import common

BUCKETS, DIMENSIONS, SIZES = 1 << 14, 16, (2, 3, 4)
#: Labelled rows to fit on, at most; each language has an equal share.
SAMPLE = 4_000
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.5, 12
#: Words of the short stretch that is learned besides a whole text.
STRETCH = 12
#: The share of errors among accepted rows that the threshold of rejection keeps to, on rows not trained on.
RISK = 0.01
#: Code points of a block of texts that is scored at once.
BLOCK_CHARS = 1 << 18
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: its id's checksum leaves 2 modulo 4. Rows without id are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: A character that is no letter, a digit or an underscore.
_BORDER = re.compile(r"[\W\d_]")
_is_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; made once in a worker."""
    global _is_letter
    if _is_letter is None:
        _is_letter = np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)
    return _is_letter


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the subwords of all texts in a row, and the text that each belongs to, ascending by text within each size."""
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
    buckets, owners = [], []
    for size in SIZES:
        n = len(codes) - size + 1
        if n <= 0:
            continue
        value = np.full(n, size, np.uint64)
        for k in range(size):
            value = (value ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        # inside there are letters only, and one letter at least
        valid = letter[:n] | letter[1 : 1 + n] if size == 2 else np.logical_and.reduce([letter[k : k + n] for k in range(1, size - 1)])
        at = np.flatnonzero(valid & (owner[:n] == owner[size - 1 :]))
        buckets.append(((value[at] >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(owner[at])
    return np.concatenate(buckets or [np.zeros(0, np.int32)]), np.concatenate(owners or [np.zeros(0, np.int32)])


def _pieces(text: str) -> Iterator[str]:
    """A text in slices of about BLOCK_CHARS, cut at characters that aren't letters, so that their subwords are the text's."""
    start = 0
    while cut := _BORDER.search(text, start + BLOCK_CHARS):
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def _means(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The mean of the rows of table over the subwords of each text; zeros without subwords. Memory follows BLOCK_CHARS."""
    sums, counts = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    block: list[str] = []
    places: list[int] = []

    def add() -> None:
        buckets, owners = subwords(block)
        at = np.array(places)
        np.add.at(counts, at, np.bincount(owners, minlength=len(at)))
        for k in range(table.shape[1]):
            np.add.at(sums[:, k], at, np.bincount(owners, table[buckets, k], len(at)))
        block.clear()
        places.clear()

    held = 0
    for k, text in enumerate(texts):
        for piece in _pieces(text):
            block.append(piece)
            places.append(k)
            held += len(piece)
            if held >= BLOCK_CHARS:
                add()
                held = 0
    if block:
        add()
    return sums / np.maximum(counts, 1)[:, None]


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Model:
    """Languages, the score of each bucket for each language, the temperature and the least accepted score."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, scale: float, least: float):
        self.languages, self.table, self.bias, self.scale, self.least = languages, table, bias, scale, least

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return _softmax((_means(texts, self.table) + self.bias) * self.scale)

    def dump(self) -> bytes:
        np.savez_compressed(out := io.BytesIO(), languages=np.array(self.languages, "U"), table=self.table, bias=self.bias, scale=self.scale, least=self.least)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        x = np.load(io.BytesIO(data))
        return cls(x["languages"].tolist(), x["table"], x["bias"], float(x["scale"]), float(x["least"]))


def _stretches(texts: list[str], rng: np.random.Generator) -> list[str]:
    out = []
    for text in texts:
        words = text.split()
        start = int(rng.integers(max(len(words) - STRETCH, 0) + 1))
        out.append(" ".join(words[start : start + STRETCH]))
    return out


def _counts(texts: list[str]) -> np.ndarray:
    """A row for each text: the share of each bucket among its subwords."""
    buckets, owners = subwords(texts)
    x = np.bincount(owners.astype(np.int64) * BUCKETS + buckets, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS).astype(np.float32)
    return x / np.maximum(x.sum(1, keepdims=True), 1)


def fit(texts: list[str], labels: list[str], *, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Train on four fifths of the rows and calibrate on the others; rows come in an order that says nothing."""
    languages = sorted(set(labels))
    y = np.searchsorted(languages, labels)
    rng = np.random.default_rng(seed)
    aside = np.arange(len(texts)) % 5 == 4
    own = np.flatnonzero(~aside) if aside.any() else np.arange(len(texts))
    embeddings = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    weights += rng.normal(0, 0.1, weights.shape).astype(np.float32)
    # buckets are rare, so their vectors take steps by their own past gradients
    past, past_w, steps, step = np.full((BUCKETS, 1), 1e-6, np.float32), 1e-6, epochs * -(-len(own) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(own)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            whole = [texts[k] for k in rows]
            x = _counts(whole + _stretches(whole, rng))
            t = np.concatenate((y[rows], y[rows]))
            hidden = x @ embeddings
            error = _softmax(hidden @ weights + bias)
            error[np.arange(len(t)), t] -= 1
            error /= len(t)
            down, side = hidden.T @ error, x.T @ (error @ weights.T)
            rate = RATE * (1 - step / steps)
            past += (side**2).mean(1, keepdims=True)
            past_w += float((down**2).mean())
            embeddings -= rate * side / np.sqrt(past)
            weights -= rate * down / np.sqrt(past_w)
            bias -= rate * error.sum(0)
            step += 1
    model = Model(languages, embeddings @ weights, bias, 1.0, 0.0)
    if aside.any():
        kept = [texts[k] for k in np.flatnonzero(aside)]
        _calibrate(model, kept + _stretches(kept, rng), np.concatenate((y[aside], y[aside])))
    return model


def _calibrate(model: Model, texts: list[str], y: np.ndarray) -> None:
    """The scale of least log loss, and the least score from which on at most RISK of the accepted rows are wrong."""
    raw = _means(texts, model.table) + model.bias
    scales = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    losses = [-np.log(np.maximum(_softmax(raw * s)[np.arange(len(y)), y], 1e-12)).mean() for s in scales]
    model.scale = float(scales[int(np.argmin(losses))])
    p = _softmax(raw * model.scale)
    order = np.argsort(-p.max(1), kind="stable")
    wrong = np.cumsum(p.argmax(1)[order] != y[order])
    sound = np.flatnonzero(wrong <= RISK * np.arange(1, len(y) + 1))
    model.least = float(p.max(1)[order][sound[-1]]) if len(sound) else 1.0
    if len(sound) and sound[-1] == len(y) - 1:
        model.least = 0.0  # nothing needs to be rejected


def sample(docs: DataFrame, size: int) -> DataFrame:
    """text, lang: at most `size` labelled rows that are not held out, an equal share for each language, by a hash of text and id.

    Rows without id, text or language don't serve. The hash keeps about twice the share before rows are ordered, so few move.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("doc_id is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("lang", "_lang")
    share = max(1, size // max(counts.count(), 1))
    few = F.broadcast(counts.orderBy("_lang").limit(size))  # a row for each language, `size` at most
    drawn = rows.filter("text is not null").join(few, F.col("lang") == F.col("_lang")).withColumn("_h", F.xxhash64("text", "doc_id"))
    likely = drawn.filter((F.shiftrightunsigned("_h", 11) / float(1 << 53)) * F.col("_n") < 2 * share + 20)
    order = Window.partitionBy("lang").orderBy("_h", "doc_id", "text")
    return likely.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= share).select("text", "lang", "_h")


def train(docs: DataFrame, size: int = SAMPLE) -> Model | None:
    """The model, fitted by one task on the sample; None without labelled rows."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((h, t, lang) for b in batches for t, lang, h in zip(*(c.to_pylist() for c in b.columns), strict=True))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([fit([t for _, t, _ in rows], [x for *_, x in rows]).dump()], pa.binary())], names=["model"])

    found = sample(docs, size).coalesce(1).mapInArrow(learn, "model binary").collect()
    return Model.load(found[0]["model"]) if found else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows of SCHEMA for each row of docs, from its text alone.

    `und` with score 0 (and rejected) for null texts, texts without a letter, and all texts where nothing was learned.
    Repeated rows are scored each, ties of the score go to the language that sorts first, other columns are ignored, an
    empty table has no rows. A long text is scored whole, in blocks of its own.
    """
    data = model.dump() if model else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.load(data) if data else None
        for batch in batches:
            ids, kept = batch.column(0), batch.column(1)
            texts = [x or "" for x in batch.column(2).to_pylist()]
            known = [own is not None and any(map(str.isalpha, t)) for t in texts]
            names, scores, low = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            places = [k for k, x in enumerate(known) if x]
            if places:
                p = own.probabilities([texts[k] for k in places])
                for k, best, value in zip(places, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                    names[k], scores[k], low[k] = own.languages[best], value, value < own.least
            yield pa.RecordBatch.from_arrays([ids, kept, pa.array(names), pa.array(scores), pa.array(low)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].cast("string").alias("text"))
    return own.mapInArrow(score, SCHEMA)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
