"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

1. Fixed patterns find emails, addresses, card and phone numbers in whole texts. These are the seeds.
2. Every seed and every other identifier-like piece of text (a token of five characters or more with a digit or an at
   sign, or groups of digits with spaces, dots, dashes and brackets between them, seven digits or more) is a mention. A
   mention's lexical patterns are the two words before it, the words on both sides, and the two words after it.
3. Patterns and instances form a graph over the corpus, scored in ROUNDS rounds. Known positives are the seeds and what
   earlier rounds accepted; known negatives are other instances that occur in NEGATIVE_SPREAD times as many patterns as
   a seed does on the mean (years, versions); the rest is unknown and counts UNKNOWN_WEIGHT as a negative. A pattern with
   SUPPORT positives or more has as confidence the lower end of Wilson's interval for its precision. An instance is as
   certain as its patterns of MIN_CONFIDENCE together (noisy or); of MIN_CONFIDENCE, and with MIN_SHARE of all its patterns
   among those, it is accepted: a positive of the next round, so identifiers found in one round induce patterns in the next.
   All of these are rates, so copies of a corpus give the same identifiers as the corpus.
4. All mentions of accepted instances that are of no fixed kind are added as kind "context", wherever they stand.

Offsets are code points. Null texts are empty; repeated rows are judged each and are one instance; other columns are kept
or ignored as the caller asks; an empty table gives no rows. A very long text is whole in a task and every scan of it is
linear; a word that is over LONG_WORD characters, or begins more than CONTEXT_CHARS away, stands in patterns as "~".
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import common

ROUNDS, SUPPORT, MIN_CONFIDENCE, UNKNOWN_WEIGHT, Z = 3, 5, 0.75, 0.5, 1.0
#: How many times the mean patterns of a seed make an instance a negative, and the share of an instance's patterns that must be sure.
NEGATIVE_SPREAD, MIN_SHARE = 6.0, 0.02
KINDS = ("email", "ip", "card", "phone")
#: The base patterns; an email is searched from its at sign, and digits are taken as whole runs.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN, GROUPS = re.compile(r"[A-Za-z0-9@._%+/:#-]+"), re.compile(r"[0-9][0-9().\x20-]*")
MARK, WORD = re.compile("[0-9@]"), re.compile(r"[^\s]+")
CONTEXT_CHARS, LONG_WORD, TOKEN_CHARS, GROUP_DIGITS, BATCH_ROWS = 200, 64, 5, 7, 256
SPANS = "array<struct<kind:string,start:int,end:int>>"
MENTIONS = "array<struct<start:int,end:int,instance:string,seed:boolean,patterns:array<string>>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Start and end of each email, leftmost first, not overlapping."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        if m := DOMAIN.match(text, at + 1):
            while start > free and text[start - 1] in LOCAL:
                start -= 1
        if start < at:
            free = m.end()
            out.append((start, free))
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of each base match that holds, by kind as listed and then by start."""
    out = [("email", a, b) for a, b in emails(text)]
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def plain_words(piece: str, cut: int | None) -> list[str]:
    """Words in lower case without punctuation, digits as 0; the word at place `cut` goes on outside the piece."""
    words = WORD.findall(piece)
    if cut is not None and words:
        words[cut] = "~"
    return [x for w in words if (x := "~" if len(w) > LONG_WORD else re.sub("[0-9]+", "0", w.strip(".,;:()[]\"'").lower()))]


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a mention."""
    a, b = max(0, start - CONTEXT_CHARS), min(len(text), end + CONTEXT_CHARS)
    before = plain_words(text[a:start], 0 if a and not text[a - 1].isspace() and not text[a].isspace() else None)[-2:]
    after = plain_words(text[end:b], -1 if b < len(text) and not text[b].isspace() and not text[b - 1].isspace() else None)[:2]
    out = []
    if len(before) == 2:
        out.append("L " + " ".join(before))
    if before and after:
        out.append(f"B {before[-1]} _ {after[0]}")
    if len(after) == 2:
        out.append("R " + " ".join(after))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Start and end of tokens and groups of digits that may be identifiers; groups first, tokens may overlap them."""
    out = []
    for m in GROUPS.finditer(text):
        piece = m[0].rstrip("(). -")
        if " " in piece and sum("0" <= c <= "9" for c in piece) >= GROUP_DIGITS:
            start = m.start() - (m.start() > 0 and text[m.start() - 1] == "(" and piece.find(")") > 0)
            out.append((start, m.start() + len(piece)))
    for m in TOKEN.finditer(text):
        end = m.start() + len(m[0].rstrip(".:/-"))
        if end - m.start() >= TOKEN_CHARS and MARK.search(text, m.start(), end):
            out.append((m.start(), end))
    return out


def mentions(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds, and other pieces that look like identifiers."""
    one = lambda a, b, seed: {"start": a, "end": b, "instance": re.sub(r"[^a-z0-9@]", "", text[a:b].lower()), "seed": seed, "patterns": patterns(text, a, b)}
    out = [one(a, b, True) for _, a, b in spans]
    if not MARK.search(text):
        return out
    # by start, seeds before groups and groups before tokens where they begin together; what overlaps the last is out
    order = sorted([(a, 0, b) for _, a, b in spans] + [(a, 1, b) for a, b in candidates(text)], key=lambda x: (x[0], x[1], -x[2]))
    seeds = sorted((a, b) for _, a, b in spans)
    free, at = 0, 0
    for a, kind, b in order:
        if kind == 0:
            free = max(free, b)
            continue
        while at < len(seeds) and seeds[at][1] <= a:
            at += 1
        if a >= free and not (at < len(seeds) and seeds[at][0] < b):
            out.append(one(a, b, False))
            free = b
    return out


def found(docs: DataFrame) -> DataFrame:
    """Adds base spans and mentions to every row; needs the column text and keeps all."""
    kept = docs.columns

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        mention = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))]))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                rows = batch.slice(at, BATCH_ROWS)
                texts = [t or "" for t in rows.column("text").to_pylist()]
                spans = [base_spans(t) for t in texts]
                own = [mentions(t, s) for t, s in zip(texts, spans, strict=True)]
                columns = [*rows.columns, pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], span), pa.array(own, mention)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "base", "mentions"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(find, f"{fields}, base {SPANS}, mentions {MENTIONS}")


def scored(edges: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """The sure patterns, and the accepted instances. edges: pattern, instance, seed (of the pair), once each."""
    # an instance that is a seed anywhere is one everywhere
    spread = edges.groupBy("instance").agg(F.bool_or("seed").alias("positive"), F.count(F.lit(1)).alias("n"))
    usual = spread.filter("positive").agg(F.avg("n")).first()[0] or 0.0  # one number
    state = scratch.stage(spread.select("instance", "n", "positive", (~F.col("positive") & (F.col("n") >= NEGATIVE_SPREAD * usual)).alias("negative")), "state0")
    share, n = F.col("pos") / F.col("n"), F.col("n")
    wilson = (share + Z * Z / (2 * n) - Z * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    for k in range(ROUNDS):
        sums = edges.join(state.drop("n"), "instance").groupBy("pattern").agg(F.count_if("positive").alias("pos"), F.count_if("negative").alias("neg"), F.count(F.lit(1)).alias("all"))
        weighed = sums.filter(F.col("pos") >= SUPPORT).withColumn("n", F.col("pos") + F.col("neg") + UNKNOWN_WEIGHT * (F.col("all") - F.col("pos") - F.col("neg")))
        sure = scratch.stage(weighed.select("pattern", wilson.alias("confidence")).filter(F.col("confidence") >= MIN_CONFIDENCE), f"patterns{k}")
        doubt = edges.join(sure, "pattern").groupBy("instance").agg(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))).alias("doubt"), F.count(F.lit(1)).alias("n_sure"))
        certain = F.coalesce((1 - F.exp("doubt") >= MIN_CONFIDENCE) & (F.col("n_sure") >= MIN_SHARE * F.col("n")), F.lit(False))
        positive = F.col("positive") | certain
        state = scratch.stage(state.join(doubt, "instance", "left").select("instance", "n", positive.alias("positive"), (F.col("negative") & ~positive).alias("negative")), f"state{k + 1}")
    return sure.select("pattern"), state.filter("positive").select("instance")


def accepted(staged: DataFrame, scratch: common.Scratch) -> DataFrame:
    """row and the spans of kind "context" there. staged: row, mentions."""
    each = staged.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    edges = each.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.bool_or("seed").alias("seed"))
    _, certain = scored(scratch.stage(edges, "edges"), scratch)
    hits = each.filter(~F.col("seed")).select("row", "start", "end", "instance").join(certain, "instance", "left_semi")
    spans = hits.select("row", F.struct(F.lit("context").alias("kind"), "start", "end").alias("s")).distinct()
    return spans.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("added"))


def detected(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Every row's base (spans by kind and start) and added (spans of kind context); its columns `keep` in the struct
    _kept, but for text, which is a column of its own."""
    scratch = common.Scratch(docs.sparkSession, "personal-data")
    own = docs.select(F.struct(*(c for c in keep if c != "text")).alias("_kept"), "text", F.monotonically_increasing_id().alias("row"))
    rows = found(own)
    staged = scratch.stage(rows if "text" in keep else rows.drop("text"), "found")
    added = scratch.stage(accepted(staged.select("row", "mentions").filter(F.size("mentions") > 0), scratch), "added")
    return staged.drop("mentions").join(added.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left").withColumn("added", F.coalesce("added", F.array().cast(SPANS))).drop("_row", "row")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with its kind in angle brackets in place of each span, in one pass; of spans that overlap the first begins and the last ends."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets, and n_chars, where there is one, counted anew."""
    rows = detected(docs, docs.columns).select("_kept", "text", F.concat("base", "added").alias("spans"))

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                spans = part.column(2).to_pylist()
                new = [masked(t, [(s["start"], s["end"], s["kind"]) for s in own]) if own else t for t, own in zip(part.column(1).to_pylist(), spans, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(new, pa.string()), pa.array([bool(own) for own in spans])], ["_kept", "_text", "changed"])

    out = rows.mapInArrow(mask, T.StructType([rows.schema["_kept"], T.StructField("_text", T.StringType()), T.StructField("changed", T.BooleanType())]))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("changed"), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_kept.n_chars"))
    return out.select(*(new.get(c, F.col("_kept")[c]).alias(c) for c in docs.columns))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detected(common.table(spark, sf_dir, "documents"), ["doc_id"])
    text_of = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select("_kept.doc_id", *(number(k).alias(f"n_{k}") for k in KINDS), F.sha2(text_of("base"), 256).alias("base_sha256"), text_of(F.concat("base", "added")).alias("spans"))
