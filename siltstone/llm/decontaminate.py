"""Benchmark decontamination by template windows.

A text's tokens are canonical: numbers (digits with a sign, and NUMBERS), names (words of two letters or more with a
capital, unless they are FUNCTION words) and units become typed placeholders, other words are in lower case without
punctuation. Windows of WINDOW canonical tokens of documents are hash-joined with those of the benchmark items, so a
question with other numbers, names or units still matches. Slots tell whether a match is one: the values in an item's
placeholders must map to the document's values one to one. An item of fewer tokens than a window is one window of its
own size. Each word of a name of several is a slot of its own, so names match names of as many words.

A capital may begin a sentence or a name, so an item's window is indexed with each capitalised word as a name and as a
word, and so is the first word of a sentence in lower case; FUNCTION words are words everywhere. A document's windows
are taken in FORMS: with every capitalised word as a name, and as they stand in lower case. The words of a match are then
compared: where they differ, both must be names, numbers or units.

A pair is contaminated if windows that are consistent or equal word for word cover MIN_SHARE of the item's tokens, or
MIN_TOKENS. Windows with fewer than half of their tokens literal are evidence only where they are equal word for word.

Items of fewer than MIN_TEMPLATE tokens have too few to be a template, so they match word for word only, and where some
of their words are signs, which are no tokens, as strings of code points, by hashed windows and then in full. So do items of up to
MIN_TEMPLATE tokens in a script that puts no spaces between words.

Null and empty texts match nothing. Each text is judged by itself, whatever rows share its id or have none: a pair of a
document and an item is contaminated if one of the document's texts is, and `clean` only drops that text. Repeated rows share
one judgement; other columns are ignored; an empty table on either side gives no pairs. A very long text is arrays of its
words and window hashes within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common, native

WINDOW, MIN_TEMPLATE, MIN_SHARE, MIN_TOKENS = 8, 4, 0.5, 13
#: A side of a join is broadcast up to so many rows, and shuffled beyond.
BROADCAST_ROWS = 200_000
#: Units of measure, currency and time.
UNITS = "kg g mg lb lbs oz km m cm mm mi mile miles ft feet inch inches yard yards l ml litre litres liter liters gallon gallons sec second seconds min minute minutes hr hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents percent hz khz mhz ghz kw kj".split()
#: Number words, and words that begin sentences and are no names.
NUMBERS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
FUNCTION = "the this that these those there here it he she we you they his her its our your their my if when while where what which who whom whose why how is are was were be do does did can could will would shall should may might must has have had not no yes and but or nor so for from in on at by with without of to as an into over under about after before between during then than thus hence because although though since until unless each every all both some any many much most few several other another such".split()
PUNCTUATION = ".,;:!?()[]{}\"'`´‘’“”«»…*_|/\\$€£%#&<>=+~^"
#: Marks before a word: a capital within a sentence, another capital, the first word of a sentence in lower case.
INNER, OUTER, FIRST = "\x02", "\x03", "\x04"
MARKS, SLOT = INNER + OUTER + FIRST, "\x01"
SPACE = "[ \\t-\\r]"
NAME = f"{SLOT}name"
#: Scripts that don't part words by spaces.
UNSPACED = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]"
#: A document's windows: capitals as names, words as they stand.
FORMS = ("names", "raw")


def any_of(words: list[str]) -> str:
    """A pattern of any of the words, the longest first, those with one first letter together."""
    of = {c: sorted((w[1:] for w in words if w[0] == c), key=len, reverse=True) for c in sorted({w[0] for w in words})}
    return f"(?=[{''.join(of)}])(?:{'|'.join(c + '(?:' + '|'.join(rest) + ')' for c, rest in of.items())})"


def marked_text(text: Column, *, first: bool = False) -> Column:
    """The text without punctuation; capitalised words begin with a mark, and with `first` those that begin a sentence."""
    plain = F.translate(F.coalesce(text, F.lit("")), MARKS + SLOT, "")
    words = any_of(FUNCTION) + "(?!\\p{L})"
    if first:
        quotes = "[^\\p{L}\\p{N}\\s]*"
        plain = F.regexp_replace(plain, f"(^\\s*{quotes}|[.?!:]{quotes}\\s+{quotes})(?=\\p{{Ll}})(?!{words})", f"$1{FIRST}")
    name = f"(?=\\p{{Lu}}\\p{{L}})(?!(?i:{words}))"
    # patterns begin with the space before a word, which fails sooner at other places than to look behind each of them
    named = F.regexp_replace(plain, f"{SPACE}(?<=[\\p{{L}}\\p{{N}},;)\"']{SPACE}){name}", f"$0{INNER}")
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(named, PUNCTUATION, "")), f"{SPACE}{name}", f"$0{OUTER}")


def canonical_text(low: Column) -> Column:
    """Text in lower case with typed placeholders but for names. Patterns run over whole texts: one per token costs more."""
    padded, units = F.concat(F.lit(" "), low), any_of(UNITS)
    out = F.regexp_replace(padded, f"({SPACE})(?:[-\u2212]?[0-9]+|{any_of(NUMBERS)})({units})?(?![^ \\t-\\r])", f"$1{SLOT}number$2")
    out = F.regexp_replace(out, f"{SLOT}number(?=[^ \\t-\\r])[^ \\t-\\r]+", f"{SLOT}numberunit")
    return F.regexp_replace(out, f"({SPACE}){units}(?![^ \\t-\\r])", f"$1{SLOT}unit")


def with_tokens(df: DataFrame, *, first: bool = False) -> DataFrame:
    """Adds, place by place, tokens with marks, canonical ones, and words in lower case; needs text."""
    own = df.withColumn("_marked", marked_text(F.col("text"), first=first))
    own = own.withColumn("_low", F.lower(F.translate("_marked", MARKS, "")))
    own = own.withColumn("tokens", native.words_of(F.col("_marked"))).withColumn("words", native.words_of(F.col("_low")))
    return own.withColumn("canonical", native.words_of(canonical_text(F.col("_low")))).drop("_marked", "_low")


def is_slot(token: Column) -> Column:
    """Whether a canonical token is a placeholder."""
    return token.startswith(SLOT)


def is_capital(token: Column) -> Column:
    return token.startswith(INNER) | token.startswith(OUTER)


def windows(df: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """key, size, place and hash of every window in each form; df has the column text."""
    own = df.withColumn("_marked", marked_text(F.col("text")))
    own = own.withColumn("_raw", F.lower(F.translate("_marked", MARKS, "")))
    # names are put in as text, so that each form is split and hashed once
    own = own.withColumn("_names", canonical_text(F.lower(F.regexp_replace("_marked", f"[{INNER}{OUTER}][^ \\t-\\r]+", NAME))))
    for form in FORMS:
        own = own.withColumn(f"_words_{form}", native.words_of(F.col(f"_{form}"))).withColumn(form, F.transform(f"_words_{form}", lambda w: F.xxhash64(w)))
        own = native.with_window_hashes(own, form, sizes)
        own = own.withColumnsRenamed({f"w{s}": f"_{form}{s}" for s in sizes})
    own = own.withColumn("_n", F.size("raw"))
    # not posexplode: the filter that Spark infers from it would evaluate the windows again before each text
    parts = [own.select(key, "_n", F.lit(s).alias("size"), F.posexplode_outer(F.concat(*(f"_{form}{s}" for form in FORMS))).alias("at", "hash")) for s in sizes]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(key, "size", (F.col("at") % F.greatest(F.col("_n") - F.col("size") + 1, F.lit(1))).alias("place"), "hash")


def loses_words() -> Column:
    """Whether some of a text's words are signs alone, which are no tokens."""
    return F.size(native.words_of(F.col("text"))) != F.size("tokens")


def item_windows(items: DataFrame) -> DataFrame:
    """window (a number), item_id, n_tokens, size, item_place and the tokens, words and canonical tokens of each window."""
    own = with_tokens(items.select("item_id", "text").distinct(), first=True).filter((F.size("tokens") >= MIN_TEMPLATE) | ((F.size("tokens") > 0) & ~loses_words()))
    own = own.withColumn("size", F.least(F.size("tokens"), F.lit(WINDOW)))
    rows = own.withColumn("n_tokens", F.size("tokens")).withColumn("item_place", F.explode(F.sequence(F.lit(0), F.col("n_tokens") - F.col("size"))))
    part = lambda c: F.slice(c, F.col("item_place") + 1, F.col("size")).alias(c)
    return rows.select(F.monotonically_increasing_id().alias("window"), "item_id", "n_tokens", "size", "item_place", part("tokens"), part("words"), part("canonical"))


def item_hashes(wanted: DataFrame) -> DataFrame:
    """window, item_id, n_tokens, size, item_place and hash: the window as it stands, and each reading with enough literal tokens."""
    both = F.zip_with("canonical", "tokens", lambda c, t: F.struct(c.alias("c"), (is_capital(t) | t.startswith(FIRST)).alias("either")))
    with_word = lambda made, c: F.transform(made, lambda v: F.concat(v, F.array(c)))
    step = lambda made, z: F.when(z["either"], F.concat(with_word(made, z["c"]), with_word(made, F.lit(NAME)))).otherwise(with_word(made, z["c"]))
    read = F.aggregate("_both", F.array(F.array().cast("array<string>")), step)
    readings = F.filter("_read", lambda v: (F.size(v) >= MIN_TEMPLATE) & (F.size(F.filter(v, lambda w: ~is_slot(w))) * 2 >= F.size(v)))
    own = wanted.withColumn("_both", both).withColumn("_read", read).withColumn("_read", readings)
    own = own.withColumn("_hashes", F.explode(F.array_distinct(F.concat("_read", F.array("words")))))
    sizes = [*range(1, WINDOW + 1)]
    own = native.with_window_hashes(own.withColumn("_hashes", F.transform("_hashes", lambda w: F.xxhash64(w))), "_hashes", sizes)
    chosen = F.coalesce(*(F.when(F.col("size") == s, F.col(f"w{s}")[0]) for s in sizes))
    return own.select("window", "item_id", "n_tokens", "size", "item_place", chosen.alias("hash")).distinct()


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a hint to broadcast it, if it has been counted to be small enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def judged(hits: DataFrame, own: DataFrame, place: list[str], name: str) -> DataFrame:
    """Adds the number of slots of `own` at each place, and whether their values map one to one, as column `name`."""
    values = own.select(*place, F.explode("values").alias("z")).select(*place, "z.item_words", "z.doc_words").distinct()
    forward = values.groupBy(*place, "item_words").agg(F.count(F.lit(1)).alias("n")).select(*place, "n", F.lit(1).alias("slot"))
    back = values.groupBy(*place, "doc_words").agg(F.count(F.lit(1)).alias("n")).select(*place, "n", F.lit(0).alias("slot"))
    checked = forward.unionByName(back).groupBy(*place).agg(F.sum("slot").alias("_slots"), (F.max("n") <= 1).alias("_same"))
    checked = checked.select(*(F.col(c).alias(f"_{c}") for c in place), "_slots", "_same")
    joined = hits.join(checked, F.expr(" and ".join(f"{c} <=> _{c}" for c in place)), "left")
    return joined.select(*hits.columns, F.coalesce("_slots", F.lit(0)).cast("long").alias("n_slots"), F.coalesce("_same", F.lit(True)).alias(name))


def literal_matches(docs: DataFrame, items: DataFrame, scratch: common.Scratch) -> DataFrame | None:
    """doc_id, row, item_id, n_tokens, n_windows: texts that hold an item that isn't words, code point by code point.

    Case and runs of white space don't count. docs: doc_id, row, text. None if no item is of this kind.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), f"{SPACE}+", " "))
    own = with_tokens(items.select("item_id", "text").distinct(), first=True).withColumn("n_tokens", F.size("tokens").cast("long")).withColumn("item", plain(F.col("text")))
    signs = (F.col("n_tokens") < MIN_TEMPLATE) & loses_words()
    own = own.filter((F.length("item") > 0) & ((F.col("n_tokens") == 0) | signs | ((F.col("n_tokens") <= MIN_TEMPLATE) & F.col("item").rlike(UNSPACED))))
    characters = lambda c: F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), lambda x: F.xxhash64(x))
    own = own.select("item_id", "n_tokens", "item", F.least(F.length("item"), F.lit(WINDOW)).alias("size"), characters(F.col("item")).alias("_h"))
    own = native.with_window_hashes(own, "_h", [*range(1, WINDOW + 1)])
    own = scratch.stage(own.select("item_id", "n_tokens", "item", "size", F.coalesce(*(F.when(F.col("size") == s, F.col(f"w{s}")[0]) for s in range(1, WINDOW + 1))).alias("hash")), "literals")
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())  # WINDOW at most
    if not sizes:
        return None
    texts = native.with_window_hashes(docs.withColumn("_plain", plain(F.col("text"))).withColumn("_h", characters(F.coalesce("_plain", F.lit("")))), "_h", sizes)
    found = None
    for s in sizes:
        at = texts.select("doc_id", "row", "_plain", F.posexplode_outer(f"w{s}").alias("place", "_hash")).join(small(own.filter(F.col("size") == s), own.count()), F.col("_hash") == F.col("hash"))
        at = at.filter(F.col("_plain").substr(F.col("place") + 1, F.length("item")) == F.col("item")).select("doc_id", "row", "item_id", "n_tokens", "place")
        found = at if found is None else found.unionByName(at)
    return found.distinct().groupBy("doc_id", "row", "item_id").agg(F.max("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_windows"))


def text_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, row (the text's hash), item_id, n_tokens, n_windows, n_covered, n_slots, consistent and contaminated of each
    text and item with a match."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "decontaminate")
    wanted = scratch.stage(item_windows(items), "items")
    keys = scratch.stage(item_hashes(wanted), "keys")
    facts = keys.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each window size
    sizes, n_wanted = sorted(r["size"] for r in facts) or [WINDOW], sum(r["n"] for r in facts)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    joined = windows(own.select(F.struct("doc_id", "row").alias("key"), "text"), "key", sizes).join(small(keys, n_wanted), ["size", "hash"])
    # a window may match in several forms
    found = joined.select("key.doc_id", "key.row", "item_id", "n_tokens", "size", "place", "item_place", "window").distinct()
    hits = scratch.stage(found.withColumn("shift", F.col("place") - F.col("item_place")), "hits")
    texts = scratch.stage(hits.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct(), "texts")
    place = ["doc_id", "row", "item_id", "shift"]
    read = with_tokens(own.join(small(texts, texts.count()), F.expr("doc_id <=> _id and row = _row"), "left_semi").dropDuplicates(["doc_id", "row"]))
    read = read.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("tokens").alias("_tokens"), F.col("words").alias("_words"))
    seen = hits.join(small(wanted.select("window", "tokens", "words", "canonical"), n_wanted), "window").join(read, F.expr("doc_id <=> _id and row = _row"))
    part = lambda c: F.slice(c, F.col("place") + 1, F.col("size"))
    pairs = F.arrays_zip("tokens", "words", "canonical", part("_tokens").alias("doc_tokens"), part("_words").alias("doc_words"))
    seen = seen.withColumn("_pairs", pairs)
    same = lambda z: z["words"] == z["doc_words"]
    names = lambda z: is_capital(z["tokens"]) & is_capital(z["doc_tokens"])
    # the first word of a sentence is a slot only where it differs
    slot = lambda z: is_slot(z["canonical"]) | (names(z) & (z["tokens"].startswith(INNER) | ~same(z)))
    value = lambda c: F.translate(c, MARKS, "")
    values = F.transform(F.filter("_pairs", slot), lambda z: F.struct(value(z["tokens"]).alias("item_words"), value(z["doc_tokens"]).alias("doc_words")))
    match = F.forall("_pairs", lambda z: same(z) | is_slot(z["canonical"]) | names(z))
    first = F.exists("_pairs", lambda z: ~same(z) & ~is_slot(z["canonical"]) & ~z["tokens"].startswith(INNER))
    compared = seen.withColumn("first", first).withColumn("_match", match).withColumn("exact", F.forall("_pairs", same)).withColumn("values", values).filter("_match")
    hits = scratch.stage(compared.select(*place, "n_tokens", "size", "item_place", "exact", "first", "values"), "compared")
    # matches that read the first word of a sentence as a name must not make others at their place inconsistent
    hits = judged(hits, hits.filter("not first"), place, "sure").withColumnRenamed("n_slots", "_sure")
    hits = judged(hits, hits, place, "consistent")
    hits = hits.withColumn("n_slots", F.when(F.col("consistent") | F.col("first"), F.col("n_slots")).otherwise(F.col("_sure")))
    hits = hits.withColumn("consistent", F.col("consistent") | (~F.col("first") & F.col("sure")))
    key = ["doc_id", "row", "item_id"]
    # a match with inconsistent slots covers nothing but where it is equal word for word
    covered = hits.filter("consistent or exact").select(*key, F.explode(F.sequence("item_place", F.col("item_place") + F.col("size") - 1)).alias("at")).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_covered"))
    counted = hits.groupBy(*key).agg(F.max("n_tokens").cast("long").alias("n_tokens"), F.count(F.lit(1)).alias("n_windows"), F.max("n_slots").alias("n_slots"), F.bool_or("consistent").alias("consistent"))
    rows = counted.alias("w").join(covered.alias("c"), F.expr("w.doc_id <=> c.doc_id and w.row = c.row and w.item_id <=> c.item_id"), "left").select("w.*", F.coalesce("c.n_covered", F.lit(0)).cast("long").alias("n_covered"))
    enough = (F.col("n_covered") >= MIN_SHARE * F.col("n_tokens")) | (F.col("n_covered") >= MIN_TOKENS)
    rows = rows.withColumn("contaminated", enough)
    literal = literal_matches(own, items, scratch)
    if literal is None:
        return rows
    whole = literal.select(*key, "n_tokens", "n_windows", F.lit(0).cast("long").alias("n_slots"), F.lit(True).alias("consistent"), F.col("n_tokens").alias("n_covered"), F.lit(True).alias("contaminated"))
    # an item may be found both ways
    both = rows.unionByName(whole).groupBy(*key)
    return both.agg(*(F.max(c).alias(c) for c in ("n_tokens", "n_windows", "n_slots")), F.bool_or("consistent").alias("consistent"), F.max("n_covered").alias("n_covered"), F.bool_or("contaminated").alias("contaminated"))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same for each document and item: the most of any of the document's texts, contaminated if one of them is."""
    of = text_matches(docs, items).groupBy("doc_id", "item_id")
    return of.agg(*(F.max(c).alias(c) for c in ("n_tokens", "n_windows", "n_slots")), F.bool_or("consistent").alias("consistent"), F.max("n_covered").alias("n_covered"), F.bool_or("contaminated").alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows whose text isn't contaminated; rows of the same id with other texts stay."""
    found = text_matches(docs, items).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_row")), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).filter("contaminated")
