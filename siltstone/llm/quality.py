"""Quality rules whose cutoffs are certified on labelled documents.

Every document gets its counts and the features of RULES from its whole text. A rule rejects what lies beyond its
cutoff. All rules' cutoffs run together in STEPS steps from mild to strict, so a stratum (the language) has one sequence
of nested rejections. A step is certified if the exact binomial probability of so few false rejections among the
stratum's labelled good documents, were their true rate ALPHA, is at most DELTA / strata (Bonferroni over strata). Steps
are tested from the mildest on and testing stops at the first that fails, so no further correction is due along the
sequence: with probability 1 - DELTA, no stratum's cutoffs reject more than ALPHA of the good documents that the base
rules keep. Among certified steps the one with the best balance of bad and good rejections is used. With too few labels
(fewer than ln(DELTA / strata) / ln(1 - ALPHA), 144 for four strata) nothing is certified and only the base rules reject.

Null texts have no words. A document with several labels counts as bad if one says so, and counts once in a stratum
however many rows it has, as its most rejected one; labels without a document, null labels and other columns are
ignored. A null language is a stratum of its own. Repeated rows are judged each. An empty table gives no rows. A very
long text is arrays of its words and their hashes within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import common, native

ALPHA, DELTA, GOOD_WEIGHT, WINDOW, STEPS = 0.03, 0.05, 20.0, 8, 24
#: Each rule's feature and its mildest and strictest cutoff; a rule rejects what lies beyond its cutoff.
RULES = {
    "long_words": ("mean_word", 12.0, 6.5),
    "short_words": ("minus_mean_word", -2.0, -4.0),
    "symbols": ("symbol_share", 0.4, 0.01),
    "repeated_lines": ("line_share", 0.98, 0.35),
    "repeated_words": ("repeat_share", 0.98, 0.3),
    "capitals": ("capital_share", 0.98, 0.3),
}
CUTOFFS = {name: [mild + (strict - mild) * k / (STEPS - 1) for k in range(STEPS)] for name, (_, mild, strict) in RULES.items()}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds BASE, the features and base_failed to each row; needs the columns text and stratum."""
    kept = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_words", native.words_of(F.col("text")))
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    df = native.with_window_hashes(df, "_hashes", [WINDOW]).withColumnRenamed(f"w{WINDOW}", "_windows")
    df = df.withColumn("_again", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    # only texts with a repeated window are sorted: windows by hash, so that equal ones are neighbours
    df = df.withColumn("_sorted", F.when(F.col("_again"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("_equal", F.zip_with("_sorted", F.slice("_sorted", 2, F.size("_windows")), lambda a, b: a["h"] == b["h"]))
    df = df.withColumn("_found", F.filter("_sorted", lambda s, k: F.coalesce(F.col("_equal")[k], F.lit(False)) | ((k > 0) & F.col("_equal")[F.greatest(k - 1, F.lit(0))])))
    df = df.withColumn("_places", F.sort_array(F.transform("_found", lambda s: s["i"])))
    covered = F.aggregate(F.zip_with("_places", F.slice("_places", 2, F.size("_windows")), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda x, y: x + y)
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(native.SPACES)) != "")
    df = df.withColumn("_lines", lines)
    n_lines = F.size("_lines")
    df = df.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate(text, native.SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        n_lines.cast("long").alias("n_lines"),
        (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    df = df.withColumn("mean_word", share("word_chars", "n_words")).withColumn("minus_mean_word", -F.col("mean_word"))
    df = df.withColumn("symbol_share", share("n_symbols", "word_chars")).withColumn("line_share", share("n_dup_lines", "n_lines"))
    df = df.withColumn("repeat_share", share("n_repeat_words", "n_words")).withColumn("capital_share", share("n_capitals", "word_chars"))
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def beyond(feature: str, cutoffs: list[float]) -> Column:
    """How many of the cutoffs the feature lies beyond."""
    return F.size(F.filter(F.array(*map(F.lit, cutoffs)), lambda c: F.col(feature) > c))


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """The exact probability of at most k of n at this rate, summed from logarithms."""
    ratio = F.log(F.lit(rate / (1 - rate)))
    start = F.struct((n * F.log(F.lit(1 - rate))).alias("last"), F.exp(n * F.log(F.lit(1 - rate))).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        last = acc["last"] + F.log((n - j + 1) / j) + ratio
        return F.struct(last.alias("last"), (acc["sum"] + F.exp(last)).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * rate, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.aggregate(terms, start, add, lambda acc: acc["sum"])))


def labelled_counts(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Good and bad labelled documents by stratum and by the steps that reject them, counted from the strictest."""
    marks = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = stats.filter("not base_failed").join(marks.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"))
    passed = F.greatest(*(beyond(f, CUTOFFS[name]) for name, (f, _, _) in RULES.items()))
    once = held.groupBy("stratum", "doc_id").agg(F.max(passed).alias("passed"), F.min("quality").alias("quality"))
    good, bad = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") != 1)
    return once.groupBy("stratum", "passed").agg(good.alias("good"), bad.alias("bad"))


def certified(counts: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """From labelled_counts, a row for each stratum with a certified step: stratum, place, and its figures."""
    own = Window.partitionBy("stratum")
    totals = counts.groupBy("stratum").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
    tested = totals.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))))
    # a document beyond the cutoffs of `passed` steps is rejected at the places STEPS - passed and stricter
    exact = counts.select("stratum", "good", "bad", (STEPS - F.col("passed")).alias("from"))
    rejected = tested.alias("t").join(exact.alias("e"), F.expr("t.stratum <=> e.stratum and e.from <= t.place"), "left")
    rejected = rejected.groupBy("t.stratum", "t.place", "t.n_good", "t.n_bad").agg(F.coalesce(F.sum("e.good"), F.lit(0)).alias("false_rejected"), F.coalesce(F.sum("e.bad"), F.lit(0)).alias("rejected"))
    n_strata = counts.select("stratum").distinct().count()
    tests = rejected.withColumn("p", binomial_tail(F.col("false_rejected"), F.col("n_good"), alpha))
    worst = F.max("p").over(own.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    passed = tests.withColumn("worst", worst).filter(F.col("worst") * n_strata <= delta)
    balance = F.col("rejected") / F.greatest(F.col("n_bad"), F.lit(1)) - GOOD_WEIGHT * F.col("false_rejected") / F.greatest(F.col("n_good"), F.lit(1))
    best = F.row_number().over(own.orderBy(F.desc(balance), "place"))
    return passed.withColumn("best", best).filter("best = 1 and rejected > 0").select("stratum", "place", "n_good", "false_rejected", "n_bad", "rejected", "p")


def judged(stats: DataFrame, steps: DataFrame) -> DataFrame:
    """Adds failed_rules and kept; a stratum has at most one row of steps, Spark broadcasts it only if it is small."""
    chosen = steps.select(F.col("stratum").alias("_stratum"), F.col("place").alias("_place"))
    cutoff = lambda name: F.array(*map(F.lit, CUTOFFS[name]))[F.col("_place")]
    failed = F.array_compact(F.array(*(F.when(F.col(f) > cutoff(name), F.lit(name)) for name, (f, _, _) in RULES.items())))
    df = stats.join(chosen, F.col("stratum").eqNullSafe(F.col("_stratum")), "left").withColumn("failed_rules", F.coalesce(failed, F.array().cast("array<string>")))
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_place", "_stratum")


def quality(docs: DataFrame, labels: DataFrame, keep: list[str], *, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Every row's counts, stratum, failed_rules, base_failed and kept, and its columns `keep` in the struct _kept."""
    own = docs.select("doc_id", "text", F.col("lang").alias("stratum"), F.struct(*keep).alias("_kept"))
    scratch = common.Scratch(docs.sparkSession, "quality")
    stats = scratch.stage(with_counts(own).drop("text"), "stats")
    counts = scratch.stage(labelled_counts(stats, labels), "counts")
    steps = scratch.stage(certified(counts, alpha=alpha, delta=delta), "steps")
    return judged(stats, steps)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = quality(common.table(spark, sf_dir, "documents"), labels, ["doc_id"])
    return rows.select("doc_id", *BASE, "base_failed", "kept", "stratum", F.array_join("failed_rules", "+").alias("failed_rules"))
