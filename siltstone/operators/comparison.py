"""Comparison of annotators and of predicted with reference events: sets, multisets, confusion, bootstrap."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import md5

SEMANTIC = ["document_id", "field_name", "normalized_value", "unit", "event_type"]
EXACT = [*SEMANTIC, "paragraph_id", "start_char", "end_char"]
ATTRIBUTES = ["duration_ps", "temperature_k", "pressure_bar", "timestep_fs", "ensemble", "restraints", "replicates"]
MISSED, SPURIOUS = "__missed__", "__spurious__"
ITERATIONS, SEED, INTERVAL = 2000, 3997, (0.025, 0.975)
#: Raw numbers taken from the generator at once; places of documents whose counts travel as one value, and that a task holds.
BLOCK, PLACES, GROUP = 1 << 20, 1 << 16, 1 << 24
#: Places that a task holds whose draws are hashes: each group draws anew, and a hash costs more than a generator's number.
HASHED_GROUP = 1 << 26


def significant(value: Column, digits: int = 12) -> Column:
    """A number rounded to so many significant digits; two numbers are the same value if these agree."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(value))))
    return F.when((value == 0) | value.isNull(), value).otherwise(F.round(value * scale) / scale)


def span_errors(annotations: DataFrame) -> DataFrame:
    """Annotations whose quote isn't as long as their span, or whose span is empty or negative."""
    right = (F.col("start_char") >= 0) & (F.col("end_char") > F.col("start_char")) & (F.col("end_char") - F.col("start_char") == F.length("quote"))
    return annotations.filter(~F.coalesce(right, F.lit(False)))


def sides(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of both with in_a and in_b. A grouping takes nulls as equal, as these keys want it."""
    rows = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    return rows.groupBy(*keys).agg((F.max("_a") == 1).alias("in_a"), (F.max("_b") == 1).alias("in_b"))


def agreement(agreed: Column, only_a: Column, only_b: Column) -> Column:
    total = agreed + only_a + only_b
    return F.when(total == 0, 1.0).otherwise(agreed / F.greatest(total, F.lit(1)))


def _counts() -> list[Column]:
    return [F.count_if(F.col("in_a") & F.col("in_b")).alias("agreed"), F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a"), F.count_if(~F.col("in_a") & F.col("in_b")).alias("only_b")]


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row a level (semantic, exact): agreed, only_a, only_b, agreement."""
    levels = [sides(a, b, keys).agg(*_counts()).withColumn("level", F.lit(name)) for name, keys in (("semantic", SEMANTIC), ("exact", EXACT))]
    return levels[0].unionByName(levels[1]).withColumn("agreement", agreement(F.col("agreed"), F.col("only_a"), F.col("only_b")))


def compared_by_field(a: DataFrame, b: DataFrame) -> DataFrame:
    rows = sides(a, b, SEMANTIC).groupBy("field_name").agg(*_counts())
    return rows.withColumn("agreement", agreement(F.col("agreed"), F.col("only_a"), F.col("only_b")))


def disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """Exact keys of one side only, to be adjudicated."""
    rows = sides(a, b, EXACT).filter("in_a <> in_b")
    return rows.select(*EXACT, F.when(F.col("in_a"), "a").otherwise("b").alias("source"), F.lit("pending").alias("status"))


def attribute_rows(events: DataFrame) -> DataFrame:
    """A row for each event and attribute; a value is text, numbers by significant digits, and may be null."""
    kinds = dict(events.dtypes)
    value = lambda c: significant(F.col(c)).cast("string") if kinds[c] in ("double", "float") else F.col(c).cast("string")
    own = F.array(*(F.struct(F.lit(c).alias("attribute"), value(c).alias("value")) for c in ATTRIBUTES if c in kinds))
    return events.select("document_id", "event_type", F.explode(own).alias("x")).select("document_id", "event_type", "x.*")


def attribute_counts(events: DataFrame) -> DataFrame:
    """How often each document, phase, attribute and value occurs; numbers by significant digits, nulls left out."""
    return attribute_rows(events).filter("value is not null").groupBy("document_id", "event_type", "attribute", "value").agg(F.count(F.lit(1)).alias("n"))


def attribute_keys(events: DataFrame) -> DataFrame:
    return attribute_counts(events).drop("n")


def signature_counts(events: DataFrame) -> DataFrame:
    """How often each document and whole event occurs; null is a value."""
    kinds = dict(events.dtypes)
    own = [(significant(F.col(c)) if kinds[c] in ("double", "float") else F.col(c)).alias(c) for c in ATTRIBUTES if c in kinds]
    keys = [c for c in ATTRIBUTES if c in kinds]
    return events.select("document_id", "event_type", *own).groupBy("document_id", "event_type", *keys).agg(F.count(F.lit(1)).alias("n"))


def duration_phase_counts(events: DataFrame) -> DataFrame:
    own = events.filter("duration_ps is not null").select("document_id", "event_type", significant(F.col("duration_ps")).alias("duration_ps"))
    return own.groupBy("document_id", "event_type", "duration_ps").agg(F.count(F.lit(1)).alias("n"))


def multiset(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """Per document tp, fp and fn of two counted multisets with the same columns and n."""
    keys = [c for c in predicted.columns if c != "n"]
    rows = predicted.select(*keys, F.col("n").alias("p"), F.lit(0).cast("long").alias("r")).unionByName(reference.select(*keys, F.lit(0).cast("long").alias("p"), F.col("n").alias("r")))
    rows = rows.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    zero = F.lit(0)
    return rows.groupBy("document_id").agg(F.sum(F.least("p", "r")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("r"), zero)).alias("fp"), F.sum(F.greatest(F.col("r") - F.col("p"), zero)).alias("fn"))


def article_counts(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """tp, fp and fn of the attributes of every document with an event on either side; 0 where its events have none."""
    # one grouping for both sides; of an event's nulls one stays, so that its document does
    first = lambda events: next(c for c in ATTRIBUTES if c in events.columns)
    side = lambda events, p, r: attribute_rows(events).filter((F.col("attribute") == first(events)) | F.col("value").isNotNull()).withColumns({"p": F.lit(p), "r": F.lit(r)})
    rows = side(predicted, 1, 0).unionByName(side(reference, 0, 1)).groupBy("document_id", "event_type", "attribute", "value").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    stated = lambda x: F.sum(F.when(F.col("value").isNotNull(), x).otherwise(0))
    p, r = F.col("p"), F.col("r")
    return rows.groupBy("document_id").agg(stated(F.least(p, r)).alias("tp"), stated(F.greatest(p - r, F.lit(0))).alias("fp"), stated(F.greatest(r - p, F.lit(0))).alias("fn"))


def metric(rows: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp and fn; 0 where they are undefined."""
    share = lambda a, b: F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(0.0)
    tp = F.col("tp")
    rows = rows.withColumn("precision", share(tp, tp + F.col("fp"))).withColumn("recall", share(tp, tp + F.col("fn")))
    total = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


LEVELS = {"event": signature_counts, "attribute": attribute_counts, "duration_phase": duration_phase_counts}


def evaluated(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """One row a level: event, attribute, duration_phase, summed over documents."""
    rows = None
    for name, counts in LEVELS.items():
        own = multiset(counts(predicted), counts(reference)).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn"))).withColumn("level", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    return metric(rows)


def confusion(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """Reference and predicted phase of events paired by document and duration.

    Equal phases pair first. What is left on both sides is put in order of phase and paired place by place; the rest is
    missed or spurious. Left counts become intervals of places, and two phases pair as often as their intervals overlap,
    so no event is written out as a row. A document and duration is one row with an entry for each phase.
    """
    p, r = duration_phase_counts(predicted), duration_phase_counts(reference)
    keys = ["document_id", "duration_ps", "event_type"]
    none = F.lit(0).cast("long")
    rows = p.select(*keys, F.col("n").alias("p"), none.alias("r")).unionByName(r.select(*keys, none.alias("p"), F.col("n").alias("r")))
    rows = rows.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    phases = F.sort_array(F.collect_list(F.struct("event_type", "p", "r")))
    interval = "array<struct<phase:string,both:bigint,p_from:bigint,p_to:bigint,r_from:bigint,r_to:bigint>>"
    zero = F.struct(none.alias("p_all"), none.alias("r_all"), F.array().cast(interval).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        both = F.least(x["p"], x["r"])
        p_to, r_to = acc["p_all"] + x["p"] - both, acc["r_all"] + x["r"] - both
        one = F.struct(x["event_type"].alias("phase"), both.alias("both"), acc["p_all"].alias("p_from"), p_to.alias("p_to"), acc["r_all"].alias("r_from"), r_to.alias("r_to"))
        return F.struct(p_to.alias("p_all"), r_to.alias("r_all"), F.concat(acc["out"], F.array(one)).alias("out"))

    left = rows.groupBy("document_id", "duration_ps").agg(phases.alias("x")).select(F.aggregate("x", zero, step).alias("a")).select("a.*")
    cell = lambda reference, predicted, n: F.struct(reference.alias("reference_phase"), predicted.alias("predicted_phase"), n.alias("n"))
    equal = F.transform("out", lambda x: cell(x["phase"], x["phase"], x["both"]))
    pairs = F.flatten(F.transform("out", lambda y: F.transform("out", lambda x: cell(y["phase"], x["phase"], F.least(x["p_to"], y["r_to"]) - F.greatest(x["p_from"], y["r_from"])))))
    missed = F.transform("out", lambda x: cell(x["phase"], F.lit(MISSED), x["r_to"] - F.greatest(x["r_from"], F.col("p_all"))))
    spurious = F.transform("out", lambda x: cell(F.lit(SPURIOUS), x["phase"], x["p_to"] - F.greatest(x["p_from"], F.col("r_all"))))
    cells = left.select(F.explode(F.filter(F.concat(equal, pairs, missed, spurious), lambda c: c["n"] > 0)).alias("c"))
    return cells.groupBy("c.reference_phase", "c.predicted_phase").agg(F.sum("c.n").alias("n"))


def resamples(n_documents: int, iterations: int = ITERATIONS, seed: int = SEED) -> list[tuple[int, int, int]]:
    """(iteration, document, times): draws with replacement by Python's generator, counted."""
    rng, places, out = random.Random(seed), range(n_documents), []
    for k in range(iterations):
        drawn: dict[int, int] = {}
        for _ in places:
            at = rng.choice(places)
            drawn[at] = drawn.get(at, 0) + 1
        out += [(k, at, n) for at, n in drawn.items()]
    return out


def _drawn(generator, n: int, left: int) -> Iterator[np.ndarray]:
    """The next `left` draws of places under n, in blocks: the generator's numbers that are in range."""
    shift = 32 - n.bit_length()
    while left:
        block = generator.random_raw(min(BLOCK, left + left // 2 + 64)).view(np.int64)
        block = block[block < n << shift] >> shift
        left -= len(block)
        yield block


def _generator(key: bytes, pos: int):
    source = np.random.MT19937()
    source.state = {"bit_generator": "MT19937", "state": {"key": np.frombuffer(key, np.uint32), "pos": pos}}
    return source


def _turns(first: int, last: int, key: bytes, pos: int, skip: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Iterations from first up to last, each in one or several pieces of its n draws."""
    source = _generator(key, pos)
    source.random_raw(skip, output=False)
    blocks, rest = _drawn(source, n, (last - first) * n), np.empty(0, np.int64)
    for k in range(first, last):
        done = 0
        while done < n:
            if not len(rest):
                rest = next(blocks)
            part, rest = rest[: n - done], rest[n - done :]
            done += len(part)
            yield k, part


def generator_states(spark: SparkSession, n: int, iterations: int, per_task: int, seed: int = SEED) -> DataFrame:
    """first, last, key, pos, skip: the state from which each task draws its iterations, noted by one run through the numbers.

    The generator can't be put ahead, and each iteration takes as many numbers as rejections want. So one task runs through
    them, a few nanoseconds each and nothing kept, and notes the state before the block in which an iteration begins.
    """
    limit = np.uint64(n << 32 - n.bit_length())

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not any(b.num_rows for b in batches):
            return
        *key, pos = random.Random(seed).getstate()[1]
        source, accepted = _generator(np.array(key, np.uint32).tobytes(), pos), 0
        for first in range(0, iterations, per_task):
            while True:
                state = source.state["state"]
                before = state["key"].tobytes(), int(state["pos"])
                good = source.random_raw(BLOCK) < limit
                count = int(np.count_nonzero(good))
                if accepted + count > first * n:
                    skip = int(np.flatnonzero(good)[first * n - accepted])
                    break
                accepted += count
            source = _generator(*before)  # the next iterations may begin in the same block
            columns = [pa.array([first], pa.int32()), pa.array([min(first + per_task, iterations)], pa.int32()), pa.array([before[0]], pa.binary()), pa.array([before[1]], pa.int32()), pa.array([skip], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["first", "last", "key", "pos", "skip"])

    return spark.range(0, 1, 1, 1).mapInArrow(note, "first int, last int, key binary, pos int, skip int")


def packed_draws(states: DataFrame, n: int, tasks: int, places: int = PLACES, group: int = GROUP) -> DataFrame:
    """iteration, range, times: how often each iteration draws each of a range of `places` places, as packed 32-bit numbers.

    A task takes the iterations of one of `tasks` states and a group of `group` places, so what it holds has a bound for any n.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, key, pos, skip, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = g * group, min(n, (g + 1) * group)
                for k, parts in itertools.groupby(_turns(first, last, key, pos, skip, n), lambda x: x[0]):
                    counts = np.zeros(high - low, np.int32)
                    for _, part in parts:
                        own = part[(part >= low) & (part < high)] - low
                        counts += np.bincount(own, minlength=high - low).astype(np.int32)
                    spans = range(0, high - low, places)
                    columns = [pa.array([k] * len(spans), pa.int32()), pa.array([(low + a) // places for a in spans], pa.int64()), pa.array([counts[a : a + places].tobytes() for a in spans], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["iteration", "range", "times"])

    dealt = states.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(-(-n // group) - 1))))
    return dealt.repartition(tasks * -(-n // group)).mapInArrow(draw, "iteration int, range long, times binary")


def _sums(per_document: DataFrame, states: DataFrame, draws: Callable[[dict], Iterator[tuple[int, np.ndarray]]], n: int, tasks: int, places: int, group: int) -> DataFrame:
    """tp, fp, fn and f1 of each iteration. states: task (0 to tasks - 1) and what `draws` needs to give the task's draws, each piece
    with its iteration.

    Each task draws for a group of places and adds the counts of what it draws, so no draw leaves its task. Documents' counts travel
    to the tasks packed by ranges of places, in as few bytes as they need; what a task holds has a bound for any n. Tasks are dealt
    by number: nothing is joined, so no plan can broadcast a side.
    """
    if group % places:
        raise ValueError("a group is some whole ranges")
    groups, counts = -(-n // group), ("tp", "fp", "fn")

    def pack(key, table):
        order = np.argsort(table.column("place").to_numpy())
        own = [table.column(c).to_numpy()[order] for c in counts]
        return pa.table({"range": pa.array([key[0].as_py()], pa.int64()), "size": pa.array([len(order)], pa.int32())} | {c: pa.array([x.astype(np.min_scalar_type(int(x.max()))).tobytes()], pa.binary()) for c, x in zip(counts, own, strict=True)})

    ranges = per_document.select("place", *(F.col(c).cast("long").alias(c) for c in counts)).groupBy(F.expr(f"place div {places}").alias("_range")).applyInArrow(pack, "range long, size int, tp binary, fp binary, fn binary")
    slot = lambda task, g: (task * groups + g).cast("int").alias("slot")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = states.withColumn("_group", every(groups)).select(slot(F.col("task"), F.col("_group")), *(c for c in states.columns if c != "task"))
    held = ranges.withColumn("_task", every(tasks)).select(slot(F.col("_task"), F.expr(f"range div {group // places}")), "range", "size", *counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, todo = [], []
        for batch in batches:
            for x in batch.to_pylist():
                (todo if x["range"] is None else own).append(x)
        for state in todo:
            own.sort(key=lambda x: x["range"])
            low, values = own[0]["range"] * places, []
            for c in counts:
                values.append(np.concatenate([np.frombuffer(x.pop(c), f"u{size}") for x in own for size in [len(x[c]) // x["size"]]]))
            high, sums = low + len(values[0]), {}
            for k, part in draws(state):
                at = part if groups == 1 else part[(part >= low) & (part < high)] - low
                sums[k] = sums.get(k, 0) + np.array([int(x.take(at).sum(dtype=np.int64)) for x in values])
            table = np.array(list(sums.values()), np.int64).reshape(len(sums), 3)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *(pa.array(table[:, i]) for i in range(3))], ["iteration", *counts])

    rows = dealt.unionByName(held, allowMissingColumns=True).repartitionById(tasks * groups, "slot").mapInArrow(add, "iteration int, tp long, fp long, fn long")
    return metric(rows.groupBy("iteration").agg(*(F.sum(c).alias(c) for c in counts)))


def _none(spark: SparkSession, n: int) -> DataFrame | None:
    """Without documents there are no iterations."""
    if n >= 1 << 31:
        raise ValueError("places are 32-bit numbers")
    return None if n else metric(spark.createDataFrame([], "iteration int, tp long, fp long, fn long"))


def seeded_bootstrap(per_document: DataFrame, n: int, *, iterations: int = ITERATIONS, seed: int = SEED, per_task: int | None = None, places: int = PLACES, group: int = GROUP) -> DataFrame:
    """tp, fp, fn and f1 of each iteration under Python's generator. per_document: place (0 to n - 1), tp, fp, fn. Without documents
    there are no rows."""
    spark = per_document.sparkSession
    if (none := _none(spark, n)) is not None:
        return none
    per_task = per_task or max(1, iterations // (4 * spark.sparkContext.defaultParallelism))
    states = generator_states(spark, n, iterations, per_task, seed).withColumn("task", F.expr(f"first div {per_task}"))
    return _sums(per_document, states, lambda x: _turns(x["first"], x["last"], x["key"], x["pos"], x["skip"], n), n, -(-iterations // per_task), places, group)


def hashed_bootstrap(per_document: DataFrame, n: int, *, iterations: int, tasks: int | None = None, places: int = PLACES, group: int = HASHED_GROUP) -> DataFrame:
    """`seeded_bootstrap` with draws that SQL has too: the first 48 bits of the MD5 of iteration|turn, modulo n."""
    spark = per_document.sparkSession
    if (none := _none(spark, n)) is not None:
        return none
    tasks = min(n * iterations, tasks or 2 * spark.sparkContext.defaultParallelism)

    def draws(x: dict) -> Iterator[tuple[int, np.ndarray]]:
        at, last = n * iterations * x["share"] // tasks, n * iterations * (x["share"] + 1) // tasks
        while at < last:
            k, end = at // n, min(last, (at // n + 1) * n)
            for bits in md5.numbered(f"{k}|", at - k * n, end - k * n):
                yield k, bits % n
            at = end

    states = spark.range(tasks).select(F.col("id").alias("task"), F.col("id").alias("share"))
    return _sums(per_document, states, draws, n, tasks, places, group)


def bootstrap(per_document: DataFrame, draws: DataFrame) -> DataFrame:
    """tp, fp, fn and f1 of each iteration. per_document: place, tp, fp, fn; draws: iteration, place, times."""
    rows = draws.join(per_document, "place").groupBy("iteration").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in ("tp", "fp", "fn")))
    return metric(rows)


def interval(iterations: DataFrame, quantiles: tuple[float, float] = INTERVAL) -> DataFrame:
    """The F1 at the floor places of the ordered iterations. There are as many rows as iterations, not documents."""
    values = iterations.agg(F.sort_array(F.collect_list("f1")).alias("f1"))
    at = lambda q: F.col("f1")[F.floor((F.size("f1") - 1) * q).cast("int")]
    return values.select(at(quantiles[0]).alias("low"), at(quantiles[1]).alias("high"))


def pivoted(cells: DataFrame, phases: list[str]) -> DataFrame:
    """The confusion as a table: a row for each reference phase (or spurious), a column for each predicted phase (and missed)."""
    rows = cells.groupBy("reference_phase").pivot("predicted_phase", [*phases, MISSED]).agg(F.sum("n"))
    return rows.na.fill(0)


def report(predicted: DataFrame, reference: DataFrame, bounds: DataFrame) -> DataFrame:
    """One row with all that an evaluation states: articles, the three levels with their metrics, the attributes' interval, and the
    confusion as a map of maps. bounds: low and high, as `interval` gives them; every part is one row."""
    articles = predicted.select("document_id").union(reference.select("document_id")).agg(F.count_distinct("document_id").alias("article_count"))
    cell = F.struct(*(F.col(c) for c in ("tp", "fp", "fn", "precision", "recall", "f1")))
    levels = evaluated(predicted, reference).agg(*(F.any_value(F.when(F.col("level") == n, cell), True).alias(n) for n in LEVELS))
    rows = confusion(predicted, reference).groupBy("reference_phase").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicted_phase", "n")))).alias("row"))
    cells = rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reference_phase", F.map_entries("row").alias("row"))))).alias("_cells"))
    cells = cells.select(F.transform_values("_cells", lambda _, v: F.map_from_entries(v)).alias("duration_phase_confusion"))
    out = articles.crossJoin(levels).crossJoin(bounds.select(F.array("low", "high").alias("interval"))).crossJoin(cells)
    return out.select(
        "article_count", F.col("event").alias("event_exact"), F.col("attribute").alias("event_attribute"), F.col("interval").alias("article_bootstrap_95_ci_f1"), "duration_phase", "duration_phase_confusion",
        F.lit(ITERATIONS).alias("bootstrap_iterations"), F.lit(SEED).alias("bootstrap_seed"),
    )
