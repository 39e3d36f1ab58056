"""Protocol events: durations in a paragraph with the phase and the conditions stated nearest to them.

Paragraphs are rows of document_id, section, paragraph_id and text. Arrow scans columns of texts and NumPy pairs what it finds,
so the whole operator is one pass over the paragraphs without a shuffle: a paragraph's events leave the pass as one list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import ArrayType

from siltstone.functions import units
from siltstone.functions.matching import arrow_scan, part
from siltstone.functions.scanning import Texts, compiled, each, lists

#: The patterns, and the windows in characters around an anchor.
DURATION = r"(\d+(?:\.\d+)?)\s*(fs|ps|ns|µs|μs|us|ms)\b"
TEMPERATURE = r"(\d+(?:\.\d+)?)\s*K\b"
PRESSURE = r"(\d+(?:\.\d+)?)\s*(bar|atm)\b"
STEP_NAME = r"(?:time\s*step|timestep|integration step)"
TIMESTEP = rf"(?:{STEP_NAME}[^.;]{{0,35}}?(\d+(?:\.\d+)?)\s*(fs|ps)|(\d+(?:\.\d+)?)\s*(fs|ps)[^.;]{{0,20}}?{STEP_NAME})"
REPLICATES = r"(\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+(?:independent\s+)?(?:replicates|runs|simulations)\b"
ENSEMBLE = r"\b(NVE|NVT|NPT|NPAT|NPH)\b"
STEP_BEFORE, STEP_AFTER = rf"{STEP_NAME}[^.;]{{0,24}}$", rf"^\s*{STEP_NAME}"
PHASES = {
    "minimisation": r"minimi[sz]",
    "heating": r"heat(?:ed|ing)?|ramp(?:ed|ing)?",
    "equilibration": r"equilibrat",
    "production": r"production|unrestrained\s+(?:md|simulation)|md\s+run",
    "analysis_window": r"last\s+\d|final\s+\d|used for (?:further )?analys",
    "sampling_interval": r"saved|written|recorded|sampled|output",
}
UNKNOWN, UNKNOWN_WORDS = "unknown", ("simulation", "dynamics", "trajectory", "md ")
PHASE_CHARS, GATE_CHARS, LINK_CHARS, BEFORE_CHARS, AFTER_CHARS = 100, 80, 180, 32, 24
METHOD = "same_paragraph_nearest_within_180_chars"


#: What can be asked of an anchor besides quote, start and end, and the fields it is told by.
FIELDS = {
    "timestep": {"is_timestep": pa.bool_()},
    "duration": {"duration_ps": pa.float64()},
    "phase": {"event_type": pa.string(), "passes_gate": pa.bool_()},
    "conditions": {"temperature_k": pa.float64(), "pressure_bar": pa.float64(), "timestep_fs": pa.float64(), "replicates": pa.int32(), "ensemble": pa.string()},
}
CONDITIONS = {"temperature_k": "double", "pressure_bar": "double", "timestep_fs": "double", "ensemble": "string", "replicates": "int"}
#: Names of phases in order: of equal distances the first counts.
ORDER = sorted(PHASES)


class _Anchors:
    """The durations of a column of texts."""

    def __init__(self, texts: Texts):
        self.texts, found = texts, texts.spans(DURATION)
        self.row, self.start, self.end, self.quote = found.row, found.start, found.end, found.quote

    def keep(self, which: np.ndarray) -> None:
        self.row, self.start, self.end, self.quote = self.row[which], self.start[which], self.end[which], self.quote.filter(pa.array(which))

    def near(self, before: int, after: int) -> tuple[Texts, np.ndarray]:
        return self.texts.parts(self.row, self.start - before, self.end + after)

    def timestep(self) -> dict:
        before, k = self.texts.parts(self.row, self.start - BEFORE_CHARS, self.start)
        after, j = self.texts.parts(self.row, self.end, self.end + AFTER_CHARS)
        return {"is_timestep": before.found(STEP_BEFORE)[k] | after.found(STEP_AFTER)[j]}

    def duration(self) -> dict:
        def value(quote: str) -> float | None:
            number, unit = compiled(DURATION).match(quote).groups()
            factor = units.PICOSECONDS.get(unit.lower())
            return None if factor is None else float(number) * factor

        return {"duration_ps": each(self.quote, pa.float64(), value)}

    def phase(self) -> dict:
        """The phase whose word is nearest by whole centres; and whether an anchor without one stands near a word of simulation."""
        windows, k = self.near(PHASE_CHARS, PHASE_CHARS)
        # no word of one phase overlaps one of another, so one scan finds what a scan for each phase would
        words = windows.spans("|".join(f"(?:{p})" for p in PHASES.values()))
        rank = each(words.quote, pa.int8(), lambda q: ORDER.index(next(n for n, p in PHASES.items() if compiled(p).match(q)))).to_numpy(zero_copy_only=False)
        left = np.maximum(self.start - PHASE_CHARS, 0)
        at = words.nearest(k, (self.start + self.end) // 2 - left, (words.start + words.end) // 2, rank)
        known = at >= 0
        names = pa.array([*ORDER, UNKNOWN]).take(pa.array(np.append(rank, len(ORDER))[at].astype(np.int32)))
        gate, j = self.near(GATE_CHARS, GATE_CHARS)
        return {"event_type": names, "passes_gate": known | gate.found("|".join(UNKNOWN_WORDS))[j]}

    def conditions(self) -> dict:
        """The nearest temperature, pressure, time step and replicates by starts (ties: the earliest), and the first ensemble."""
        windows, k = self.near(LINK_CHARS, LINK_CHARS)
        place = np.minimum(self.start, LINK_CHARS)

        def nearest(pattern: str, kind: pa.DataType, value) -> pa.Array:
            found = windows.spans(pattern)
            return each(found.quotes(found.nearest(k, place, found.start)), kind, lambda q: value(*compiled(pattern).match(q).groups()))

        ensemble = windows.spans(ENSEMBLE)
        return {
            "temperature_k": nearest(TEMPERATURE, pa.float64(), float),
            "pressure_bar": nearest(PRESSURE, pa.float64(), lambda number, unit: float(number) * (units.ATMOSPHERE_BAR if unit.lower() == "atm" else 1.0)),
            "timestep_fs": nearest(TIMESTEP, pa.float64(), lambda a, of_a, b, of_b: float(a or b) * (1000.0 if (of_a or of_b).lower() == "ps" else 1.0)),
            "replicates": nearest(REPLICATES, pa.int32(), units.whole),
            "ensemble": each(ensemble.quotes(ensemble.first(k)), pa.string(), str.upper),
        }


def _kinds(parts: tuple[str, ...]) -> dict[str, pa.DataType]:
    return {"quote": pa.string(), "start": pa.int32(), "end": pa.int32()} | {c: kind for p in parts for c, kind in FIELDS[p].items()}


def listed(text: Column, *parts: str, emitted: bool) -> Column:
    """The anchors of a text as an array of structs with the fields of the parts; emitted: of those that are events only."""
    kinds = _kinds(parts)

    def scan(column: pa.Array) -> pa.Array:
        own, out = _Anchors(Texts(column)), {}

        def keep(which: np.ndarray) -> None:
            own.keep(which)
            for c, x in out.items():
                out[c] = x.filter(pa.array(which)) if isinstance(x, pa.Array) else x[which]

        if emitted:
            keep(~own.timestep()["is_timestep"])
            out |= own.duration()
            keep(pc.fill_null(pc.greater(out["duration_ps"], 0.0), False).to_numpy(zero_copy_only=False))
            out |= own.phase()
            keep(out["passes_gate"])
        for p in parts:
            if not FIELDS[p].keys() <= out.keys():
                out |= getattr(own, p)()
        out |= {"quote": own.quote, "start": own.start, "end": own.end}
        return lists(len(column), own.row, {c: (out[c] if isinstance(out[c], pa.Array) else pa.array(out[c])).cast(t) for c, t in kinds.items()})

    return arrow_scan(scan, ArrayType(from_arrow_schema(pa.schema(kinds.items()))))(text)


def _found(paragraphs: DataFrame, parts: tuple[str, ...], emitted: bool) -> DataFrame:
    """A row for every anchor with its number from 0 and the fields of the parts."""
    # outer: from an inner explosion Spark infers a filter that would look for the anchors a first time
    found = F.posexplode_outer(listed(F.col("text"), *parts, emitted=emitted)).alias("pos", "m")
    return paragraphs.select("*", found).filter("m is not null").select("*", *(F.col(f"m.{c}") for c in _kinds(parts))).drop("m")


def anchors(paragraphs: DataFrame, *parts: str) -> DataFrame:
    """A row for every duration: number, quote, start, end, and the fields of the parts of FIELDS asked for."""
    return _found(paragraphs, parts, emitted=False)


def emitted(paragraphs: DataFrame, *parts: str) -> DataFrame:
    """Anchors that are events, numbered from 0 in each paragraph, with duration, phase and the fields of the parts.

    An anchor is one if it is no time step, its duration is above nothing and it has a phase or stands near a word of simulation.
    """
    return _found(paragraphs, ("duration", "phase", *parts), emitted=True)


def extract_events(paragraphs: DataFrame, conditions: bool = True) -> DataFrame:
    """All events with identifiers and evidence, numbered in each paragraph. A paragraph is one row, and no two have the same document
    and paragraph id. Without conditions these are null, and nothing looks for them."""
    # a hash for a paragraph, not for each of its events
    rows = emitted(paragraphs.withColumn("context_sha256", F.sha2("text", 256)), *(("conditions",) if conditions else ()))
    stated = [F.col(c) if conditions else F.lit(None).cast(kind).alias(c) for c, kind in CONDITIONS.items()]
    return rows.select(
        F.concat_ws(":", "document_id", "paragraph_id", F.concat(F.lit("event-"), F.col("pos") + 1)).alias("event_id"),
        "document_id", "section", "paragraph_id", "event_type", "duration_ps", *stated,
        F.lit(None).cast("string").alias("restraints"), "quote", F.col("start").alias("start_char"), F.col("end").alias("end_char"),
        "context_sha256", F.lit(METHOD).alias("relation_method"),
        F.when(F.col("event_type") == UNKNOWN, 0.65).otherwise(0.92).alias("confidence"),
    )


def evidence_errors(events: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Events whose quote isn't their paragraph's text at the given place, or whose paragraph hash differs."""
    texts = paragraphs.select("document_id", "paragraph_id", "text", F.sha2("text", 256).alias("_sha256"))
    rows = events.join(texts, ["document_id", "paragraph_id"], "left")
    right = (part(F.col("text"), F.col("start_char"), F.col("end_char")) == F.col("quote")) & (F.col("_sha256") == F.col("context_sha256"))
    return rows.filter(~F.coalesce(right, F.lit(False))).drop("text", "_sha256")
