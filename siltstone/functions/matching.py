"""Regular-expression matches in columns: all of them with code-point offsets by Arrow, single answers inside Catalyst.

Patterns are read with Unicode classes and case folding, as the texts' first readers did. `regexp_instr` isn't used: it counts
otherwise beyond the basic plane.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import scanning

FLAGS = "(?U)(?iu)"
SPANS = "array<struct<quote:string,start:int,end:int>>"


def arrow_scan(f: Callable[[pa.Array], pa.Array], kind: str) -> Callable[[Column], Column]:
    """A column function over texts from one over Arrow columns."""
    over = scanning.by_pieces(f)

    @F.arrow_udf(kind)
    def scanned(column: pa.Array) -> pa.Array:
        return over(column)

    return scanned


def matches(text: Column, pattern: str) -> Column:
    """All matches from left to right as quote, start and end (end exclusive); empty for null. Patterns must not match nothing.

    Arrow scans whole columns. What Catalyst could say instead, marks put around matches and an aggregation over the pieces between,
    isn't compiled and costs a hundred times as much.
    """

    def scan(column: pa.Array) -> pa.Array:
        spans = scanning.Texts(column).spans(pattern)
        return scanning.lists(len(column), spans.row, {"quote": spans.quote, "start": spans.start.astype(np.int32), "end": spans.end.astype(np.int32)})

    return arrow_scan(scan, SPANS)(text)


def found(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(FLAGS + pattern), F.lit(False))


def number(text: Column, pattern: str) -> Column:
    """How many matches."""
    return F.coalesce(F.regexp_count(text, F.lit(FLAGS + pattern)), F.lit(0)).cast("long")


def group(text: Column, pattern: str, k: int) -> Column:
    """Group k of the first match; null if it took no part."""
    return F.nullif(F.regexp_extract(text, FLAGS + pattern, k), F.lit(""))


def part(text: Column, start: Column, end: Column) -> Column:
    """Characters from start (0-based, cut at 0) up to end."""
    start = F.greatest(start, F.lit(0))
    return text.substr(start + 1, F.greatest(end - start, F.lit(0)))
