"""Deterministic sampling of articles: exclusions, stratified rounds, splits, and the plans made from them."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.commitment import root_of

#: The seed and the sizes of the splits.
SEED, SIZES = 3997, (30, 10, 20)
SPLITS = ("development", "validation", "locked_test")
PRIOR_MINIMUM = 30


class TooFew(ValueError):
    """There are fewer eligible articles than the plan needs."""


def canonical_sha256(payload, ascii_only: bool = False) -> str:
    """SHA-256 of JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only).encode()).hexdigest()


def rank(seed: int, document_id: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|"), document_id), 256)


def with_reasons(candidates: DataFrame, excluded: DataFrame, *, year_min: int | None = None, year_max: int | None = None, require_year: bool = False) -> DataFrame:
    """Adds identifier and reason (null if eligible). candidates: position, document_id, full_text_available, year.

    An identifier becomes a duplicate after its first eligible row, whatever the later row's own reason.
    """
    ids = excluded.select(F.upper("document_id").alias("_excluded")).distinct()
    rows = candidates.withColumn("identifier", F.upper("document_id")).join(ids, F.col("identifier") == F.col("_excluded"), "left")
    year = F.col("year")
    own = F.when(F.col("_excluded").isNotNull(), "previous_development_article").when(~F.col("full_text_available"), "full_text_unavailable")
    own = own.when(~F.col("identifier").startswith("PMC"), "missing_pmc_identifier")
    if require_year:
        own = own.when(year.isNull(), "missing_publication_year")
    if year_min is not None:
        own = own.when(year < year_min, "publication_year_below_window")
    if year_max is not None:
        own = own.when(year > year_max, "publication_year_above_window")
    first = F.min(F.when(F.col("_own").isNull(), F.col("position"))).over(Window.partitionBy("identifier"))
    rows = rows.withColumn("_own", own).withColumn("_first", first)
    return rows.withColumn("reason", F.when(F.col("position") > F.col("_first"), "duplicate_document_id").otherwise(F.col("_own"))).drop("_own", "_first", "_excluded")


def selected(eligible: DataFrame, target: int, seed: int = SEED) -> DataFrame:
    """One article of each stratum per round, strata in order of name and articles in order of rank, until the target.

    A stratum gives at most `target` articles, so all but those are dropped before anything is ordered over strata.
    """
    stratum = F.coalesce(F.nullif(F.lower(F.trim("stratum")), F.lit("")), F.lit("unknown"))
    rows = eligible.withColumn("stratum", stratum).withColumn("_rank", rank(seed, F.col("identifier")))
    rounds = F.row_number().over(Window.partitionBy("stratum").orderBy("_rank", "position"))
    return rows.withColumn("round", rounds).filter(F.col("round") <= target).orderBy("round", "stratum").limit(target).drop("_rank")


def split(chosen: DataFrame, seed: int = SEED, sizes: tuple[int, int, int] = SIZES) -> DataFrame:
    """Adds order and split. chosen has as many rows as the plan, so one order over all of them is small."""
    order = F.row_number().over(Window.orderBy(rank(seed + 1, F.col("identifier")), "position"))
    rows = chosen.withColumn("order", order)
    return rows.withColumn("split", F.when(F.col("order") <= sizes[0], SPLITS[0]).when(F.col("order") <= sizes[0] + sizes[1], SPLITS[1]).otherwise(SPLITS[2]))


def create_plan(candidates: DataFrame, excluded: DataFrame, *, seed: int = SEED, sizes: tuple[int, int, int] = SIZES, **window) -> DataFrame:
    """The plan's articles with order and split; raises TooFew."""
    rows = with_reasons(candidates, excluded, **window).filter("reason is null")
    chosen = selected(rows, sum(sizes), seed)
    if (n := chosen.count()) < sum(sizes):
        raise TooFew(f"need at least {sum(sizes)} eligible articles; found {n}")
    return split(chosen, seed, sizes)


def commitment(plan: DataFrame, exclusions: DataFrame, settings: dict) -> str:
    """The hash that commits a plan: its settings, its splits in order, and what was left out and why.

    The exclusions, of any number, enter by the root of their tree in order of position, so that a proof can show one of them.
    """
    rows = plan.select("split", "order", "identifier").orderBy("order").collect()  # the plan's size
    core = dict(settings) | {name: [r["identifier"] for r in rows if r["split"] == name] for name in SPLITS}
    left_out = root_of(exclusions.select("position", "document_id", "reason"), ["position"])
    return canonical_sha256(core | {"exclusions_root": left_out})


def manifest_root(articles: DataFrame) -> str:
    """The commitment that a manifest bears: the root of its rows' tree in order of id, all columns included."""
    return root_of(articles, ["document_id"])


def manifest_intact(articles: DataFrame, stored: str | None) -> bool:
    """Whether a manifest's rows are those that its stored commitment was made of."""
    return stored is not None and manifest_root(articles) == stored


def gate_plan(excluded: DataFrame, *, lock: bool, year_max: int | None = None, require_year: bool = False, temporal: bool = False) -> list[str]:
    """What stands against making this plan."""
    out = []
    if lock and excluded.select("document_id").distinct().count() < PRIOR_MINIMUM:
        out.append("too_few_prior_identifiers")
    if temporal and year_max is None:
        out.append("missing_publication_year_max")
    if temporal and not require_year:
        out.append("known_year_not_required")
    return out


def finalized(pool: DataFrame, screen: DataFrame, sizes: tuple[int, int, int] = SIZES) -> DataFrame:
    """Every article of the pool in order, with its split or the reason it has none.

    pool: document_id, order. screen: document_id, eligible, status, article_type. Eligible articles are numbered over
    the pool, which is a plan and so small.
    """
    rows = pool.join(screen, "document_id", "left").withColumn("_eligible", F.coalesce("eligible", F.lit(False)))
    place = F.sum(F.col("_eligible").cast("int")).over(Window.orderBy("order", "document_id"))
    rows = rows.withColumn("_place", F.when(F.col("_eligible"), place))
    ends = [sizes[0], sizes[0] + sizes[1], sum(sizes)]
    name = F.when(F.col("_place") <= ends[0], SPLITS[0]).when(F.col("_place") <= ends[1], SPLITS[1]).when(F.col("_place") <= ends[2], SPLITS[2])
    reason = F.when(F.col("split").isNull(), F.when(F.col("eligible") == F.lit(False), "not_machine_eligible").otherwise("eligible_reserve_not_selected"))
    return rows.withColumn("split", name).withColumn("reason", reason).drop("_eligible", "_place")


def workpack(final: DataFrame, screen: DataFrame) -> DataFrame:
    """Rows for annotators in plan order: selected articles with what the screen said; null columns as empty text."""
    rows = final.filter("split is not null").select("document_id", "order", "split").join(screen, "document_id", "left")
    within = F.row_number().over(Window.partitionBy("split").orderBy("order"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select("document_id", "split", within.alias("split_order"), text("article_type").alias("article_type"), text("status").alias("status"), F.col("eligible").isNull().alias("missing_screen"))


def manifest_errors(manifest: DataFrame, sizes: tuple[int, int, int] = SIZES) -> DataFrame:
    """One row: whether the manifest has the plan's size, its split sizes and distinct ids."""
    n = lambda s: F.count_if(F.col("split") == s)
    right = [n(s) == size for s, size in zip(SPLITS, sizes, strict=True)]
    return manifest.agg(
        F.count(F.lit(1)).alias("n_articles"), (F.count(F.lit(1)) == sum(sizes)).alias("size_ok"),
        (right[0] & right[1] & right[2]).alias("splits_ok"), (F.count_distinct("document_id") == F.count(F.lit(1))).alias("ids_ok"),
    )
