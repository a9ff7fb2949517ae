"""Credibility by rules alone: one join, one aggregation, and ladders of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIDENCE, STAGES, STATUS, STICKY_REVIEW


def evidence(items: DataFrame, by: str = "event_id") -> DataFrame:
    """What the items of each event say.

    ``items``: event_id, org (null: unknown), affiliated (boolean), effective_class, stage_rank, discovered_at.
    Affiliated items never count as organisations.
    """
    affiliated = F.coalesce("affiliated", F.lit(False))
    level = F.coalesce("effective_class", F.lit("D"))
    official = F.coalesce("effective_class", F.lit("")) == "A"
    return items.groupBy(by).agg(
        F.count_distinct(F.when(~affiliated, F.col("org"))).alias("independent_orgs"),
        F.coalesce(F.bool_or(affiliated & (level == "A")), F.lit(False)).alias("has_official"),
        F.coalesce(F.bool_or(~affiliated & (level == "B")), F.lit(False)).alias("has_deep"),
        F.min(F.when(official, F.col("stage_rank"))).alias("official_stage"),
        F.max(F.when(~official, F.col("stage_rank"))).alias("evidence_stage"),
        F.max("discovered_at").alias("last_discovered"),
        F.min("discovered_at").alias("first_discovered"),
        F.count(F.lit(1)).alias("n_items"),
    )


def confidence_rank(least_orgs: int) -> Column:
    """1 (highest) to 5."""
    many = F.col("independent_orgs") >= least_orgs
    return F.when(F.col("has_official") & many, 1).when(F.col("has_official"), 2).when(many, 3).when(F.col("has_deep"), 4).otherwise(5)


def stage_rank() -> Column:
    """Both sides: the lower; else the one there is."""
    return F.least("official_stage", "evidence_stage")


def stage_basis() -> Column:
    both = F.col("official_stage").isNotNull() & F.col("evidence_stage").isNotNull()
    return F.when(both, "both").when(F.col("official_stage").isNotNull(), "official").when(F.col("evidence_stage").isNotNull(), "evidence").otherwise("none")


def at_or_after(at: Column, reference: Column) -> Column:
    """Unknown times are never at or after anything."""
    return F.coalesce(at.cast("timestamp_ntz") >= reference, F.lit(False))


def status_rank(event_date: Column, first_seen: Column, observed_from: Column, reported_from: Column) -> Column:
    """1 new, 2 continuing, 3 silent, 4 old; an event dated before the window is old whatever was seen."""
    return (
        F.when(event_date.isNotNull() & ~at_or_after(event_date, observed_from), 4)
        .when(at_or_after(first_seen, reported_from), 1)
        .when(at_or_after(F.col("last_discovered"), reported_from), 2)
        .when(at_or_after(event_date, observed_from), 3)
        .otherwise(4)
    )


def review_state(previous: Column, confidence: Column) -> Column:
    """Human verdicts stick; otherwise the weakest events wait for one."""
    return F.when(previous.isin(*STICKY_REVIEW), previous).when(confidence == 5, "pending").otherwise("none")


def verify(events: DataFrame, items: DataFrame, observed_from: Column, reported_from: Column, least_orgs: int = 2) -> DataFrame:
    """``events`` with their verdict columns; events without items stay as they are."""
    facts = evidence(items).withColumnRenamed("event_id", "id")
    silent = events.join(facts.select("id"), "id", "left_anti")
    joined = events.drop("independent_orgs").join(facts, "id", "inner")
    ranked = joined.withColumn("confidence_rank", confidence_rank(least_orgs)).withColumn("stage_rank", stage_rank())
    name = lambda names, rank: F.element_at(F.array(*map(F.lit, names)), rank.cast("int"))
    status = status_rank(F.col("event_date"), F.col("first_seen_at"), observed_from, reported_from)
    verdicts = ranked.select(
        *(c for c in events.columns if c not in ("confidence", "stage", "stage_basis", "status", "review_state", "independent_orgs")),
        F.col("independent_orgs").cast("int").alias("independent_orgs"),
        name(CONFIDENCE, F.col("confidence_rank")).alias("confidence"),
        F.when(F.col("stage_rank").isNotNull(), name(STAGES, F.col("stage_rank") + 1)).alias("stage"),
        stage_basis().alias("stage_basis"),
        name(STATUS, status).alias("status"),
        review_state(F.coalesce("review_state", F.lit("none")), F.col("confidence_rank")).alias("review_state"),
    )
    return verdicts.unionByName(silent, allowMissingColumns=True)
