"""Screening and extraction: the judge proposes, rules and statuses dispose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import present
from ..plugins.answers import AnswerLog
from ..plugins.judge import Judge, ask
from ..schemas import DRAFT


def screened(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, status) of pending items by verdicts (id, keep); a missing verdict keeps."""
    pending = items.where("status = 'pending'").select("id")
    keep = F.coalesce("keep", F.lit(True))
    return pending.join(verdicts.select("id", "keep"), "id", "left").select("id", F.when(keep, "screened").otherwise("rejected").alias("status"))


def prescreen(items: DataFrame, judge: Judge, size: int = 12, log: AnswerLog | None = None) -> DataFrame:
    """(id, status, why): batches are judged; a batch whose answer fails stays pending for the next run."""
    rows = items.where("status = 'pending'").select("id", "title", F.left(F.regexp_replace("content", "\n", " "), F.lit(260)).alias("content"))
    answers = ask(rows, judge, "prescreen", ["id"], size, log)
    verdict = F.from_json("answer", "keep boolean, why string")
    status = F.when(F.col("answer").isNull(), "pending").when(F.coalesce(verdict["keep"], F.lit(True)), "screened").otherwise("rejected")
    return answers.select("id", status.alias("status"), verdict["why"].alias("why"))


def route(effective_class: Column, config: EngineConfig) -> Column:
    """Aggregators and unknown sources are evidence only; the others are extracted by their class."""
    level = F.coalesce(present(effective_class), F.lit(config.unknown_source_class))
    return F.when(level == "D", "evidence_only").otherwise(F.concat(F.lit("extract_"), level))


def extract(items: DataFrame, judge: Judge, config: EngineConfig, size: int = 1, log: AnswerLog | None = None) -> DataFrame:
    """(id, status, draft) of screened items; a failed call leaves the item as it was."""
    rows = items.where("status = 'screened'").withColumn("route", route(F.col("effective_class"), config))
    asked = rows.where("route <> 'evidence_only'").select("id", "route", "title", F.left("content", F.lit(1800)).alias("content"))
    draft = F.from_json("answer", DRAFT)
    useful = F.coalesce(F.col("draft.relevant"), F.lit(False)) & present(F.col("draft.event_key")).isNotNull()
    status = F.when(F.col("answer").isNull(), "screened").when(useful, "extracted").otherwise("rejected")
    done = ask(asked, judge, "extract", ["id"], size, log).withColumn("draft", draft).select("id", status.alias("status"), "draft")
    evidence = rows.where("route = 'evidence_only'").select("id", F.lit("evidence_only").alias("status"), F.lit(None).cast(done.schema["draft"].dataType).alias("draft"))
    return done.unionByName(evidence)


def backfill_stage(items: DataFrame, judge: Judge, size: int = 12, log: AnswerLog | None = None) -> DataFrame:
    """(id, draft_stage) for items of events that have none."""
    placed = F.col("event_id").isNotNull() & ~F.startswith("event_id", F.lit("draft:"))
    rows = items.where(F.col("draft_stage").isNull() & placed).select("id", "title", F.left("content", F.lit(420)).alias("content"))
    answers = ask(rows, judge, "stage", ["id"], size, log)
    return answers.select("id", F.from_json("answer", "stage string")["stage"].alias("draft_stage")).where("draft_stage is not null")


def search_tasks(companies: DataFrame, domains: DataFrame, sites: DataFrame) -> DataFrame:
    """(kind, query): every company with every domain, and each site for itself; both lists are configuration."""
    matrix = companies.crossJoin(domains).select(F.lit("matrix").alias("kind"), F.concat_ws(" ", "company", "domain").alias("query"))
    return matrix.unionByName(sites.select(F.lit("site").alias("kind"), F.concat(F.lit("site:"), "site").alias("query")))
