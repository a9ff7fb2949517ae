"""Event-base tables derived from the given tables, for Spark and, with the same rules, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.verify import confidence_rank, evidence

AS_OF, OBSERVED_FROM, REPORTED_FROM = "2024-01-31", "2024-01-01", "2024-01-24"
LEAST_ORGS = 2
AI_TERMS = ("the ", "que ", "der ", "los ")
INDUSTRY_TERMS = ("tion", "ent", "ung", "ado")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def when(day: str):
    return F.lit(day).cast("timestamp_ntz")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of events: singletons and groups of six."""
    e = F.col("event_id")
    minutes = (F.col("doc_id") * 7919 % 43200).cast("int")
    return (
        table(spark, sf_dir, "documents")
        .withColumn("event_id", F.expr("case when doc_id % 10 < 4 then doc_id else doc_id div 10 * 10 + 4 end"))
        .select(
            F.col("doc_id").alias("item_id"), "event_id", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source_id"),
            F.concat(F.lit("org"), (F.col("doc_id") % 6).cast("string")).alias("org"),
            F.concat(F.lit("co"), (e % 9).cast("string")).alias("company"),
            ((F.col("doc_id") % 5 == 0) & (F.col("doc_id") % 3 != 0)).alias("affiliated"),
            F.substring(F.lit("ABCDE"), (F.col("doc_id") % 5 + 1).cast("int"), F.lit(1)).alias("effective_class"),
            F.when(F.col("doc_id") % 7 != 6, F.col("doc_id") % 7 % 4).alias("stage_rank"),
            (when(OBSERVED_FROM) + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("discovered_at"),
            F.when(e % 13 != 0, F.date_sub(F.lit(AS_OF).cast("date"), (e % 50).cast("int"))).alias("event_date"),
            "text", F.substring_index("text", "\n", 1).alias("title"), "source", "lang",
        )
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event, with its company, dates and evidence."""
    rows = items(spark, sf_dir)
    base = rows.groupBy("event_id").agg(F.first("company").alias("company"), F.first("event_date").alias("event_date"))
    return base.join(evidence(rows), "event_id").withColumn("confidence", confidence_rank(LEAST_ORGS))


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw items in the order of their ids."""
    minutes = (F.col("doc_id") * 7919 % 43200).cast("int")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.md5(F.col("text").cast("binary")), F.lit("?utm_source=x")).alias("url"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"),
        (when("2023-12-20") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("published_at"),
        F.element_at(F.array(*map(F.lit, ("exact", "parsed", "inferred"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("time_source"),
        F.lit(None).cast("string").alias("prefilter_drop"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from each event to the next id, some of which exist no more; every third is a rule edge."""
    e = events(spark, sf_dir).select("event_id")
    return e.select(
        F.col("event_id").alias("from_event"), (F.col("event_id") + 1).alias("to_event"),
        F.when(F.col("event_id") % 3 == 0, "same_actor_track").otherwise("follows").alias("relation"),
        F.when(F.col("event_id") % 3 == 0, "rule").otherwise("model").alias("created_by"),
    )


SQL_ITEMS = f"""
    docs as (select *, case when doc_id % 10 < 4 then doc_id else doc_id // 10 * 10 + 4 end as event_id from documents),
    items as (
        select doc_id as item_id, event_id, case when doc_id % 4 <> 0 then source end as source_id,
               'org' || cast(doc_id % 6 as varchar) as org, 'co' || cast(event_id % 9 as varchar) as company,
               doc_id % 5 = 0 and doc_id % 3 <> 0 as affiliated, substr('ABCDE', cast(doc_id % 5 + 1 as int), 1) as effective_class,
               case when doc_id % 7 <> 6 then doc_id % 7 % 4 end as stage_rank,
               timestamp '{OBSERVED_FROM}' + to_minutes(cast(doc_id * 7919 % 43200 as int)) as discovered_at,
               case when event_id % 13 <> 0 then date '{AS_OF}' - cast(event_id % 50 as int) end as event_date,
               text, string_split(text, chr(10))[1] as title, source, lang
        from docs)"""
SQL_EVENTS = f"""{SQL_ITEMS},
    evidence as (
        select event_id, min(company) as company, min(event_date) as event_date,
               count(distinct case when not affiliated then org end) as independent_orgs,
               bool_or(affiliated and effective_class = 'A') as has_official,
               bool_or(not affiliated and effective_class = 'B') as has_deep,
               min(case when effective_class = 'A' then stage_rank end) as official_stage,
               max(case when effective_class <> 'A' then stage_rank end) as evidence_stage,
               max(discovered_at) as last_discovered, min(discovered_at) as first_discovered, count(*) as n_items
        from items group by event_id),
    ev as (
        select *, case when has_official and independent_orgs >= {LEAST_ORGS} then 1 when has_official then 2
                       when independent_orgs >= {LEAST_ORGS} then 3 when has_deep then 4 else 5 end as confidence
        from evidence)"""
SQL_EDGES = f"""{SQL_EVENTS},
    edges as (
        select event_id as from_event, event_id + 1 as to_event,
               case when event_id % 3 = 0 then 'same_actor_track' else 'follows' end as relation,
               case when event_id % 3 = 0 then 'rule' else 'model' end as created_by
        from ev)"""
