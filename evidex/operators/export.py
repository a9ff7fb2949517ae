"""Documents of the read side: meta, runs with their rejects, reports, sources and reviews, each as JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered
from .reports import source_health

#: Channels that the list of sources counts, and rows that lists show.
LISTED_CHANNELS = ("rss", "rsshub", "direct", "exa")
SHOWN_REVIEWS, SHOWN_REJECTS, SHOWN_RUNS, SHOWN_REPORTS = 12, 400, 3, 5


def meta_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of every table, and events that wait for a person or are watched."""
    out = None
    for name, frame in tables.items():
        n = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    states = {"pending_review": ("pending", "suspect_duplicate"), "watching": ("watching",)}
    waiting = tables["events"].agg(*(F.count_if(F.col("review_state").isin(*s)).alias(k) for k, s in states.items()))
    return out.unionByName(waiting.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("n")) for k in states))).alias("x")).select("x.*"))


def rejects_by(rejects: DataFrame, *columns: str) -> DataFrame:
    """(columns, n) of the ledger."""
    return rejects.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def run_rejects(rejects: DataFrame, run_id: str, reason: str | None = None, shown: int = SHOWN_REJECTS) -> tuple[DataFrame, DataFrame]:
    """(by_reason, rows): the ledger of a run, by stage and reason; with ``reason`` only its rows."""
    own = rejects.where(F.col("run_id") == run_id)
    found = own if reason is None else own.where(F.col("reason_code") == reason)
    columns = ("stage", "reason_code", "reason_detail", "title", "url", "source_name", "merged_into")
    return rejects_by(own, "reason_code"), found.orderBy("stage", "reason_code", "item_id").limit(shown).select(*columns)


def first_rows(rows: DataFrame, shown: int, *order: Column) -> tuple[DataFrame, DataFrame]:
    """(first, truncated): the first rows of a list, and (total, truncated) for the rest."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).limit(shown), total.select("total", F.greatest(F.col("total") - shown, F.lit(0)).alias("truncated"))


def run_documents(runs: DataFrame, rejects: DataFrame) -> DataFrame:
    """(id, document) of every run, the latest first, with its rejects by reason."""
    by_reason = rejects_by(rejects, "run_id", "reason_code").groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason_code", "n")))).alias("reject_summary"))
    rows = runs.join(by_reason.withColumnRenamed("run_id", "id"), "id", "left")
    document = F.to_json(F.struct(*(F.col(c) for c in runs.columns), F.coalesce("reject_summary", F.create_map().cast("map<string,bigint>")).alias("reject_summary")))
    return rows.orderBy(F.desc("started_at"), "id").select("id", document.alias("document"))


def report_documents(reports: DataFrame) -> DataFrame:
    """(id, document) of every report, the latest period first."""
    return reports.orderBy(F.desc("period_start")).select("id", F.to_json(F.struct(*reports.columns)).alias("document"))


def source_documents(sources: DataFrame, items: DataFrame, rejects: DataFrame) -> DataFrame:
    """Registered sources with their health: most hits first, then by class. Rejects count by the source's name."""
    lost = rejects.join(sources.select(F.col("name").alias("source_name"), F.col("id").alias("source_id")), "source_name").select("source_id")
    health = source_health(sources.select(F.col("id").alias("source_id")), items, lost).withColumnRenamed("source_id", "id")
    shown = [c for c in ("id", "name", "org", "source_class", "channel", "affiliated_with", "reliability", "active", "note") if c in sources.columns]
    return sources.select(*shown).join(health, "id").orderBy(F.desc("hits"), "source_class", "id")


def channel_counts(sources: DataFrame) -> DataFrame:
    """(channel, n) for the listed channels alone, also those without a source."""
    counts = sources.agg(*(F.count_if(F.col("channel") == c).alias(c) for c in LISTED_CHANNELS))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("n")) for c in LISTED_CHANNELS))).alias("x")).select("x.*")


def human_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews by people; what the system has flagged is no review."""
    return reviews.where("reviewer <> 'system'")


def reviews_document(reviews: DataFrame, events: DataFrame, shown: int = SHOWN_REVIEWS) -> DataFrame:
    """(document): reviews by people by action, how many events they touch, the latest of them and how many more there are."""
    own = human_reviews(reviews)
    by_action = own.groupBy("action").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "count")))).alias("by_action"))
    touched = events.agg(F.count_if(~F.coalesce("review_state", F.lit("none")).isin("none", "")).alias("affected_events"))
    latest, rest = first_rows(own, shown, F.desc("created_at"), F.col("target_id"))
    listed = latest.agg(F.sort_array(F.collect_list(F.struct("created_at", *(c for c in reviews.columns if c != "created_at"))), False).alias("results"))
    one = by_action.crossJoin(touched).crossJoin(rest).crossJoin(listed)  # each is one row
    return one.select(F.to_json(F.struct("total", "by_action", "affected_events", "results", "truncated")).alias("document"))


def coverage(items: DataFrame, events: DataFrame) -> DataFrame:
    """(sources, first_date, last_date) of what the base holds."""
    dates = events.agg(F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))
    return items.agg(F.count_distinct("source_id").alias("sources")).crossJoin(dates)  # one row each


def total_cost(calls: DataFrame, column: str = "cost") -> DataFrame:
    """(calls, cost): what the answers of a paid channel cost in all."""
    return calls.agg(F.count(F.lit(1)).alias("calls"), F.round(F.coalesce(F.sum(column), F.lit(0.0)), 4).alias("cost"))


def facet_counts(events: DataFrame, *facets: str) -> DataFrame:
    """(facet, value, n); an event counts for each value of an array column."""
    kinds = dict(events.dtypes)

    def listed(c: str) -> Column:
        values = F.array_distinct(F.col(c)) if kinds[c].startswith("array") else F.array(F.col(c))
        return F.transform(values, lambda v: F.named_struct(F.lit("facet"), F.lit(c), F.lit("value"), v.cast("string")))

    return events.select(F.explode(F.concat(*map(listed, facets))).alias("x")).groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))


def ranked_hits(events: DataFrame, hits: DataFrame) -> DataFrame:
    """``events`` that a search has found, in its order: hits (id, place)."""
    return events.join(hits.select("id", "place"), "id").orderBy("place")


def wanted(picked: Column, inferred: Column) -> Column:
    """The union of what was picked and what was understood, in that order; null is nothing."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(picked, none), F.coalesce(inferred, none))


def in_scope(events: DataFrame, companies: Column, domains: Column) -> DataFrame:
    """Events of the wanted companies and domains; an empty set restricts nothing."""
    asked = events.withColumn("_companies", companies).withColumn("_domains", domains)
    by_company = (F.size("_companies") == 0) | F.array_contains("_companies", F.col("company"))
    by_domain = (F.size("_domains") == 0) | F.arrays_overlap("domains", "_domains")
    return asked.where(by_company & by_domain).drop("_companies", "_domains")


#: Messages of a request, characters of a question, an answer and all texts, bytes of the request.
MOST_TURNS, QUESTION_CHARS, ANSWER_CHARS, ALL_CHARS, BODY_BYTES = 21, 2000, 8000, 24_000, 80_000
#: What counts as empty: white space of any script.
BLANK = r"^[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*$"


def units(text: Column) -> Column:
    """Length in 16-bit units, as a browser counts."""
    return F.char_length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def checked_turns(turns: DataFrame, by: str, turn: str, role: str, text: str) -> DataFrame:
    """(by, problem): why a conversation that is put to an event is refused, null if it isn't.

    A request that is too large is refused as such. Else there is an odd number
    of messages, 21 at most; a user's and an assistant's alternate, the user
    begins; none is blank; questions, answers and all of them have a greatest length.
    """
    rows = turns.select(by, F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))
    placed = numbered(rows, ["turn", "role", "content"], [by], "_i")
    due = F.when(F.col("_i") % 2 == 0, "user").otherwise("assistant")
    most = F.when(F.col("role") == "user", QUESTION_CHARS).otherwise(ANSWER_CHARS)
    wrong = ~F.col("role").eqNullSafe(due) | F.col("content").isNull() | F.coalesce(F.rlike("content", F.lit(BLANK)), F.lit(True)) | (units(F.col("content")) > most)
    message = F.octet_length(F.to_json(F.struct("role", "content"))) + 1
    found = placed.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(wrong).alias("wrong"), F.sum(units(F.col("content"))).alias("size"), (F.sum(message) + len('{"messages":[]}') - 1).alias("bytes"),
    )
    invalid = (F.col("n") > MOST_TURNS) | (F.col("n") % 2 != 1) | F.col("wrong") | (F.col("size") > ALL_CHARS)
    problem = F.when(F.col("bytes") > BODY_BYTES, "body_too_large").when(invalid, "invalid_messages")
    return found.select(by, problem.alias("problem"))
