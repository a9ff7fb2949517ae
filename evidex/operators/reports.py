"""Weekly reports, source health, distributions and exported documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.url import display_host
from .ordered import as_of, row_before

#: Characters of an item's body that its event shows.
EXCERPT_CHARS = 400


def week_of(day: Column) -> Column:
    """Monday of the day's week."""
    return F.date_trunc("week", day).cast("date")


def period(as_of: Column) -> tuple[Column, Column]:
    """Monday and Sunday of the week before."""
    monday = week_of(as_of)
    return F.date_sub(monday, 7), F.date_sub(monday, 1)


def weeks_with_events(events: DataFrame, as_of: Column, least: int) -> DataFrame:
    """Finished weeks with enough dated events."""
    weeks = events.where("event_date is not null").groupBy(week_of(F.col("event_date")).alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return weeks.where((F.col("week") < week_of(as_of)) & (F.col("n") >= least))


def week_digest(events: DataFrame, facts: DataFrame, start: Column, end: Column, most: int = 4) -> DataFrame:
    """(event_id, company, event_date, facts): events of the period with their first facts in one text."""
    from .events import first_claims

    some = first_claims(facts, most).groupBy("event_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda c: c["text"]), " / ").alias("facts")
    )
    inside = events.where(F.col("event_date").between(start, end))
    return inside.join(some, "event_id", "left").select("event_id", "company", "event_date", F.coalesce("facts", F.lit("")).alias("facts"))


def needs_report(reports: DataFrame, period_start: Column, period_end: Column) -> Column:
    """Whether a week is still to be reported: a report written after its end settles it."""
    raise_if = F.to_date("generated_at") > period_end
    return ~F.coalesce(F.bool_or((F.col("period_start") == period_start) & raise_if), F.lit(False))


def previous_report(reports: DataFrame, columns: list[str]) -> DataFrame:
    """Each report with what the latest earlier one said, as prev_<column>."""
    found = row_before(reports, ["period_start"], (), columns, "_before")
    return found.select(*reports.columns, *(F.col(f"_before.{c}").alias(f"prev_{c}") for c in columns))


def previous_watchlist(reports: DataFrame, start: Column) -> DataFrame:
    """(place, text): what the latest report before ``start`` watches; its entries are objects with a text, or texts."""
    last = reports.where(F.col("period_start") < start).agg(F.max_by("body", "period_start").alias("body"))
    entry = F.coalesce(F.get_json_object("w", "$.text"), F.when(~F.startswith(F.ltrim("w"), F.lit("{")), F.col("w")), F.lit(""))
    listed = last.select(F.posexplode(F.from_json("body", "watchlist array<string>")["watchlist"]).alias("place", "w"))
    return listed.select("place", entry.alias("text"))


def normal_summary(value: Column) -> Column:
    """A domain's {summary, watch}: a judge may give the summary alone as a text."""
    parsed = F.from_json(value, "summary string, watch string")
    is_object = F.startswith(F.ltrim(value), F.lit("{")) & F.get_json_object(value, "$").isNotNull()
    return F.when(is_object, F.struct(parsed["summary"].alias("summary"), parsed["watch"].alias("watch"))).otherwise(F.struct(value.alias("summary"), F.lit("").alias("watch")))


def previous_asof(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """As-of join: the last ``value`` of ``right`` strictly before each row of ``left``, inside ``by``."""
    found = as_of(left, right.where(F.col(value).isNotNull()), at, [by], [value], "_asof")
    return found.select(*left.columns, F.col(f"_asof.{value}").alias(f"prev_{value}"))


def sanitize_evidence(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings (finding, evidence) with evidence that exists; without any left they go."""
    cited = findings.select("finding", F.posexplode("evidence").alias("place", "id")).join(known.select("id"), "id", "left_semi")
    return cited.groupBy("finding").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda e: e["id"]).alias("evidence"))


def channel_mix(items: DataFrame, *columns: str) -> DataFrame:
    """(dimension, value, n) for each column in one pass."""
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in columns)))
    return items.select(parts.alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def distributions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of several columns by grouping sets: (dimension, value, n)."""
    if not columns:
        return rows.select(F.lit("").alias("dimension"), F.lit("").alias("value"), F.lit(0).cast("long").alias("n")).limit(0)
    held = {c: F.when(F.grouping(c) == 0, F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value"))) for c in columns}
    grouped = rows.groupingSets([[F.col(c)] for c in columns], *map(F.col, columns))
    return grouped.agg(F.coalesce(*held.values()).alias("d"), F.count(F.lit(1)).alias("n")).select("d.dimension", "d.value", "n")


def source_health(sources: DataFrame, items: DataFrame, rejects: DataFrame) -> DataFrame:
    """(source_id, hits, accepted, rejected, last_seen, accept_rate) for every source, also silent ones."""
    seen = items.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("hits"), F.count_if(F.col("status") == "accepted").alias("accepted"), F.max("discovered_at").alias("last_seen")
    )
    lost = rejects.groupBy("source_id").agg(F.count(F.lit(1)).alias("rejected"))
    joined = sources.select("source_id").join(seen, "source_id", "left").join(lost, "source_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "source_id", number("hits").alias("hits"), number("accepted").alias("accepted"), number("rejected").alias("rejected"),
        "last_seen", F.round(F.try_divide("accepted", "hits"), 3).alias("accept_rate"),
    )


CLAIM = ("id", "text", "source_item_id", "attributed_to", "audience", "needs_internal_data")
ITEM = ("id", "title", "url", "source_id", "source_class", "effective_class", "original_source", "published_at", "time_source", "discovered_at", "channel")
#: Fixed value: the name of a source without a registration and without a host.
UNKNOWN_SOURCE = "来源未知"


def event_documents(events: DataFrame, claims: DataFrame, items: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id, document): one JSON text for each event with its claims by kind, its items and its edges in both directions.

    Claims come by id, items by their dates, edges those that follow first, then
    by the other event's date, one for each other event and relation. Edges to
    events that are gone, or to the event itself, are left out. An item's source
    is its registered name, else its host.
    """
    known = lambda df, names: [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names]
    listed = lambda df, key, name, *cols: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name)).withColumnRenamed(key, "_id")
    parts = [
        listed(claims.where(F.col("kind") == kind).select("event_id", *known(claims, CLAIM)), "event_id", name, *CLAIM)
        for kind, name in (("fact", "facts"), ("inference", "inferences"), ("recommendation", "recommendations"))
    ]
    named = items.select("event_id", *known(items, ITEM), *([F.left("content", F.lit(EXCERPT_CHARS)).alias("excerpt")] if "content" in items.columns else [F.lit("").alias("excerpt")]))
    if sources is not None:
        said = sources.select(F.col("id").alias("source_id"), F.col("name").alias("_name"), F.coalesce("partial_content", F.lit(False)).alias("partial_content"))
        named = named.join(said, "source_id", "left")
    else:
        named = named.withColumn("_name", F.lit(None).cast("string")).withColumn("partial_content", F.lit(False))
    host = F.nullif(display_host(F.coalesce(F.col("url"), F.lit(""))), F.lit(""))
    named = named.withColumn("source_name", F.coalesce("_name", host, F.lit(UNKNOWN_SOURCE))).withColumn("registered", F.col("_name").isNotNull()).fillna(False, ["partial_content"])
    # A text sorts as the document has it: what has no date comes first.
    shown = [F.coalesce(F.col("published_at").cast("string"), F.lit("")).alias("_at"), *ITEM, "source_name", "registered", "partial_content", "excerpt"]
    parts.append(listed(named, "event_id", "items", *shown).withColumn("items", F.transform("items", lambda x: x.dropFields("_at"))))
    more = [c for c in ("basis", "created_by") if c in edges.columns]
    end = lambda own, direction, other: edges.select(F.col(own).alias("_id"), F.lit(direction).alias("direction"), F.col(other).alias("other"), "relation", *more)
    ends = end("from_event", "out", "to_event").unionByName(end("to_event", "in", "from_event")).where("_id <> other")
    ends = ends.groupBy("_id", "other", "relation").agg(F.max(F.struct("direction", *more)).alias("e")).select("_id", "other", "relation", "e.*")
    meta = events.select(F.col("id").alias("other"), *known(events, ("title", "company", "event_date")))
    ends = ends.join(meta, "other").withColumn("_place", F.struct(F.col("relation") != "follows", F.coalesce(F.col("event_date").cast("string"), F.lit("")), "other"))
    shown = listed(ends, "_id", "edges", "_place", "other", "relation", *more, "direction", "title", "company", "event_date")
    parts.append(shown.withColumn("edges", F.transform("edges", lambda x: x.dropFields("_place"))))
    out = events
    for part in parts:
        out = out.join(part, out["id"] == part["_id"], "left").drop("_id")
    names = ("facts", "inferences", "recommendations", "items", "edges")
    return out.select("id", F.to_json(F.struct(*events.columns, *(F.coalesce(x, F.array()).alias(x) for x in names))).alias("document"))


def write_snapshot(documents: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """One folder of JSON lines for each endpoint; returns characters written."""
    sizes = {}
    for name, frame in documents.items():
        path = f"{folder}/{name}"
        frame.write.mode("overwrite").text(path) if len(frame.columns) == 1 else frame.write.mode("overwrite").json(path)
        sizes[name] = frame.sparkSession.read.text(path).agg(F.coalesce(F.sum(F.char_length("value")), F.lit(0))).first()[0]
    return sizes


def carried_vectors(new: DataFrame, previous: DataFrame) -> DataFrame:
    """(id, vector): new vectors, else those of the pack before."""
    old = previous.select("id", F.col("vector").alias("old"))
    return new.join(old, "id", "full_outer").select("id", F.coalesce("vector", "old").alias("vector")).where("vector is not null")
