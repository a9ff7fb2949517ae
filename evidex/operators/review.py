"""Human review: verdicts, flags, the queue, and the trail that they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import STICKY_REVIEW
from .events import group_key


def apply_event_verdicts(events: DataFrame, actions: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(events, reviews) after actions (id, action confirm|reject|watch, note, reviewer)."""
    state = F.create_map(*(F.lit(x) for pair in STATE_OF.items() for x in pair))
    told = actions.select("id", F.try_element_at(state, F.col("action")).alias("_state")).where("_state is not null").dropDuplicates(["id"])
    changed = events.join(told, "id", "left").withColumn("review_state", F.coalesce("_state", "review_state")).select(*events.columns)
    known = actions.join(events.select("id"), "id", "left_semi")
    trail = known.select(F.lit("event").alias("target_type"), F.col("id").alias("target_id"), "action", "note", "reviewer", at.alias("created_at"))
    return changed, trail


def batch_scope(events: DataFrame, scope: str) -> DataFrame:
    """Events that a batch verdict covers."""
    if scope == "single":
        return events.where((F.col("review_state") == "pending") & (F.col("independent_orgs") <= 1))
    return events.where(F.col("review_state") == {"pending": "pending", "suspect": "suspect_duplicate"}[scope])


def flag_once(groups: DataFrame, reviews: DataFrame, at: Column) -> DataFrame:
    """New flags for groups (members) that no earlier flag holds, whatever its order."""
    keyed = groups.select(group_key(F.col("members")).alias("target_id")).distinct()
    earlier = reviews.where("action = 'flag'").select(group_key(F.split("target_id", r"\|")).alias("target_id"))
    return keyed.join(earlier, "target_id", "left_anti").select(
        F.lit("merge").alias("target_type"), "target_id", F.lit("flag").alias("action"), F.lit("system").alias("reviewer"), at.alias("created_at")
    )


def live_groups(reviews: DataFrame, events: DataFrame) -> DataFrame:
    """(target_id, live) for each flagged group: live while all its events exist."""
    flags = reviews.where("action = 'flag'").select("target_id").distinct()
    ids = flags.select("target_id", F.explode(F.split("target_id", r"\|")).alias("id"))
    found = ids.join(events.select("id", F.lit(True).alias("_here")), "id", "left")
    return found.groupBy("target_id").agg(F.bool_and(F.coalesce("_here", F.lit(False))).alias("live"))


def stale_suspects(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """Suspect events none of whose flagged groups is live any more."""
    groups = live_groups(reviews, events).select(F.explode(F.split("target_id", r"\|")).alias("id"), "live")
    flagged = groups.groupBy("id").agg(F.bool_or("live").alias("live"))
    return events.where("review_state = 'suspect_duplicate'").join(flagged.where("not live"), "id", "left_semi").select("id")


def review_queue(events: DataFrame) -> DataFrame:
    """What waits for a person, suspects after the undecided."""
    return events.where(F.col("review_state").isin("pending", "suspect_duplicate")).orderBy("review_state", "id")


STATE_OF = {"confirm": "confirmed", "reject": "rejected", "watch": "watching"}
_TRAIL = ["target_type", "target_id", "action", "note", "reviewer", "created_at"]


def batch_verdict(events: DataFrame, scope: str, action: str, note: str, reviewer: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(events, reviews): one verdict on all events of a scope, and one row that says how many it covers; none for none."""
    covered = batch_scope(events, scope).select("id")
    mark = covered.withColumn("_state", F.lit(STATE_OF[action]))
    changed = events.join(mark, "id", "left").withColumn("review_state", F.coalesce("_state", "review_state")).select(*events.columns)
    total = covered.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    first = covered.orderBy("id").limit(6).agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("ids"))
    size = F.col("n").cast("string")
    told = F.concat(F.lit(f"{note} | "), size, F.lit(" events: "), F.col("ids"), F.when(F.col("n") > 6, " and others").otherwise(""))
    trail = total.crossJoin(first).select(  # one row each
        F.lit("batch").alias("target_type"), F.concat(F.lit(f"{scope}×"), size).alias("target_id"), F.lit(action).alias("action"),
        told.alias("note"), F.lit(reviewer).alias("reviewer"), at.alias("created_at"),
    )
    return changed, trail


def human_merge(tables: dict[str, DataFrame], pairs: DataFrame, action: str, note: str, reviewer: str, at: Column) -> dict[str, DataFrame]:
    """Tables after a person's verdict on pairs (a, b) of events: ``split`` confirms both, ``same`` merges them.

    The event with more items stays, of equals the first named; it is confirmed. Either leaves a review row.
    """
    from .events import apply_merges, human_survivors

    events, items = tables["events"], tables["items"]
    known = pairs.join(events.select(F.col("id").alias("a")), "a", "left_semi").join(events.select(F.col("id").alias("b")), "b", "left_semi").where("a <> b").select("a", "b")

    def confirmed(frame: DataFrame, ids: DataFrame) -> DataFrame:
        mark = ids.distinct().withColumn("_state", F.lit("confirmed"))
        return frame.join(mark, "id", "left").withColumn("review_state", F.coalesce("_state", "review_state")).select(*events.columns)

    trail = lambda df: df.select(F.lit("merge").alias("target_type"), "target_id", F.lit(action).alias("action"), F.lit(note).alias("note"), F.lit(reviewer).alias("reviewer"), at.alias("created_at"))
    if action == "split":
        return {"events": confirmed(events, known.select(F.explode(F.array("a", "b")).alias("id"))), "reviews": trail(known.withColumn("target_id", F.concat_ws("|", "a", "b")))}
    counts = items.groupBy(F.col("event_id").alias("id")).agg(F.count(F.lit(1)).alias("n_items"))
    sides = known.select(F.concat_ws("|", "a", "b").alias("group"), F.posexplode(F.array("a", "b")).alias("ordinal", "id"))
    merges = human_survivors(sides.join(counts, "id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0))))
    changed = apply_merges(events, items, tables["claims"], tables["edges"], tables["rejects"], merges.select("loser", "survivor"))
    titles = merges.join(events.select(F.col("id").alias("loser"), "title"), "loser")
    ledger = titles.select("title", F.lit("—").alias("source_name"), F.lit("human_review").alias("stage"), F.lit("merged").alias("reason_code"),
                           F.concat(F.lit("a person holds it for the same event as "), F.col("survivor")).alias("reason_detail"), F.col("survivor").alias("merged_into"), at.alias("created_at"))
    return changed | {
        "events": confirmed(changed["events"], merges.select(F.col("survivor").alias("id"))),
        "rejects": changed["rejects"].unionByName(ledger, allowMissingColumns=True),
        "reviews": trail(merges.withColumn("target_id", F.concat_ws("|", "survivor", "loser"))),
    }


def unmerge(tables: dict[str, DataFrame], chosen: DataFrame, event: str, title: str | None, note: str, reviewer: str, at: Column) -> dict[str, DataFrame]:
    """Chosen items (id) of an event and their claims under a new event, which may not take all of them.

    The new event is confirmed and has no verdicts until it is verified. One
    review row says what moved, another keeps both from being merged again.
    """
    from .events import event_id

    events, items, claims = tables["events"], tables["items"], tables["claims"]
    own = items.where(F.col("event_id") == event)
    moved = own.join(chosen.select("id").distinct(), "id", "left_semi")
    given = chosen.select("id").distinct().count()
    if moved.count() != given:
        raise ValueError(f"some items are not of {event}")
    if not given or given >= own.count():
        raise ValueError("an event keeps at least one item, and a new one has one")
    head = moved.agg(
        F.min(F.struct("published_at", "title")).alias("first"), F.min("discovered_at").alias("first_seen_at"), F.min(F.to_date("published_at")).alias("event_date"),
        F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("items"),
    )
    name = F.left(F.trim(F.lit(title) if title else F.col("first.title")), F.lit(120))
    new = head.join(events.where(F.col("id") == event).select("company", "domains", F.col("title").alias("_from"))).withColumn("title", name)
    new = new.withColumn("event_key", F.left("title", F.lit(60))).withColumn("id", event_id(F.col("company"), F.col("event_key")))
    new_id = new.select("id").first()["id"]
    if not events.where(F.col("id") == new_id).isEmpty():
        raise ValueError(f"{new_id} exists; another title gives another id")
    row = new.select("id", "event_key", "title", "company", "domains", F.coalesce("first_seen_at", at).alias("first_seen_at"), at.alias("last_update_at"), "event_date", F.lit(0).alias("independent_orgs"), F.lit("confirmed").alias("review_state"))
    touched = events.withColumn("last_update_at", F.when(F.col("id") == event, at).otherwise(F.col("last_update_at")))
    picked = moved.select(F.col("id").alias("_id"), F.lit(True).alias("_picked"))

    def move(frame: DataFrame, key: str) -> DataFrame:
        at_new = F.when(F.col("_picked") & (F.col("event_id") == event), F.lit(new_id)).otherwise(F.col("event_id"))
        return frame.join(picked, F.col(key) == F.col("_id"), "left").withColumn("event_id", at_new).select(*frame.columns)

    told = F.concat(F.lit(f"{note} | from {event} "), F.left("_from", F.lit(30)), F.lit(": "), F.col("items"))
    entries = F.array(
        F.struct(F.lit("event").alias("target_type"), F.col("id").alias("target_id"), F.lit("unmerge").alias("action"), told.alias("note")),
        F.struct(F.lit("merge").alias("target_type"), F.concat_ws("|", F.lit(event), "id").alias("target_id"), F.lit("split").alias("action"), F.lit(note).alias("note")),
    )
    trail = new.select(F.explode(entries).alias("x")).select("x.*", F.lit(reviewer).alias("reviewer"), at.alias("created_at"))
    return {"events": touched.unionByName(row, allowMissingColumns=True), "items": move(items, "id"), "claims": move(claims, "source_item_id"), "reviews": trail}


def retier(sources: DataFrame, source: str, note: str, reviewer: str, at: Column, source_class: str | None = None, reliability: float | None = None, active: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(sources, reviews): a source with other attributes, and a row that tells what changed; none if nothing is given."""
    given = {k: v for k, v in (("source_class", source_class), ("reliability", reliability), ("active", active)) if v is not None}
    own = F.col("id") == source
    changed = sources
    for column, value in given.items():
        changed = changed.withColumn(column, F.when(own, F.lit(value)).otherwise(F.col(column)))
    told = F.concat_ws("; ", *(F.concat(F.lit(f"{c} "), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(f" → {str(v).lower() if isinstance(v, bool) else v}")) for c, v in given.items()))
    trail = sources.where(own & F.lit(bool(given))).select(
        F.lit("source").alias("target_type"), F.col("id").alias("target_id"), F.lit("retier").alias("action"),
        F.concat(told, F.lit(f". {note}")).alias("note"), F.lit(reviewer).alias("reviewer"), at.alias("created_at"),
    )
    return changed, trail


def queue_view(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """(kind, n): what waits by state, flagged groups that are still to be settled, and suspects whose groups are gone."""
    states = events.where(F.col("review_state").isin("pending", "suspect_duplicate")).groupBy(F.col("review_state").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    settled = reviews.where(F.col("action").isin("same", "split")).select(group_key(F.split("target_id", r"\|")).alias("key")).distinct()
    live = live_groups(reviews, events).where("live").withColumn("key", group_key(F.split("target_id", r"\|")))
    groups = live.join(settled, "key", "left_anti").agg(F.count_distinct("key").alias("n")).select(F.lit("open_groups").alias("kind"), "n")
    stale = stale_suspects(events, reviews).agg(F.count(F.lit(1)).alias("n")).select(F.lit("stale_suspects").alias("kind"), "n")
    return states.unionByName(groups).unionByName(stale)


def cleared_suspects(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """Events whose suspicion has lost its ground go back to what their confidence asks for."""
    gone = stale_suspects(events, reviews).withColumn("_stale", F.lit(True))
    back = F.when(F.col("_stale"), "none").otherwise(F.col("review_state"))
    return events.join(gone, "id", "left").withColumn("review_state", back).select(*events.columns)


def sticky(state: Column) -> Column:
    return state.isin(*STICKY_REVIEW)
