"""From extracted items to events: claims, merging, edges, and relations between events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import present
from .ordered import row_before


def event_id(company: Column, key: Column) -> Column:
    return F.concat(F.lit("EV-"), F.substring(F.sha1(F.concat_ws(":", company, key).cast("binary")), 1, 8))


def pair_key(a: Column, b: Column) -> Column:
    """One name for an unordered pair of ids."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def group_key(members: Column) -> Column:
    """One name for an unordered group of ids."""
    return F.array_join(F.array_sort(F.array_distinct(members)), "|")


def normal_company(company: Column, config: EngineConfig) -> Column:
    """A known company, its known alias, or the industry as a whole."""
    name = F.lower(F.trim(company))
    known = F.array(*map(F.lit, config.companies)) if config.companies else F.array().cast("array<string>")
    aliases = [x for k, v in config.company_aliases.items() for x in (F.lit(k.lower()), F.lit(v))]
    mapped = F.try_element_at(F.create_map(*aliases), name) if aliases else F.lit(None).cast("string")
    return F.when(F.array_contains(known, name), name).otherwise(F.coalesce(mapped, F.lit("industry")))


def claim_id(event: Column, item: Column, mark: str, text: Column) -> Column:
    return F.concat(F.lit("cl_"), F.substring(F.sha1(F.concat(event, F.coalesce(item, F.lit("")), F.lit(mark), text).cast("binary")), 1, 12))


def write_claims(drafts: DataFrame) -> DataFrame:
    """Claims of drafts: (event_id, item_id, effective_class, draft). Opinions give no facts."""
    clean = lambda c: F.left(F.trim(c), F.lit(500))
    facts = drafts.where(F.coalesce("effective_class", F.lit("")) != "E").select("event_id", "item_id", F.explode("draft.facts").alias("t"))
    facts = facts.where(F.char_length(F.trim("t")) >= 6).select(
        claim_id(F.col("event_id"), F.col("item_id"), "f", F.col("t")).alias("id"), "event_id", F.lit("fact").alias("kind"),
        clean(F.col("t")).alias("text"), F.col("item_id").alias("source_item_id"), F.lit(None).cast("string").alias("attributed_to"),
        F.lit(None).cast("string").alias("audience"), F.lit(None).cast("boolean").alias("needs_internal_data"),
    )
    views = drafts.select("event_id", "item_id", F.explode("draft.inferences").alias("v")).where(F.char_length(F.trim("v.text")) >= 6).select(
        claim_id(F.col("event_id"), F.col("item_id"), "i", F.col("v.text")).alias("id"), "event_id", F.lit("inference").alias("kind"),
        clean(F.col("v.text")).alias("text"), F.col("item_id").alias("source_item_id"), F.col("v.attributed_to").alias("attributed_to"),
        F.lit(None).cast("string").alias("audience"), F.lit(None).cast("boolean").alias("needs_internal_data"),
    )
    advice = drafts.where(F.char_length(F.trim("draft.implication.text")) >= 8).select(
        claim_id(F.col("event_id"), F.lit(""), "r", clean(F.col("draft.implication.text"))).alias("id"), "event_id",
        F.lit("recommendation").alias("kind"), clean(F.col("draft.implication.text")).alias("text"),
        F.lit(None).cast("string").alias("source_item_id"), F.lit(None).cast("string").alias("attributed_to"),
        F.col("draft.implication.audience").alias("audience"), F.col("draft.implication.needs_internal_data").alias("needs_internal_data"),
    )
    return facts.unionByName(views).unionByName(advice).dropDuplicates(["id"])


def first_claims(claims: DataFrame, k: int) -> DataFrame:
    """The first ``k`` claims of each event by id, with their rank."""
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy("id"))
    return claims.withColumn("rank", rank).where(F.col("rank") <= k)


def claims_by_kind(claims: DataFrame) -> DataFrame:
    kinds = ("fact", "inference", "recommendation")
    return claims.groupBy("event_id").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds))


def merge_fold(members: DataFrame, by: str) -> DataFrame:
    """One event from the drafts of a group: earliest date, all domains, the first summary.

    ``members``: ordinal, event_date, domains, summary, item_id.
    """
    return members.groupBy(by).agg(
        F.min("event_date").alias("event_date"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("domains")))).alias("domains"),
        F.min_by("summary", F.when(present(F.col("summary")).isNotNull(), F.col("ordinal"))).alias("summary"),
        F.count(F.lit(1)).alias("n_items"),
    )


def assign_groups(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(item_id, company, key): the judge's last group that names a candidate, else the candidate's own key.

    ``candidates``: company, place, item_id, own_key; ``verdicts``: company, ordinal, key, members.
    """
    named = verdicts.select("company", "ordinal", "key", F.explode("members").alias("place"))
    last = named.groupBy("company", "place").agg(F.max_by("key", "ordinal").alias("key"))
    joined = candidates.join(last, ["company", "place"], "left")
    return joined.select("item_id", "company", F.coalesce("key", "own_key").alias("key"), F.col("key").isNull().alias("orphan"))


def resolved_relations(relations: DataFrame, events: DataFrame) -> DataFrame:
    """Edges whose two keys name different known events and that have a basis."""
    ids = events.select("company", "event_key", "id").dropDuplicates(["company", "event_key"])
    a = ids.select("company", F.col("event_key").alias("from"), F.col("id").alias("from_event"))
    b = ids.select("company", F.col("event_key").alias("to"), F.col("id").alias("to_event"))
    found = relations.join(a, ["company", "from"]).join(b, ["company", "to"])
    kept = found.where((F.col("from_event") != F.col("to_event")) & present(F.trim("basis")).isNotNull())
    return kept.select("from_event", "to_event", "relation", "basis").dropDuplicates(["from_event", "to_event", "relation"])


def survivors(members: DataFrame) -> DataFrame:
    """(group, loser, survivor): the earliest seen event of a group stays, of equals the one with most items.

    ``members``: group, id, first_seen_at, n_items.
    """
    order = F.struct(F.coalesce("first_seen_at", F.lit("9999-12-31").cast("timestamp_ntz")).alias("t"), (-F.col("n_items")).alias("n"), "id")
    best = members.groupBy("group").agg(F.min_by("id", order).alias("survivor"))
    return members.join(best, "group").where("id <> survivor").select("group", F.col("id").alias("loser"), "survivor")


def human_survivors(members: DataFrame) -> DataFrame:
    """As survivors(), by a person's verdict: the event with most items stays, of equals the first named."""
    order = F.struct((-F.col("n_items")).alias("n"), "ordinal")
    best = members.groupBy("group").agg(F.min_by("id", order).alias("survivor"))
    return members.join(best, "group").where("id <> survivor").select("group", F.col("id").alias("loser"), "survivor")


def split_blocked(groups: DataFrame, splits: DataFrame) -> DataFrame:
    """Groups (group, members) that hold two ids which a person set apart (splits: members)."""
    ids = groups.select("group", F.explode(F.array_distinct("members")).alias("id"))
    apart = splits.select(group_key(F.col("members").cast("array<string>")).alias("split"), F.explode(F.array_distinct("members")).alias("id"))
    hits = ids.join(apart, "id").groupBy("group", "split").agg(F.count(F.lit(1)).alias("n"))
    return hits.where("n >= 2").select("group").distinct()


def closure(merges: DataFrame, write=lambda df: df) -> DataFrame:
    """(loser, survivor) with chains followed to their ends; rounds double the distance."""
    paths = write(merges.select("loser", "survivor"))
    while True:
        step = paths.select(F.col("loser").alias("via"), F.col("survivor").alias("beyond"))
        longer = paths.join(step, paths["survivor"] == step["via"], "left")
        open_ends = F.count_if(F.col("beyond").isNotNull())
        paths = write(longer.select("loser", F.coalesce("beyond", "survivor").alias("survivor"), "beyond"))
        if not paths.agg(open_ends.alias("n")).first()["n"]:
            return paths.select("loser", "survivor")
        paths = paths.select("loser", "survivor")


def apply_merges(events: DataFrame, items: DataFrame, claims: DataFrame, edges: DataFrame, rejects: DataFrame, merges: DataFrame) -> dict[str, DataFrame]:
    """Tables after merges: items, claims and merge records follow the survivor; losers go with their edges."""
    moved = merges.select(F.col("loser").alias("_loser"), F.col("survivor").alias("_survivor"))

    def follow(df: DataFrame, column: str, only: Column | None = None) -> DataFrame:
        hit = F.col(column) == F.col("_loser")
        joined = df.join(moved, hit if only is None else hit & only, "left")
        return joined.withColumn(column, F.coalesce("_survivor", column)).drop("_loser", "_survivor")

    gone = merges.select(F.col("loser").alias("id"))
    members = merges.select(F.col("survivor").alias("_id"), F.col("loser").alias("id")).unionByName(
        merges.select(F.col("survivor").alias("_id"), F.col("survivor").alias("id"))
    )
    dates = members.distinct().join(events.select("id", "event_date"), "id").groupBy("_id").agg(F.min("event_date").alias("_date"))
    left = events.join(gone, "id", "left_anti").join(dates, F.col("id") == F.col("_id"), "left")
    left = left.withColumn("event_date", F.coalesce("_date", "event_date")).drop("_id", "_date")
    from .tables import cascade_delete

    return {
        "events": left.select(*events.columns),
        "items": follow(items, "event_id").select(*items.columns),
        "claims": follow(claims, "event_id").select(*claims.columns),
        "edges": cascade_delete(edges, gone),
        "rejects": follow(rejects, "merged_into", F.col("stage") == "merge_cross").select(*rejects.columns),
    }


def dangling(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Edges with an end that is no event."""
    ids = events.select("id").distinct()
    both = edges.join(ids.withColumnRenamed("id", "from_event"), "from_event", "left_semi")
    both = both.join(ids.withColumnRenamed("id", "to_event"), "to_event", "left_semi").select(*edges.columns)
    return edges.exceptAll(both)


def adjacent_edges(events: DataFrame, existing: DataFrame) -> DataFrame:
    """New rule edges: neighbours in time among the dated events of a company, however many it has."""
    dated = events.where("event_date is not null").select("company", "event_date", "id")
    found = row_before(dated, ["event_date", "id"], ["company"], ["id", "event_date"])
    pairs = found.select(
        "company", F.col("previous.id").alias("from_event"), F.col("id").alias("to_event"), F.col("previous.event_date").alias("from_date"), F.col("event_date").alias("to_date")
    )
    pairs = pairs.where("from_event is not null").withColumn("relation", F.lit("same_actor_track"))
    return pairs.join(existing.select("from_event", "to_event", "relation"), ["from_event", "to_event", "relation"], "left_anti")


def answered_pairs(edges: DataFrame, reviews: DataFrame) -> DataFrame:
    """Unordered pairs that a judge or a person has decided; rule edges decide nothing."""
    by_edge = edges.where("created_by <> 'rule'").select(pair_key(F.col("from_event"), F.col("to_event")).alias("pair"))
    return by_edge.union(reviews.where("target_type = 'relate'").select("target_id")).distinct()


def semantic_degree(edges: DataFrame) -> DataFrame:
    ends = edges.where("created_by <> 'rule'").select(F.explode(F.array("from_event", "to_event")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def relate_focus(events: DataFrame, edges: DataFrame, since: Column, least: int) -> DataFrame:
    """Events touched since then, filled up to ``least`` with the latest that have no semantic edge."""
    touched = F.coalesce(F.col("last_update_at") >= since, F.lit(False))
    ranked = events.join(semantic_degree(edges), "id", "left").select(
        "id", touched.alias("touched"), F.coalesce("degree", F.lit(0)).alias("degree"), "event_date"
    )
    fresh = ranked.where("touched").select("id")
    missing = max(0, least - fresh.limit(least).count())
    spare = ranked.where("not touched and degree = 0").orderBy(F.desc_nulls_last("event_date"), F.desc("id")).limit(missing)
    return fresh.unionByName(spare.select("id"))


def accepted_relations(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, none): verdicts (a, b, relation, source, basis) with a known relation and a basis of 8 characters."""
    from ..config import RELATIONS

    good = F.coalesce(F.col("relation").isin(*RELATIONS[1:]) & (F.char_length(F.trim("basis")) >= 8), F.lit(False))
    start = F.when(F.col("source") == "B", F.col("b")).otherwise(F.col("a"))
    end = F.when(F.col("source") == "B", F.col("a")).otherwise(F.col("b"))
    edges = verdicts.where(good).select(start.alias("from_event"), end.alias("to_event"), "relation", F.trim("basis").alias("basis"))
    none = verdicts.where(~good).select(F.lit("relate").alias("target_type"), pair_key(F.col("a"), F.col("b")).alias("target_id"), F.lit("no_relation").alias("action"))
    return edges, none


def recent_pool(items: DataFrame, fresh: DataFrame, since: Column, most: int) -> DataFrame:
    """The newest ``most`` items that are not rejected, less the fresh ones, which use up places."""
    at = F.coalesce("published_at", "discovered_at")
    pool = items.where((F.col("status") != "rejected") & (at >= since)).orderBy(at.desc(), "id").limit(most)
    return pool.join(fresh.select("id"), "id", "left_anti")


def semantic_drops(pairs: DataFrame, write=lambda df: df.checkpoint()) -> DataFrame:
    """(id, merged_into) from judged pairs (place, a, b, a_at, b_at, dup) folded in order of ``place``.

    The later discovered side goes; once a side of a pair is gone the pair says
    nothing. Rounds decide all pairs that come first for both of their sides,
    so pairs that share no row are folded at once.
    """
    later = F.col("a_at") >= F.col("b_at")
    new, old = F.when(later, F.col("a")).otherwise(F.col("b")), F.when(later, F.col("b")).otherwise(F.col("a"))
    left = write(pairs.where("dup").select("place", "a", "b", new.alias("id"), old.alias("merged_into")))
    found = left.select("id", "merged_into").limit(0)
    while not left.isEmpty():
        first = left.select("place", F.explode(F.array("a", "b")).alias("side")).groupBy("side").agg(F.min("place").alias("first"))
        of = lambda c: first.select(F.col("side").alias(c), F.col("first").alias(f"first_{c}"))
        both = left.join(of("a"), "a").join(of("b"), "b")
        ready = write(both.where("place = first_a and place = first_b").select("place", "id", "merged_into"))
        found = found.unionByName(ready.select("id", "merged_into"))
        rest = left.join(ready.select("place"), "place", "left_anti")
        for side in ("a", "b"):
            rest = rest.join(ready.select(F.col("id").alias(side)), side, "left_anti")
        left = write(rest.select(*left.columns))
    return found


def fold_groups(members: DataFrame, splits: DataFrame, write=lambda df: df.checkpoint()) -> tuple[DataFrame, DataFrame]:
    """(merges, blocked) of groups (group, id, first_seen_at, n_items) taken in order of ``group``.

    What an earlier group has merged away no longer counts in a later one, and
    a group that a person has split is left alone. ``merges``: group, loser,
    survivor; ``blocked``: group. Rounds take all groups that come first for
    each of their members.
    """
    left = write(members.dropDuplicates(["group", "id"]))
    merges = blocked = None
    while not left.isEmpty():
        first = left.groupBy("id").agg(F.min("group").alias("first"))
        late = left.join(first, "id").where(F.col("group") != F.col("first")).select("group").distinct()
        ready = write(left.join(late, "group", "left_anti"))
        several = ready.join(ready.groupBy("group").count().where("count > 1").select("group"), "group", "left_semi")
        stopped = split_blocked(several.groupBy("group").agg(F.collect_list("id").alias("members")), splits)
        stopped = write(stopped)
        merged = write(survivors(several.join(stopped, "group", "left_anti")))
        merges = merged if merges is None else merges.unionByName(merged)
        blocked = stopped if blocked is None else blocked.unionByName(stopped)
        rest = left.join(ready.select("group").distinct(), "group", "left_anti")
        left = write(rest.join(merged.select(F.col("loser").alias("id")), "id", "left_anti").select(*members.columns))
    if merges is None:
        merges = survivors(members)
        blocked = members.select("group").limit(0)
    return merges, blocked


def open_pairs(pairs: DataFrame, edges: DataFrame, reviews: DataFrame) -> DataFrame:
    """Candidate pairs (a, b, ...) that neither a judge nor a person has answered, each once."""
    keyed = pairs.withColumn("pair", pair_key(F.col("a"), F.col("b"))).dropDuplicates(["pair"])
    return keyed.join(answered_pairs(edges, reviews), "pair", "left_anti").drop("pair")


def with_source_names(items: DataFrame, sources: DataFrame, unknown: str = "未登记来源") -> DataFrame:
    """Items with the name of their source."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return items.join(names, "source_id", "left").withColumn("source_name", F.coalesce("source_name", F.lit(unknown)))


def claims_with_items(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Claims with the address and title of the item that they come from, if any."""
    of = items.select(F.col("id").alias("source_item_id"), F.col("url").alias("item_url"), F.col("title").alias("item_title"))
    return claims.join(of, "source_item_id", "left")


def display_name(value: Column, names: dict[str, str]) -> Column:
    """The configured name of an id, else the id."""
    given = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(given, value), value)
