"""Layered deduplication of raw items with a ledger of every rejected row.

Rows are taken in the order of ``seq``; the first failing check names the
reason. Addresses, titles and fingerprints count only against rows that were
accepted, in earlier runs or earlier in this one, which makes the accepted
rows the first maximal independent set of the conflict graph in that order.
It is found by rounds: a row whose earlier neighbours are all rejected is
accepted, a row with an earlier accepted neighbour is rejected. Rows of one
address, title or fingerprint are not paired: each of these carries the least
accepted and the least open ``seq`` of its rows. Different fingerprints of the
new rows that are near are listed as pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TRUSTED_TIME, EngineConfig
from ..functions.simhash import simhash_value
from ..functions.text import keyword_gate, normalize_plain_title, normalize_title, present
from ..functions.url import canonical_url, item_id
from .comparators import ComparatorIndex, against_history
from .similarity import hamming_pairs


def prepare(raw: DataFrame, config: EngineConfig, window_start: Column, entities: bool = True) -> DataFrame:
    """Columns that the checks need, and ``local_reason`` of the checks that look at one row alone.

    ``raw``: seq, url, title, content, published_at, time_source, prefilter_drop.
    """
    gate = keyword_gate(F.col("title"), F.col("content"), config.ai_terms, config.industry_terms)
    norm = (normalize_title if entities else normalize_plain_title)(F.col("title"))
    rows = raw.select(
        "*", canonical_url(F.col("url")).alias("url_canonical"), norm.alias("title_norm"), gate.alias("gate")
    ).withColumn("item_id", item_id(F.col("url_canonical")))
    missing = present(F.trim("title")).isNull() | present(F.col("url")).isNull()
    stale = F.col("time_source").isin(*TRUSTED_TIME) & (F.col("published_at") < window_start)
    return rows.withColumn("simhash", simhash_value(F.concat_ws(" ", "title", "content"))).withColumn(
        "early_reason", F.when(missing, "no_title").when(F.col("prefilter_drop").isNotNull(), "off_topic")
    ).withColumn("late_reason", F.when(F.coalesce(stale, F.lit(False)), "stale").when(~F.col("gate.passes"), "off_topic"))


def layered_dedup(rows: DataFrame, known: DataFrame | ComparatorIndex, threshold: int, write) -> DataFrame:
    """(seq, reason, dup_of): reason is null for accepted rows, dup_of the earliest accepted one that stands against it.

    ``rows`` as of prepare(); ``known``: seq (before all of ``rows``), url_canonical,
    title_norm, simhash of accepted items of earlier runs, or an index of them.
    History is met by the keys of ``rows`` once, and never with itself; a round
    reads the rows that are open and what the round before accepted. ``write``
    materialises a frame.
    """
    cols, kinds = ["seq", "url_canonical", "title_norm", "simhash"], ("url_canonical", "title_norm", "simhash")
    early = rows.where("early_reason is not null").select("seq", F.col("early_reason").alias("reason"), F.lit(None).cast("long").alias("dup_of"))
    live = write(against_history(rows.where("early_reason is null").select(*cols, "late_reason"), known, threshold))
    graph = live.where("late_reason is null").select(*cols, *(f"{k}_stood" for k in kinds), F.lit("open").alias("state"))
    graph = write(graph)
    pairs = hamming_pairs(graph, "simhash", threshold)
    near = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = write(near.union(graph.select(F.col("simhash").alias("a"), F.col("simhash").alias("b")).distinct()))

    def least(frame: DataFrame, key: str) -> DataFrame:
        return frame.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(key).agg(
            F.min(F.when(F.col("state") == "accepted", F.col("seq"))).alias(f"{key}_accepted"),
            F.min(F.when(F.col("state") == "open", F.col("seq"))).alias(f"{key}_open"),
        )

    def faced(frame: DataFrame, graph: DataFrame) -> DataFrame:
        """``frame`` with the earliest accepted and open rows of ``graph`` that it conflicts with."""
        by_print = least(graph, "simhash").withColumnRenamed("simhash", "b")
        by_print = near.join(by_print, "b").groupBy("a").agg(
            F.min("simhash_accepted").alias("simhash_accepted"), F.min("simhash_open").alias("simhash_open")
        )
        out = frame.join(least(graph, "url_canonical"), "url_canonical", "left").join(least(graph, "title_norm"), "title_norm", "left")
        return out.join(by_print.withColumnRenamed("a", "simhash"), "simhash", "left")

    taken = []
    while graph.where("state = 'open'").limit(1).count():
        stood = {k: F.least(F.col(f"{k}_stood"), F.col(f"{k}_accepted")) for k in kinds}
        against = F.least(*stood.values(), F.lit(1 << 62))
        before = F.least(*(F.col(f"{k}_open") for k in kinds), F.lit(1 << 62))
        # What is accepted and earlier rejects; without anything open and earlier the row is accepted.
        step = F.when(against < F.col("seq"), "rejected").when(before >= F.col("seq"), "accepted").otherwise("open")
        decided = faced(graph.where("state = 'open'"), graph).select(*cols, *(v.alias(f"{k}_stood") for k, v in stood.items()), step.alias("state"))
        graph = write(decided.where("state <> 'rejected'"))
        taken.append(graph.where("state = 'accepted'").select(*cols, "state"))
    accepted = reduce(DataFrame.unionByName, taken, graph.where("false").select(*cols, "state"))
    final = faced(live, accepted)
    hit = lambda k: F.least(F.col(f"{k}_stood"), F.when(F.col(f"{k}_accepted") < F.col("seq"), F.col(f"{k}_accepted")))
    url, title, near_hit = (hit(k) for k in kinds)
    reason = (
        F.when(url.isNotNull(), "duplicate_url")
        .when(F.col("late_reason").isNotNull(), F.col("late_reason"))
        .when(title.isNotNull() | near_hit.isNotNull(), "syndication")
    )
    dup_of = F.when(url.isNotNull(), url).when(F.col("late_reason").isNull(), F.coalesce(title, near_hit))
    return final.select("seq", reason.alias("reason"), dup_of.cast("long").alias("dup_of")).unionByName(early)


def funnel(decisions: DataFrame) -> DataFrame:
    """(reason, n) with the accepted rows under their own name; the numbers add up to the rows given."""
    return decisions.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def ledger(rows: DataFrame, decisions: DataFrame, run_id: str, stage: str, at: Column) -> DataFrame:
    """Reject rows for the log: nothing goes without its reason."""
    ids = rows.select(F.col("seq").alias("dup_of"), F.col("item_id").alias("merged_into"))
    out = rows.join(decisions.where("reason is not null"), "seq").join(ids, "dup_of", "left")
    return out.select(
        F.lit(run_id).alias("run_id"), "item_id", "url", F.left("title", F.lit(300)).alias("title"),
        F.lit(stage).alias("stage"), F.col("reason").alias("reason_code"), "merged_into", at.alias("created_at"),
    )


def exact_duplicates(items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, first): rows whose text an earlier row has, and the earliest such row."""
    from pyspark.sql import Window

    same = Window.partitionBy(F.sha2(F.col(text), 256))
    return items.select(F.col(key), F.min(key).over(same).alias("first")).where(F.col(key) != F.col("first"))
