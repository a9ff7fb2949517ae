"""S0: from sources to items, over all channels that are fetched directly, with a failure for each source that gives nothing.

Requests are a table: one for each address, or for each mirror of a source that
has some. Fetching is dealt over the tasks by source; what comes back is a row,
an error too, so one source never fails another. Items are read from responses
by the channel of their source; of mirrors the first that gave an item counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_charset
from .readers import fetch, first_mirror, listing_links, parse_feed, union_channels

#: Channels whose responses are feeds, and those that are asked at mirrors.
FEEDS, MIRRORED = ("rss", "rsshub"), ("rsshub",)
RESPONSE = "source_id string, channel string, mirror int, url string, status string, body binary"


def requests(sources: DataFrame, instances: list[str]) -> DataFrame:
    """(source_id, channel, mirror, url) of active sources (id, channel, channel_ref): an address each, or one for each instance."""
    active = sources.where(F.coalesce("active", F.lit(True))) if "active" in sources.columns else sources
    mirrored = F.transform(F.array(*(F.lit(i.rstrip("/")) for i in instances)), lambda i: F.concat(i, F.col("channel_ref"))) if instances else F.array().cast("array<string>")
    addresses = F.when(F.col("channel").isin(*MIRRORED), mirrored).otherwise(F.array("channel_ref"))
    asked = active.where(F.col("channel").isin(*FEEDS, "direct") & F.col("channel_ref").isNotNull())
    return asked.select(F.col("id").alias("source_id"), "channel", F.posexplode(addresses).alias("mirror", "url"))


def fetched(asked: DataFrame, timeout: float = 20, most: int = 600_000) -> DataFrame:
    """``asked`` with status and body; every address once, dealt by source."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(len(frame)):  # a body at a time
                row = frame.iloc[[at]]
                status, body = fetch(row["url"].iloc[0], timeout, most)
                yield row.assign(status=status, body=[body])

    return asked.select("source_id", "channel", "mirror", "url").repartition("source_id").mapInPandas(run, RESPONSE)


def items_of(sources: DataFrame, responses: DataFrame, content_chars: int = 6000) -> tuple[DataFrame, DataFrame]:
    """(items, failures): items with source_id, channel and their total order ``seq``; failures (source_id, reason).

    A source fails that answered with an error or without a body, at its last
    mirror if it has some, unless another one gave an item. A page without
    articles is no failure of its source, a feed of mirrors without items is.
    """
    good = responses.where("status = '200' and octet_length(body) > 0").withColumn("text", decode_charset(F.col("body")))
    key = F.struct("source_id", "mirror", "channel").alias("path")
    feeds = parse_feed(good.where(F.col("channel").isin(*FEEDS)).select(key, "text"), content_chars)
    fed = feeds.select(F.col("path.source_id").alias("source_id"), F.col("path.mirror").alias("mirror"), F.col("path.channel").alias("channel"), "url", "title", "content", "published_at", "time_source")
    fed = first_mirror(fed).drop("mirror")
    has = set(sources.columns)
    pattern = F.col("article_url_pattern") if "article_url_pattern" in has else F.lit(None).cast("string")
    pages = good.where("channel = 'direct'").join(sources.select(F.col("id").alias("source_id"), "domains", pattern.alias("pattern")), "source_id")
    listed = listing_links(pages.select("url", F.col("text").alias("html"), "domains", "pattern")).join(pages.select("source_id", "url"), "url")
    direct = listed.select("source_id", F.lit("direct").alias("channel"), F.col("link").alias("url"), "title")
    items = union_channels({"rss": fed.where("channel = 'rss'").drop("channel"), "rsshub": fed.where("channel = 'rsshub'").drop("channel"), "direct": direct.drop("channel")})
    gave = items.select("source_id").distinct()
    last = responses.groupBy("source_id", "channel").agg(F.max_by(F.struct("status", F.coalesce(F.octet_length("body"), F.lit(0)).alias("size")), "mirror").alias("last"), F.min_by("status", "mirror").alias("first"))
    bad = (F.col("last.status") != "200") | (F.col("last.size") == 0) | F.col("channel").isin(*MIRRORED)
    why = F.when(F.col("channel").isin(*MIRRORED), F.concat(F.lit("all mirrors failed, the last with "), "last.status")).otherwise(F.concat(F.lit("HTTP "), "last.status"))
    return items, last.where(bad).join(gave, "source_id", "left_anti").select("source_id", why.alias("reason"))


def collect(sources: DataFrame, instances: list[str], timeout: float = 20) -> tuple[DataFrame, DataFrame]:
    """(items, failures) of all sources, each fetched once."""
    responses = fetched(requests(sources, instances), timeout).checkpoint()
    return items_of(sources, responses)
