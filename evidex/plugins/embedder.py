"""Embedders turn texts into vectors; a table of known vectors comes first."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_CHARS = 1600


def cache_key(text: Column, model: str, task: str) -> Column:
    joined = F.concat_ws("|", F.lit(model), F.lit(task), F.left(F.trim(text), F.lit(TEXT_CHARS)))
    return F.substring(F.sha1(joined.cast("binary")), 1, 20)


def embed(rows: DataFrame, key: str, text: str, known: DataFrame, embedder: Callable[[list[str]], list] | None, model: str, task: str = "match") -> tuple[DataFrame, DataFrame]:
    """((key, vector), (cache_key, vector) of new texts): each distinct unknown text is embedded once.

    Without an embedder, and where it gives nothing, the vector is null.
    """
    asked = rows.select(key, F.left(F.trim(F.col(text)), F.lit(TEXT_CHARS)).alias("text"), cache_key(F.col(text), model, task).alias("cache_key"))
    missing = asked.where("text <> ''").select("cache_key", "text").dropDuplicates(["cache_key"]).join(known, "cache_key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), 32):
                part = frame.iloc[low : low + 32]
                vectors = embedder(part["text"].tolist()) if embedder else [None] * len(part)
                yield pd.DataFrame({"cache_key": part["cache_key"].to_numpy(), "vector": vectors})

    fresh = missing.mapInPandas(run, "cache_key string, vector array<double>").where("vector is not null")
    found = known.select("cache_key", "vector").unionByName(fresh)
    return asked.join(found, "cache_key", "left").select(key, "vector"), fresh


def angle_embedder(angles: dict[str, float], size: int = 8) -> Callable[[list[str]], list]:
    """For tests: a text is a direction in the plane."""
    return lambda texts: [[math.cos(angles[t]), math.sin(angles[t]), *[0.0] * (size - 2)] if t in angles else None for t in texts]


def event_text(events: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, text): title, the start of the summary and of the first two facts."""
    from ..operators.events import first_claims

    facts = first_claims(claims.where("kind = 'fact'"), 2).groupBy("event_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda c: F.concat(F.lit(" "), F.left(c["text"], F.lit(80)))), "").alias("facts")
    )
    joined = events.join(facts, events["id"] == facts["event_id"], "left")
    return joined.select("id", F.concat("title", F.lit("。"), F.left(F.coalesce("summary", F.lit("")), F.lit(200)), F.coalesce("facts", F.lit(""))).alias("text"))


def item_text(title: Column, content: Column) -> Column:
    return F.concat(title, F.lit("。"), F.left(F.coalesce(content, F.lit("")), F.lit(600)))
