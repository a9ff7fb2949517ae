"""The read side: facets, hybrid search, retrieval for briefs, and context budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sliding_tokens
from ..functions.vector import cosine

DEFAULT_LIMIT, MOST_LIMIT = 200, 500


def facets(events: DataFrame, company: str | None = None, status: str | None = None, confidence: str | None = None, stage: str | None = None, domain: str | None = None) -> DataFrame:
    """Events that meet every facet given; conditions reach the scan."""
    for column, value in (("company", company), ("status", status), ("confidence", confidence), ("stage", stage)):
        if value is not None:
            events = events.where(F.col(column) == value)
    return events if domain is None else events.where(F.array_contains("domains", domain))


def list_events(events: DataFrame, limit: int | None = None, **asked: str) -> tuple[int, DataFrame]:
    """(how many in all, the latest of them)."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    found = facets(events, **asked)
    return found.count(), found.orderBy(F.desc_nulls_last("event_date"), "id").limit(min(limit or DEFAULT_LIMIT, MOST_LIMIT))


def any_of(events: DataFrame, **asked: list[str]) -> DataFrame:
    """OR inside a facet, AND between facets; array columns overlap."""
    kinds = dict(events.dtypes)
    for column, values in asked.items():
        if values:
            given = F.array(*map(F.lit, values))
            events = events.where(F.arrays_overlap(column, given) if kinds[column].startswith("array") else F.col(column).isin(*values))
    return events


def hybrid_search(rows: DataFrame, key: str, texts: list[str], vector: str | None, query: str, query_vector: list[float] | None, floor: float = 0.62, top: int = 50) -> DataFrame:
    """(key, lexical, similarity): rows that hold the query, then rows near it."""
    if not 2 <= len(query) <= 200:
        raise ValueError("a query has 2 to 200 characters")
    lexical = F.lit(False)
    for text in texts:
        lexical = lexical | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(query.lower()))
    near = cosine(F.array(*map(F.lit, query_vector)), F.col(vector)) if query_vector and vector else F.lit(None).cast("double")
    scored = rows.select(key, lexical.alias("lexical"), F.when(near >= floor, near).alias("similarity"))
    hits = scored.where(F.col("lexical") | F.col("similarity").isNotNull())
    return hits.orderBy(F.desc("lexical"), F.desc_nulls_last("similarity"), key).limit(top)


def brief_candidates(rows: DataFrame, key: str, text: str, prompt: str, similarity: Column, status: Column, top: int = 15) -> DataFrame:
    """(key, score): shared word and character pairs, six times the similarity, and a bonus for news."""
    spark = rows.sparkSession
    grams = spark.range(1).select(sliding_tokens(F.lit(prompt), 2, True).alias("g")).first()["g"]
    asked = F.array(*map(F.lit, grams)) if grams else F.array().cast("array<string>")
    shared = F.size(F.array_intersect(sliding_tokens(F.col(text), 2, True), asked))
    bonus = F.when(status == "new", 2).when(status == "continuing", 1).otherwise(0)
    score = shared + 6 * F.coalesce(similarity, F.lit(0.0)) + bonus
    return rows.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(top)


def context_budget(parts: DataFrame, by: str, order: str, text: str, budget: int) -> DataFrame:
    """Parts in order until the budget of characters is used up; the last one is clipped."""
    size = F.char_length(text)
    used = F.sum(size).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    room = budget - F.coalesce("_used", F.lit(0))
    return parts.withColumn("_used", used).where(room > 0).select(by, order, F.substr(F.col(text), F.lit(1), room.cast("int")).alias(text))


def conversation_trim(turns: DataFrame, by: str, order: str, text: str, last: int = 20, budget: int = 24_000, question: Column | None = None) -> DataFrame:
    """The last turns of each conversation: two at a time go from the oldest end until they fit the budget with the question."""
    turns = turns.withColumn("_asked", F.lit(0) if question is None else F.char_length(question))
    back = Window.partitionBy(by).orderBy(F.desc(order))
    recent = turns.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= last)
    oldest = F.max("_back").over(Window.partitionBy(by))
    newer = Window.partitionBy(by).orderBy(F.desc("_pair")).rangeBetween(Window.unboundedPreceding, 0)
    held = recent.withColumn("_pair", F.floor((oldest - F.col("_back")) / 2)).withColumn("_chars", F.sum(F.char_length(text)).over(newer))
    return held.where(F.col("_chars") + F.col("_asked") <= budget).drop("_back", "_pair", "_chars", "_asked")


def safe_links(hits: DataFrame, url: str, most: int = 5) -> DataFrame:
    """The first few distinct web addresses without credentials."""
    address = F.col(url)
    fine = address.rlike(r"^https?://[^/@\s]+(?:[/?#]|$)") & (F.char_length(address) <= 2000)
    first = hits.where(fine).groupBy(url).agg(F.min("place").alias("place"))
    return first.orderBy("place").limit(most)


def search_index(events: DataFrame) -> DataFrame:
    return events.select("id", "title", F.left(F.coalesce("summary", F.lit("")), F.lit(200)).alias("summary"), "company", "status")
