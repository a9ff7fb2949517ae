"""Markdown documents: front matter, outlines with anchors, table checks, live tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered

#: What opens a document, a code fence, a heading and the second row of a table.
FRONT_MATTER = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n"
FENCE = r"^\s*```"
HEADING = r"^(#{1,3})\s+(.+?)\s*$"
DELIMITER = r"^\|[\s:|-]*-[\s:|-]*\|?\s*$"
#: The part of an index document that its entries are.
ENTRIES = 3


def strip_frontmatter(text: Column) -> Column:
    """Text without the block between two --- lines that it opens with."""
    return F.regexp_replace(text, FRONT_MATTER, "")


def frontmatter(text: Column) -> Column:
    """A map of the flat ``key: value`` lines of that block; of a repeated key the last value stays."""
    lines = F.split(F.regexp_extract(text, FRONT_MATTER, 1), r"\r?\n")
    flat = F.filter(lines, lambda x: F.contains(x, F.lit(":")) & ~x.rlike(r"^[ \t-]"))
    key = lambda x: F.trim(F.substring_index(x, ":", 1))
    later = lambda x, i: F.exists(F.slice(flat, i + 2, F.size(flat)), lambda y: key(y) == key(x))
    last = F.filter(flat, lambda x, i: ~later(x, i))
    return F.map_from_arrays(F.transform(last, key), F.transform(last, lambda x: F.trim(F.substr(x, F.locate(":", x) + 1))))


def _lines(docs: DataFrame) -> DataFrame:
    """(id, pos, line, fenced): lines from 1 on, with whether they open, close or lie in a code fence."""
    lines = docs.select("id", F.posexplode(F.split("text", r"\r?\n", -1)).alias("pos", "line"))
    fence = F.col("line").rlike(FENCE)
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.sum(fence.cast("int")).over(before)
    return lines.select("id", (F.col("pos") + 1).alias("pos"), "line", (fence | (seen % 2 == 1)).alias("fenced"))


def slug(text: Column) -> Column:
    """Anchor of a heading: what is neither word character nor CJK becomes a dash, none at the ends."""
    bare = F.regexp_replace(F.trim(text), r"[`*_~]", "")
    dashed = F.regexp_replace(bare, r"[^A-Za-z0-9_\x{4E00}-\x{9FFF}]+", "-")
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(dashed, r"^-+|-+$", "")), F.lit("")), F.lit("h"))


def outline(docs: DataFrame) -> DataFrame:
    """(id, pos, level, title, anchor) of headings of three levels outside fences; the second of an anchor ends in -2."""
    rows = _lines(docs).where(~F.col("fenced") & F.col("line").rlike(HEADING)).select(
        "id", "pos", F.char_length(F.regexp_extract("line", HEADING, 1)).alias("level"), F.regexp_extract("line", HEADING, 2).alias("title")
    ).withColumn("base", slug(F.col("title")))
    nth = F.row_number().over(Window.partitionBy("id", "base").orderBy("pos"))
    return rows.withColumn("n", nth).select(
        "id", "pos", "level", "title", F.when(F.col("n") > 1, F.concat_ws("-", "base", "n")).otherwise(F.col("base")).alias("anchor")
    )


def broken_tables(docs: DataFrame) -> DataFrame:
    """(id, pos): where a block of rows that open with a bar starts whose second row is no row of dashes."""
    rows = _lines(docs).withColumn("row", ~F.col("fenced") & F.startswith("line", F.lit("|")))
    order = Window.partitionBy("id").orderBy("pos")
    first = F.col("row") & ~F.coalesce(F.lag("row").over(order), F.lit(False))
    second = F.lead("row").over(order) & F.lead("line").over(order).rlike(DELIMITER)
    return rows.select("id", "pos", first.alias("first"), F.coalesce(second, F.lit(False)).alias("delimited")).where("first and not delimited").select("id", "pos")


def counted_table(counts: DataFrame, title: str, preferred: tuple[str, ...] = ()) -> DataFrame:
    """(markdown): a table of (value, n), preferred values first, then by number."""
    places = F.array_position(F.array(*map(F.lit, preferred)), F.col("value")) if preferred else F.lit(0)
    order = F.struct(F.when(places > 0, places).otherwise(1 << 30).alias("p"), (-F.col("n")).alias("m"), "value", "n")
    rows = counts.agg(F.array_sort(F.collect_list(order)).alias("r"))
    body = F.array_join(F.transform("r", lambda x: F.concat(F.lit("| "), x["value"], F.lit(" | "), F.format_number(x["n"], 0), F.lit(" |"))), "\n")
    return rows.select(F.concat(F.lit(f"| {title} | n |\n|---|---|\n"), body).alias("markdown"))


def spliced(text: Column, name: str, block: Column) -> Column:
    """Text with what stands between the marks of a live block replaced."""
    found = F.regexp_extract(text, rf"(?s)(<!-- live:{name} -->\n).*?(<!-- /live:{name} -->)", 0)
    fresh = F.concat(F.lit(f"<!-- live:{name} -->\n"), block, F.lit(f"\n<!-- /live:{name} -->"))
    return F.when(found != "", F.replace(text, found, fresh)).otherwise(text)


def exported(files: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, index, missing) of Markdown ``files`` (name, text) by a registry (name, id, group, description, place).

    documents: (id, document), a JSON text with title, outline, body and what the
    front matter says; index: (place, id, title, group, lines, sections) in the
    registry's order, index_document makes one text of it; missing: the names
    that have no file. A document's title is its first heading of the first
    level, else its name without the ending.
    """
    held = registry.join(files.select("name", "text"), "name")
    bare = strip_frontmatter(F.col("text"))
    body = held.select("id", bare.alias("text"))
    place = F.struct("pos", "level", F.col("title").alias("text"), "anchor")
    listed = outline(body).groupBy("id").agg(F.array_sort(F.collect_list(place)).alias("outline"))
    rows = held.withColumn("markdown", bare).withColumn("front", frontmatter(F.col("text"))).join(listed, "id", "left")
    rows = rows.withColumn("outline", F.coalesce("outline", F.array()))
    first = F.get(F.filter("outline", lambda x: x["level"] == 1), 0)["text"]
    rows = rows.withColumn("title", F.coalesce(first, F.regexp_replace("name", r"\.[^.]*$", "")))
    told = F.struct("id", "title", "group", "description", F.col("name").alias("source"), F.transform("outline", lambda x: F.struct(x["level"].alias("level"), x["text"].alias("text"), x["anchor"].alias("anchor"))).alias("outline"),
                    "markdown", F.try_element_at("front", F.lit("created")).alias("updated"), F.try_element_at("front", F.lit("status")).alias("status"))
    sections = F.transform(F.filter("outline", lambda x: x["level"] == 2), lambda x: x["text"])
    lines = F.size(F.split("markdown", "\n", -1))
    index = rows.select("place", "id", "title", "group", "description", F.col("name").alias("source"), lines.alias("lines"), sections.alias("sections"))
    missing = registry.join(files.select("name"), "name", "left_anti").select("name")
    return rows.select("id", F.to_json(told).alias("document")), index, missing


def index_pieces(index: DataFrame) -> DataFrame:
    """(part, nth, text): the index document in pieces, which in the order of part and nth are its text.

    How many documents there are (0), their groups by first appearance (1), what
    stands between (2), their entries in order (ENTRIES), and the end (4). No
    row holds more than one entry, so a registry may be of any size.
    """
    cols = [c for c in index.columns if c != "place"]
    entries = numbered(index, ["place", *cols], name="nth")
    groups = numbered(index.groupBy("group").agg(F.min("place").alias("place")), ["place", "group"], name="nth")
    comma = F.when(F.col("nth") > 0, ",").otherwise("")
    piece = lambda df, part, text, nth=F.lit(0).cast("long"): df.select(F.lit(part).alias("part"), nth.alias("nth"), text.alias("text"))
    quoted = F.substr(F.to_json(F.struct(F.array("group").alias("g"))), F.lit(7))
    total = index.agg(F.count(F.lit(1)).cast("string").alias("total"))
    one = total.select()
    return (
        piece(total, 0, F.concat(F.lit('{"total":'), "total", F.lit(',"groups":[')))
        .unionByName(piece(groups, 1, F.concat(comma, F.left(quoted, F.char_length(quoted) - 2)), F.col("nth")))
        .unionByName(piece(one, 2, F.lit('],"results":[')))
        .unionByName(piece(entries, ENTRIES, F.concat(comma, F.to_json(F.struct(*cols))), F.col("nth")))
        .unionByName(piece(one, 4, F.lit("]}")))
    )


def index_document(index: DataFrame) -> DataFrame:
    """(document): how many documents there are, their groups by first appearance, and their entries, in order.

    One text, so for a registry that fits into one; index_pieces has no such bound.
    """
    pieces = index_pieces(index).agg(F.array_sort(F.collect_list(F.struct("part", "nth", "text"))).alias("p"))
    return pieces.select(F.array_join(F.transform("p", lambda x: x["text"]), "").alias("document"))


def numbered_reports(reports: DataFrame) -> DataFrame:
    """Reports with their issue number, the first one being 1."""
    # One report a week: a thousand rows are twenty years, so one task orders them.
    return reports.withColumn("issue", F.row_number().over(Window.orderBy("period_start")))


def page_metrics(text: Column) -> Column:
    """(cjk, items, blocked) of a fetched page: visible Chinese length, feed items, signs of a wall."""
    shown = F.regexp_replace(text, r"(?is)<(script|style|noscript).*?</\1>", " ")
    lower, visible = F.lower(text), F.regexp_replace(shown, r"(?s)<[^>]+>", " ")
    walls = F.lit(False)
    for sign in ("subscribe to continue", "captcha", "access denied", "请登录", "付费"):
        walls = walls | F.contains(lower, F.lit(sign))
    return F.struct(
        F.regexp_count(visible, F.lit(r"[\x{4E00}-\x{9FFF}]")).alias("cjk"),
        F.regexp_count(lower, F.lit(r"<(?:item|entry)[\s>]")).alias("items"),
        walls.alias("blocked"),
    )


def feed_titles(text: Column, n: int) -> Column:
    """The first titles of a feed after its own."""
    return F.slice(F.regexp_extract_all(text, F.lit(r"(?is)<title[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</title>"), F.lit(1)), 2, n)
