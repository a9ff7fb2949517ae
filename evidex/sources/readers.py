"""Captured pages, feeds and answers as item rows; parsing is column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.patterns import pattern_hits
from ..functions.text import decode_charset, parse_time, present, strip_html
from ..functions.url import authority
from ..functions.url import path as url_path

ITEM = "url string, title string, content string, published_at timestamp, time_source string"


def captured(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): saved responses, decoded by the charset ladder; at most 600 kB of each."""
    data = spark.read.format("binaryFile").load(path)
    return data.select("path", decode_charset(F.substring("content", 1, 600_000)).alias("text"))


#: The elements of a feed, what wraps text, and how a link is written.
FEED_ITEM, FEED_ENTRY = r"(?is)<item[\s>].*?</item>", r"(?is)<entry[\s>].*?</entry>"
WRAPPED = r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$"
#: What the title of a refused page says; a longer number that holds 403 is no refusal.
REFUSED = r"(?<![0-9])403(?![0-9])|Forbidden"
#: Characters that are kept of a body and a title.
CONTENT_CHARS, TITLE_CHARS = 6000, 300


def tag(block: Column, *names: str) -> Column:
    """The first of a list of candidates that says something: for each name the element's text, then its href."""
    text = lambda name: F.regexp_replace(F.regexp_extract(block, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1), WRAPPED, "$1")
    href = lambda name: F.regexp_extract(block, rf"(?is)<{name}\s[^>]*href=[\"']([^\"']+)", 1)
    candidates = F.array(*(F.trim(take(name)) for name in names for take in (text, href)))
    return F.get(F.filter(candidates, lambda x: x != ""), 0)


def parse_feed(pages: DataFrame, content_chars: int = CONTENT_CHARS) -> DataFrame:
    """Items of RSS and Atom texts (path, text); without a title or a web link they are left out."""
    items = F.regexp_extract_all("text", F.lit(FEED_ITEM), F.lit(0))
    entries = F.regexp_extract_all("text", F.lit(FEED_ENTRY), F.lit(0))
    blocks = pages.select("path", F.posexplode(F.when(F.size(items) > 0, items).otherwise(entries)).alias("place", "block"))
    block = F.col("block")
    at = parse_time(tag(block, "pubDate", "published", "updated", "dc:date"), exact=True)
    rows = blocks.select(
        "path", "place", tag(block, "link", "guid").alias("url"), F.left(strip_html(tag(block, "title")), F.lit(TITLE_CHARS)).alias("title"),
        F.left(strip_html(F.coalesce(tag(block, "content:encoded", "description", "summary", "content"), F.lit(""))), F.lit(content_chars)).alias("content"), at.alias("at"),
    )
    return rows.where((F.coalesce("title", F.lit("")) != "") & F.startswith("url", F.lit("http"))).select(
        "path", "place", "url", "title", "content", F.col("at.at").alias("published_at"), F.col("at.time_source").alias("time_source")
    )


def absolute(href: Column, base: Column) -> Column:
    """A link against the page that holds it."""
    scheme = F.substring_index(base, "://", 1)
    root = F.concat(scheme, F.lit("://"), authority(base))
    folder = F.regexp_extract(base, r"^([a-z]+://[^?#]*/)", 1)
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .otherwise(F.concat(F.when(F.char_length(folder) > F.char_length(root), folder).otherwise(F.concat(root, F.lit("/"))), href))
    )


#: Paths of menus and sections, paths of articles, and links in a page and in a rendered list.
NAVIGATION = (
    "about", "contact", "career", "careers", "job", "jobs", "privacy", "terms", "legal", "sitemap", "search", "login", "register", "rss", "feed",
    "tag", "tags", "category", "categories", "topic", "topics", "author", "channel", "column", "list", "index", "home", "investor-relations", "ir",
)
ARTICLE_PATH = r"(/20\d{2}[-/]\d{1,2}|/\d{5,}|[-_/]\d{6,})"
ANCHOR = r"(?is)<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
RENDERED_LINK = r"- \[([^\]]{4,90})\]\((https?://[^)]+)\)"
BARE_LINK = r"https?://[^\s<>\"'()\[\]]+"
DATE_IN_PATH = r"/(20\d{2})(\d{2})(\d{2})/"
#: Articles of a list that are read, and rendered ones; Chinese characters that a rendered article has at least.
LISTED, RENDERED, LEAST_CJK = 25, 8, 120


def listing_links(pages: DataFrame, most: int = LISTED) -> DataFrame:
    """Article links of list pages (url, html, domains, and pattern or null): on the source's domains, each address once.

    The text is a headline: 10 to 120 characters with five Chinese ones or eight words.
    """
    pattern = F.coalesce("pattern", F.lit(ARTICLE_PATH))
    anchors = pages.select("url", "domains", pattern.alias("pattern"), F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))).alias("place", "a"))
    rows = anchors.select(
        "url", "domains", "pattern", "place", absolute(F.regexp_extract("a", ANCHOR, 1), F.col("url")).alias("link"), strip_html(F.regexp_extract("a", ANCHOR, 2)).alias("title")
    )
    words = F.size(F.split("title", " "))
    cjk = F.regexp_count("title", F.lit(r"[\x{4E00}-\x{9FFF}]"))
    site, folder = authority(F.col("link")), url_path(F.col("link"))
    good = rows.where(
        F.char_length("title").between(10, 120) & ((cjk >= 5) | (words >= 8)) & F.col("link").rlike("^https?://")
        & F.exists("domains", lambda d: F.contains(site, d)) & F.regexp_like(folder, F.col("pattern")) & ~folder.rlike(rf"(?i)/({'|'.join(NAVIGATION)})(/|$|\.)")
    )
    first = good.groupBy("url", "link").agg(F.min_by("title", "place").alias("title"), F.min("place").alias("place"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("url").orderBy("place"))).where(F.col("rank") <= most)


def rendered_links(pages: DataFrame) -> DataFrame:
    """(source_id, place, url, title): links of rendered list pages (source_id, text, pattern) that match the source's pattern.

    Pairs of title and address; where a page has none that match, addresses alone. Each address once, at its first place.
    """
    clean = lambda u: F.regexp_replace(u, r"[.,;]+$", "")
    pairs = F.transform(F.regexp_extract_all("text", F.lit(RENDERED_LINK), F.lit(0)), lambda m: F.named_struct(F.lit("url"), clean(F.regexp_extract(m, RENDERED_LINK, 2)), F.lit("title"), F.regexp_extract(m, RENDERED_LINK, 1)))
    bare = F.transform(F.regexp_extract_all("text", F.lit(BARE_LINK), F.lit(0)), lambda u: F.named_struct(F.lit("url"), clean(u), F.lit("title"), F.lit("")))
    wanted = lambda links: F.filter(links, lambda x: F.regexp_like(x["url"], F.col("pattern")))
    named = wanted(pairs)
    found = pages.select("source_id", F.posexplode(F.when(F.size(named) > 0, named).otherwise(wanted(bare))).alias("place", "l"))
    first = found.groupBy("source_id", "l.url").agg(F.min(F.struct("place", "l.title")).alias("f"))
    return first.select("source_id", "f.place", "url", strip_html(F.col("f.title")).alias("title"))


def listing_only(links: DataFrame, most: int = LISTED) -> DataFrame:
    """Items of a source whose articles can't be read: titles, and dates as the address gives them."""
    day = F.regexp_extract("url", DATE_IN_PATH, 0)
    at = F.try_to_timestamp(F.concat_ws("-", *(F.regexp_extract("url", DATE_IN_PATH, k) for k in (1, 2, 3))), F.lit("yyyy-MM-dd"))
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("place"))
    rows = links.where("title <> ''").withColumn("nth", nth).where(F.col("nth") <= most)
    published = F.when(day != "", at)
    return rows.select("source_id", "url", F.left("title", F.lit(TITLE_CHARS)).alias("title"), published.alias("published_at"), F.when(published.isNotNull(), "parsed").alias("time_source"))


def rendered_plan(links: DataFrame, terms: tuple[str, ...], most: int = RENDERED) -> DataFrame:
    """``links`` with ``prefilter_drop`` (no term in the title) and ``read``: the first of the others of each source.

    Without terms, or for a source without titles, the first links are read.
    """
    marked = title_prefilter(links, terms)
    marked = marked.withColumn("prefilter_drop", F.when(F.col("title") != "", F.col("prefilter_drop")))
    titled = F.max(F.col("title") != "").over(Window.partitionBy("source_id"))
    open_ones = marked.withColumn("_skip", F.col("prefilter_drop").isNotNull() | (titled & (F.col("title") == "") & F.lit(bool(terms))))
    nth = F.sum((~F.col("_skip")).cast("int")).over(Window.partitionBy("source_id").orderBy("place"))
    return open_ones.withColumn("read", ~F.col("_skip") & (nth <= most)).drop("_skip")


def rendered_articles(pages: DataFrame, content_chars: int = CONTENT_CHARS) -> DataFrame:
    """Items of rendered article pages (url, text): title, text without pictures and link marks, enough Chinese."""
    title = F.regexp_extract("text", r"(?m)^Title: (.+)$", 1)
    body = F.substring_index("text", "Markdown Content:", -1)
    for pattern, left in ((r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", ""), (r"\s+", " ")):
        body = F.regexp_replace(body, pattern, left)
    rows = pages.select("url", F.trim(title).alias("title"), F.trim(body).alias("content"), parse_time(present(F.regexp_extract("text", "Published Time: (.+)", 1)), exact=True).alias("at"))
    fine = (F.col("title") != "") & ~F.col("title").rlike(REFUSED) & (F.regexp_count("content", F.lit(r"[\x{4E00}-\x{9FFF}]")) >= LEAST_CJK)
    return rows.where(fine).select("url", F.left("title", F.lit(TITLE_CHARS)).alias("title"), F.left("content", F.lit(content_chars)).alias("content"), F.col("at.at").alias("published_at"), F.col("at.time_source").alias("time_source"))


def collected(rows: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, failures): what the channels gave, and a row for each source that failed or gave nothing.

    ``rows``: source_id and item columns; ``errors``: source_id, status, one for each source that was asked.
    """
    counted = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    asked = errors.join(counted, "source_id", "left")
    why = F.when(F.col("status") != "200", F.concat(F.lit("HTTP "), F.col("status"))).when(F.coalesce("n", F.lit(0)) == 0, "no items")
    return rows, asked.select("source_id", why.alias("reason")).where("reason is not null")


def discovered_feeds(pages: DataFrame) -> DataFrame:
    """(url, feed): feeds that pages (url, html) announce."""
    links = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<link\s[^>]*>"), F.lit(0))).alias("l"))
    feeds = links.where(F.col("l").rlike(r"(?i)rel=[\"']alternate") & F.col("l").rlike(r"(?i)type=[\"']application/(?:rss|atom)\+xml"))
    return feeds.select("url", absolute(F.regexp_extract("l", r"(?i)href=[\"']([^\"']+)", 1), F.col("url")).alias("feed")).distinct()


def first_mirror(rows: DataFrame) -> DataFrame:
    """Of mirrors (source_id, mirror, ...) the first that gave a row, with all its rows."""
    best = rows.groupBy("source_id").agg(F.min("mirror").alias("mirror"))
    return rows.join(best, ["source_id", "mirror"], "left_semi")


def discovery_items(answers: DataFrame, first_party_hints: tuple[str, ...]) -> DataFrame:
    """Items of a discovery API (url, title, publisher, published): one for each address, class by publisher."""
    hinted = F.lit(False)
    for hint in first_party_hints:
        hinted = hinted | F.contains(F.col("publisher"), F.lit(hint))
    once = answers.groupBy("url").agg(F.min_by(F.struct(*answers.columns), F.struct("published", "title")).alias("r")).select("r.*")
    return once.withColumn("source_class", F.when(hinted, "A").otherwise("C"))


def title_prefilter(rows: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """Rows marked, not dropped, where the title holds none of the terms."""
    from ..functions.text import contains_any

    miss = F.lit(False) if not terms else ~contains_any(F.coalesce("title", F.lit("")), terms)
    return rows.withColumn("prefilter_drop", F.when(miss, "title"))


def domain_index(sources: DataFrame) -> DataFrame:
    """(domain, source_id, place): the later of two sources that claim a domain has it."""
    rows = sources.select(F.explode("domains").alias("domain"), F.col("id").alias("source_id"), "place")
    return rows.groupBy(F.lower("domain").alias("domain")).agg(F.max_by("source_id", "place").alias("source_id"), F.max("place").alias("place"))


def attribute(items: DataFrame, key: str, url: str, index: DataFrame) -> DataFrame:
    """(key, source_id): the source of the host itself, else the first source whose domain the host ends in.

    The endings of a host are few, so the suffix match is an equi-join.
    """
    labels = F.split(F.substring_index(F.substring_index(authority(F.col(url)), "@", -1), ":", 1), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = items.select(key, F.posexplode(ends).alias("cut", "domain"))
    hits = hosts.join(index, "domain").groupBy(key).agg(F.min_by("source_id", F.struct(F.col("cut") > 0, "place")).alias("source_id"))
    return items.select(key).join(hits, key, "left")


def original_source(items: DataFrame, key: str, text: str, patterns: DataFrame) -> DataFrame:
    """(key, original_source): the first registered source named in the first 600 characters.

    ``patterns`` (pattern, source_id, place) come from the registry, however large it is.
    """
    heads = items.select(key, F.left(F.col(text), F.lit(600)).alias("_head"))
    hits = pattern_hits(heads, key, "_head", patterns).join(patterns, "pattern")
    best = hits.groupBy(key).agg(F.min_by("source_id", "place").alias("original_source"))
    return items.select(key).join(best, key, "left")


def effective_class(own: Column, attributed: Column) -> Column:
    """The better of a row's own class and that of the source it names; letters order classes."""
    return F.least(F.coalesce(attributed, own), own)


def union_channels(channels: dict[str, DataFrame]) -> DataFrame:
    """All channels in one frame, each row with its channel and a total order ``seq``.

    Rows are sorted in ranges and numbered by range, so ``seq`` rises with (channel, address, title) but has gaps.
    """
    out = None
    for rank, (name, rows) in enumerate(channels.items()):
        tagged = rows.withColumn("channel", F.lit(name)).withColumn("_rank", F.lit(rank))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    ordered = out.repartitionByRange("_rank", "url", "title").sortWithinPartitions("_rank", "url", "title")
    return ordered.withColumn("seq", F.monotonically_increasing_id() + 1).drop("_rank")


def fetch(url: str, timeout: float = 20, most: int = 600_000) -> tuple[str, bytes]:
    """(status, body) of one address; an error's name is its status."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"User-Agent": "evidex"}), timeout=timeout) as answer:
            return str(getattr(answer, "status", None) or 200), answer.read(most)
    except HTTPError as error:
        return str(error.code), b""
    except Exception as error:
        return type(error).__name__, b""


class FetchReader(DataSourceReader):
    """Fetches addresses, one partition each; an error is a row with its name, never a failed task."""

    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.timeout, self.most = float(options.get("timeout", 20)), int(options.get("maxBytes", 600_000))

    def partitions(self):
        return [InputPartition(u) for u in self.urls] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is not None:
            yield partition.value, *fetch(partition.value, self.timeout, self.most)


class FetchSource(DataSource):
    """spark.read.format("evidex_fetch").option("urls", ...)"""

    @classmethod
    def name(cls):
        return "evidex_fetch"

    def schema(self):
        return "url string, status string, body binary"

    def reader(self, schema):
        return FetchReader(self.options)
