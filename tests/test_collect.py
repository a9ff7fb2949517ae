"""Channels from addresses to items, over local files, and the small functions of reading and writing."""

import json

import pytest
from pyspark.sql import functions as F

from evidex.functions import url
from evidex.operators import documents, reports, tables
from evidex.plugins import judge
from evidex.sources import collect, readers

FEED = """<rss><channel><title>Feed</title>{}</channel></rss>"""
ITEM = "<item><title>{0}</title><link>https://n.example.com/{0}</link><pubDate>Tue, 01 Sep 2026 10:00:00 GMT</pubDate><description>Body of {0}</description></item>"
PAGE = "<a href='/2026/09/story-one'>A headline that has more than eight words in it today</a><a href='/about/2026/09'>A headline that has more than eight words in it today</a>"


@pytest.fixture
def site(tmp_path):
    (tmp_path / "a.xml").write_text(FEED.format(ITEM.format("one") + ITEM.format("two")))
    (tmp_path / "cn.xml").write_bytes(FEED.format(ITEM.format("漢字")).encode("gbk"))
    (tmp_path / "empty.xml").write_text("")
    (tmp_path / "second").mkdir()
    (tmp_path / "second/r.xml").write_text(FEED.format(ITEM.format("three")))
    (tmp_path / "first").mkdir()
    (tmp_path / "first/none.xml").write_text(FEED.format(""))
    return f"file://{tmp_path}"


def test_sources_become_items(spark, site):
    rows = [
        ("s1", "rss", f"{site}/a.xml", True), ("s2", "rss", f"{site}/cn.xml", True), ("s3", "rss", f"{site}/missing.xml", True), ("s4", "rss", f"{site}/empty.xml", True),
        ("s5", "rsshub", "/r.xml", True), ("s6", "rsshub", "/none.xml", True), ("s7", "rss", f"{site}/a.xml", False), ("s8", "exa", "q", True), ("s9", "rss", None, True),
    ]
    sources = spark.createDataFrame([(*r, ["example.com"]) for r in rows], "id string, channel string, channel_ref string, active boolean, domains array<string>")
    items, failures = collect.collect(sources, [f"{site}/first", f"{site}/second/"])
    got = {(r.source_id, r.channel, r.title) for r in items.collect()}
    assert got == {("s1", "rss", "one"), ("s1", "rss", "two"), ("s2", "rss", "漢字"), ("s5", "rsshub", "three")}
    assert {r.source_id for r in failures.collect()} == {"s3", "s4", "s6"}
    assert items.select("seq").distinct().count() == 4 and items.where("published_at is null").count() == 0


def test_pages_become_items(spark):
    sources = spark.createDataFrame([("d", "direct", "https://n.example.com/news", ["n.example.com"])], "id string, channel string, channel_ref string, domains array<string>")
    row = ("d", "direct", 0, "https://n.example.com/news", "200", bytearray(PAGE.encode()))
    items, failures = collect.items_of(sources, spark.createDataFrame([row], collect.RESPONSE))
    assert [(r.url, r.channel) for r in items.collect()] == [("https://n.example.com/2026/09/story-one", "direct")] and failures.count() == 0
    _, failures = collect.items_of(sources, spark.createDataFrame([(*row[:4], "503", None)], collect.RESPONSE))
    assert [tuple(r) for r in failures.collect()] == [("d", "HTTP 503")]


def test_fetch_source(spark, site):
    spark.dataSource.register(readers.FetchSource)
    got = {r.url.rsplit("/", 1)[1]: (r.status, len(r.body)) for r in spark.read.format("evidex_fetch").option("urls", f"{site}/a.xml {site}/missing.xml").option("maxBytes", 50).load().collect()}
    assert got == {"a.xml": ("200", 50), "missing.xml": ("URLError", 0)}
    assert spark.read.format("evidex_fetch").load().count() == 0


def test_feeds_that_pages_announce(spark):
    html = "<link rel='alternate' type='application/rss+xml' href='/feed.xml'><link rel=\"alternate\" type=\"application/atom+xml\" href=\"https://o.example.org/a\"><link rel='stylesheet' href='x'>"
    rows = spark.createDataFrame([("https://n.example.com/x/y", html), ("https://n.example.com", None)], "url string, html string")
    assert {r.feed for r in readers.discovered_feeds(rows).collect()} == {"https://n.example.com/feed.xml", "https://o.example.org/a"}
    feed = spark.createDataFrame([(FEED.format(ITEM.format("one") + "<item><title><![CDATA[two]]></title></item>"),)], "t string")
    assert feed.select(documents.feed_titles(F.col("t"), 5)).first()[0] == ["one", "two"]


def test_small_functions(spark, tmp_path):
    assert tables.dataset_path("/x/", "b") == "/x/b" and tables.dataset_path("/x") == "/x/main"
    more = tables.add_missing_columns(spark.createDataFrame([("a", "b")], "from_event string, to_event string"), "edges")
    assert more.columns == ["from_event", "to_event", "relation", "basis", "created_by"] and more.first().basis is None
    one = spark.range(1)
    hosts = ["https://www.n.example.com:8080/x", "https://WWW.n.example.com", "n", ""]
    assert [one.select(url.display_host(F.lit(h))).first()[0] for h in hosts][0].startswith("n.example.com")
    assert one.select(judge.token_cost(F.lit(1_500_000), F.lit(2_000_000))).first()[0] == 9.0
    history = spark.createDataFrame([("2026-01-05", "a", 1), ("2026-01-19", "c", 3), ("2026-01-12", "b", 2)], "period_start string, body string, n int")
    before = {r.body: (r.prev_body, r.prev_n) for r in reports.previous_report(history, ["body", "n"]).collect()}
    assert before == {"a": (None, None), "b": ("a", 1), "c": ("b", 2)}
    sizes = reports.write_snapshot({"events": spark.createDataFrame([('{"a": 1}',)], "document string"), "list": history}, str(tmp_path))
    assert sizes["events"] == 8 and json.loads(spark.read.text(f"{tmp_path}/events").first()[0]) == {"a": 1} and spark.read.json(f"{tmp_path}/list").count() == 3


def test_a_number_that_holds_403_is_no_refusal(spark):
    titles = ["Model 2403 is out", "4031 stores", "403 Forbidden", "Error 403", "HTTP403", "Forbidden"]
    pages = spark.createDataFrame([(t, f"Title: {t}\nMarkdown Content:\n" + "中" * 200) for t in titles], "url string, text string")
    assert {r.title for r in readers.rendered_articles(pages).collect()} == set(titles[:2])
