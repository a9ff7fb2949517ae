"""Scalar functions against values worked out by hand, and their properties."""

import hashlib

from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.functions import url as U
from evidex.functions import vector as V
from evidex.functions.simhash import hamming, simhash

URLS = [
    "HTTP://User@Example.COM:8080/a/b/?b=2&a=1&UTM_Source=x#frag", "https://x.com/Acct/1", "https://x.com/", "https://a.b.com.cn/z?a=&c=3&c=1",
    "https://www.example.org", "https://m.news.example.org/p//?q=a+b%20c&t=%E4%BD%A0*~", "http://[bad", "https://stock.site.co.uk/x?ref=1&from=2",
    "plain/path", "https://e.com/?x=1&&y", "",
]


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.out for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_canonical_url(spark):
    want = [
        "http://user@example.com:8080/a/b?a=1&b=2", "https://x.com/Acct/1", "https://x.com/", "https://a.b.com.cn/z?c=1&c=3",
        "https://www.example.org/", "https://m.news.example.org/p?q=a+b+c&t=%E4%BD%A0%2A~", "http://[bad", "https://stock.site.co.uk/x", "plain/path", "https://e.com/?x=1",
    ]
    got = column(spark, URLS[:-1], U.canonical_url)
    assert got == want
    assert column(spark, got, U.canonical_url) == got  # once more changes nothing
    orders = ["https://e.com/?b=2&a=1", "https://e.com/?a=1&b=2&utm_medium=z", "https://E.com?a=1&b=2#x"]
    assert set(column(spark, orders, U.canonical_url)) == {"https://e.com/?a=1&b=2"}


def test_org_key(spark):
    urls = [u for u in URLS if u != "http://[bad"] + [None, "https://t.me/chan/9"]
    keys = ["example.com", "x.com/acct", "x.com", "b.com.cn", "example.org", "example.org", "site.co.uk", "plain/path", "e.com", "", "", "t.me/chan"]
    assert column(spark, urls, U.org_key) == [f"unregistered:{k}" for k in keys]


def test_titles(spark):
    titles = ["天猫上线新品_凤凰网", "A&amp;B 报告 | 新浪财经_新浪网", "legit X-ray", "！？。", "Plain Title", "a ｜ b – c", "", "é_x"]
    assert column(spark, titles, T.normalize_title) == ["天猫上线新品", "ab报告", "legitx", "", "plaintitle", "a", "", "é"]
    bare = ["天猫上线新品", "A & B 报告", "Plain Title"]
    assert column(spark, [f"{t}_某网站" for t in bare], T.normalize_title) == column(spark, bare, T.normalize_title)


def test_simhash_and_hamming(spark):
    texts = ["", "the quick brown fox", "这是一个测试文本呀", "mixed 中文 and english words words", "ab", "one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.simhash % (1 << 64) for r in simhash(rows, "i", "t").collect()}
    # A text of one token has the low half of its MD5, a token that outweighs all others decides every bit.
    assert got[0] == got[4] == 0
    low = lambda t: int(hashlib.md5(t.encode()).hexdigest()[16:], 16)
    assert got[5] == low("one")
    more = ["one one one two three", "two one three one one", "one two"]
    rows = spark.createDataFrame(list(enumerate(more)), "i int, t string")
    again = {r.i: r.simhash % (1 << 64) for r in simhash(rows, "i", "t").collect()}
    assert again[0] == again[1] == low("one") and again[2] == low("one") & low("two")
    pairs = spark.createDataFrame([(5, 6), (None, 1)], "a long, b long")
    assert [r.d for r in pairs.select(hamming(F.col("a"), F.col("b")).alias("d")).collect()] == [2, 64]


def test_strip_html(spark):
    pages = ["&amp;lt;b&amp;gt;x &amp; y", "<header><nav>a</nav>b</header>c<br>d", "<script>var a='<p>'</script> t  e\n", "<p>open", "a &lt;i&gt;b"]
    assert column(spark, pages, T.strip_html) == ["x & y", "c d", "t e", "open", "a b"]


def test_entities_that_a_semicolon_ends(spark):
    pages = ["a&amp b &amp;amp; &quot &#65; &#x42 &none; &amp;copy;<i>", None]
    assert column(spark, pages, lambda c: T.strip_html(c, T.unescape_ended)) == ["a&amp b & &quot A &#x42 &none; ©", None]
    assert column(spark, pages, T.strip_html) == ['a& b & " A B &none; ©', None]


def test_times(spark):
    raw = ["Tue, 01 Sep 2026 10:00:00 +0800", "2026-09-01T10:00:00+08:00", "2026-09-01T10:00:00.25Z", "2026-09-01", "于2026/9/1发布", "2026-13-01", None, "x"]
    got = column(spark, raw, lambda c: T.parse_time(c, True))
    assert [g.time_source for g in got] == ["exact", "exact", "exact", "exact", "parsed", None, None, None]
    assert [str(g["at"])[:19] for g in got[:5]] == ["2026-09-01 02:00:00", "2026-09-01 02:00:00", "2026-09-01 10:00:00", "2026-09-01 00:00:00", "2026-09-01 00:00:00"]


def test_tokens_and_charsets(spark):
    assert column(spark, ["中文字 Some ab words Words", ""], T.sliding_tokens) == [["中文", "文字", "some", "words"], []]
    data = ["中文".encode("gbk"), "中文".encode(), b"\xff\xfeab", None]
    assert column(spark, data, T.decode_charset, "binary") == ["中文", "中文", "ab", None]


def test_answers_are_found_in_text(spark):
    raw = ['{"a": 1}', '```json\n[{"i": 0}]\n```', 'so: {"a": {"b": 2}} ok', "none", 'told:\n```json\n{"a": 3}\n``` and more']
    got = column(spark, raw, lambda c: F.to_json(T.json_answer(c)))
    assert got == ['{"a":1}', '[{"i":0}]', '{"a":{"b":2}}', None, '{"a":3}']


def test_vectors(spark):
    vectors = [[3.0, 4.0], [0.0, 0.0], [-1.0, 0.5]]
    q = column(spark, vectors, V.quantise, "array<double>")
    assert q == [[76, 102], [0, 0], [-114, 57]]
    assert column(spark, vectors, lambda c: V.from_base64(V.to_base64(V.quantise(c))), "array<double>") == q
    assert abs(column(spark, vectors, lambda c: V.cosine(c, F.array(F.lit(4.0), F.lit(3.0))), "array<double>")[0] - 0.96) < 1e-9
