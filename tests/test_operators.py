"""Stage operators: greedy equality, verification, merging, relations, review, sources, streaming."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from evidex.config import EngineConfig
from evidex.operators import dedup, events, reports, review, search, similarity, tables, verify
from evidex.plugins import embedder, judge
from evidex.sources import readers
from evidex.streaming.incremental import run_available

START = dt.datetime(2024, 1, 1)


def ntz(day):
    return F.lit(day).cast("timestamp_ntz")


def random_items(n, seed):
    rnd = random.Random(seed)
    words = "alpha beta gamma delta omega sigma kappa lambda theta".split()
    bodies = [" ".join(rnd.choice(words) for _ in range(40)) for _ in range(n // 3)]
    out = []
    for k in range(n):
        body = rnd.choice(bodies).split()
        body[rnd.randrange(40)] = rnd.choice(words)
        name = rnd.choice([f"Title {rnd.randrange(n)}", f"Same story {rnd.randrange(5)}_Site{k}", "", "！"])
        at = dt.datetime(2023, 12, 25) + dt.timedelta(days=rnd.randrange(20))
        out.append((f"https://s{rnd.randrange(3)}.example.com/{rnd.randrange(n)}?utm_source={k}", name, " ".join(body), at, rnd.choice(["exact", "inferred"])))
    return out


def greedy(spark, rows, known, terms):
    """The reason of each row, one after the other, by the engine's own columns of it."""
    from evidex.functions.simhash import simhash_value
    from evidex.functions.text import normalize_title
    from evidex.functions.url import canonical_url

    frame = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate([*known, *rows])], "i long, url string, name string, body string")
    seen = frame.select("i", canonical_url(F.col("url")).alias("u"), normalize_title(F.col("name")).alias("t"), simhash_value(F.concat_ws(" ", "name", "body")).alias("p")).orderBy("i").collect()
    accepted, out = list(seen[: len(known)]), []
    for row, (_, name, body, at, source) in zip(seen[len(known) :], rows):
        near = any(((row.p ^ a.p) % (1 << 64)).bit_count() <= 3 for a in accepted)
        checks = {
            "no_title": not name.strip(),
            "duplicate_url": row.u in {a.u for a in accepted},
            "stale": source != "inferred" and at < START,
            "off_topic": bool(terms) and not any(t in f"{name} {body}" for t in terms),
            "syndication": near or bool(row.t) and row.t in {a.t for a in accepted},
        }
        out.append(next((reason for reason, hit in checks.items() if hit), None))
        if out[-1] is None:
            accepted.append(row)
    return out


RAW = "seq long, url string, title string, content string, published_at timestamp_ntz, time_source string, prefilter_drop string"


@pytest.mark.parametrize("seed", [1, 2])
def test_layered_dedup_is_the_greedy_one(spark, seed):
    rows = random_items(60, seed)
    config = EngineConfig(ai_terms=("alpha", "omega"), industry_terms=("a",))
    raw = spark.createDataFrame([(i, *r, None) for i, r in enumerate(rows[20:])], RAW)
    keep = lambda df: df.checkpoint()
    ready = dedup.prepare(raw, config, ntz("2024-01-01"))
    old = spark.createDataFrame([(i - 100, *r, None) for i, r in enumerate(rows[:20])], RAW)
    known = dedup.prepare(old, config, ntz("2024-01-01")).select("seq", "url_canonical", "title_norm", "simhash")
    got = {r.seq: r.reason for r in dedup.layered_dedup(keep(ready), known, 3, keep).collect()}
    want = greedy(spark, rows[20:], rows[:20], ("alpha", "omega"))
    assert got == dict(enumerate(want))


def test_funnel_adds_up(spark):
    decided = spark.createDataFrame([(1, None), (2, "stale"), (3, "stale")], "seq long, reason string")
    assert {r.reason: r.n for r in dedup.funnel(decided).collect()} == {"accepted": 1, "stale": 2}


@pytest.mark.parametrize("threshold", [0, 1, 3, 5])
def test_hamming_pairs(spark, threshold):
    rnd = random.Random(threshold)
    base = [rnd.getrandbits(64) for _ in range(15)]
    prints = {b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 6))) for b in base for _ in range(6)}
    signed = lambda p: p - (p >> 63 << 64)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "simhash long")
    got, *wider = (sorted((r.a, r.b, r.distance) for r in similarity.hamming_pairs(frame, "simhash", threshold, shared).collect()) for shared in (None, 2, 3))
    want = sorted((signed(a), signed(b), (a ^ b).bit_count()) for a in prints for b in prints if signed(a) < signed(b) and (a ^ b).bit_count() <= threshold)
    assert got == want and wider == [want, want]


def test_jaccard_pairs(spark):
    rnd = random.Random(3)
    sets = {i: {f"w{rnd.randrange(30)}" for _ in range(rnd.randint(1, 9))} for i in range(80)}
    frame = spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "id long, s array<string>")
    got = {(r.a, r.b) for r in similarity.jaccard_pairs(frame, "id", "s", 0.34).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.34}


def test_jaccard_pairs_of_equal_and_of_common_sets(spark, monkeypatch):
    """Against all pairs, with few members in a block, with ids of both kinds."""
    monkeypatch.setattr(similarity, "SET_BLOCK", 7)
    rnd = random.Random(5)
    pool = [[f"w{min(rnd.randrange(25), rnd.randrange(25))}" for _ in range(rnd.randint(0, 7))] for _ in range(60)]
    sets = {i: rnd.choice(pool) for i in range(150)} | {150 + i: ["w0", None, f"x{i}", "w0"] for i in range(30)} | {180: None}
    bare = {i: {w for w in s or () if w} for i, s in sets.items()}
    for least in (0.2, 0.5, 0.9):
        want = {(a, b): len(bare[a] & bare[b]) / len(bare[a] | bare[b]) for a in sets for b in sets if a < b and bare[a] & bare[b]}
        want = {k: v for k, v in want.items() if v >= least}
        for kind, name in (("long", int), ("string", "{:03d}".format)):
            frame = spark.createDataFrame([(name(i), s) for i, s in sets.items()], f"id {kind}, s array<string>")
            got = [((int(r.a), int(r.b)), r.jaccard) for r in similarity.jaccard_pairs(frame, "id", "s", least).collect()]
            assert dict(got) == want and len(got) == len(want)


def test_a_common_token_makes_few_candidates():
    """Sets of eight tokens that share the commonest alone, which is last in each, are not held against each other."""
    import numpy as np

    n = 300
    rows = np.concatenate([np.arange(7 * n).reshape(n, 7), np.full((n, 1), 7 * n)], axis=1)
    given = (np.full(n, 8), np.full(n, 7), rows)
    seen, all_at_once = [], similarity._candidates
    similarity._candidates = lambda *x: (seen.append(len(c[0])) or c for c in all_at_once(*x))
    try:
        assert sum(len(a) for a, _, _ in similarity._met(7 * n, True, given, given, 0.2)) == 0 and sum(seen) == 0
    finally:
        similarity._candidates = all_at_once


def test_verify_rules(spark):
    items = spark.createDataFrame(
        [("e1", "o1", True, "A", 2, dt.datetime(2024, 1, 30)), ("e1", "o2", False, "B", 1, dt.datetime(2024, 1, 2)), ("e1", "o3", False, None, None, None),
         ("e2", "o1", True, "B", 0, dt.datetime(2024, 1, 5)), ("e3", "o1", False, "C", 3, dt.datetime(2024, 1, 5))],
        "event_id string, org string, affiliated boolean, effective_class string, stage_rank int, discovered_at timestamp_ntz",
    )
    base = spark.createDataFrame(
        [("e1", "watching", dt.date(2024, 1, 10), dt.datetime(2024, 1, 2)), ("e2", None, dt.date(2023, 6, 1), dt.datetime(2024, 1, 30)),
         ("e3", "none", None, dt.datetime(2024, 1, 5)), ("e4", "none", None, None)],
        "id string, review_state string, event_date date, first_seen_at timestamp_ntz",
    )
    got = {r.id: r for r in verify.verify(base, items, ntz("2024-01-01"), ntz("2024-01-24")).collect()}
    assert got["e1"].confidence == "官方确认·多源印证" and got["e1"].stage == "试点探索" and got["e1"].status == "延续" and got["e1"].review_state == "watching"
    assert got["e2"].confidence == "单源待确认" and got["e2"].independent_orgs == 0 and got["e2"].status == "旧闻/背景" and got["e2"].review_state == "pending"
    assert got["e3"].stage == "规模化应用" and got["e3"].status == "旧闻/背景" and got["e4"].confidence is None


def test_merge_moves_everything(spark):
    evs = spark.createDataFrame([("a", dt.date(2024, 1, 5)), ("b", dt.date(2024, 1, 2)), ("c", None)], "id string, event_date date")
    items = spark.createDataFrame([("i1", "a"), ("i2", "b"), ("i3", "c")], "id string, event_id string")
    edges = spark.createDataFrame([("a", "b"), ("c", "a")], "from_event string, to_event string")
    rejects = spark.createDataFrame([("merge_cross", "b"), ("merge", "b")], "stage string, merged_into string")
    merges = spark.createDataFrame([("b", "a")], "loser string, survivor string")
    out = events.apply_merges(evs, items, items, edges, rejects, merges)
    assert {(r.id, str(r.event_date)) for r in out["events"].collect()} == {("a", "2024-01-02"), ("c", "None")}
    assert {(r.id, r.event_id) for r in out["items"].collect()} == {("i1", "a"), ("i2", "a"), ("i3", "c")}
    assert [tuple(r) for r in out["edges"].collect()] == [("c", "a")]
    assert sorted(tuple(r) for r in out["rejects"].collect()) == [("merge", "b"), ("merge_cross", "a")]


def test_survivors_of_people_and_rules_differ(spark):
    rows = [(1, "a", dt.datetime(2024, 1, 2), 9, 1), (1, "b", dt.datetime(2024, 1, 1), 1, 0), (2, "c", None, 1, 0), (2, "d", None, 1, 1)]
    members = spark.createDataFrame(rows, "group long, id string, first_seen_at timestamp_ntz, n_items long, ordinal int")
    assert {(r.loser, r.survivor) for r in events.survivors(members).collect()} == {("a", "b"), ("d", "c")}
    assert {(r.loser, r.survivor) for r in events.human_survivors(members).collect()} == {("b", "a"), ("d", "c")}


def test_semantic_drops_follow_the_order(spark):
    pairs = spark.createDataFrame(
        [(1, "a", "b", 2, 1, True), (2, "b", "c", 1, 3, True), (3, "a", "c", 2, 3, True), (4, "x", "y", 1, 1, False)],
        "place long, a string, b string, a_at long, b_at long, dup boolean",
    )
    assert {(r.id, r.merged_into) for r in events.semantic_drops(pairs).collect()} == {("a", "b"), ("c", "b")}


def test_claims(spark):
    draft = {
        "relevant": True, "company": "c", "facts": ["long enough fact", "short"], "inferences": [{"text": "a view of things", "attributed_to": "x"}],
        "implication": {"text": "do something", "audience": "all", "needs_internal_data": False},
    }
    from evidex.schemas import DRAFT

    rows = spark.createDataFrame([("e", "i", "C", json.dumps(draft)), ("e", "j", "E", json.dumps(draft))], "event_id string, item_id string, effective_class string, d string")
    got = events.write_claims(rows.withColumn("draft", F.from_json("d", DRAFT))).collect()
    assert sorted(r.kind for r in got) == ["fact", "inference", "inference", "recommendation"]


def test_relations_need_known_ends(spark):
    evs = spark.createDataFrame([("c", "k1", "e1"), ("c", "k2", "e2")], "company string, event_key string, id string")
    rel = spark.createDataFrame([("c", "k1", "k2", "follows", "because"), ("c", "k1", "ghost", "follows", "x"), ("c", "k1", "k1", "follows", "x"), ("c", "k2", "k1", "causes", " ")], "company string, from string, to string, relation string, basis string")
    assert [tuple(r) for r in events.resolved_relations(rel, evs).collect()] == [("e1", "e2", "follows", "because")]
    verdicts = spark.createDataFrame([("a", "b", "follows", "B", "a long enough basis"), ("c", "d", "follows", "A", "short"), ("f", "e", None, None, None)], "a string, b string, relation string, source string, basis string")
    edges, none = events.accepted_relations(verdicts)
    assert [(r.from_event, r.to_event) for r in edges.collect()] == [("b", "a")]
    assert {r.target_id for r in none.collect()} == {"c|d", "e|f"}


def test_review_trail(spark):
    evs = spark.createDataFrame([("a", "pending", 1), ("b", "suspect_duplicate", 2)], "id string, review_state string, independent_orgs int")
    acts = spark.createDataFrame([("a", "confirm", "ok", "me"), ("ghost", "watch", "", "me")], "id string, action string, note string, reviewer string")
    changed, trail = review.apply_event_verdicts(evs, acts, F.lit("2024-01-01"))
    assert {(r.id, r.review_state) for r in changed.collect()} == {("a", "confirmed"), ("b", "suspect_duplicate")} and trail.count() == 1


def test_unmerge_makes_a_confirmed_event_and_keeps_it_apart(spark):
    held = {
        "events": tables.conform(spark.createDataFrame([("e", "co", "Title", "suspect_duplicate")], "id string, company string, title string, review_state string"), "events"),
        "items": spark.createDataFrame([("i", "e", "First", "2024-01-03"), ("j", "e", "Other", "2024-01-01")], "id string, event_id string, title string, published_at string"),
        "claims": spark.createDataFrame([("c", "e", "i"), ("d", "e", None)], "id string, event_id string, source_item_id string"),
    }
    held["items"] = held["items"].withColumn("published_at", F.col("published_at").cast("timestamp")).withColumn("discovered_at", F.col("published_at"))
    one, now = spark.createDataFrame([("i",)], "id string"), F.lit("2024-02-01").cast("timestamp")
    done = review.unmerge(held, one, "e", None, "apart", "me", now)
    new = next(r for r in done["events"].collect() if r.id != "e")
    assert (new.title, new.company, new.review_state, str(new.event_date), new.confidence) == ("First", "co", "confirmed", "2024-01-03", None)
    assert {(r.id, r.event_id) for r in done["items"].collect()} == {("i", new.id), ("j", "e")}
    assert {(r.id, r.event_id) for r in done["claims"].collect()} == {("c", new.id), ("d", "e")}
    assert {(r.action, r.target_id) for r in done["reviews"].collect()} == {("unmerge", new.id), ("split", f"e|{new.id}")}
    for chosen in (held["items"].select("id"), one.where("false"), spark.createDataFrame([("z",)], "id string")):
        with pytest.raises(ValueError):
            review.unmerge(held, chosen, "e", None, "", "me", now)


def test_retier_tells_what_changed(spark):
    sources = spark.createDataFrame([("s", "C", True), ("t", "C", True)], "id string, source_class string, active boolean")
    changed, trail = review.retier(sources, "s", "why", "me", F.lit("2024-01-01"), source_class="A", active=False)
    assert {tuple(r) for r in changed.collect()} == {("s", "A", False), ("t", "C", True)}
    assert [(r.action, r.note) for r in trail.collect()] == [("retier", "source_class C → A; active true → false. why")]
    assert review.retier(sources, "s", "", "me", F.lit("2024-01-01"))[1].count() == 0


def test_groups_fold_in_order(spark):
    """What a group has merged away is no member of a later one."""
    rows = [(1, "a", "2024-01-01", 1), (1, "b", "2024-01-02", 1), (2, "b", "2024-01-02", 1), (2, "c", "2024-01-03", 9), (3, "c", "2024-01-03", 9), (3, "d", "2024-01-03", 2), (4, "e", None, 1), (4, "f", None, 1)]
    members = spark.createDataFrame(rows, "group long, id string, first_seen_at string, n_items long").withColumn("first_seen_at", F.col("first_seen_at").cast("timestamp_ntz"))
    splits = spark.createDataFrame([(["f", "e"],)], "members array<string>")
    merges, blocked = events.fold_groups(members, splits)
    assert {(r.loser, r.survivor) for r in merges.collect()} == {("b", "a"), ("d", "c")} and [r.group for r in blocked.collect()] == [4]


def test_replace_resets_and_merge_keeps(spark):
    old = spark.createDataFrame([("1", "u1", "x"), ("2", "u2", "y")], "id string, url string, note string")
    new = spark.createDataFrame([("1", "u2")], "id string, url string")
    assert [tuple(r) for r in tables.replace_rows(old, new, "id", "url").collect()] == [("1", "u2", None)]
    assert {tuple(r) for r in tables.merge_rows(old, new, "id").collect()} == {("1", "u2", "x"), ("2", "u2", "y")}


def test_dump_and_rebuild(spark, tmp_path):
    sources = tables.conform(spark.createDataFrame([("s1", "S"), ("s2", "T")], "id string, name string"), "sources")
    tables.dump({"sources": sources}, str(tmp_path))
    back = tables.rebuild(spark, str(tmp_path), "sources")
    assert {(r.id, r.reliability) for r in back.collect()} == {("s1", 1.0), ("s2", 1.0)}
    with pytest.raises(ValueError):
        tables.dump({"sources": sources.limit(0)}, str(tmp_path))


def test_feeds_and_links(spark):
    feed = """<rss><item><title><![CDATA[A &amp; B]]></title><link>https://e.com/1</link><pubDate>Tue, 01 Sep 2026 10:00:00 GMT</pubDate></item>
      <item><title>No link</title></item><item><title>Mail</title><link>mailto:x</link></item></rss>"""
    atom = """<feed><entry><title>T</title><link href="https://e.com/2"/><updated>2026-09-01T10:00:00Z</updated></entry></feed>"""
    got = readers.parse_feed(spark.createDataFrame([("r", feed), ("a", atom)], "path string, text string")).collect()
    assert {(r.url, r.title, r.time_source) for r in got} == {("https://e.com/1", "A & B", "exact"), ("https://e.com/2", "T", "exact")}
    page = '<a href="/news/12345.html">one two three four five six seven eight</a><a href="/news/12345.html">again</a><a href="https://other.org/news/1234">one two three four five six seven eight</a><a href="/tag/9999">one two three four five six seven eight</a>'
    pages = spark.createDataFrame([("https://www.e.com/list/", page, ["e.com"], None)], "url string, html string, domains array<string>, pattern string")
    links = readers.listing_links(pages).collect()
    assert [r.link for r in links] == ["https://www.e.com/news/12345.html"]


def test_attribution_by_suffix(spark):
    sources = spark.createDataFrame([("a", ["example.com"], 0), ("b", ["news.example.com", "other.org"], 1)], "id string, domains array<string>, place int")
    items = spark.createDataFrame([(1, "https://news.example.com/x"), (2, "https://m.example.com/"), (3, "https://notexample.com/"), (4, "https://a.news.example.com/")], "id long, url string")
    got = {r.id: r.source_id for r in readers.attribute(items, "id", "url", readers.domain_index(sources)).collect()}
    assert got == {1: "b", 2: "a", 3: None, 4: "a"}


def test_named_sources_and_classes(spark):
    patterns = spark.createDataFrame([("来源：A", "a", 1), ("B报", "b", 0)], "pattern string, source_id string, place int")
    items = spark.createDataFrame([(1, "来源：A 和 B报"), (2, "x" * 600 + "B报"), (3, "来源：A")], "id long, text string")
    assert {r.id: r.original_source for r in readers.original_source(items, "id", "text", patterns).collect()} == {1: "b", 2: None, 3: "a"}
    levels = spark.createDataFrame([("C", "A"), ("B", "D"), ("C", None)], "own string, named string")
    assert [r[0] for r in levels.select(readers.effective_class(F.col("own"), F.col("named"))).collect()] == ["A", "B", "C"]


def test_channels_and_mirrors(spark):
    one = spark.createDataFrame([("u1", "t")], "url string, title string")
    both = readers.union_channels({"rss": one, "exa": one.withColumn("extra", F.lit(1))}).orderBy("seq").collect()
    assert [(r.channel, r.extra) for r in both] == [("rss", None), ("exa", 1)] and both[0].seq < both[1].seq
    rows = spark.createDataFrame([("s", 2, "x"), ("s", 1, "y"), ("s", 1, "z"), ("t", 3, "w")], "source_id string, mirror int, url string")
    assert {r.url for r in readers.first_mirror(rows).collect()} == {"y", "z", "w"}
    found = spark.createDataFrame([("u", "T", "Acme Official", "2024"), ("u", "S", "Blog", "2025"), ("v", "V", "Blog", "2024")], "url string, title string, publisher string, published string")
    assert {(r.url, r.title, r.source_class) for r in readers.discovery_items(found, ("Official",)).collect()} == {("u", "T", "A"), ("v", "V", "C")}
    assert [r.prefilter_drop for r in readers.title_prefilter(found.orderBy("url", "title"), ("V",)).collect()] == ["title", "title", None]


def test_documents_of_events(spark):
    evs = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, title string")
    claims = spark.createDataFrame([("a", "fact", "c1", "text")], "event_id string, kind string, id string, text string")
    items = spark.createDataFrame([("a", None, "i1", "u", "t")], "event_id string, published_at timestamp_ntz, id string, url string, title string")
    edges = spark.createDataFrame([("a", "b", "follows", "x"), ("ghost", "a", "causes", "y")], "from_event string, to_event string, relation string, basis string")
    got = {r.id: json.loads(r.document) for r in reports.event_documents(evs, claims, items, edges).collect()}
    assert [(e["other"], e["direction"]) for e in got["a"]["edges"]] == [("b", "out")] and got["b"]["edges"][0]["direction"] == "in"
    assert got["a"]["facts"][0]["id"] == "c1" and got["b"]["items"] == got["a"]["inferences"] == []
    assert got["a"]["items"][0]["source_name"] == "来源未知" and got["a"]["edges"][0]["title"] == "B"


def test_edges_are_ordered_by_the_other_end(spark):
    evs = spark.createDataFrame([("a", None), ("b", "2026-03-01"), ("c", "2026-01-01"), ("d", None)], "id string, event_date string")
    edges = spark.createDataFrame([("a", "b", "causes"), ("a", "c", "causes"), ("d", "a", "causes"), ("b", "a", "follows"), ("a", "a", "follows"), ("c", "a", "causes")], "from_event string, to_event string, relation string")
    none = spark.createDataFrame([], "event_id string, kind string, published_at timestamp_ntz, id string, url string, title string, text string")
    got = {r.id: json.loads(r.document) for r in reports.event_documents(evs, none, none, edges).collect()}
    assert [(e["other"], e["relation"], e["direction"]) for e in got["a"]["edges"]] == [("b", "follows", "in"), ("d", "causes", "in"), ("c", "causes", "out"), ("b", "causes", "out")]


def test_requests_about_an_event(spark):
    from evidex.operators import export

    turn = lambda n: ("user", "assistant")[n % 2]
    cases = {
        "ok": [("user", "Why?")], "three": [("user", "a"), ("assistant", "b"), ("user", "c")], "even": [("user", "a"), ("assistant", "b")],
        "twice": [("user", "a"), ("user", "b"), ("user", "c")], "blank": [("user", " \u3000")], "null": [("user", None)], "long": [("user", "x" * 2001)],
        "fits": [("user", "x" * 2000)], "wide": [("user", "\U0001f600" * 1001)], "answer": [("user", "a"), ("assistant", "b" * 8000), ("user", "c")],
        "answer2": [("user", "a"), ("assistant", "b" * 8001), ("user", "c")], "21": [(turn(n), "x") for n in range(21)], "23": [(turn(n), "x") for n in range(23)],
        "sum": [(turn(n), "x" * 1900) for n in range(13)], "bytes": [(turn(n), "漢" * 1900) for n in range(15)], "system": [("system", "a")],
    }
    rows = [(k, n, r, t) for k, v in cases.items() for n, (r, t) in enumerate(v)]
    got = {r.k: r.problem for r in export.checked_turns(spark.createDataFrame(rows, "k string, n int, r string, t string"), "k", "n", "r", "t").collect()}
    assert {k for k, p in got.items() if p is None} == {"ok", "three", "fits", "answer", "21"}
    assert {k for k, p in got.items() if p == "body_too_large"} == {"bytes"}


def test_summaries_and_visible_text(spark):
    rows = spark.createDataFrame([('{"summary": "s", "watch": "w"}',), ("plain",), ("{broken",)], "v string")
    assert [tuple(r.s) for r in rows.select(reports.normal_summary(F.col("v")).alias("s")).collect()] == [("s", "w"), ("plain", ""), ("{broken", "")]
    from evidex.operators import documents

    page = spark.createDataFrame([("<p>漢字</p><script>漢</script><STYLE>字</STYLE><a title='漢'>x</a><noscript>漢</noscript>",)], "h string")
    assert page.select(documents.page_metrics(F.col("h"))["cjk"]).first()[0] == 2


def test_orphans_of_one_key(spark):
    """Candidates that no group names come one after the other: the last one's title and date stay, nothing is said in the ledger."""
    from evidex.operators import stages
    from evidex.schemas import DRAFT

    told = lambda t, day: json.dumps({"relevant": True, "company": "co1", "event_key": "k", "event_title": t, "event_date": day, "facts": ["f " + t]})
    rows = spark.createDataFrame([("i1", told("first", "2026-01-01")), ("i2", told("second", "2026-02-02"))], "id string, d string")
    items = rows.select("id", F.lit("extracted").alias("status"), F.lit(None).cast("string").alias("event_id"), F.lit("A").alias("effective_class"), F.lit(None).cast("timestamp_ntz").alias("published_at"), F.from_json("d", DRAFT).alias("draft"))
    groups = spark.createDataFrame([], "company string, ordinal int, key string, title string, reason string, members array<int>")
    relations = spark.createDataFrame([], "company string, `from` string, `to` string, relation string, basis string")
    events = spark.createDataFrame([], "id string, event_key string, first_seen_at timestamp")
    done = stages.merge(items, events, groups, relations, EngineConfig(companies=("co1",)), "R", F.lit("2026-03-01").cast("timestamp"))
    assert [(r.title, str(r.event_date)) for r in done["events"].collect()] == [("second", "2026-02-02")]
    assert done["rejects"].count() == 0 and {r.status for r in done["items"].collect()} == {"accepted"} and done["claims"].count() == 2


def test_events_whose_ids_collide_stay_two(spark):
    """co1:k1519 and co0:k1679 have hashes with the same first eight digits, and so has an event of before, of another company."""
    from evidex.operators import stages
    from evidex.schemas import DRAFT

    told = lambda company, key: json.dumps({"relevant": True, "company": company, "event_key": key, "event_title": key, "facts": []})
    rows = spark.createDataFrame([("i1", told("co1", "k1519")), ("i2", told("co0", "k1679")), ("i3", told("co0", "k1679"))], "id string, d string")
    items = rows.select("id", F.lit("extracted").alias("status"), F.lit(None).cast("string").alias("event_id"), F.lit("A").alias("effective_class"), F.lit(None).cast("timestamp_ntz").alias("published_at"), F.from_json("d", DRAFT).alias("draft"))
    groups = spark.createDataFrame([], "company string, ordinal int, key string, title string, reason string, members array<int>")
    relations = spark.createDataFrame([], "company string, `from` string, `to` string, relation string, basis string")
    before = [("EV-a15e8ce9", "k1519", "co1", dt.datetime(2026, 1, 1)), ("EV-a15e8ce9", "other", "co2", dt.datetime(2025, 1, 1))]
    events = spark.createDataFrame(before, "id string, event_key string, company string, first_seen_at timestamp")
    done = stages.merge(items, events, groups, relations, EngineConfig(companies=("co0", "co1")), "R", F.lit("2026-03-01").cast("timestamp"))
    assert {(r.id, r.company, r.event_key, r.first_seen_at.year, r.first_seen_at.month) for r in done["events"].collect()} == {
        ("EV-a15e8ce9", "co1", "k1519", 2026, 1), ("EV-a15e8ce9", "co0", "k1679", 2026, 3), ("EV-a15e8ce9", "co2", "other", 2025, 1),
    }
    assert {(r.id, r.company) for r in done["placed"].collect()} == {("i1", "co1"), ("i2", "co0"), ("i3", "co0")}


def test_old_vectors_are_carried(spark):
    new = spark.createDataFrame([("a", [1]), ("b", None)], "id string, vector array<int>")
    old = spark.createDataFrame([("b", [2]), ("c", [3])], "id string, vector array<int>")
    assert {(r.id, r.vector[0]) for r in reports.carried_vectors(new, old).collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_judges_and_batches(spark):
    rows = spark.createDataFrame([(k,) for k in range(5)], "k long").coalesce(1)
    answers = judge.ask(rows, judge.RuleJudge(lambda r: {"keep": r["k"] % 2 == 0}), "screen", ["k"], 2).collect()
    assert {r.k: json.loads(r.answer)["keep"] for r in answers} == {0: True, 1: False, 2: True, 3: False, 4: True}
    cached = judge.CachedJudge({})
    with pytest.raises(KeyError):
        cached.answer("t", [])
    scripted = judge.ScriptedJudge([[1], [2]])
    replay = judge.CachedJudge({}, scripted)
    assert replay.answer("t", [{"a": 1}]) == replay.answer("t", [{"a": 1}]) == "[1]" and len(scripted.asked) == 1


def test_embedding_asks_once(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "A "), (3, "zzz"), (4, "")], "id long, text string")
    known = spark.createDataFrame([], "cache_key string, vector array<double>")
    vectors, fresh = embedder.embed(rows, "id", "text", known, embedder.angle_embedder({"A": 0.0}), "m")
    got = {r.id: r.vector and r.vector[0] for r in vectors.collect()}
    assert got == {1: 1.0, 2: 1.0, 3: None, 4: None} and fresh.count() == 1


def test_recall_band(spark):
    rows = spark.createDataFrame([(i, embedder.angle_embedder({"t": a})(["t"])[0]) for i, a in enumerate((0.0, 0.02, 1.2))], "id long, v array<double>")
    assert [(r.a, r.b) for r in similarity.band_pairs(rows, "id", "v", 0.90).collect()] == [(0, 1)]
    assert [(r.a, r.b) for r in similarity.band_pairs(rows, "id", "v", 0.30, 0.50, block=1).orderBy("a").collect()] == [(0, 2), (1, 2)]


def test_search_limits(spark):
    rows = spark.createDataFrame([(1, "has needle", [1.0, 0.0]), (2, "none", [0.9, 0.1]), (3, "none", [0.0, 1.0])], "id long, t string, v array<double>")
    assert [r.id for r in search.hybrid_search(rows, "id", ["t"], "v", "Needle", [1.0, 0.0]).collect()] == [1, 2]
    for bad in ("x", "x" * 201):
        with pytest.raises(ValueError):
            search.hybrid_search(rows, "id", ["t"], None, bad, None)


def test_weekly_gate(spark):
    given = spark.createDataFrame([(dt.date(2024, 1, 22), dt.datetime(2024, 1, 26))], "period_start date, generated_at timestamp_ntz")
    need = lambda df: df.agg(reports.needs_report(df, F.lit("2024-01-22").cast("date"), F.lit("2024-01-28").cast("date")).alias("n")).first().n
    assert need(given) and not need(given.withColumn("generated_at", ntz("2024-01-30")))


def test_two_batches_are_one(spark, tmp_path):
    rows = random_items(40, 5)
    lines = [dict(zip(("url", "title", "content", "published_at", "time_source"), (*r[:3], r[3].isoformat(), r[4])), seq=i) for i, r in enumerate(rows)]
    source = tmp_path / "in"
    source.mkdir()
    config = EngineConfig()
    for k in range(2):
        (source / f"{k}.json").write_text("\n".join(map(json.dumps, lines[20 * k : 20 * k + 20])))
        run_available(spark, str(source), str(tmp_path / "out"), config, ntz("2024-01-01"), 1)
    got = {r.seq for r in spark.read.parquet(str(tmp_path / "out" / "accepted")).collect()}
    assert got == {i for i, reason in enumerate(greedy(spark, rows, [], ())) if reason is None}


def test_hybrid_search_query_keeps_documents_without_a_vector(spark):
    from evidex.plans import queries

    sf = "/root/testdata/sf0.01"
    holding = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").where("contains(lower(text), 'license')").collect()}
    vectors = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = queries.QUERIES["hybrid_search"](spark, sf).collect()
    assert holding - vectors and {r.doc_id for r in got if r.lexical} == holding
