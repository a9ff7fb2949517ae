"""Screening, extraction and markdown documents."""

import json

from pyspark.sql import functions as F

from evidex.config import EngineConfig
from evidex.operators import documents, screening
from evidex.plans.run import run_stages
from evidex.plugins.judge import RuleJudge, with_retries


ITEMS = "id string, title string, content string, status string, effective_class string, draft_stage string, event_id string"


def test_prescreen_and_extract(spark):
    rows = [("a", "keep", "x", "pending", "A", None, None), ("b", "drop", "x", "pending", "D", None, None), ("c", "t", "x", "screened", None, None, "e"), ("d", "t", "x", "screened", "B", None, "e")]
    items = spark.createDataFrame(rows, ITEMS)
    judge = RuleJudge(lambda r: {"keep": r["title"] == "keep", "why": "w"})
    assert {(r.id, r.status) for r in screening.prescreen(items, judge).collect()} == {("a", "screened"), ("b", "rejected")}
    assert {r.status for r in screening.prescreen(items, RuleJudge(lambda r: 1 / 0)).collect()} == {"pending"}
    drafts = RuleJudge(lambda r: {"relevant": True, "event_key": "k", "facts": ["f"]})
    got = {r.id: r for r in screening.extract(items, drafts, EngineConfig()).collect()}
    assert got["c"].status == "evidence_only" and got["d"].status == "extracted" and got["d"].draft.facts == ["f"]
    assert {r.status for r in screening.extract(items, RuleJudge(lambda r: {"relevant": False}), EngineConfig()).collect()} == {"evidence_only", "rejected"}
    assert {r.id for r in screening.backfill_stage(items, RuleJudge(lambda r: {"stage": "已上线"})).collect()} == {"c", "d"}


def test_retries_end():
    tries = []

    class Flaky:
        def answer(self, task, rows):
            tries.append(1)
            if len(tries) < 3:
                raise RuntimeError
            return json.dumps([1])

    assert with_retries(Flaky()).answer("t", []) == "[1]" and len(tries) == 3


def test_markdown(spark):
    text = "---\na: 1\n---\n# Top\n```\n# not\n```\n## Same\n## Same\n| a | b |\n|---|---|\n| 1 | 2 |\n| 1 | 2 | 3 |\n\n| x |\n"
    docs = spark.createDataFrame([("d", text)], "id string, text string").withColumn("text", documents.strip_frontmatter(F.col("text")))
    heads = [(r.level, r.anchor) for r in documents.outline(docs).orderBy("pos").collect()]
    assert heads == [(1, "top"), (2, "same"), (2, "same-2")]
    assert [r.pos for r in documents.broken_tables(docs).collect()] == [12]
    slugs = spark.createDataFrame([(" `A` b_c! ",), ("第一 节。",), ("!?",)], "t string").select(documents.slug(F.col("t")).alias("s"))
    assert [r.s for r in slugs.collect()] == ["a-bc", "第一-节", "h"]
    counts = spark.createDataFrame([("a", 1), ("b", 5000), ("c", 7)], "value string, n long")
    assert documents.counted_table(counts, "kind", ("c",)).first()[0] == "| kind | n |\n|---|---|\n| c | 7 |\n| b | 5,000 |\n| a | 1 |"
    live = spark.createDataFrame([("x <!-- live:n -->\nold\n<!-- /live:n --> y",)], "t string")
    assert live.select(documents.spliced(F.col("t"), "n", F.lit("new"))).first()[0] == "x <!-- live:n -->\nnew\n<!-- /live:n --> y"


def test_stages_are_isolated(spark):
    one = spark.range(1)

    def good(tables):
        return {"a": tables["a"].union(tables["a"])}, {"n": 2}

    def bad(tables):
        raise ValueError("broken")

    tables, stats = run_stages({"a": one}, [("first", good), ("second", bad), ("third", good)], lambda df: df)
    assert tables["a"].count() == 4 and stats["second"]["error"].startswith("ValueError") and stats["third"] == {"n": 2}


def test_exported_documents(spark):
    from evidex.operators import documents

    files = spark.createDataFrame([("a.md", "---\ncreated: 2026-01-01\nstatus: open\n---\n# Title\n## One\ntext\n## Two\n"), ("b.md", "no heading"), ("x.md", "# not registered")], "name string, text string")
    registry = spark.createDataFrame([("b.md", "b", "second", "B", 1), ("a.md", "a", "first", "A", 2), ("gone.md", "g", "first", "G", 3)], "name string, id string, `group` string, description string, place int")
    told, index, missing = documents.exported(files, registry)
    got = {r.id: json.loads(r.document) for r in told.collect()}
    assert got["a"]["title"] == "Title" and got["a"]["updated"] == "2026-01-01" and got["a"]["status"] == "open" and got["b"]["title"] == "b"
    assert [(o["level"], o["anchor"]) for o in got["a"]["outline"]] == [(1, "title"), (2, "one"), (2, "two")] and got["a"]["markdown"].startswith("# Title")
    whole = json.loads(documents.index_document(index).first().document)
    assert whole["total"] == 2 and whole["groups"] == ["second", "first"] and [e["id"] for e in whole["results"]] == ["b", "a"]
    assert whole["results"][1]["sections"] == ["One", "Two"] and whole["results"][1]["lines"] == 5 and [r.name for r in missing.collect()] == ["gone.md"]


def test_an_index_in_pieces_has_one_entry_a_row(spark):
    rows = [(n, f"i{n}", 'T "q"', f"g{n % 3}", None, f"n{n}.md", 3, ["a", 'b"']) for n in range(50)]
    index = spark.createDataFrame(rows, "place int, id string, title string, `group` string, description string, source string, lines int, sections array<string>")
    pieces = documents.index_pieces(index.orderBy(F.desc("id"))).orderBy("part", "nth").collect()
    text = "".join(p.text for p in pieces)
    whole = json.loads(text)
    assert whole["total"] == 50 and whole["groups"] == ["g0", "g1", "g2"] and [e["id"] for e in whole["results"]] == [f"i{n}" for n in range(50)]
    assert max(len(p.text) for p in pieces) < 120 and documents.index_document(index).first().document == text
    assert json.loads(documents.index_document(index.limit(0)).first().document) == {"total": 0, "groups": [], "results": []}


def test_the_index_query_carries_no_copy_of_the_index(spark, tmp_path):
    from evidex.plans.queries import QUERIES
    from evidex.plans import stage_queries  # noqa: F401

    spark.range(40).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["docs_index"](spark, str(tmp_path))
    assert found.count() == 32 and {r.id: r.after_group for r in found.collect()}["13"] == 12
    assert "results#" not in found._jdf.queryExecution().analyzed().toString()
