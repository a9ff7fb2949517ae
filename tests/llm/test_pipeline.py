"""The pipeline against plain Python, stage by stage, on the smallest tables."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from test_near_copies import least_of_components
from test_repeats import brute

SF = "/root/testdata/sf0.001"
WS = re.compile("[\x20\x09-\x0d]")


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return [[frame.collect() for frame in pair] for pair in out]


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_columns_stay(results):
    for _, after in results[:-1]:
        assert [*after[0].asDict()] == corpus_pipeline.COLUMNS


def test_toxicity_rejects_what_it_scores(spark, results):
    from evidex.llm.toxicity import toxicity

    scored = toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert texts(results[0][1]).keys() == {r.doc_id for r in scored.where("predicted = 0").collect()}


def test_exact_copies_go(results):
    before, after = results[1]
    groups = defaultdict(list)
    for r in before:
        groups[WS.sub("", r.text)].append((-len(r.text), r.doc_id))
    assert texts(after).keys() == {min(g)[1] for g in groups.values()}


def test_near_copies_go(results):
    before, after = results[2]
    assert texts(after).keys() == least_of_components([(r.doc_id, r.text) for r in before])


def test_passages_go(results):
    before, after = results[3]
    want = {i: kept.decode(errors="ignore") for i, *_, kept in brute([(r.doc_id, r.text) for r in before], 50)}
    assert texts(after) == want and all(r.n_chars == len(r.text) for r in after)


def test_every_id_is_packed_once(results):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before, after = results[4]
    pieces = defaultdict(list)
    for r in after:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for r in before:
        ids, at = np.array([*library.encode(r.text, add_special_tokens=False).ids, 2], "<u4"), 0
        for start, length, crc in sorted(pieces.pop(r.doc_id)):
            assert start == at and zlib.crc32(ids[start : start + length].tobytes()) == crc
            at += length
        assert at == len(ids)
    assert not pieces


def test_repeated_rows_stay_once(spark):
    rows = [(1, "same text", "en", "s", 9), (1, "same text", "en", "s", 9), (2, "same  text", "en", "s", 10), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id or -1 for r in corpus_pipeline.exact_dedup_stage(spark, docs, SF).collect()) == [-1, 2]
    twice = spark.createDataFrame([rows[0]] * 3, docs.schema)
    assert corpus_pipeline.exact_dedup_stage(spark, twice, SF).count() == 1


def test_run_and_no_documents(spark, results):
    got = corpus_pipeline.run(spark, SF)
    assert {(r.doc_id, r.start, r.ids_crc32) for r in got.collect()} == {(r.doc_id, r.start, r.ids_crc32) for r in results[4][1]}
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []


@pytest.fixture(scope="module")
def odd(spark, awkward):
    """Awkward rows with columns that stages use inside, of other types."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", 0.1, "y") for i, t in awkward]
    names = "row int, text_hash string, toxicity_score double, kept string"
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}").repartition(3)


def kept_rows(stage, odd):
    got = stage(odd.sparkSession, odd, SF)
    assert got.columns == corpus_pipeline.COLUMNS
    return sorted(((r.doc_id, r.text) for r in got.collect()), key=str)


def test_toxicity_stage_on_odd_rows(odd, awkward):
    """Nothing here is toxic: all rows stay, nulls and repeats too."""
    assert kept_rows(corpus_pipeline.toxicity_stage, odd) == sorted(awkward, key=str)


def test_exact_stage_on_odd_rows(odd, awkward):
    order = lambda r: (-len(r[1] or ""), r[0] is not None, r[0] or 0)
    groups = defaultdict(list)
    for row in awkward:
        groups[WS.sub("", row[1] or "")].append(row)
    got = kept_rows(corpus_pipeline.exact_dedup_stage, odd)
    want = [min(rows, key=order) for rows in groups.values()]
    assert sorted((i is None, i or 0, t or "") for i, t in got) == sorted((i is None, i or 0, t or "") for i, t in want)


def test_near_copies_stage_on_odd_rows(odd, awkward):
    """One row's key of each component stays, each as often as it came."""
    keys = sorted({(i is None, i or 0, t or "") for i, t in awkward})
    least = least_of_components([(n, k[2]) for n, k in enumerate(keys)])
    texts_kept = {keys[n][2] for n in least}
    got = kept_rows(corpus_pipeline.near_copies_stage, odd)
    assert {(i is None, i or 0) for i, _ in got} == {keys[n][:2] for n in least} and {t or "" for _, t in got} == texts_kept


def test_suffix_array_stage_on_odd_rows(odd, awkward):
    got = kept_rows(corpus_pipeline.suffix_array_stage, odd)
    want = [(i, kept.decode(errors="ignore")) for i, *_, kept in brute(awkward, 50)]
    assert got == sorted(want, key=str)


def test_packing_stage_on_odd_rows(spark, odd, awkward):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in awkward)
    assert sum(r.length for r in corpus_pipeline.packing_stage(spark, odd, SF).collect()) == want
