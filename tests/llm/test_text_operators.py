"""Exact dedup, line dedup, media, token counts and packing against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from evidex.llm import media, packing, token_counts
from evidex.llm.exact_dedup import exact_dedup
from evidex.llm.line_dedup import line_dedup

WS = re.compile("[\x20\x09-\x0d]")
order = lambda i: (i is not None, i)  # noqa: E731  null first


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_exact_dedup(docs_of, awkward, block):
    groups = defaultdict(list)
    for doc_id, text in awkward:
        groups[WS.sub("", text or "")].append((-len(text or ""), order(doc_id), doc_id, text or ""))
    want = []
    for normal, rows in groups.items():
        rows.sort(key=lambda r: r[:2])
        sha = hashlib.sha256(normal.encode()).hexdigest()
        want += [(r[2], rows[0][2], len(rows), k == 0, sha) for k, r in enumerate(rows)]
    got = [tuple(r)[:5] for r in exact_dedup(docs_of([r for r in awkward if block > 2 or len(r[1] or "") < 500]), block).collect()]
    if block > 2:
        assert sorted(got, key=str) == sorted(want, key=str)
    else:
        assert {r[0]: r[4] for r in got}.items() <= {r[0]: r[4] for r in want}.items()
    assert sum(r[3] for r in got) == len({r[4] for r in got})


def test_line_dedup(docs_of, awkward):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(lower)
    holders = defaultdict(set)
    for doc_id, text in awkward:
        for line in (text or "").split("\n"):
            holders[key(line)].add(order(doc_id))
    want = []
    for doc_id, text in awkward:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != order(doc_id))]
        want.append((doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)))
    got = [tuple(r) for r in line_dedup(docs_of(awkward)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_media_round_trip_and_damage():
    rnd = np.random.default_rng(3)
    for rows in (1, 2, 40, media.ROWS_AT_ONCE + 3):
        payload = rnd.integers(0, 255, rows * media.WIDTH, np.uint8).tobytes()
        png = media.encode_png(payload)
        assert media.decode_png(png).tobytes() == payload
        broken = bytearray(png)
        broken[60] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(broken))
        with pytest.raises(ValueError):
            media.decode_png(png[:-3])


def test_media_reads_every_filter():
    rnd = np.random.default_rng(4)
    picture = rnd.integers(0, 255, (9, 7)).astype(int)
    kinds = np.array([4, 3, 0, 1, 2, 2, 3, 4, 4], np.uint8)
    rows = np.zeros((9, 7), np.uint8)
    at = lambda y, x: int(picture[y, x]) if x >= 0 and y >= 0 else 0
    for y in range(9):
        for x in range(7):
            a, b, c = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)
            paeth = min((a, b, c), key=lambda v: abs(a + b - c - v))
            rows[y, x] = (picture[y, x] - [0, a, b, (a + b) // 2, paeth][kinds[y]]) % 256
    assert (media._unfiltered(kinds, rows) == picture).all()


def test_media_query(docs_of, awkward):
    got = media.media_features(media.media_column(docs_of(awkward))).collect()
    assert len(got) == len(awkward)
    want = defaultdict(list)
    for doc_id, text in awkward:
        data = (text or "").encode()
        want[doc_id].append(data + b"\xff" * (-len(data) % 576 or (0 if data else 576)))
    seen = {}
    for r in got:
        full = next(p for p in want[r.doc_id] if hashlib.sha256(p).hexdigest() == r.payload_sha256)
        assert r.payload_bytes == len(full) and r.tail_crc32 == zlib.crc32(full[-32:]) and len(r.feature) == 16
        assert seen.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_media_hash_is_a_plain_cosine_transform():
    """Block means, the sums of the cosine transform written out, and signs against the median."""
    rnd = np.random.default_rng(6)
    for height in (1, 5, 40):
        picture = rnd.integers(0, 256, (height, media.WIDTH), np.uint8)
        span = lambda k, n: range(k * n // 32, max(k * n // 32 + 1, (k + 1) * n // 32))
        mean = [[np.mean([int(picture[y, x]) for y in span(v, height) for x in span(u, media.WIDTH)]) for u in range(32)] for v in range(32)]
        wave = lambda k, n: np.cos(np.pi * (2 * n + 1) * k / 64)
        low = [round(sum(mean[v][u] * wave(j, v) * wave(k, u) for v in range(32) for u in range(32)), 6) for j in range(8) for k in range(8)]
        middle = sorted(low[1:])[31]
        digits = int("".join("1" if x > middle else "0" for x in low), 2)
        assert media.cosine_hash(picture) == f"{digits:016x}"


def test_line_dedup_of_many_repeated_lines(docs_of):
    rows = [(i, f"a line of over twenty characters {i % 1}\n" * 40_000 + f"own {i}") for i in range(3)]
    got = {r.doc_id: r for r in line_dedup(docs_of(rows)).collect()}
    assert [(got[i].n_lines, got[i].n_dropped, got[i].text) for i in (0, 1)] == [(40_001, 40_000, "own 0"), (40_001, 40_000, "own 1")]
    assert got[2].n_dropped == 0 and got[2].text == rows[2][1]


def test_token_counts(docs_of, awkward):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for i, t in awkward]
    got = [tuple(r) for r in token_counts.token_counts(docs_of(awkward), path, limit=100).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    counter, rnd = token_counts.token_counter(path), random.Random(1)
    for _ in range(800):
        text = "".join(rnd.choice(" ab\n▁\té漢ﬁthe s<>0") for _ in range(rnd.randint(0, 40)))
        assert counter.count(text) == len(library.encode(text)), text


@pytest.mark.parametrize("chunk, before", [(7, 2), (40, 64)])
def test_chunks_of_long_texts(docs_of, awkward, monkeypatch, chunk, before):
    """Maps compose to the counts of whole texts, also where their states have to be read in further rounds."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(token_counts, "BEFORE", before)
    rnd = random.Random(chunk)
    rows = [(i, t if t is None else t[: 12 * chunk]) for i, t in awkward]
    rows += [(90_000 + k, "".join(rnd.choice(" ab\n▁thers\t") for _ in range(12 * chunk))) for k in range(20)]
    rows += [(95_000, "a" * 10 * chunk), (95_001, " " * 10 * chunk), (95_002, "-=" * 5 * chunk)]
    got = token_counts.token_counts(docs_of(rows), path, chunk=chunk).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(library.encode(t or ""))) for i, t in rows)


def test_transducer_forgets_within_a_word(monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    monkeypatch.setattr(token_counts, "TRANSITIONS", 200)
    counter = token_counts.TokenCounter(token_counts.PieceModel.load(path))
    rnd = random.Random(9)
    text = "".join(rnd.choice("etaoinshrdlu") for _ in range(3000))
    assert counter.count(text) == len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))
    assert counter.transducer.compiled <= 200 and len(counter.transducer.states) <= 201


def test_cuts_are_optimal():
    rnd = random.Random(2)
    for _ in range(60):
        places = np.array([0, *np.cumsum([rnd.randint(1, 6) for _ in range(12)])])
        penalties = np.array([0, *(rnd.choice([0, 2, 9]) for _ in range(11)), 0])
        window = rnd.randint(6, 12)
        cost = lambda cuts: sum(window + penalties[c] for c in cuts)
        best = [0] + [10**9] * 12
        for j in range(1, 13):
            best[j] = min(best[i] + window + penalties[j] for i in range(j) if places[j] - places[i] <= window)
        cuts = packing.choose_cuts(places, penalties, window, True)
        assert cuts[-1] == 12 and cost(cuts) == best[12]


@pytest.mark.parametrize("window, block", [(16, 64), (4096, 1 << 19)])
def test_packing(docs_of, awkward, monkeypatch, window, block):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", block)
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = defaultdict(list)
    for doc_id, text in awkward:
        want[doc_id].append(np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    got = packing.pack(docs_of(awkward), path, window=window).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, texts in want.items():
        need = sorted({p for ids in texts for p in covered(ids, pieces[doc_id])})
        assert need == sorted(set(pieces[doc_id]))
        assert sum(p[1] for p in pieces[doc_id]) == sum(map(len, texts))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window


def test_words_are_encoded_as_the_library_does():
    """Every assigned code point below the surrogates alone, in a word, before punctuation and before a mark."""
    import unicodedata

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder, rnd = Tokenizer.from_file(path), packing.WordEncoder(path), random.Random(3)
    points = [chr(c) for c in range(0xD800) if unicodedata.category(chr(c)) != "Cn"]
    points = [c for c in points if ord(c) < 0x3400 or rnd.random() < 0.05]
    texts = [f"{c} a{c} {c}! a{c}b. {c}a, x{c}\u0301; {c}" for c in points]
    texts += ["\u0958\u0932\u092e \u0130! a\x1c. \x1f;", "<|endoftext|>. <|ENDOFTEXT|>!", "it's'S. a's!?", "\x85.", "é.e\u0301."]
    some = [*"  .,;:!?'\n\t\u0301_-<|>", "\u0130", *(chr(c) for c in range(0x20, 0x250))]
    texts += ["".join(rnd.choice(some) for _ in range(30)) for _ in range(3000)]
    theirs = library.encode_batch(texts, add_special_tokens=False)
    for text, ours, their in zip(texts, encoder.encode(texts), theirs):
        assert ours == np.array(their.ids, "<u4").tobytes(), text


def test_copies_of_one_row_are_packed_each(docs_of):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    n = len(Tokenizer.from_file(path).encode("some words of a text", add_special_tokens=False).ids) + 1
    got = packing.pack(docs_of([(None, "some words of a text")] * 300 + [(4, "some words of a text")] * 300), path, window=64).collect()
    assert sum(r.length for r in got if r.doc_id is None) == 300 * n == sum(r.length for r in got if r.doc_id == 4)


def covered(ids, pieces):
    """The pieces that these ids would have."""
    return [p for p in pieces if p[3] == len(ids) and zlib.crc32(ids[p[0] : p[0] + p[1]].tobytes()) == p[2]]
