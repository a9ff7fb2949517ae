"""Licence scan against plain Python; piece codec against the sentencepiece library."""

import re
import struct

import numpy as np
import public_tokenizers
import sentencepiece

from evidex.llm import licences, piece_codec
from evidex.llm.piece_model import PieceModel


def bigrams(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return {(a, b) for a, b in zip(words, words[1:])}


def test_licence_scan(docs_of, awkward):
    rows = awkward + [
        (900, "x\nLicensed under the Apache License, version 2.0\ny"),
        (901, licences.TEMPLATES["MIT-text"].replace("conditions: ", "conditions:\n").upper()),
        (902, licences.TEMPLATES["MIT-text"] + " é" * 300),
        (903, "Released under the MIT License.\nReleased under the MIT License."),
    ]
    want = []
    for i, text in rows:
        lines = (text or "").split("\n")
        for unit, part in [*enumerate(lines), *([(-1, text)] if len(lines) > 1 else [])]:
            a, found = bigrams(part), []
            for name, template in licences.TEMPLATES.items():
                b = bigrams(template)
                dice = 2 * len(a & b) / (len(a) + len(b))
                if dice >= 0.8:
                    found.append((-dice, name))
            if found:
                want.append((i, unit, min(found)[1], round(-min(found)[0], 9)))
    got = [(r.doc_id, r.unit, r.licence, round(r.dice, 9)) for r in licences.licence_scan(docs_of(rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) >= 4


def expected(text, templates, threshold=0.8):
    """(unit, licence, dice) of a text by trying every line, the whole text and every window."""
    reach = threshold / (2 - threshold)
    split = lambda part: re.findall(r"[^\W_]+", part.lower())
    pairs_of = lambda words: list(zip(words, words[1:]))
    known = {name: (set(pairs_of(split(t))), len(split(t)) - 1) for name, t in templates.items()}

    def best(pairs):
        a = set(pairs)
        scores = [(-2 * len(a & t) / (len(a) + len(t)), name) for name, (t, _) in known.items()] if a else []
        return min((x for x in scores if -x[0] >= threshold), default=None)

    lines = text.split("\n")
    words = [(w, n) for n, line in enumerate(lines) for w in split(line)]
    pairs = pairs_of([w for w, _ in words])
    in_lines = [(n, m) for n, line in enumerate(lines) if (m := best(pairs_of(split(line))))]
    in_all = best(pairs) if len(lines) > 1 else None
    out = [(n, m[1], -m[0]) for n, m in in_lines] + ([(-1, in_all[1], -in_all[0])] if in_all else [])
    if in_all or len(lines) == 1 and in_lines:
        return out
    found = []
    for name, (template, length) in known.items():
        span = int(length / reach + 1e-9)
        for i in (i for i, p in enumerate(pairs) if p in template):
            for j in range(i, min(i + span, len(pairs))):
                if pairs[j] in template:
                    a = set(pairs[i : j + 1])
                    dice = 2 * len(a & template) / (len(a) + len(template))
                    if dice >= threshold:
                        found.append((-dice, name, i, j))
    touched = lambda i, j: any(words[i][1] <= n <= words[j + 1][1] for n, _ in in_lines)
    kept = []
    for loss, name, i, j in sorted(f for f in found if not touched(f[2], f[3])):
        if all(y + 1 < i or j + 1 < x for x, y in kept):
            kept.append((i, j))
            out.append((words[i][1], name, -loss))
    return out


def test_windows_of_random_mixtures(docs_of):
    import random

    rnd = random.Random(11)
    own = {
        "short": "Released under the Sample License.", "notice": "Permission is granted to copy, modify and sell this thing, provided that this notice stays in all copies of the thing.",
        "twin": "Permission is granted to copy, modify and sell this thing, provided that this text stays in all copies of the thing.", "repeats": "one two one two one two three four five one two",
    }
    noise = ["the", "License", "copy", "one", "two", "x", "thing", "of", "code", "=", "//", "*", "permission", "under"]
    texts = []
    for _ in range(160):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            parts += [rnd.choice(noise) for _ in range(rnd.randrange(12))]
            if rnd.random() < 0.7:
                words = rnd.choice(list(own.values())).split()
                for _ in range(rnd.randrange(3)):
                    at = rnd.randrange(len(words))
                    words[at : at + rnd.randrange(2)] = [rnd.choice(noise)] * rnd.randrange(2)
                parts += words
        glue = rnd.choice([[" "], [" ", " ", "\n"], [" ", "\n", "\n// "], [" ", " ", " ", "\n * "]])
        texts.append("".join(w + rnd.choice(glue) for w in parts))
    got: dict[int, list] = {}
    for r in licences.licence_scan(docs_of([*enumerate(texts)]), own).collect():
        got.setdefault(r.doc_id, []).append((r.unit, r.licence, round(r.dice, 9)))
    want = {i: sorted((u, n, round(d, 9)) for u, n, d in expected(t, own)) for i, t in enumerate(texts)}
    assert {i: sorted(g) for i, g in got.items()} == {i: w for i, w in want.items() if w}
    assert sum(len(w) for w in want.values()) > 100 and {n for w in want.values() for _, n, _ in w} == set(own)


def test_templates_of_a_table(spark, docs_of):
    import random

    import pytest

    rnd = random.Random(5)
    full = [" ".join(f"w{rnd.randrange(300)}" for _ in range(700)) for _ in range(2)]
    table = spark.createDataFrame([("A", full[0]), ("B", full[1]), ("C", "This thing is free."), (None, "x"), ("D", None), ("C", "This thing is free of charge.")], "name string, text string")
    known = licences.templates_of(table)
    assert set(known) == {"A", "B", "C"} and known["C"] == "This thing is free of charge."
    body = full[0].split()
    texts = ["code before\n" + "\n".join(" ".join(body[i : i + 9]) for i in range(0, 700, 9)) + "\nand a long end " + "y z " * 900, full[1], "This thing is free of any charge.", "nothing"]
    assert {(r.doc_id, r.licence) for r in licences.licence_scan(docs_of([*enumerate(texts)]), known).collect()} >= {(0, "A"), (1, "B")}
    with pytest.raises(ValueError, match="words"):
        licences.templates_of(table, 1000)


def test_piece_codec(docs_of, awkward):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = piece_codec.encode_pieces(docs_of(awkward), path)
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.parity) for r in encoded.collect()), key=str)
    assert got == sorted(((i, library.encode(t or ""), True) for i, t in awkward), key=str)
    digest = piece_codec.decoded_digest(encoded, path).collect()
    assert len(digest) == len(awkward) and all(r.round_trip and r.parity for r in digest)


def test_piece_codec_on_runs_and_random_texts(docs_of):
    """Ids and texts equal the library's, also where merges of one piece have ranks of their own."""
    import random

    path, rnd = public_tokenizers.path("piece_bpe_32k.model"), random.Random(8)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [c * n for c in (" ", "\t", "-", "▁", "=") for n in range(1, 65)] + [f"def f():\n{' ' * n}return {n}" for n in range(1, 65)]
    some = [*"abc \t\n.-=é漢😀▁", "    ", "=====", "</s>"]
    texts += ["".join(rnd.choice(some) * rnd.choice([1, 1, 1, 7, 16]) for _ in range(12)) for _ in range(2000)]
    encoder, decoder = piece_codec.PieceEncoder(path), piece_codec.PieceDecoder(path)
    ids, parity = zip(*encoder.encode(texts))
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == library.encode(texts)
    assert not all(parity)  # the rebuilt merges alone would differ, and say so
    assert decoder.decode([*ids]) == [t.replace("▁", " ") for t in texts]
    free = [[rnd.randrange(3, 259 if rnd.random() < 0.5 else 32_000) for _ in range(20)] for _ in range(500)]
    assert decoder.decode([np.array(i, "<u4").tobytes() for i in free]) == decoder.tokenizer.decode_batch(free, skip_special_tokens=False)
    digest = piece_codec.decoded_digest(piece_codec.encode_pieces(docs_of([*enumerate(texts[:200])]), path), path).collect()
    assert all(r.round_trip for r in digest)


def test_full_tokenizer_is_rebuilt(awkward):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    full = piece_codec.rebuilt(PieceModel.load(path))
    for _, text in awkward[:24]:
        ids = library.encode(text or "")
        assert full.encode(text or "", add_special_tokens=False).ids == ids
        assert full.decode(ids, skip_special_tokens=False) == library.decode(ids)


def _field(number, value):
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    if isinstance(value, int):
        key = number << 3
        return (bytes([key]) if key < 128 else bytes([key & 127 | 128, key >> 7])) + bytes([value])
    return bytes([number << 3 | 2, len(value)]) + value


def test_unigram_model_is_rebuilt():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -4.0, 1), ("▁ab", -5.0, 1), ("ba", -5.5, 1)]
    data = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in pieces)
    data += _field(2, _field(3, 1) + _field(35, 1)) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 1) + _field(5, 1))
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    full = piece_codec.rebuilt(PieceModel.parse(data))
    for text in ("ab", "abba  ab", " a ", "aé b", "bab ab"):
        assert full.encode(text, add_special_tokens=False).ids == library.encode(text), text


def test_notices_inside_long_texts_are_found(docs_of):
    import textwrap

    def wrapped(name, width):
        return "\n".join(textwrap.wrap(licences.TEMPLATES[name], width))

    prose = "\n".join(f"some other words of line {i} that say nothing at all" for i in range(200))
    within = " ".join(f"filler{i}" for i in range(300))
    names = ["MIT-text", "ISC", "GPL-3.0-header", "MPL-2.0"]
    rows = [(i, f"{prose}\n{wrapped(name, 60)}\n{prose}") for i, name in enumerate(names)]
    rows += [(10, f"{within} Released under the MIT License. {within}"), (11, f"{within}\n{wrapped('ISC', 50)}\nx y\n{within}\n{wrapped('ISC', 70)}")]
    rows += [(12, f"{prose}\nLicensed under the Apache License, Version 2.0.\n{prose}"), (13, prose), (None, f"{prose}\n{wrapped('MPL-2.0', 40)}\n{prose}")]
    got = sorted(((r.doc_id, r.unit, r.licence) for r in licences.licence_scan(docs_of(rows)).where("dice > 0.95").collect()), key=str)
    isc = 1 + len(wrapped("ISC", 50).split("\n")) + 2
    want = [(i, 200, name) for i, name in enumerate(names)] + [(10, 0, "MIT"), (11, 1, "ISC"), (11, isc, "ISC"), (12, 200, "Apache-2.0"), (None, 200, "MPL-2.0")]
    assert got == sorted(want, key=str)


def test_words_that_any_window_holds():
    for name, bigrams in licences.template_bigrams(licences.TEMPLATES).items():
        least = -(-2 * len(bigrams) // 3)
        words = licences._cover(bigrams, least)
        assert sum(not set(words) & set(b.split(" ")) for b in bigrams) < least, name
