"""Small document tables with the awkward rows that every operator must take."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, key string, h long, pos int, n long"


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and long texts, copies, near copies, repeated rows, clashing column names."""
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta.", "é", "ﬁn", "loser", "x", "1.5", "漢字", "l'eau", "don't"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    long_line = "a line that many documents hold, over twenty characters"
    base = text(120)
    texts = [None, "", " ", "\n\n", "a", "A", "  a b ", "ab", base, base, base + " ", base.replace("alpha", "omega", 1)]
    texts += [text(n) for n in (3, 4, 5, 50, 400, 2000)]
    texts += [f"{text(5)}\n{long_line}\n {long_line.upper()}\t\n{text(7)}\n" for _ in range(6)]
    texts += ["z" * 5000, "ab" * 3000, "    x\x1cy \r\n\t end", "<s> <|endoftext|> </s>", "▁▁ a  b   c "]
    ids = [*range(0, 7 * len(texts), 7)]
    ids[3] = None
    rows = list(zip(ids, texts))
    rows += [rows[8], rows[8], (10_000, base), (ids[15], texts[15])]
    return rows


@pytest.fixture
def docs_of(spark):
    def make(rows):
        full = [(i, t, "en", "clash", 1, 2, 3) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make
