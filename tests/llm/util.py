"""Small fixtures and brute-force versions."""

import random

import public_tokenizers

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
# Column names that operators use inside, and one that differs from another only in case.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, row long, digest string, TEXT string, rank int, kept int, m_tokens int, content string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=DOCS):
    width = len(schema.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


def clashing(spark, rows):
    """The same rows with twelve columns; the config lets names differ only in case."""
    wide = [(d, t, "en", "s", 1, 7, "x", "other", 3, 4, 5, "y") for d, t, *_ in rows]
    return docs(spark, wide, CLASH)


def awkward():
    """Nulls, empty and blank texts, repeats, a very long text, special strings, odd white space."""
    rnd = random.Random(3)
    words = [w + s for w in ("alpha", "Béta", "gamma", "delta's", "日本", "x1y2") for s in ("", ".", "!!", "é")]
    long = " ".join(rnd.choice(words) for _ in range(30_000))
    return [
        (1, "Hello <|endoftext|> World  and\tmore\n\nlines ", "en"), (2, None, "en"), (3, "", None), (4, "   ", "de"), (5, long, "fr"),
        (6, "Hello world", "en"), (6, "Hello world", "en"), (7, "HELLO WORLD", "en"), (None, "no id", "en"), (None, None, None),
        (8, "a" * 3000, "en"), (9, "12 34 !! ??", "en"), (10, "\x1c tab\x0bs and spaces", "en"),
    ]


def sentence(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))
