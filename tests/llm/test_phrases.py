"""Phrases against a brute-force count, whatever the size of groups and filters."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shipgauge.llm import phrases as ph
from tests.llm.util import awkward, clashing, docs


def brute(rows, least, top=2000, depth=5):
    counts, out = {}, set()
    for _, text, lang in rows:
        f = counts.setdefault(lang if lang is not None else "und", Counter())
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            f.update(tuple(w[i:i + m]) for m in range(1, depth + 1) for i in range(len(w) - m + 1))
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {s for p, a in found.items() for s in (p[:-1], p[1:]) if len(s) > 1 and f[s] == a}
        scored = []
        for p, a in found.items():
            if p in covered:
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n, -s))
    return out


def rows(seed=0, n=300):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ünd", "É", "the", "OF", "a\x1cb", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    fixed = ["Alpha beta gamma delta epsilon zeta", "the of the of the of", "x\ty  z"]
    out = []
    for i in range(n):
        parts = [" ".join(rnd.choices(words, weights, k=rnd.randrange(1, 40))) for _ in range(rnd.randrange(4))]
        parts += [rnd.choice(fixed) for _ in range(rnd.randrange(3))]
        rnd.shuffle(parts)
        out.append((i, rnd.choice([". ", "\n", " ", ",x;"]).join(parts), rnd.choice(["en", "de", None, "und"])))
    return out


def got(df, least, **more):
    return {tuple(r) for r in ph.phrases(df, least=least, **more).collect()}


@pytest.mark.parametrize("budget, log", [(1 << 18, 26), (40, 26), (4, 8)])
def test_phrases(spark, budget, log, monkeypatch):
    """Groups of any size, hot prefixes of one and two words, and full filters give the same."""
    monkeypatch.setattr(ph, "FILTER_LOG", log)
    data = rows() + [(i, t, l) for i, t, l in awkward()]
    assert got(docs(spark, data).repartition(5), 6, budget=budget) == brute(data, 6)


def test_first_of_each_language(spark):
    data = rows(1)
    assert got(docs(spark, data), 3, top=7) == brute(data, 3, 7)


def test_colliding_hashes_take_another_seed(spark):
    """With hashes of 2 bits most seeds give two of the words one; the table of words shows it."""
    data = [(i, "one two three. one two", "en") for i in range(5)]
    assert any(len({ph.word_hash("en", w, (s, 2)) for w in (b"one", b"two", b"three")}) < 3 for s in range(3))
    words, found = ph.frequent_phrases(docs(spark, data), least=3, bits=2)
    assert len({bytes(r.key) for r in words.collect()}) == 3 and sorted(r.n for r in found.collect()) == [5, 5, 10]


def test_empty_and_clashing(spark):
    assert got(docs(spark, []), 1) == set()
    assert got(docs(spark, [(1, None, None), (2, "", "en"), (3, " .,\n", "en")]), 1) == set()
    data = [(i, "so it goes, so it goes", "en") for i in range(3)]
    assert got(clashing(spark, data), 2) == brute(data, 2)


def test_one_long_text(spark):
    data = [(1, "never ending story " * 200_000, "en")]
    assert got(docs(spark, data), 100) == brute(data, 100)


def test_split_words():
    texts = pa.array(["Ab  cD.e", None, "", "\tx\x0by", ".", "z"])
    words, piece, text = ph.split_words(texts)
    assert words.to_pylist() == [b"ab", b"cd", b"e", b"x", b"y", b"z"] and text.tolist() == [0, 0, 0, 3, 3, 5]
    assert [a == b for a, b in zip(piece, piece[1:])] == [True, False, False, False, False]
    sliced, _, text = ph.split_words(texts[3:])
    assert sliced.to_pylist() == [b"x", b"y", b"z"] and text.tolist() == [0, 0, 2]


def test_bits():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64)
    words = np.zeros(1 << 10, np.uint64)
    b = ph.Bits(words)
    for k in keys.tolist():
        for p in (k & int(b.mask), (k >> 32) & int(b.mask)):
            words[p >> 6] |= np.uint64(1 << (p & 63))
    others = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    assert b.has(keys).all() and b.has(others).mean() < 0.01


def test_text_is_cut_into_words_in_small_parts(monkeypatch):
    """A batch of 8 MB never has the places of all its words in memory at once."""
    sizes, words = [], ph.split_words
    monkeypatch.setattr(ph, "split_words", lambda texts: sizes.append(texts.nbytes) or words(texts))
    text = "some words again and again " * 2_000
    batch = pa.record_batch({"text": pa.array([text] * 150), "lang": pa.array(["en"] * 150)})
    counted = pa.Table.from_batches(ph._word_counts((0, 64), ph.BUDGET)(iter([batch])))
    assert max(sizes) < 3 << 20 < sum(sizes)
    assert dict(zip(counted.column("word").to_pylist(), counted.column("n").to_pylist())) == {w: 300_000 * (1 + (w == "again")) for w in ("some", "words", "again", "and")}
