"""Encoding, token counts, shards and packing against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shipgauge.llm.encoding import Encoder
from shipgauge.llm.frames import new_path
from shipgauge.llm.packing import SumOfSquares, pack
from shipgauge.llm.token_counts import TokenCache, content_digest, token_counts
from shipgauge.llm.wavelet import WaveletMatrix, from_bytes, read_shards, to_bytes, token_shards, write_shards
from tests.llm.util import BYTE, WORD, awkward, clashing, docs

LIBRARY = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
ENCODERS = {p: Encoder(p) for p in (WORD, BYTE)}


def ids(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \n\t\r aAéÉß1'st.,\u0301\u2002\u3000\x1c\x85\u200bΣ日İﬁ<|>", "<|endoftext|>", "'s", " a"]), max_size=25).map("".join), max_size=4))
def test_words_one_after_the_other_are_the_text(path, texts):
    flat, starts = ENCODERS[path].encode(pa.array(texts, pa.string()))
    assert [flat[a:b].tolist() for a, b in zip(starts, starts[1:])] == [ids(path, t) for t in texts]
    assert ENCODERS[path].count(pa.array(texts, pa.string())).tolist() == [len(ids(path, t)) for t in texts]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_sliced_texts_and_known_words(path):
    """Slices of an array, texts without words and words met before give the library's ids."""
    texts = ["", "first words", None, "", "words\nfirst again", " ", "first", ""]
    whole, own = pa.array(texts), Encoder(path)
    for a, b in ((0, 8), (2, 5), (3, 4), (5, 8), (0, 0), (1, 7)):
        flat, starts = own.encode(whole[a:b])
        assert len(starts) == b - a + 1 and starts[-1] == len(flat) and flat.dtype == np.uint32
        assert [flat[x:y].tolist() for x, y in zip(starts, starts[1:])] == [list(ids(path, t)) for t in texts[a:b]]


def test_memo_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr("shipgauge.llm.encoding.MEMO_WORDS", 5)
    e = Encoder(WORD)
    for text in ("a b c d", "e f g h", "a b c d e f g h i", "i a"):
        assert e.encode(pa.array([text]))[0].tolist() == ids(WORD, text)


def test_sentencepiece_model():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    assert Encoder(path).encode(pa.array(["Hello  world", None]))[0].tolist() == own.encode("Hello  world")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_token_counts(spark, path):
    rows = awkward()
    cache = TokenCache(spark, new_path(spark, "cache"), path)
    got = token_counts(docs(spark, rows), path, cache, limit=10).collect()
    want = sorted(((d, len((t or "").encode()), len(ids(path, t))) for d, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 10) for r in got)


def test_only_distinct_misses_are_encoded_and_kept(spark):
    cache = TokenCache(spark, new_path(spark, "cache"), WORD)
    token_counts(docs(spark, [(1, "one two"), (2, "one  two"), (3, "three")]), WORD, cache).collect()
    assert cache.counts().count() == spark.read.parquet(cache.folder).count() == 2  # white space does not count
    # A stored count is used, not made again.
    planted = spark.createDataFrame([("four",)], "t string").select(content_digest(F.col("t"), True).alias("content"), F.lit(99).cast("long").alias("n_tokens"))
    cache.append(planted)
    got = token_counts(docs(spark, [(4, "four"), (5, "three"), (6, "five six")]), WORD, cache).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {4: 99, 5: 1, 6: 2}
    assert spark.read.parquet(cache.folder).count() == 4
    assert TokenCache(spark, cache.folder.rsplit("/", 1)[0], BYTE).counts().count() == 0  # another version has its own


def test_repeated_rows_are_encoded_once(spark):
    texts = ["one two", "three", "four five six"]
    rows = [(i % 3, texts[i % 3]) for i in range(81)] + [(None, "no id")] * 40
    cache = TokenCache(spark, new_path(spark, "cache"), WORD)
    got = token_counts(docs(spark, rows).repartition(4), WORD, cache).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(((d, len(ids(WORD, t))) for d, t in rows), key=str)
    assert spark.read.parquet(cache.folder).count() == cache.counts().count() == 4


def test_empty_tables(spark):
    none = docs(spark, [])
    assert token_counts(none, WORD, TokenCache(spark, new_path(spark, "cache"), WORD)).collect() == []
    assert pack(none, WORD).collect() == []
    assert token_shards(none, BYTE, new_path(spark, "shards")).collect() == []


def test_clashing_columns(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        wide = clashing(spark, awkward())
        n = len(awkward())
        assert token_counts(wide, WORD, TokenCache(spark, new_path(spark, "cache"), WORD)).count() == n
        assert token_shards(wide, BYTE, new_path(spark, "shards")).count() == n
        assert pack(wide, WORD).select("doc_id").distinct().count() == len({d for d, *_ in awkward()})
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


@pytest.mark.parametrize("high", [1, 2, 300, 65_536, 1 << 20])
def test_wavelet_matrix(high):
    x = np.random.default_rng(high).integers(0, high, 9001).astype(np.uint32)
    doc_ids, lengths, w = from_bytes(to_bytes([None, 5], np.array([9000, 1]), x))
    assert doc_ids == [None, 5] and lengths.tolist() == [9000, 1]
    assert (w.decode() == x).all() and (w.access(np.arange(len(x))[::-7]) == x[::-7]).all()
    for token in {int(x[0]), int(x[4100]), int(x[-1])}:
        places = np.flatnonzero(x == token)
        assert w.rank(token) == len(places) and w.rank(token, 4500) == (places < 4500).sum()
        assert [w.select(token, k) for k in (0, len(places) // 2, len(places) - 1)] == places[[0, len(places) // 2, -1]].tolist()
        with pytest.raises(IndexError):
            w.select(token, len(places))
    assert w.rank(1 << 30) == 0
    with pytest.raises(IndexError):
        w.access([9001])


@pytest.mark.parametrize("n", [1, 7, 8, 9, 4_095, 4_097])
@pytest.mark.parametrize("high", [2, 300, 1 << 16, 1 << 20])
def test_planes_are_stable_partitions(n, high):
    """Every plane holds a digit of the ids, ordered stably by each digit before; decoding gives the ids."""
    values = np.random.default_rng(n).integers(0, high, n).astype(np.uint32)
    matrix, at = WaveletMatrix.build(values), values.copy()
    for level, plane in enumerate(matrix.planes):
        bits = at >> (len(matrix.planes) - 1 - level) & 1
        assert np.unpackbits(plane, count=n, bitorder="little").tolist() == bits.tolist()
        at = np.concatenate([at[bits == 0], at[bits == 1]])
    assert matrix.decode().tolist() == values.tolist()


def test_wavelet_matrix_of_nothing():
    w = from_bytes(to_bytes([], np.zeros(0, np.int64), np.zeros(0, np.uint32)))[2]
    assert len(w.decode()) == 0 and w.rank(3) == 0


def test_token_shards(spark):
    rows = awkward()
    manifest = write_shards(docs(spark, rows), BYTE, new_path(spark, "shards"), shard_tokens=20_000)
    assert manifest.count() > 2
    got = sorted(read_shards(manifest).collect(), key=lambda r: r.start)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    at = 0
    for r, (d, t, _) in zip(got, sorted(rows, key=key), strict=True):
        all_ids = np.array([*ids(BYTE, t), 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(all_ids), zlib.crc32(all_ids.tobytes()))
        at += len(all_ids)


def check_pieces(pieces, rows, window):
    """Every id in exactly one piece, sequences gapless and padded little."""
    by_sequence = defaultdict(list)
    for r in pieces:
        by_sequence[r.sequence_id].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at & (at - 1) == 0
    want = defaultdict(int)
    for d, t, *_ in rows:
        want[d, len(ids(WORD, t)) + 1] += len(ids(WORD, t)) + 1
    got = defaultdict(int)
    for r in pieces:
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == want
    single = {d: t for d, t, *_ in rows if [x for x, *_ in rows].count(d) == 1}
    for d, t in single.items():
        all_ids, at = np.array([*ids(WORD, t), 2], "<u4"), 0
        for r in sorted((r for r in pieces if r.doc_id == d), key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(all_ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(all_ids)


def test_pack(spark):
    rows = awkward()
    for window in (64, 4096):
        check_pieces(pack(docs(spark, rows), WORD, window=window).collect(), rows, window)


def test_pack_of_many(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(("ab", "the", "of", "xyzzy")) for _ in range(rnd.randrange(90)))) for i in range(400)]
    check_pieces(pack(docs(spark, rows).repartition(3), WORD, window=100).collect(), rows, 100)


def test_sum_of_squares_is_least_at_every_step():
    rnd, window = random.Random(1), 30
    packer, counts = SumOfSquares(window), [0] * (window + 1)
    squares = lambda c: sum(x * x for x in c[1:window])
    for i in range(500):
        size = rnd.choice((3, 7, 11, 13, 29, 1))
        options = []
        for level in [0, *range(1, window - size + 1)]:
            if level and not counts[level]:
                continue
            after = counts.copy()
            after[level] -= level > 0
            after[level + size] += 1
            options.append((squares(after), -level, after))
        packer.place(((i, size), 0, np.zeros(size, np.uint32)))
        counts = min(options)[2]
        assert packer.counts[1:window].tolist() == counts[1:window]
    left = sum(len(p[2]) for pieces in packer.open.values() for w in pieces for p in w)
    assert sum(len(p[2]) for w in packer.close() for p in w) == left


