"""Phrases of words by vertical partitioning of word suffixes.

The suffixes of all pieces, cut off after DEPTH words, are dealt into groups by their
first words, so that a group's suffix tree fits a memory budget and is built on its
own (Mansour et al., ERA). A prefix is one word; where a word begins too many
suffixes, two; where a pair does, all DEPTH. A group's tree is its sorted suffixes
with their common prefixes: a node's count is the total of the leaves below it.
Only phrases shorter than their group's prefix are spread over groups, and added up.

A phrase is frequent only if its words and neighbouring pairs are. Both sets are bit
filters of bounded size, by which tasks leave out suffixes that reach no frequent
pair. A full filter costs time, never a phrase, since trees count exactly.
Words go as 64-bit hashes of language and word; a pass over the word table makes sure
that no two share one, and takes another seed if they do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shipgauge.llm.encoding import slices
from shipgauge.llm.frames import Stored, materialize, pick
from shipgauge.llm.words import mix64

DEPTH = 5
LEAST = 100
TOP = 2_000
# Suffixes of a group, and of the rows that a task holds before it passes them on.
BUDGET = 1 << 18
# Text that is cut into words at once; places, pieces and hashes take some 20 times as much.
TEXT_BYTES = 2 << 20
# Bits of a filter: 16 a key, at most 2 ** FILTER_LOG.
FILTER_LOG = 26
WORD_COUNTS = "h long, lang string, word string, n long"

_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of all texts (under 2 GB) as bytes, the piece of each (numbers differ between pieces) and its text."""
    raw = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    kind = _KIND[data]
    inside = kind == 0
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    begins = begins[:-1]
    start = inside.copy()
    start[1:] &= ~inside[:-1] | begins[1:]
    at = np.flatnonzero(start)
    piece = np.cumsum((kind == 2) | begins, dtype=np.int32)[at]
    kept = _LOWER[data[inside]]
    bounds = np.append(np.cumsum(inside, dtype=np.int32)[at] - 1, len(kept)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
    return words, piece, np.searchsorted(offsets, at, side="right") - 1


def word_hash(lang: str, word: bytes, seed: tuple[int, int]) -> int:
    """Of a seed and a number of bits; never 0, which stands for no word."""
    name = lang.encode()
    return xxhash.xxh3_64_intdigest(len(name).to_bytes(4, "big") + name + word, seed[0]) >> (64 - seed[1]) or 1


class Coded:
    """A slice of documents: the hash and the piece of each word, and how often each distinct one occurs."""

    def __init__(self, batch: pa.RecordBatch, seed: tuple[int, int], count: bool = False):
        words, self.piece, text = split_words(batch.column("text"))
        langs = batch.column("lang").dictionary_encode()
        coded, names = words.dictionary_encode(), langs.dictionary.to_pylist()
        both = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(names))
        both += langs.indices.to_numpy(zero_copy_only=False)[text]
        n = np.bincount(both, minlength=1)
        used = np.flatnonzero(n)
        table = coded.dictionary.to_pylist()
        hashes = np.array([word_hash(names[k % len(names)], table[k // len(names)], seed) for k in used.tolist()], np.uint64)
        at = np.zeros(len(n), np.int64)
        at[used] = np.arange(len(used))
        self.hashes = hashes[at[both]] if len(both) else np.zeros(0, np.uint64)
        if count:
            self.counts = pa.table({
                "h": hashes.view(np.int64), "lang": pa.array([names[k % len(names)] for k in used.tolist()], pa.string()),
                "word": pa.array([table[k // len(names)] for k in used.tolist()], pa.binary()).cast(pa.string()), "n": n[used].astype(np.int64)})


class Bits:
    """Keys that are frequent, as a bit array with two places a key; now and then it also holds another."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for place in (keys & self.mask, (keys >> np.uint64(32)) & self.mask):
            out &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return out

    @staticmethod
    def of(keys: DataFrame, column: str) -> Bits:
        log = min(max(math.ceil(math.log2(keys.count() * 16 + 1)), 10), FILTER_LOG)
        mask = F.lit((1 << log) - 1)
        places = keys.select(F.explode(F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(column, 32).bitwiseAND(mask))).alias("p"))
        slots = places.groupBy(F.shiftright("p", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
        words = np.zeros(1 << (log - 6), np.uint64)
        words[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy().view(np.uint64)
        return Bits(words)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(mix64(a) * np.uint64(31) + b)


def _word_counts(seed: tuple[int, int], held_rows: int):
    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                held.append(Coded(part, seed, count=True).counts)
                rows += held[-1].num_rows
                if rows > held_rows:
                    held = [_added(held)]
                    rows = held[0].num_rows
                    if rows > held_rows // 2:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from _added(held).to_batches()

    return run


def _added(tables: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(tables).group_by(["h", "lang", "word"]).aggregate([("n", "sum")])
    return total.rename_columns([c.removesuffix("_sum") for c in total.column_names]).select(["h", "lang", "word", "n"]).combine_chunks()


def _pair_counts(seed: tuple[int, int], words, held_rows: int):
    def run(batches):
        held, rows = [], 0

        def added():
            keys, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(n, first)

        def out(keys, n):
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                c = Coded(part, seed)
                known = words.value.has(c.hashes)
                both = known[:-1] & known[1:] & (c.piece[:-1] == c.piece[1:])
                if not both.any():
                    continue
                held.append(np.unique(pair_key(c.hashes[:-1][both], c.hashes[1:][both]), return_counts=True))
                rows += len(held[-1][0])
                if rows > held_rows:
                    held = [added()]
                    rows = len(held[0][0])
                    if rows > held_rows // 2:
                        yield out(*held[0])
                        held, rows = [], 0
        if held:
            yield out(*added())

    return run


def merged(rows: np.ndarray, n: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct rows and their added counts; ``more`` are columns that equal rows share."""
    order = np.lexsort([*rows.T[::-1], *more])
    rows, n, more = rows[order], n[order], [m[order] for m in more]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    at = np.flatnonzero(first)
    return rows[at], np.add.reduceat(n, at) if len(at) else n, *[m[at] for m in more]


def _suffixes(seed: tuple[int, int], pairs, hot_words, hot_pairs, groups: int, depth: int, held_rows: int):
    """Suffixes by group: distinct ones of a stretch of texts, sorted, as one binary row a group."""
    def dealt(held):
        rows = np.concatenate(held)
        first, second = mix64(rows[:, 0]), pair_key(rows[:, 0], rows[:, 1])
        whole = second.copy()
        for d in range(2, depth):
            whole = pair_key(whole, rows[:, d])
        wide = hot_words.value.has(rows[:, 0])
        full = wide & hot_pairs.value.has(second)
        prefix = np.where(full, whole, np.where(wide, second, first))
        group = (mix64(prefix) % np.uint64(groups)).astype(np.int32)
        need = np.where(full, depth, np.where(wide, 2, 1)).astype(np.uint8)
        rows, n, need, group = merged(rows, np.ones(len(rows), np.int64), need, group)
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        blobs = [pack(rows[a:b], n[a:b], need[a:b]) for a, b in zip(cuts, [*cuts[1:], len(rows)])]
        return pa.RecordBatch.from_arrays([pa.array(group[cuts], pa.int32()), pa.array(blobs, pa.binary())], names=["group", "suffixes"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                c = Coded(part, seed)
                if len(c.hashes) < 2:
                    continue
                good = np.zeros(len(c.hashes) + depth, bool)
                good[:len(c.hashes) - 1] = (c.piece[:-1] == c.piece[1:]) & pairs.value.has(pair_key(c.hashes[:-1], c.hashes[1:]))
                at = np.flatnonzero(good)
                if not len(at):
                    continue
                rows, on = np.zeros((len(at), depth), np.uint64), np.ones(len(at), bool)
                rows[:, 0] = c.hashes[at]
                for d in range(1, depth):
                    on = on & good[at + d - 1]
                    rows[on, d] = c.hashes[at[on] + d]
                held.append(rows)
                size += len(rows)
                if size > held_rows:
                    yield dealt(held)
                    held, size = [], 0
        if held:
            yield dealt(held)

    return run


def pack(rows: np.ndarray, n: np.ndarray, need: np.ndarray) -> bytes:
    return rows.T.astype("<u8").tobytes() + n.astype("<i8").tobytes() + need.astype("u1").tobytes()


def unpack(blob: bytes, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = len(blob) // (8 * depth + 9)
    rows = np.frombuffer(blob, "<u8", size * depth).reshape(depth, size).T
    return rows, np.frombuffer(blob, "<i8", size, 8 * depth * size), np.frombuffer(blob, "u1", size, (8 * depth + 8) * size)


def _tree(depth: int, least: int):
    """Totals of the nodes of a group's tree from the second word on.

    A node below the group's prefix is complete and goes on only if it is frequent;
    one above it goes on as its part of a total.
    """
    def run(table: pa.Table) -> pa.Table:
        rows, n, need = (np.concatenate(x) for x in zip(*(unpack(b, depth) for b in table.column("suffixes").to_pylist())))
        order = np.lexsort(rows.T[::-1])
        rows, n, need = rows[order], n[order], need[order]
        keys, totals = [], []
        new = np.zeros(len(rows), bool)
        new[0] = True
        for d in range(depth):
            new[1:] |= rows[1:, d] != rows[:-1, d]
            if d == 0:
                continue
            at = np.flatnonzero(new)
            total = np.add.reduceat(n, at)
            stay = (rows[at, d] > 0) & ((total >= least) | (need[at] > d + 1))
            keys += [k.tobytes() for k in rows[at[stay], :d + 1].astype(">u8")]
            totals.append(total[stay])
        return pa.table({"key": pa.array(keys, pa.binary()), "n": pa.array(np.concatenate(totals), pa.int64())})

    return run


def frequent_phrases(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, budget: int = BUDGET, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: words (key, lang, word, n) of every word, and phrases (key, n) of the frequent ones of 2 to ``depth`` words.

    A key is the words' hashes, 8 bytes each. Texts are read three times and never move.
    """
    spark = docs.sparkSession
    texts = pick(docs, text="string", lang="string").select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    seed = (0, bits)
    while True:
        counted = texts.mapInArrow(_word_counts(seed, budget), WORD_COUNTS).groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))
        table = Stored(counted, "words")
        if table.df.groupBy("h").count().where("count > 1").isEmpty():
            break
        table.drop()
        seed = (seed[0] + 1, bits)
    words = table.df.select(F.unhex(F.lpad(F.hex("h"), 16, "0")).alias("key"), "lang", "word", "n")
    share = spark.sparkContext.broadcast
    frequent = table.df.where(F.col("n") >= least)
    known = share(Bits.of(frequent, "h"))
    paired = Stored(texts.mapInArrow(_pair_counts(seed, known, budget), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "pairs")
    pairs = share(Bits.of(paired.df, "key"))
    # A prefix that begins more than a part of what a group may hold is made longer.
    hot_words = share(Bits.of(frequent.where(F.col("n") > budget // 4), "h"))
    hot_pairs = share(Bits.of(paired.df.where(F.col("n") > budget // 4), "key"))
    total = paired.df.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // budget))
    dealt = texts.mapInArrow(_suffixes(seed, pairs, hot_words, hot_pairs, groups, depth, budget), "group int, suffixes binary")
    nodes = dealt.groupBy("group").applyInArrow(_tree(depth, least), "key binary, n long")
    phrases = materialize(nodes.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")
    paired.drop()
    return words, phrases


def _size(key: str) -> Column:
    return (F.octet_length(key) / 8).cast("int")


def phrases(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` collocations of every language.

    Letters A to Z become lower-case; pieces end at any of ``.,;:!?`` and line ends,
    words at spaces and tabs. Everything is per language, a null one is ``und``. n is
    the number of all words, a how often the phrase (2 to ``depth`` words, within a
    piece) occurs, overlaps included, at least ``least``. Of a phrase's cuts into a
    first part (l) and a rest (r) the one with the smallest floor(1000 * a * n / (l * r))
    counts, then the shortest first part. A phrase that lies in a longer one as often
    as it occurs is dropped. Ranks go by score and a, both descending, then phrase.

    A null or empty text has no words; repeated rows count as often as they come, and
    so do texts of any length, whole. A word may hold any other character. doc_id is
    not looked at, nor is any further column; an empty table gives an empty result.
    Exact up to 10^15 occurrences of a phrase and 10^17 words of a language.
    """
    words, found = frequent_phrases(docs, depth, least, budget)
    counts = materialize(found.unionByName(words.where(F.col("n") >= least).select("key", "n")), "counts")
    longer = found.where(F.octet_length("key") > 16)
    inner = longer.select("n", F.explode(F.array(
        F.substring(F.col("key"), F.lit(1), F.octet_length("key") - 8), F.substring(F.col("key"), F.lit(9), F.octet_length("key") - 8))).alias("key"))
    covered = inner.groupBy("key").agg(F.max("n").alias("inside"))
    cuts = (
        found.join(covered, "key", "left").where("inside IS NULL OR inside < n")
        .select("key", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), _size("key") - 1)).alias("k"))
        .select("key", "a", "k", F.substring(F.col("key"), F.lit(1), F.col("k") * 8).alias("left"), F.substring(F.col("key"), F.col("k") * 8 + 1, F.octet_length("key")).alias("right")))
    parts = cuts.join(counts.select(F.col("key").alias("left"), F.col("n").alias("l")), "left").join(counts.select(F.col("key").alias("right"), F.col("n").alias("r")), "right")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    first = words.where(F.col("n") >= least).select(F.col("key").alias("first"), "lang")
    scored = (
        parts.withColumn("first", F.substring("key", 1, 8)).join(first, "first").join(sizes, "lang")
        .withColumn("score", F.expr(
            "bigint((cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))))"))
        .groupBy("lang", "n", "key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "key", "a", "cut.l", "cut.r", "n", "cut.score"))
    # All that can be among the first by score and a; texts of phrases decide only between the last ones.
    best = scored.withColumn("place", F.rank().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top)
    best = materialize(best.drop("place"), "best")
    spelled = (
        best.select("key", F.explode(F.sequence(F.lit(0), _size("key") - 1)).alias("i"))
        .select("key", "i", F.substring(F.col("key"), F.col("i") * 8 + 1, F.lit(8)).alias("word_key"))
        .join(words.where(F.col("n") >= least).select(F.col("key").alias("word_key"), "word"), "word_key")
        .groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return best.join(spelled, "key").withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
