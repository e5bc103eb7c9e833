"""Repeated passages by hashes of lines or sentences and of windows of words.

Units are lines, or the sentences of each line. Normalised units are grouped by digest
over all documents and the earliest one by (doc_id, place) stays; later ones, in runs
that may have to have some length, are removed, with their offsets in the original text.

Passages that begin or end inside a unit are found by windows of WINDOW words:
each window that has occurred before is removed, so every repeat of so many words
goes, to the word. Windows are not compared one by one: each has an anchor, the
smallest hash among its grams of GRAM words, and neighbours with the same anchor form
a stretch. Equal windows have equal anchors, so stretches whose anchor occurs once go
no further, a stretch that has occurred before goes as a whole, and single windows are
compared only where an anchor has unlike stretches, that is at the ends of passages,
once for each kind of stretch. Both sets of anchors, and that of lines that occur more
than once, are filters of fixed size. A full filter costs time, never a passage.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shipgauge.llm.encoding import slices
from shipgauge.llm.frames import Rows, Stored, documents, materialize, position
from shipgauge.llm.words import mix64

# Sentences of fewer words are not compared; they do not break a run either. A line has one word at least.
UNIT_WORDS = 3
# A run of sentences is removed from this many words on; lines go whatever their length (1).
RUN_WORDS = 30
# Texts that a task takes apart at a time.
SLICE_BYTES = 3 << 20
# Distinct words whose hashes a task keeps from one slice to the next.
KNOWN_WORDS = 1 << 18
# Words of a window, and of the grams among which its anchor is the smallest.
WINDOW = 50
GRAM = 20
# Bits of each of three filters, 16 MB.
FILTER_BITS = 1 << 27
# A stretch's unit is -1; windows are null unless they may have to be compared.
UNITS = "doc_id long, row long, unit int, begin int, finish int, words int, word int, digest binary, anchor long, windows array<struct<digest:bigint,begin:int,finish:int>>"
_KINDS = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.int64(), pa.list_(pa.struct([("digest", pa.int64()), ("begin", pa.int32()), ("finish", pa.int32())]))]
_CUT = re.compile(r"[.!?]+\s+|\n\s*")
_WORD = re.compile(r"\S+")
_LINE = re.compile(r"\S(?:[^\n]*\S)?")
_NO_ID = (1 << 63) - 1


def text_lines(text: str):
    """begin, end, words and normalised form (letter case and white space aside) of each line that has a word."""
    for m in _LINE.finditer(text):
        words = m.group().lower().split()
        yield m.start(), m.end(), len(words), " ".join(words)


def text_units(text: str):
    """begin, end, words and normalised form of each sentence of a text; offsets in characters."""
    at = 0
    for cut in [*((m.start(), m.end()) for m in _CUT.finditer(text)), (len(text), len(text))]:
        words = text[at:cut[0]].lower().rstrip(".!?").split()
        if len(words) >= UNIT_WORDS:
            end = cut[0]
            while end < cut[1] and not text[end].isspace():
                end += 1
            yield at, end, len(words), " ".join(words)
        at = cut[1]


def _units(filters, lines: bool):
    """Lines or sentences of all texts, and their stretches that may repeat."""
    names = ["doc_id", "row", "unit", "begin", "finish", "words", "word", "digest", "anchor", "windows"]

    def run(batches):
        repeated, unlike, twice = filters.value
        known = _Known()
        twice = memoryview(twice)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                rows = list(zip(*(part.column(c).to_pylist() for c in ("doc_id", "row", "text"))))
                out = [[] for _ in names]
                h, bounds = _word_hashes([t for *_, t in rows], known)
                starts, ends, anchors = _stretches(h, bounds)
                live = _inside(repeated, anchors)
                found = starts[live], ends[live], _inside(unlike, anchors[live]), anchors[live].view(np.int64)
                limits, raw, bounds = np.searchsorted(found[0], bounds).tolist(), memoryview(h).cast("B"), bounds.tolist()
                for (doc_id, row, text), first, end, low, high in zip(rows, bounds, bounds[1:], limits, limits[1:]):
                    at, word, before = 0, 0, 0
                    for k, (a, b, n, plain) in enumerate(text_lines(text) if lines else text_units(text)):
                        # All words of a text are in its lines, not all in its sentences.
                        word += before if lines else len(text[at:a].split())
                        at, before = a, n
                        if lines:
                            bit = _line_hash(plain) % FILTER_BITS
                            if not twice[bit >> 3] >> (bit & 7) & 1:
                                continue
                        for column, v in zip(out, (doc_id, row, k, a, b, n, word, xxhash.xxh3_128_digest(plain), None, None)):
                            column.append(v)
                    if low == high:
                        continue
                    spans = [m.span() for m in _WORD.finditer(text)]
                    single = found[2][low:high].any()
                    windows = _joined(h[first:end], WINDOW).view(np.int64) if single else None
                    for a, b, one, anchor in zip(*(x[low:high].tolist() for x in found)):
                        digest = xxhash.xxh3_128_digest(raw[8 * a:8 * (b + WINDOW - 1)])
                        a, b = a - first, b - first
                        last = b + WINDOW - 1  # words a to last - 1
                        own = [dict(digest=d, begin=spans[i][0], finish=spans[i + WINDOW - 1][1]) for i, d in enumerate(windows[a:b].tolist(), a)] if one else None
                        values = doc_id, row, -1, spans[a][0], spans[last - 1][1], last - a, a, digest, anchor, own
                        for column, v in zip(out, values):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, _KINDS)], names=names)

    return run


def _stretches(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window + 1 and anchor of each stretch of all texts; those of a text begin with its words."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _sliding(_joined(h, GRAM), WINDOW - GRAM + 1, np.minimum)
    some = bounds[1:] > bounds[:-1]
    firsts, lasts = bounds[:-1][some], bounds[1:][some] - WINDOW + 1
    # Windows that reach into the next text are none.
    inside = np.zeros(len(least) + 1, np.int8)
    inside[firsts] += 1
    inside[lasts] -= 1
    new = np.append(True, least[1:] != least[:-1])
    new[firsts] = True
    starts = np.flatnonzero(new & np.cumsum(inside[:-1], dtype=np.int8).astype(bool))
    own = lasts[np.searchsorted(firsts, starts, "right") - 1]
    return starts, np.minimum(np.append(starts[1:], len(h)), own), least[starts]


def _inside(bits: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    at = (anchors % np.uint64(FILTER_BITS)).astype(np.int64)
    return ((bits[at >> 3] >> (at & 7)) & 1).astype(bool)


def _sliding(values: np.ndarray, n: int, take) -> np.ndarray:
    """The smallest (np.minimum) or largest (np.maximum) of each n neighbours."""
    width = 1
    while width * 2 <= n:
        values, width = take(values[:-width], values[width:]), width * 2
    return take(values[:len(values) - (n - width)], values[n - width:]) if n > width else values


def _joined(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each n neighbours."""
    out, width, left = None, 1, n
    at = 0
    while left:
        if left & 1:
            end = len(h) - (n - at - width) if n > at + width else len(h)
            piece = h[at:end]
            if out is None:
                out = piece
            else:
                m = min(len(out), len(piece))
                out = mix64(out[:m] * np.uint64(0x9E3779B97F4A7C15) + piece[:m])
            at += width
        left >>= 1
        if left:
            h, width = mix64(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:]), width * 2
    return out


class _Known(dict):
    """Hashes of words in lower case, sentence ends left out."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.rstrip(".!?") or word)
        return h


def _word_hashes(texts: list[str], known: _Known) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts that have a window, and where each text begins in them (one more than texts)."""
    if len(known) > KNOWN_WORDS:
        known.clear()
    parts, bounds = [np.zeros(0, np.uint64)], [0]
    for text in texts:
        words = text.lower().split()
        n = len(words) if len(words) >= WINDOW else 0
        if n:
            parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, n))
        bounds.append(bounds[-1] + n)
    return np.concatenate(parts), np.array(bounds, np.int64)


def _line_hash(plain: str) -> int:
    return xxhash.xxh3_64_intdigest(plain)


def _line_hashes(batches):
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            own = np.array([_line_hash(plain) for text in part.column("text").to_pylist() for *_, plain in text_lines(text)], np.uint64)
            hashes, n = np.unique(own, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], names=["anchor", "n"])


def _anchors(batches):
    """Anchor and digest of every stretch, and whether a window comes twice in it."""
    known = _Known()
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            h, bounds = _word_hashes(part.column("text").to_pylist(), known)
            starts, ends, anchors = _stretches(h, bounds)
            raw, places = memoryview(h).cast("B"), list(zip(starts.tolist(), ends.tolist()))
            digests = [xxhash.xxh3_64_intdigest(raw[8 * a:8 * (b + WINDOW - 1)]) for a, b in places]
            windows, loops = _joined(h, WINDOW) if len(h) else h, np.zeros(len(places), bool)
            limits = np.searchsorted(starts, bounds).tolist()
            for first, end, low, high in zip(bounds.tolist(), (bounds[1:] - WINDOW + 1).tolist(), limits, limits[1:]):
                ranked = np.sort(windows[first:max(first, end)])
                if (ranked[1:] == ranked[:-1]).any():
                    loops[low:high] = [len(np.unique(windows[a:b])) < b - a for a, b in places[low:high]]
            columns = anchors.view(np.int64), np.array(digests, np.uint64).view(np.int64), loops
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "digest", "loop"])


def _filters(texts: DataFrame, lines: bool) -> list[np.ndarray]:
    """As bytes, a bit for each anchor that occurs more than once, each that has unlike stretches, and each line that comes more than once."""
    found = texts.select("text").mapInArrow(_anchors, "anchor long, digest long, loop boolean").groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), (F.min("digest") != F.max("digest")).alias("unlike"), F.max("loop").alias("loop"))
    one = F.expr("shiftleft(1L, cast(pmod(anchor, 32) as int))")
    other = F.when(F.col("unlike") | F.col("loop"), one).otherwise(F.lit(0))
    out = _bits(found.where((F.col("n") > 1) | F.col("loop")), repeated=one, unlike=other)
    if lines:
        of_lines = texts.select("text").mapInArrow(_line_hashes, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
        return out + _bits(of_lines.where("n > 1"), twice=one)
    return [*out, np.zeros(0, np.uint8)]


def _bits(anchors: DataFrame, **masks: Column) -> list[np.ndarray]:
    cell = F.shiftright(F.pmod(F.col("anchor"), F.lit(FILTER_BITS)), 5).alias("cell")
    cells, out = anchors.groupBy(cell).agg(*[F.bit_or(m).alias(n) for n, m in masks.items()]).toArrow(), []  # at most FILTER_BITS / 32 rows
    for name in masks:
        of = np.zeros(FILTER_BITS // 32, "<u4")
        of[cells.column("cell").to_numpy()] = cells.column(name).to_numpy().astype(np.uint32)
        out.append(of.view(np.uint8))
    return out


def _place() -> Column:
    return F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.col("row").alias("row"), F.col("begin").alias("begin"))


def _later(units: DataFrame) -> DataFrame:
    """Of units with equal digests, all but the first."""
    firsts = units.groupBy("digest").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return units.join(firsts, "digest").where(_place() != F.col("first")).drop("digest")


def _single_windows(units: DataFrame) -> DataFrame:
    """The windows of the first stretch of each kind, where an anchor has unlike ones; of the others the one that says where they occur first."""
    able = units.where("windows IS NOT NULL")
    firsts = able.groupBy("digest").agg(F.min(_place()).alias("first")).select("digest", F.col("first.row").alias("row"), F.col("first.begin").alias("begin"), F.lit(True).alias("head"))
    windows = F.when(F.col("head"), F.col("windows")).otherwise(F.slice("windows", 1, 1))
    own = able.join(firsts, ["digest", "row", "begin"], "left").select("doc_id", "row", "word", F.posexplode(windows).alias("k", "w"))
    return own.select(
        "doc_id", "row", F.lit(-1).alias("unit"), F.col("w.begin").alias("begin"), F.col("w.finish").alias("finish"),
        F.lit(WINDOW).alias("words"), (F.col("word") + F.col("k")).alias("word"), F.col("w.digest").alias("digest"))


def _runs(texts: DataFrame, run_words: int, lines: bool) -> DataFrame:
    """The runs that go, from doc_id, row and text; where sentences and windows overlap, as one. Digests move, texts do not."""
    units = Stored(texts.mapInArrow(_units(texts.sparkSession.sparkContext.broadcast(_filters(texts, lines)), lines), UNITS), "units", "zstd").df
    later = _later(units.drop("anchor", "windows")).unionByName(_later(_single_windows(units))).withColumn("window", F.col("unit") < 0)
    by_word = W.partitionBy("row", "window").orderBy("word", "words")  # within one document
    end = F.col("word") + F.col("words")
    apart = F.coalesce((F.col("word") > F.max(end).over(by_word.rowsBetween(W.unboundedPreceding, -1))).cast("long"), F.lit(0))
    numbered = later.withColumns({"apart": apart, "n": F.row_number().over(by_word)})
    run = F.when(F.col("window"), F.sum("apart").over(by_word.rowsBetween(W.unboundedPreceding, 0))).otherwise((F.col("unit") - F.col("n")).cast("long"))
    words = F.when(F.col("window"), F.max(end) - F.min("word")).otherwise(F.sum("words"))
    runs = numbered.withColumn("run", run).groupBy("row", "window", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("begin").alias("begin"), F.max("finish").alias("finish"),
        F.sum((~F.col("window")).cast("long")).alias("units"), words.alias("words"), F.min("word").alias("word"), F.min(F.struct("word", "first")).alias("head"))
    order = W.partitionBy("row").orderBy("begin", F.desc("finish"), "window")  # within one document
    before = order.rowsBetween(W.unboundedPreceding, -1)
    new = F.coalesce((F.col("begin") >= F.max("finish").over(before)).cast("int"), F.lit(1))
    # Of a run that overlaps earlier ones, the words beyond them.
    more = F.greatest(F.lit(0), F.least(F.col("words"), end - F.coalesce(F.max(end).over(before), F.lit(0))))
    placed = runs.where(F.col("window") | (F.col("words") >= run_words)).withColumns({"new": new, "more": more})
    rank = F.struct("begin", -F.col("finish"), "window")
    return placed.withColumn("span", F.sum("new").over(order)).groupBy("row", "span").agg(
        F.first("doc_id").alias("doc_id"), F.min("begin").alias("begin"), F.max("finish").alias("finish"), F.sum("units").alias("units"),
        F.sum(F.when(F.col("new") == 1, F.col("words")).otherwise(F.col("more"))).alias("words"), F.min_by("head.first", rank).alias("first"))


def repeated_passages(docs: DataFrame, run_words: int = RUN_WORDS, lines: bool = False) -> DataFrame:
    """One row per removed run: doc_id, begin, finish, units, words, first_doc_id, first_begin.

    begin and finish are character offsets in the original text, finish excluded;
    units are the lines or sentences in a run, 0 where it lies within them, and words the
    words of these and of repeated windows. Whatever repeats 50 words or more goes, line
    ends and sentence ends aside. Of shorter repeats go runs of whole sentences from
    ``run_words`` on; with ``lines`` units are lines, and with ``run_words`` 1 every line
    goes that is, letter case and white space aside, one that has come before. first_doc_id and first_begin are where the run's first unit or
    window occurs first, which stays and may lie in the same document. Documents rank by doc_id (null last),
    repeated rows by their place in the table. Null and empty texts have no units; a
    document without repeated runs and an empty table give no rows. Other columns
    are not looked at.
    """
    texts = documents(docs).withColumn("row", F.monotonically_increasing_id())
    return _runs(texts.select("doc_id", "row", "text"), run_words, lines).select(
        "doc_id", "begin", "finish", "units", "words",
        F.nullif(F.col("first.id"), F.lit(_NO_ID)).alias("first_doc_id"), F.col("first.begin").alias("first_begin"))


def drop_passages(docs: DataFrame, run_words: int = RUN_WORDS, lines: bool = False) -> DataFrame:
    """``docs`` with the removed runs cut out of their texts; all rows and columns stay."""
    rows = Rows(docs)
    kept = materialize(rows.df.withColumn("row", F.monotonically_increasing_id()), "texts")
    text = rows.col("text").cast("string")
    source = kept.select(rows.col("doc_id").cast("long").alias("doc_id"), "row", F.coalesce(text, F.lit("")).alias("text"))
    spans = _runs(source, run_words, lines).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("begin", "finish"))).alias("spans"))
    # The pieces between the runs: after each run up to the next one's begin.
    starts = F.concat(F.array(F.lit(0)), F.expr("transform(spans, s -> s.finish)"))
    ends = F.concat(F.expr("transform(spans, s -> s.begin)"), F.array(F.char_length(text)))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.substring(text, p["a"] + 1, p["b"] - p["a"]))
    name = rows.inner[position(docs, "text")]
    cut = F.when(F.col("spans").isNull(), text).otherwise(F.array_join(pieces, ""))
    return rows.restore(kept.join(spans, "row", "left").withColumn(name, cut))
