"""Language by prediction by partial matching over bytes.

Per language a context tree counts which byte followed which 0 to ORDER bytes. A
byte's code length comes from the longest context in which it was seen; a context
in which it was not seen costs that context's escape (method C: an escape weighs as
much as the number of different bytes seen there), and a byte seen nowhere costs
the escapes and one of 256. The statistics do not change while texts are scored, so
a code length depends on the last ORDER + 1 bytes only and is computed once per
distinct group of bytes in a batch.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shipgauge.llm.encoding import slices
from shipgauge.llm.frames import Rows, documents, pick, position

ORDER = 4
# Documents learned from, per language: those with the smallest hashes of their ids. Whole texts count.
TRAIN_ROWS = 400
PARTS = 64
# Text scored at once: every byte of it takes some 60 bytes meanwhile.
SLICE_BYTES = 3 << 20
UND = "und"
PREDICTION = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """lang and text of at most ``rows`` documents per language that are not held out; repeated rows count once."""
    known = pick(docs, doc_id="long", text="string", lang="string").where(
        F.col("lang").isNotNull() & (F.col("lang") != UND) & F.col("text").rlike("\\p{L}") & ~held_out(F.col("doc_id")))
    known = known.withColumn("of_text", F.xxhash64("text"))
    keyed = known.select("lang", F.struct(F.xxhash64("doc_id").alias("hash"), F.col("doc_id").alias("id"), "of_text").alias("key")).distinct()
    # Rank filters, which Spark also applies before the shuffle: by parts of a language first, so that none is one task's.
    parts = W.partitionBy("lang", F.pmod(F.col("key.hash"), F.lit(PARTS))).orderBy("key")
    some = keyed.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= rows)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("key")))
    ids = ranked.where(F.col("rank") <= rows).select("lang", F.col("key.id").alias("doc_id"), F.col("key.of_text").alias("of_text"))
    # Rows per language at most, also where rows repeat.
    return known.join(F.broadcast(ids), ["lang", "doc_id", "of_text"]).dropDuplicates(["lang", "doc_id", "of_text"]).select("lang", "text")


class Model:
    """Sorted groups of bytes per order with, per language, code lengths and escapes in bits."""

    def __init__(self, langs: list[str], order: int, grams: list[np.ndarray], bits: list[np.ndarray], contexts: list[np.ndarray], escapes: list[np.ndarray]):
        self.langs, self.order = langs, order
        self.grams, self.bits, self.contexts, self.escapes = grams, bits, contexts, escapes

    def lengths(self, codes: np.ndarray, known: int | None = None) -> np.ndarray:
        """Code lengths of the last byte of each group; ``known``: preceding bytes that exist."""
        order = self.order if known is None else min(known, self.order)
        out = np.zeros((len(codes), len(self.langs)))
        open_ = np.ones(out.shape, bool)
        for k in range(order, -1, -1):
            gram = codes & np.uint64((1 << 8 * (k + 1)) - 1)
            found = _at(self.grams[k], gram)
            hit = np.where((found >= 0)[:, None], self.bits[k][found], np.inf)
            use = open_ & np.isfinite(hit)
            out[use] += hit[use]
            open_ &= ~use
            if not open_.any():
                return out
            place = _at(self.contexts[k], gram >> np.uint64(8))
            escape = np.where((place >= 0)[:, None], self.escapes[k][place], 0.0)
            out[open_] += escape[open_]
        out[open_] += 8.0
        return out


def _at(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(values), -1)
    i = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[i] == values, i, -1)


def _codes(data: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it, as one number; zeros before the first."""
    out = data.astype(np.uint64)
    for k in range(1, order + 1):
        out[k:] |= data[:-k].astype(np.uint64) << np.uint64(8 * k)
    return out


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and where each text begins (one more than texts)."""
    raw = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())])
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    return data, bounds - bounds[0]


def _count_grams(order: int):
    def run(batches):
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                texts = batch.column("text").filter(pc.equal(batch.column("lang"), lang))
                data, starts = _text_bytes(texts)
                codes, since = _codes(data, order), np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))
                for k in range(order + 1):
                    grams, n = np.unique(codes[since >= k] & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams)), pa.array(np.full(len(grams), k, np.int32)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "k", "gram", "n"])

    return run


def learn(rows: DataFrame, order: int = ORDER) -> Model:
    """Context trees from lang and text; of bounded size, as the rows are."""
    counts = (
        rows.mapInArrow(_count_grams(order), "lang string, k int, gram long, n long")
        .groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toArrow()
    )
    langs = sorted(set(counts.column("lang").to_pylist()))
    lang = pc.index_in(counts.column("lang").combine_chunks(), value_set=pa.array(langs, pa.string())).to_numpy(zero_copy_only=False)
    k, gram, n = (counts.column(c).to_numpy() for c in ("k", "gram", "n"))
    grams, bits, contexts, escapes = [], [], [], []
    for order_k in range(order + 1):
        own = k == order_k
        g, where = np.unique(gram[own].astype(np.uint64), return_inverse=True)
        table = np.zeros((len(g), len(langs)))
        table[where, lang[own]] = n[own]
        c, of = np.unique(g >> np.uint64(8), return_inverse=True)
        total, kinds = np.zeros((len(c), len(langs))), np.zeros((len(c), len(langs)))
        np.add.at(total, of, table)
        np.add.at(kinds, of, table > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            bits.append(np.log2((total + kinds)[of]) - np.log2(table))
            escapes.append(np.where(kinds > 0, np.log2(np.maximum(total + kinds, 1)) - np.log2(np.maximum(kinds, 1)), 0.0))
        grams.append(g)
        contexts.append(c)
    return Model(langs, order, grams, bits, contexts, escapes)


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Code length of every text under every language, in bits."""
    data, starts = _text_bytes(texts)
    out = np.zeros((len(texts), len(model.langs)))
    if not len(data):
        return out
    codes = _codes(data, model.order)
    since = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))
    coded = pa.array(codes).dictionary_encode()
    kinds = model.lengths(coded.dictionary.to_numpy(zero_copy_only=False))
    at = coded.indices.to_numpy(zero_copy_only=False)
    early = np.flatnonzero(since < model.order)  # their contexts are shorter
    early_bits = np.empty((len(early), len(model.langs)))
    for k in range(model.order):
        own = since[early] == k
        early_bits[own] = model.lengths(codes[early[own]], k)
    full = np.flatnonzero(np.diff(starts) > 0)
    for j in range(len(model.langs)):
        each = kinds[at, j]
        each[early] = early_bits[:, j]
        out[full, j] = np.add.reduceat(each, starts[full])
    return out


def _predict(model: Model):
    def run(batches):
        names = [c.split()[0] for c in PREDICTION.split(", ")]
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                text = part.column("text")
                bits, n = _scores(model, text), np.maximum(pc.binary_length(text).to_numpy(zero_copy_only=False), 1)
                best = bits.argmin(axis=1)
                least = bits.min(axis=1)
                share = 1 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(axis=1)
                worded = part.column("worded").to_numpy(zero_copy_only=False)
                lang = pa.array([model.langs[b] if w else UND for b, w in zip(best, worded)], pa.string())
                columns = [part.column("doc_id"), part.column("held_out"), lang, pa.array(np.where(worded, share, 0.0)), pa.array(np.where(worded, least / n, 0.0))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of every row of ``docs``.

    score is the probability of the language under equal priors, from the exact
    code lengths; bits_per_byte the best language's code length. A text that is
    null, empty or without a letter, and every text under a model of no language,
    is ``und`` with score 0. Repeated rows come out as often as they came in, a
    null doc_id stays null and is not held out. Only the text decides.
    """
    texts = documents(docs).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), F.col("text").rlike("\\p{L}").alias("worded"))
    if not model.langs:
        return texts.select("doc_id", "held_out", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    return texts.mapInArrow(_predict(model), PREDICTION)


def language_id(docs: DataFrame, train_rows: int = TRAIN_ROWS, order: int = ORDER) -> DataFrame:
    """Learn from the documents that are not held out and predict all of them."""
    return predict(docs, learn(training_rows(docs, train_rows), order))


def keep_known_languages(docs: DataFrame, train_rows: int = TRAIN_ROWS, order: int = ORDER) -> DataFrame:
    """The rows of ``docs`` that have a language; a null lang becomes the predicted one.

    Rejected are texts without a letter (null and empty ones too) and texts that no
    language codes in fewer than the 8 bits that a byte takes anyway. Where no row has
    a language to learn from, texts with a letter stay as they are. Repeated rows are
    decided alike, all columns are kept whatever their names, an empty table stays
    empty. A text is scored whole, at about 60 bytes of memory a byte.
    """
    model = learn(training_rows(docs, train_rows), order)
    rows = Rows(docs)
    text, lang = rows.col("text"), rows.inner[position(docs, "lang")]
    tagged = rows.df.withColumn("p_text", F.coalesce(text.cast("string"), F.lit(""))).withColumn("p_worded", F.col("p_text").rlike("\\p{L}"))
    schema = tagged.schema
    found = tagged.where("p_worded").mapInArrow(_accept(model, lang), schema) if model.langs else tagged.where("p_worded")
    return rows.restore(found)


def _accept(model: Model, lang: str):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "p_text", SLICE_BYTES):
                bits, n = _scores(model, part.column("p_text")), np.maximum(pc.binary_length(part.column("p_text")).to_numpy(zero_copy_only=False), 1)
                named = pa.array([model.langs[b] for b in bits.argmin(axis=1)], pa.string())
                i = part.schema.get_field_index(lang)
                filled = pc.coalesce(part.column(i), named.cast(part.schema.field(i).type))
                part = part.set_column(i, part.schema.field(i), filled)
                yield part.filter(pa.array(bits.min(axis=1) / n < 8.0))

    return run
