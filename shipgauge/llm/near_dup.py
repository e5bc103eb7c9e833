"""Near copies by order min-hash and banded alignment.

A document's k-mers of words carry their occurrence number, so repeats differ. Each
of SKETCHES sketches takes the TAKE k-mers with the smallest hashes and lists them in
the order of the text (Marçais et al., order min hash), which equals another
document's with a probability that falls with the edits between them. Documents that
share a sketch are candidates; candidates are aligned within the band that the
similarity leaves. Two cheap bounds decide most of them: the words that one has
beyond the other, and the edits of the alignment that keeps common unique words.

Documents of equal words are one node. A bucket (the nodes of one sketch) is linked
as a star around its smallest node, which is linear in its size. Members that the
star leaves over are compared with all members of the bucket, in blocks of bounded
size, so that no link between candidates is lost.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from shipgauge.llm.encoding import slices
from shipgauge.llm.frames import Rows, Stored, documents, materialize
from shipgauge.llm.graph import components
from shipgauge.llm.words import mix64, word_hashes

# Of pairs with random word edits, these find 97 % and more at similarity 0.8 and 99 % and more from 0.85 on
# (50 to 400 words); longer k-mers or more of them in a sketch lose most links near 0.8.
KMER = 3
TAKE = 2
SKETCHES = 32
SIMILARITY = 0.8
# Nodes of a block in the comparison of what stars leave over, and bins of a node's word counts there.
BLOCK = 1024
BINS = 2048
COARSE = 128
# Bits that the words of one band may take, and words from which on a cheaper upper bound is worth its time.
BAND_BITS = 1 << 29
LONG = 2000
SKETCHED = "row long, id long, digest binary, n_words int, sketches array<long>, words binary"
_NO_ID = (1 << 63) - 1


def sketch(words: np.ndarray, kmer: int, take: int, sketches: int) -> np.ndarray:
    """Sketches of one document from its word hashes; one of them all where it has no more k-mers than ``take``."""
    k = min(kmer, len(words))
    n = len(words) - k + 1
    grams = np.zeros(n, np.uint64)
    for i in range(k):
        grams = mix64(grams * np.uint64(0x9E3779B97F4A7C15) + words[i:i + n])
    grams = mix64(grams + _occurrence(grams))
    seeds = mix64(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if n > take:
        order = mix64(grams[None, :] ^ seeds[:, None])
        place = np.sort(np.argpartition(order, take - 1, axis=1)[:, :take], axis=1)
        picked = grams[place]
    else:
        picked = np.broadcast_to(grams, (sketches, n))
    out = seeds.copy()
    for j in range(picked.shape[1]):
        out = mix64(out * np.uint64(31) + picked[:, j])
    return out.view(np.int64)


def _occurrence(grams: np.ndarray) -> np.ndarray:
    """How often each value has come before."""
    by = np.argsort(grams, kind="stable")
    same = grams[by]
    first = np.concatenate([[True], same[1:] != same[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
    out = np.empty(len(by), np.uint64)
    out[by] = np.arange(len(by)) - start
    return out


def edits_within(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Word edits from a to b if they are at most ``limit``.

    The columns of the band are bits of one integer (Hyyrö's form of Myers' algorithm),
    so that a word of the shorter one costs a few integer operations. Where the bits of
    all words that the band holds would pass BAND_BITS, rows of numbers take their place.
    """
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    if len(long) - len(short) > limit:
        return None
    differs = np.flatnonzero(long[:len(short)] != short)
    at = int(differs[0]) if len(differs) else len(short)
    long, short = long[at:], short[at:]
    differs = np.flatnonzero(long[len(long) - len(short):][::-1] != short[::-1])
    at = int(differs[0]) if len(differs) else len(short)
    long, short = long[:len(long) - at], short[:len(short) - at]
    if not len(short):
        return len(long)
    if limit == 0:
        return None
    limit = min(limit, len(long))
    if len(long) * (2 * limit + 1) > BAND_BITS:
        return _band(long, short, limit)
    return _bits(long.tolist(), short.tolist(), limit)


def _bits(long: list[int], short: list[int], limit: int) -> int | None:
    """Edit distance in a band whose bit k in column j stands for row j - limit + k of ``long``."""
    m, n = len(long), len(short)
    top, mask = 1 << 2 * limit, (1 << 2 * limit + 1) - 1
    # Where a word stands in the band: bits, and the column that they belong to.
    places: dict[int, tuple[int, int]] = {}
    for i in range(limit):
        _, bits = places.get(long[i], (0, 0))
        places[long[i]] = (0, bits | 1 << i + 1 + limit)
    up, down = mask ^ ((1 << limit) - 1), 0  # rows that are one more, one less than the row above
    edits, most = limit, 2 * limit - (m - n)
    for j in range(1, n + 1):
        if j + limit <= m:
            word = long[j + limit - 1]
            since, bits = places.get(word, (j, 0))
            places[word] = (j, bits >> j - since | top)
        since, bits = places.get(short[j - 1], (j, 0))
        match = bits >> j - since
        level = ((((match & up) + up) ^ up) | match | down) & mask  # as large as the cell before, a row up
        right_up, right_down = down | (mask ^ (level | up)), level & up
        if j + limit <= m:
            edits += not level & top
            if edits > most:
                return None
        else:
            at = m - j + limit
            edits += (right_up >> at & 1) - (right_down >> at & 1)
        level >>= 1
        up, down = right_down | (mask ^ (level | right_up)), level & right_up
    return edits if edits <= limit else None


def _band(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Edit distance by rows of the diagonals -limit to limit."""
    width, far = 2 * limit + 1, len(a) + len(b) + 1
    offsets = np.arange(width)
    padded = np.concatenate([np.zeros(limit, b.dtype), b, np.zeros(2 * limit + 1, b.dtype)])
    row = np.where(offsets >= limit, offsets - limit, far)  # j = i + offset - limit
    row[offsets - limit > len(b)] = far
    for i in range(1, len(a) + 1):
        j = i + offsets - limit
        inside = (j >= 0) & (j <= len(b))
        replace = row + (padded[i - 1:i - 1 + width] != a[i - 1])
        replace[j < 1] = far
        row = np.minimum(replace, np.append(row[1:], far) + 1)
        row = np.where(inside, row, far)
        row = np.minimum.accumulate(row - offsets) + offsets
        row = np.where(inside, row, far)
        if row.min() > limit:
            return None
    got = int(row[len(b) - len(a) + limit])
    return got if got <= limit else None


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """1 - edits / words of the longer one reaches ``similarity``."""
    limit = math.floor((1 - similarity) * max(len(a), len(b)) + 1e-9)
    # Edits are at least the words that one of them has beyond the other.
    least = (int(np.abs(_bins(a) - _bins(b)).sum()) + abs(len(a) - len(b))) // 2
    return least <= limit and _aligned(a, b, limit)


def _aligned(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    """At most ``limit`` edits; of long ones the alignment over unique words is tried first."""
    return max(len(a), len(b)) > LONG and _script(a, b) <= limit or edits_within(a, b, limit) is not None


def _script(a: np.ndarray, b: np.ndarray) -> int:
    """Edits of one alignment, an upper bound: it keeps words that are unique in both and stand in common order."""
    (wa, ia, na), (wb, ib, nb) = (np.unique(x, return_index=True, return_counts=True) for x in (a, b))
    _, x, y = np.intersect1d(wa[na == 1], wb[nb == 1], assume_unique=True, return_indices=True)
    i, j = ia[na == 1][x], ib[nb == 1][y]
    order = np.argsort(i)
    i, j = i[order], j[order]
    if len(j) > 1 and (np.diff(j) < 0).any():
        keep = _increasing(j.tolist())
        i, j = i[keep], j[keep]
    i, j = np.concatenate([[-1], i, [len(a)]]), np.concatenate([[-1], j, [len(b)]])
    gap_a, gap_b = np.diff(i) - 1, np.diff(j) - 1
    even = gap_a == gap_b
    edits = int(np.maximum(gap_a, gap_b)[~even].sum())
    starts = np.repeat(i[:-1] + 1, gap_a * even)
    if not len(starts):
        return edits
    length = (gap_a * even)[even]
    at = starts + np.arange(len(starts)) - np.repeat(np.cumsum(length) - length, length)
    shift = np.repeat((j - i)[:-1][even], length)
    return edits + int((a[at] != b[at + shift]).sum())


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing run of values, gaps allowed."""
    ends, places, before = [], [], []
    for n, v in enumerate(values):
        k = bisect_left(ends, v)
        before.append(places[k - 1] if k else -1)
        if k == len(ends):
            ends.append(v)
            places.append(n)
        else:
            ends[k], places[k] = v, n
    out, n = [], places[-1] if places else -1
    while n >= 0:
        out.append(n)
        n = before[n]
    return out[::-1]


def _bins(words: np.ndarray) -> np.ndarray:
    return np.bincount(words % BINS, minlength=BINS)


def _sketch(kmer: int, take: int, sketches: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, bounds = word_hashes(part.column("text"))
                out = [[], [], [], []]
                for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                    raw = h[a:b].tobytes()
                    out[0].append(xxhash.xxh3_128_digest(raw))
                    out[1].append(b - a)
                    out[2].append(sketch(h[a:b], kmer, take, sketches) if b > a else np.zeros(0, np.int64))
                    out[3].append((h[a:b] >> np.uint64(32)).astype("<u4").tobytes())
                kinds = [pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), *[pa.array(c, t) for c, t in zip(out, kinds)]], names=["row", "id", "digest", "n_words", "sketches", "words"])

    return run


def _align(similarity: float):
    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a_words", "b_words")]
            good = [similar(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), similarity) for a, b in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], names=["a", "b", "linked"])

    return run


def _compare(similarity: float):
    """Links between the left-over nodes of a block and those of another, one per pair of groups that they join."""
    def run(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(pc.binary_length(table.column("words")).to_numpy(), kind="stable"))
        ids, words = table.column("row").to_pylist(), [np.frombuffer(w, "<u4") for w in table.column("words").to_pylist()]
        over = np.array(table.column("over").to_pylist(), bool)
        lengths = np.array([len(w) for w in words])
        bins = np.zeros((len(words), BINS), np.int16 if lengths[-1] < 1 << 14 else np.int32)
        for i, w in enumerate(words):
            bins[i] = _bins(w)
        coarse = bins.reshape(len(bins), -1, COARSE).sum(axis=1, dtype=np.int32)
        root = list(range(len(ids)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        star = np.flatnonzero(~over)
        for i in star[1:]:
            root[i] = star[0]  # all linked with the bucket's first node
        same = {}
        for i, x in enumerate(ids):
            root[find(i)] = find(same.setdefault(x, i))
        links = []
        # Those within reach of a node's length stand side by side; of two nodes left over the first meets the second.
        reach = np.stack([np.searchsorted(lengths, np.floor(similarity * lengths)), np.searchsorted(lengths, np.ceil(lengths / similarity), "right")])
        for i in np.flatnonzero(over):
            j = np.arange(*reach[:, i])
            j = j[(j > i) | ~over[j]]
            limit = np.floor((1 - similarity) * np.maximum(lengths[j], lengths[i]) + 1e-9)
            spare = 2 * limit - np.abs(lengths[j] - lengths[i])
            for counts in (coarse, bins):
                near = np.abs(counts[j] - counts[i]).sum(axis=1, dtype=np.int32) <= spare
                j, limit, spare = j[near], limit[near], spare[near]
            for x, most in zip(j.tolist(), limit.astype(int).tolist()):
                if find(i) != find(x) and _aligned(words[i], words[x], most):
                    root[find(i)] = find(x)
                    links.append((min(ids[i], ids[x]), max(ids[i], ids[x])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def linked_roots(nodes: DataFrame, words: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """node, root of all nodes that a verified link joins.

    ``nodes``: row and sketches of each, ``words``: row and words of these and others.
    Words move once, for nodes that share a sketch. A node is aligned with the
    smallest of its stars' centres first and with the others only where it is not yet
    in one component with them.
    """
    bands = nodes.select("row", F.explode("sketches").alias("key"))
    stars = bands.groupBy("key").agg(F.min("row").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    tables = []

    def stored(df: DataFrame, name: str) -> DataFrame:
        tables.append(Stored(df, name, "zstd"))
        return tables[-1].df

    members = stored(bands.join(stars, "key").select("key", "a", F.col("row").alias("b"), "n"), "members")
    pairs = stored(members.where("a != b").select("a", "b").distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    words = stored(words.join(ends.hint("shuffle_hash"), "row", "left_semi"), "words")
    first = pairs.groupBy("b").agg(F.min("a").alias("a"))
    roots = components(_linked(first, words, similarity))
    roots = _extended(roots, stored(_linked(_apart(pairs, roots).join(first, ["a", "b"], "left_anti"), words, similarity), "links"))
    # What the stars leave over: each such node meets all nodes of its bucket, block by block.
    left = stored(members.join(_apart(pairs, roots), ["a", "b"]).select("key", "b", "n"), "left")
    dirty = left.groupBy("key").agg(F.count(F.lit(1)).alias("n_left"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    blocks_left = F.greatest(F.lit(1), F.ceil(F.col("n_left") / block)).cast("int")
    part = F.xxhash64("b")
    side_left = left.join(dirty, "key").select(
        "key", F.col("b").alias("row"), F.lit(True).alias("over"), F.pmod(part, blocks_left).alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
    flagged = left.select("key", "b", F.lit(True).alias("over"))
    side_all = members.join(dirty, "key").join(flagged, ["key", "b"], "left").select(
        "key", F.col("b").alias("row"), F.coalesce("over", F.lit(False)).alias("over"), F.explode(F.sequence(F.lit(0), blocks_left - 1)).alias("i"), F.pmod(part, blocks).alias("j"))
    both = side_left.union(side_all.select(side_left.columns)).distinct()
    more = both.join(words, "row").groupBy("key", "i", "j").applyInArrow(_compare(similarity), "a long, b long")
    roots = materialize(_extended(roots, stored(more.distinct(), "more")), "roots")
    for t in tables:
        t.drop()
    return roots


def _linked(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """a, b of the pairs that alignment confirms."""
    return (
        pairs.join(words.select(F.col("row").alias("b"), F.col("words").alias("b_words")), "b")
        .join(words.select(F.col("row").alias("a"), F.col("words").alias("a_words")), "a")
        .mapInArrow(_align(similarity), "a long, b long, linked boolean").where("linked").select("a", "b"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    return pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def _extended(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of what ``roots`` and ``edges`` connect."""
    return roots if edges.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(edges.select("a", "b")))


def _classes(texts: DataFrame, kmer: int, take: int, sketches: int, similarity: float) -> DataFrame:
    """row, id, root, least (the class's smallest id and row) and size, one per row of ``texts`` (row, id, text)."""
    table = Stored(texts.mapInArrow(_sketch(kmer, take, sketches), SKETCHED), "sketches", "zstd")
    sketched = table.df
    firsts = materialize(sketched.groupBy("digest").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n")), "nodes")
    # One node of equal words carries their sketches.
    first = firsts.select(F.col("node").alias("row"), F.lit(True).alias("first"))
    sketches_of = sketched.where("n_words > 0").select("row", "sketches").join(first, "row").select("row", "sketches")
    roots = linked_roots(sketches_of, sketched.select("row", "words"), similarity)
    of_digest = firsts.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    placed = materialize(sketched.select("row", "id", "digest").join(of_digest, "digest").select("row", "id", "root"), "placed")
    table.drop()  # as large as the texts, and no longer read
    heads = placed.groupBy("root").agg(F.min(F.struct("id", "row")).alias("least"), F.count(F.lit(1)).alias("size"))
    return placed.join(heads, "root")


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(_NO_ID)).alias("id")


def near_duplicates(docs: DataFrame, kmer: int = KMER, take: int = TAKE, sketches: int = SKETCHES, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size and kept of every row of ``docs``.

    A class is what links of word edit similarity ``similarity`` or more connect;
    letter case does not count. Links are looked for between documents that share a
    sketch: of pairs with random word edits about 97 % do at similarity 0.8 and more
    than 99 % from 0.85 on; every link between such pairs is exact. class_id is its smallest doc_id, kept is true for one
    row of it, the one with that id (the first in the table of repeated rows). A null
    doc_id ranks last and a class of such rows has a null class_id. Null, empty and
    blank texts are one class; a text shorter than a k-mer is one k-mer. An empty table
    gives an empty result. Other columns are not looked at.
    """
    texts = documents(docs).select(F.monotonically_increasing_id().alias("row"), _id(F.col("doc_id")), "text")
    placed = _classes(texts, kmer, take, sketches, similarity)
    return placed.select(
        F.nullif(F.col("id"), F.lit(_NO_ID)).alias("doc_id"), F.nullif(F.col("least.id"), F.lit(_NO_ID)).alias("class_id"),
        F.col("size").alias("class_size"), (F.col("row") == F.col("least.row")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, kmer: int = KMER, take: int = TAKE, sketches: int = SKETCHES, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    rows = Rows(docs)
    marked = materialize(rows.df.withColumn("row", F.monotonically_increasing_id()), "texts")
    texts = marked.select("row", _id(rows.col("doc_id").cast("long")), F.coalesce(rows.col("text").cast("string"), F.lit("")).alias("text"))
    placed = _classes(texts, kmer, take, sketches, similarity)
    stay = placed.where(F.col("row") == F.col("least.row")).select("row")
    return rows.restore(marked.join(stay.hint("shuffle_hash"), "row", "left_semi"))
