"""Token ids as one wavelet-matrix file per shard.

A wavelet matrix keeps a sequence as one plane of bits per binary digit, the
highest first; after each plane the sequence is split stably into zeros and ones.
Ranks on the planes give a token at a place, counts before a place and the places
of a token without decoding the rest.

A file: MAGIC, length of the header (8 bytes, little endian), the header as JSON,
then its sections, each compressed by itself: the documents' ids, which of them
are null, their token counts, and per plane the bits and the ranks at the starts
of blocks.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from shipgauge.llm.encoding import encoder, slices
from shipgauge.llm.frames import documents, materialize

MAGIC = b"WAVEMAT1"
BLOCK = 4096  # bits between stored ranks
# Tokens after which a task begins its next file.
SHARD_TOKENS = 1 << 22
MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    """``planes``: bits of each level as bytes, highest digit first."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray] | None = None):
        self.n, self.planes = n, planes
        self.ranks = ranks or [_block_ranks(p) for p in planes]
        self.zeros = [n - int(r[-1]) for r in self.ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        digits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        at = pa.array(ids.astype(np.uint16 if digits <= 16 else np.uint32))
        planes = []
        for d in range(digits - 1, -1, -1):
            digit = at.to_numpy()
            planes.append(np.packbits(digit & digit.dtype.type(1 << d) != 0, bitorder="little"))
            if d:  # a plane is laid out as Arrow's booleans are
                bits = pa.Array.from_buffers(pa.bool_(), len(at), [None, pa.py_buffer(planes[-1])])
                at = pa.concat_arrays([at.filter(pc.invert(bits)), at.filter(bits)])
        return cls(len(ids), planes)

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place."""
        block, plane = i // BLOCK, self.planes[level]
        first = block * (BLOCK // 8)
        whole = i // 8 - first
        span = int(whole.max(initial=0))
        out = self.ranks[level][block].astype(np.int64)
        padded = np.concatenate([plane, np.zeros(1, np.uint8)])
        for k in range(span):
            use = whole > k
            out[use] += np.bitwise_count(padded[first[use] + k])
        return out + np.bitwise_count(padded[np.minimum(i // 8, len(plane))] & ((1 << (i % 8)) - 1).astype(np.uint8))

    def access(self, places) -> np.ndarray:
        """Tokens at the given places."""
        i = np.atleast_1d(np.asarray(places, np.int64))
        if len(i) and (i.min() < 0 or i.max() >= self.n):
            raise IndexError("no such place")
        out = np.zeros(len(i), np.uint32)
        for level, plane in enumerate(self.planes):
            bit = plane[i // 8] >> (i % 8).astype(np.uint8) & 1
            ones = self._ones(level, i)
            i = np.where(bit == 1, self.zeros[level] + ones, i - ones)
            out = out << 1 | bit
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where, after the last plane, the token's occurrences before ``end`` lie."""
        lo, hi = 0, end
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = (int(x) for x in self._ones(level, np.array([lo, hi])))
            if token >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, end: int | None = None) -> int:
        """How often the token occurs before ``end``."""
        lo, hi = self._range(token, self.n if end is None else end)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """The place of the token's occurrence number ``k``, from 0."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError("no such occurrence")
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = i >= self.zeros[level]
            i = self._place(level, i - self.zeros[level] if one else i, one)
        return i

    def _place(self, level: int, k: int, one: bool) -> int:
        """The place of a plane's one or zero number ``k``."""
        ranks = self.ranks[level].astype(np.int64)
        if not one:
            ranks = np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")[:self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(ranks[block])])

    def decode(self) -> np.ndarray:
        """The whole sequence, plane by plane from the last."""
        at = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            ones = at[self.zeros[level]:]
            ones |= at.dtype.type(1 << (len(self.planes) - 1 - level))
            out = np.empty_like(at)
            out[~bits], out[bits] = at[:self.zeros[level]], ones
            at = out
        return at.astype(np.uint32)


def _block_ranks(plane: np.ndarray) -> np.ndarray:
    ones = np.bitwise_count(plane).astype(np.uint32)
    whole = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK // 8)) if len(ones) else np.zeros(0, np.uint32)
    return np.concatenate([[0], np.cumsum(whole)]).astype(np.uint32)


def to_bytes(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    matrix, pack = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], bool)
    parts = [np.array([d or 0 for d in doc_ids], "<i8"), np.packbits(known), lengths.astype("<i8")]
    for plane, ranks in zip(matrix.planes, matrix.ranks):
        parts += [plane, ranks.astype("<u4")]
    sections = [pack(p.tobytes()) for p in parts]
    head = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "planes": len(matrix.planes), "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *sections])


def from_bytes(data: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """The documents' ids, their token counts and the matrix."""
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    at = 16 + int.from_bytes(data[8:16], "little")
    head, unpack, parts = json.loads(data[16:at]), zstandard.ZstdDecompressor().decompress, []
    for size in head["sections"]:
        parts.append(unpack(data[at:at + size]))
        at += size
    known = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=head["docs"]).astype(bool)
    doc_ids = [d if k else None for d, k in zip(np.frombuffer(parts[0], "<i8").tolist(), known)]
    planes = [np.frombuffer(p, np.uint8) for p in parts[3::2]]
    ranks = [np.frombuffer(p, "<u4") for p in parts[4::2]]
    return doc_ids, np.frombuffer(parts[2], "<i8"), WaveletMatrix(head["tokens"], planes, ranks)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the ids of ``docs`` in ascending doc_id order; the manifest: part, seq, path, n_docs, n_tokens.

    Files follow each other by part and seq. ``folder`` is any URI that Arrow's
    file systems open on every executor. An attempt writes under a name of its own
    that only the manifest of the attempt that counts lists, so a task may run
    twice. Null doc_ids come first, repeated ones stay apart in the order of their
    texts, a null or empty text is ``end_id`` alone, an empty table gives no files.
    """
    ordered = documents(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialize(ordered.mapInArrow(_writer(tokenizer, folder.rstrip("/"), end_id, shard_tokens), MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files."""
    # A row per file of SHARD_TOKENS tokens, in one task for the running sum.
    before = F.sum("n_tokens").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1))
    files = manifest.withColumn("start", F.coalesce(before, F.lit(0)))
    n = max(1, manifest.count())
    return files.repartition(n, "path").mapInArrow(_read, DOCUMENTS)


def token_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write, then read back: one row per document, with the place of its first id among all and the CRC of its ids."""
    return read_shards(write_shards(docs, tokenizer, folder, end_id, shard_tokens))


def _writer(tokenizer: str, folder: str, end_id: int, shard_tokens: int):
    def run(batches):
        part, seq, docs, lengths, ids, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            nonlocal seq, held
            path = f"{folder}/shard-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.wm"
            store, name = fs.FileSystem.from_uri(path)
            store.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(name, compression=None) as f:
                f.write(to_bytes(docs, np.array(lengths, np.int64), np.concatenate(ids)))
            row = [[part], [seq], [path], [len(docs)], [held]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            docs.clear(), lengths.clear(), ids.clear()
            seq, held = seq + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in MANIFEST.split(", ")])

        for batch in batches:
            for some in slices(batch, "text"):
                flat, starts = encoder(tokenizer).encode(some.column("text"))
                n = np.diff(starts)
                flat = np.insert(flat, starts[1:], end_id)  # behind each document's last id
                doc_ids, at, row = some.column("doc_id").to_pylist(), 0, 0
                ends = np.cumsum(n + 1)
                while row < len(n):
                    to = min(len(n), max(row + 1, int(np.searchsorted(ends, at + shard_tokens - held, side="right"))))
                    docs += doc_ids[row:to]
                    lengths += (n[row:to] + 1).tolist()
                    ids.append(flat[at:ends[to - 1]])
                    held += int(ends[to - 1] - at)
                    row, at = to, int(ends[to - 1])
                    if held >= shard_tokens or row < len(n):
                        yield flush()
        if docs:
            yield flush()

    return run


def _read(batches):
    names = [c.split()[0] for c in DOCUMENTS.split(", ")]
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_stream(name, compression=None) as f:
                doc_ids, lengths, matrix = from_bytes(f.read())
            ids = matrix.decode().astype("<u4")
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[b - n:b].tobytes()) for b, n in zip(ends.tolist(), lengths.tolist())]
            columns = [doc_ids, start + ends - lengths, lengths, crc]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
