"""Online packing by the sum of squares.

A document is placed at the fill level that leaves the smallest sum of squared
counts of partially filled windows per level (Csirik et al., the sum-of-squares
algorithm for bin packing). The counts are one array of window + 1 levels.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shipgauge.llm.encoding import encoder, slices
from shipgauge.llm.frames import documents

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# Sequence numbers of a task begin at its number times this.
SEQUENCES_PER_TASK = 1 << 40


class SumOfSquares:
    """Windows of one task. A piece is (document, start, ids); a window is a list of pieces.

    State: for each level the open windows filled so far, all of them shorter
    than a window, and their counts.
    """

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        # Level 0 stands for a new window; its own count never matters.
        self._new = np.zeros(1, np.int64)

    def level_for(self, size: int) -> int:
        """The level whose change of the sum of squares is smallest, the fuller one of equals."""
        top = self.window - size
        levels = np.flatnonzero(self.counts[1:top + 1])[::-1] + 1
        levels = np.concatenate([levels, self._new])
        change = np.where(levels > 0, 1 - 2 * self.counts[levels], 0)
        after = levels + size
        change = change + np.where(after < self.window, 1 + 2 * self.counts[np.minimum(after, self.window - 1)], 0)
        return int(levels[np.argmin(change)])

    def place(self, piece: tuple) -> list | None:
        """Put a piece of at most a window's length into a window; the window, if that fills it."""
        size = len(piece[2])
        level = self.level_for(size)
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.open.setdefault(level + size, []).append(pieces)
        self.counts[level + size] += 1
        return None

    def close(self):
        """What is still open, as full windows and at the end as lengths that are powers of two.

        The emptiest windows' pieces are cut to fill up the fullest ones.
        """
        left = [pieces for level in sorted(self.open, reverse=True) for pieces in self.open[level]]
        self.open, self.counts = {}, np.zeros(self.window + 1, np.int64)
        stream = [p for pieces in left for p in pieces]
        total = sum(len(p[2]) for p in stream)
        sizes = [self.window] * (total // self.window)
        rest = total % self.window
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        at = 0
        for size in sizes:
            pieces, free = [], size
            while free:
                doc, start, ids = stream[at]
                take = min(free, len(ids))
                pieces.append((doc, start, ids[:take]))
                if take == len(ids):
                    at += 1
                else:
                    stream[at] = (doc, start + take, ids[take:])
                free -= take
            yield pieces


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone.
    Whole windows are cut off a long document first and its rest goes where the
    sum of squares says, so a document is cut only where it fills a window, or at
    the end of a task, when what is open is cut to fill windows; of the last one
    of a task, pieces of lengths that are powers of two remain, which need no
    padding. Repeated rows and equal doc_ids are documents of their own, told
    apart by their sequences and offsets; a null doc_id stays null; an empty table
    gives no pieces. Other columns are not looked at.

    Each task packs its own rows as they come, with at most a window per level and
    a few more open, so nothing is shuffled and a lost task is simply run again.
    """
    return documents(docs).mapInArrow(_packer(tokenizer, end_id, window), SCHEMA)


def _packer(tokenizer: str, end_id: int, window: int):
    def run(batches):
        packer, names = SumOfSquares(window), [c.split()[0] for c in SCHEMA.split(", ")]
        sequence = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        rows: list[tuple] = []

        def emit(pieces):
            nonlocal sequence
            offset = 0
            for (doc_id, n), start, ids in pieces:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence, offset))
                offset += len(ids)
            sequence += 1

        def drain():
            columns = list(zip(*rows)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for part in slices(batch, "text"):
                flat, starts = encoder(tokenizer).encode(part.column("text"))
                end = np.array([end_id], np.uint32)
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), starts.tolist(), starts[1:].tolist()):
                    ids = np.concatenate([flat[a:b], end])
                    doc, whole = (doc_id, len(ids)), len(ids) // window * window
                    for at in range(0, whole, window):
                        emit([(doc, at, ids[at:at + window])])
                    if whole < len(ids):
                        full = packer.place((doc, whole, ids[whole:]))
                        if full:
                            emit(full)
                yield drain()
        for pieces in packer.close():
            emit(pieces)
        if rows:
            yield drain()

    return run
