"""Words of batches of texts as 64-bit hashes, the same on every machine."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_PIECES = re.compile(r"\w+|[^\w\s]")


def word_hashes(texts: pa.Array, pieces: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-case words and where each text begins in them (one more than texts).

    Words are what white space separates; with ``pieces`` they are cut further into
    runs of letters and digits and single other characters. Only distinct words of
    the batch are hashed.
    """
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    words = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    bounds = words.offsets.to_numpy()
    coded = pc.list_flatten(words).dictionary_encode()
    at, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    bounds = (bounds - bounds[0]).astype(np.int64)
    if not pieces:
        table = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)
        empty = np.array([w == "" for w in distinct], bool)
        return _without(table[at], empty[at] if len(distinct) else np.zeros(0, bool), bounds)
    lists = [[xxhash.xxh3_64_intdigest(p) for p in _PIECES.findall(w)] for w in distinct]
    lengths = np.array([len(x) for x in lists], np.int64)
    ragged = pa.LargeListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int64()), pa.array(np.array([h for x in lists for h in x], np.uint64)))
    flat = ragged.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    return flat, np.concatenate([[0], np.cumsum(lengths[at])]).astype(np.int64)[bounds]


def _without(values: np.ndarray, drop: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not drop.any():
        return values, bounds
    return values[~drop], np.concatenate([[0], np.cumsum(~drop)]).astype(np.int64)[bounds]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
