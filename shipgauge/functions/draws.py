"""Keyed standard-normal draws.

A draw is a pure function of (seed, project, size, iteration, item), so a retry,
another partitioning or another cluster gives the same numbers; ``rand`` and
``randn`` depend on the partition a row happens to sit in.

One MD5 per (project, size) gives two 32-bit keys. A draw adds multiples of its
iteration, chunk and pair to each, scrambles after every step, and turns the two
words into a pair of normals by one Box-Muller step.

Spark deals out units of work, a few numbers each; the draws of a unit are made
in numpy blocks that fit the cache, and only their sums per iteration come back.
The same arithmetic as Spark columns took four times as long per draw: half of
that went into adding every pair to a hash table.

Where only ranks count, ``unit_bounds`` draws the same items in 4-byte floats, several
times as fast, and returns two whole numbers that the exact sum lies between.

The first words of an iteration's pairs are 20,000 or fewer neighbours on one circle of
2^32 words, the same for all projects and sizes. Where a job draws more pairs than the
circle has words, units are dealt by the range of the circle they begin in, and the
radii of a range are worked out once for all of them.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from shipgauge.functions.stats import MS_PER_HOUR
from shipgauge.settings import MIN_ITEM_HOURS

# Odd 32-bit increments (xxHash primes) and the two multipliers of
# a 32-bit finalizer.
STEP_ITERATION = 2654435761
STEP_CHUNK = 2246822519
STEP_A = 3266489917
STEP_B = 668265263
MULTIPLIER_1 = 569420461
MULTIPLIER_2 = 695872825

# Item pairs per chunk; part of the definition of a draw.
PAIRS_PER_CHUNK = 20_000
# Pairs drawn at once: 256 KiB per array of doubles.
PAIRS_PER_BLOCK = 1 << 15

# Tasks receive the functions themselves, so workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# No draw is further from 0: sqrt(-2 log(0.5 / 2^32)) is 6.764.
FURTHEST = 6.77
# Pairs whose bounds are drawn at once: 128 KiB per array of 4 bytes.
PAIRS_PER_BOUND = 1 << 15
# Words of the circle in a range: 64 MiB of radii.
RANGE_BITS = 24
# Units whose bounds leave a task together.
UNITS_PER_BATCH = 32
# Radii are added up between every so many of them.
STRIDE = 128
# Turns a first word before its last scramble into its place on the circle.
INVERSE_A = pow(STEP_A, -1, 1 << 32)
# Widths of these arrays are multiples of it. So many pairs are added up in 4 bytes, the rest in 8.
FOLD = 4
# Directions are looked up by the first bits of an angle; its last ones turn them a little,
# for which a cosine, between 1 and 1 - 2.9e-7, counts as the middle of these.
LAST_BITS = 19
DIRECTIONS = np.exp(2j * np.pi * (np.arange(1 << 32 - LAST_BITS) + 0.5 / (1 << LAST_BITS)) / (1 << 32 - LAST_BITS))
DIRECTIONS = (DIRECTIONS * (1.0 - 1.5e-7)).astype(np.complex64)
# Units of a word's angle in a radian; hours are counted in these parts until they are added up.
ANGLE_UNITS = 4294967296.0 / (2.0 * np.pi)
# Words above it give a radius below 0.1, which is taken from 8 bytes: 4 are few for a number so near 1.
NEAR_ONE = np.uint32(4273546057)
# Bounds of errors, each once and a half what follows here. Per radius (two draws): logarithm
# of 4 ulp 0.24e-6, sqrt and products 0.1e-6, seven additions 0.42e-6, these times sqrt(2);
# direction 0.04e-6, its product 0.18e-6, its turn 0.15e-6, these twice: 1.8e-6.
ROUNDING = 2.7e-6
# Per pair: a word rounded to 2^-24 moves a radius from 0.1 on by up to 0.6e-6, times sqrt(2).
ROUNDING_PAIR = 1.3e-6

TOTALS = "project_key STRING, iteration INT, ms BIGINT"
BOUNDS = "project_key STRING, iteration INT, low BIGINT, high BIGINT"
RANGED = "project_key STRING, key_a BIGINT, key_b BIGINT, chunk BIGINT, items BIGINT, mean DOUBLE, stddev DOUBLE, listed ARRAY<INT>, range INT"


def keys(seed: int, *parts: Column) -> tuple[Column, Column]:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))

    def word(start: int) -> Column:
        return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")

    return word(1), word(9)


def _scramble(x: np.ndarray) -> np.ndarray:
    """Mix 32-bit words in place; products wrap around as uint32 does."""
    for shift, factor in ((16, MULTIPLIER_1), (15, MULTIPLIER_2)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(15)
    return x


def _stepped(key: np.ndarray, index: np.ndarray, step: int) -> np.ndarray:
    return _scramble(key + index * np.uint32(step))


def _item_ms(z: np.ndarray, mean: float, stddev: float) -> np.ndarray:
    """Whole milliseconds per item, summed over the items of each iteration."""
    z *= stddev
    z += mean
    np.maximum(z, MIN_ITEM_HOURS, out=z)
    z *= MS_PER_HOUR
    z += 0.5
    return np.floor(z, out=z).sum(axis=1)


def _lanes(key_a: int, key_b: int, chunk: int, iterations: np.ndarray) -> list[np.ndarray]:
    """What each iteration's pairs of a chunk start from, for the two words."""
    at = np.array([chunk], dtype=np.int64).astype(np.uint32)
    keys_of = (np.full(len(iterations), key, dtype=np.uint32) for key in (key_a, key_b))
    return [_stepped(_stepped(key, iterations.astype(np.uint32), STEP_ITERATION), at, STEP_CHUNK) for key in keys_of]


def _words(key_a: int, key_b: int, chunk: int, items: int, iterations: np.ndarray) -> list[np.ndarray]:
    """The two words of each iteration's pairs."""
    pair = np.arange((items + 1) // 2, dtype=np.uint32)
    lanes = _lanes(key_a, key_b, chunk, iterations)
    return [_stepped(lane[:, None], pair, step) for lane, step in zip(lanes, (STEP_A, STEP_B))]


def _certain(items: int, mean: float, stddev: float, iterations: np.ndarray) -> np.ndarray | None:
    """The sums where every draw gives the same milliseconds, else None."""
    if stddev == 0.0 or mean + FURTHEST * abs(stddev) < MIN_ITEM_HOURS:
        return np.full(len(iterations), items * int(np.floor(max(mean, MIN_ITEM_HOURS) * MS_PER_HOUR + 0.5)), np.int64)
    return None


def block_totals(
    key_a: int, key_b: int, chunk: int, items: int, mean: float, stddev: float, iterations: np.ndarray
) -> np.ndarray:
    """Milliseconds of ``items`` items of one chunk, per iteration."""
    certain = _certain(items, mean, stddev, iterations)
    if certain is not None:
        return certain
    words = _words(key_a, key_b, chunk, items, iterations)
    radius, angle = ((w + 0.5) / 4294967296.0 for w in words)
    radius = np.sqrt(-2.0 * np.log(radius))
    angle *= 2.0 * np.pi
    first = _item_ms(radius * np.cos(angle), mean, stddev)
    whole = items // 2
    second = _item_ms(radius[:, :whole] * np.sin(angle[:, :whole]), mean, stddev)
    return (first + second).astype(np.int64)


def _mix(x: np.ndarray, spare: np.ndarray) -> None:
    """As ``_scramble``, without new arrays."""
    for shift, factor in ((16, MULTIPLIER_1), (15, MULTIPLIER_2)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(15), out=spare)
    np.bitwise_xor(x, spare, out=x)


def _radii(words: np.ndarray, spare: np.ndarray, out: np.ndarray) -> None:
    """Radii of first words before their last scramble; ``words`` and ``spare`` are used up."""
    _mix(words, spare)
    np.copyto(out, words, casting="unsafe")
    out += np.float32(0.5)
    out *= np.float32(1 / 4294967296.0)
    np.log(out, out=out)
    out *= np.float32(-2.0)
    np.sqrt(out, out=out)
    small = np.flatnonzero(words > NEAR_ONE)
    out.reshape(-1)[small] = np.sqrt(np.log((words.reshape(-1)[small] + 0.5) / 4294967296.0) * -2.0)


def range_radii(number: int) -> tuple[np.ndarray, np.ndarray]:
    """Radii of a range of the circle and of as many words after it as a chunk has pairs, and their sums before every STRIDE-th."""
    size = (1 << RANGE_BITS) + ((PAIRS_PER_CHUNK + FOLD) // STRIDE + 2) * STRIDE
    out, words, spare = np.empty(size, np.float32), *np.empty((2, PAIRS_PER_BOUND), np.uint32)
    steps = np.arange(PAIRS_PER_BOUND, dtype=np.uint32) * np.uint32(STEP_A)
    for left in range(0, size, PAIRS_PER_BOUND):
        piece = out[left:left + PAIRS_PER_BOUND]
        first = ((number << RANGE_BITS) + left) * STEP_A & 0xFFFFFFFF
        np.add(steps, np.uint32(first), out=words)
        _radii(words[:len(piece)], spare[:len(piece)], piece)
    sums = np.add.reduce(out.reshape(-1, STRIDE), axis=1, dtype=np.float64)
    return out, np.concatenate([[0.0], np.cumsum(sums)])


def bound_buffers() -> list[np.ndarray]:
    """The arrays that ``block_bounds`` works in, for PAIRS_PER_BOUND pairs."""
    kinds = np.uint32, np.uint32, np.int64, np.float32, np.complex64, np.complex64, np.complex64
    buffers = [np.empty(PAIRS_PER_BOUND, t) for t in kinds]
    buffers[4].real = ANGLE_UNITS
    return buffers


def block_bounds(
    key_a: int, key_b: int, chunk: int, items: int, mean: float, stddev: float, iterations: np.ndarray,
    radii: tuple[np.ndarray, np.ndarray] | None = None, buffers: list[np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Two whole numbers of milliseconds per iteration; ``block_totals`` lies between them.

    Hours are added up as differences from the mean, in deviations, whose rounding errors are as
    small as the spread is. What is rounded to milliseconds counts with one a draw. All is done
    in arrays of PAIRS_PER_BOUND pairs that are made once and stay in a core's cache. ``radii``
    are those of the range that all of the iterations begin in.
    """
    certain = _certain(items, mean, stddev, iterations)
    if certain is not None:
        return certain, certain
    pairs = (items + 1) // 2
    padded = -(-pairs // FOLD) * FOLD
    width = min(PAIRS_PER_BOUND, padded)
    rows = min(len(iterations), PAIRS_PER_BOUND // width)
    spread = abs(stddev)
    lanes = _lanes(key_a, key_b, chunk, iterations)
    steps = [np.arange(padded, dtype=np.uint32) * np.uint32(step) for step in (STEP_A, STEP_B)]
    buffers = buffers or bound_buffers()
    least = buffers[-1].view(np.float32)[:2 * rows * width]
    least.fill((MIN_ITEM_HOURS - mean) / spread * ANGLE_UNITS)
    off, reach = np.zeros(len(iterations)), np.zeros(len(iterations))
    if radii is not None:
        table, sums = radii
        starts = (lanes[0] * np.uint32(INVERSE_A) & np.uint32((1 << RANGE_BITS) - 1)).astype(np.int64)
        reach = sums[(starts + pairs - 1) // STRIDE + 1] - sums[starts // STRIDE]
        starts = starts.tolist()
    for top in range(0, len(iterations), rows):
        some = slice(top, min(top + rows, len(iterations)))
        for left in range(0, pairs, width):
            n = min(width, padded - left)
            size = (some.stop - top) * n
            words, spare, at, radius, turn, z = (b[:size].reshape(-1, n) for b in buffers[:-1])
            if radii is None:
                np.add(lanes[0][some, None], steps[0][left:left + n], out=words)
                _radii(words, spare, radius)
                reach[some] += np.add.reduce(radius[:, :pairs - left], axis=1)
            else:
                for row, start in zip(radius, starts[some]):
                    row[:] = table[start + left:start + left + n]
            if stddev < 0:
                np.negative(radius, out=radius)
            np.add(lanes[1][some, None], steps[1][left:left + n], out=words)
            _mix(words, spare)
            # Next to a direction, an angle's sine is the angle and its cosine is 1.
            np.right_shift(words, np.uint32(LAST_BITS), out=spare)
            np.copyto(at, spare)
            np.bitwise_and(words, np.uint32((1 << LAST_BITS) - 1), out=words)
            np.copyto(turn.imag, words.view(np.int32), casting="unsafe")
            np.take(DIRECTIONS, at, out=z, mode="clip")
            z *= turn
            z *= radius
            hours = z.view(np.float32)
            np.maximum(hours, least[:2 * size].reshape(hours.shape), out=hours)
            if items < 2 * (left + n):
                hours[:, max(0, items - 2 * left):] = 0
            while hours.shape[1] > n // FOLD:
                half = hours.shape[1] // 2
                hours = np.add(hours[:, :half], hours[:, half:], out=hours[:, :half])
            off[some] += np.add.reduce(hours, axis=1, dtype=np.float64)
    middle = (items * mean + off * (spread / ANGLE_UNITS)) * MS_PER_HOUR
    error = ROUNDING * (reach * spread + items * max(MIN_ITEM_HOURS - mean, 0.0)) + ROUNDING_PAIR * pairs * spread
    error *= MS_PER_HOUR
    error += items + 1e-14 * np.abs(middle)
    return np.floor(middle - error).astype(np.int64), np.ceil(middle + error).astype(np.int64)


def _unit(unit: dict) -> tuple:
    """(project, iterations, arguments of a draw before these) of a unit, which lists its iterations or has a first and a last."""
    listed = unit["listed"]
    every = np.arange(unit["first"], unit["last"] + 1, dtype=np.int32) if listed is None else np.array(listed, np.int32)
    return unit["project_key"], every, [unit[c] for c in ("key_a", "key_b", "chunk", "items", "mean", "stddev")]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from map(_unit, batch.to_pylist())


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: units of work in, the same cut by the ranges that their iterations begin in out."""
    for project, iterations, unit in _units(batches):
        own = _lanes(*unit[:3], iterations)[0] * np.uint32(INVERSE_A) >> np.uint32(RANGE_BITS)
        order = np.argsort(own, kind="stable")
        ranges, firsts = np.unique(own[order], return_index=True)
        listed = pa.ListArray.from_arrays(np.append(firsts, len(own)).astype(np.int32), pa.array(iterations[order]))
        names = "project_key", "key_a", "key_b", "chunk", "items", "mean", "stddev"
        kinds = pa.string(), *[pa.int64()] * 4, *[pa.float64()] * 2
        same = {c: pa.repeat(pa.scalar(v, k), len(ranges)) for c, v, k in zip(names, (project, *unit), kinds)}
        yield pa.record_batch({**same, "listed": listed, "range": ranges.astype(np.int32)})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(project, iterations, milliseconds) of every unit, block by block."""
    for project, every, unit in _units(batches):
        rows = max(1, PAIRS_PER_BLOCK // ((unit[3] + 1) // 2))
        for start in range(0, len(every), rows):
            yield project, every[start:start + rows], block_totals(*unit, every[start:start + rows])


def unit_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: units of work in, sums per project and iteration out."""
    for project, iterations, ms in _blocks(batches):
        yield pa.record_batch({
            "project_key": pa.repeat(pa.scalar(project, pa.string()), len(ms)), "iteration": iterations, "ms": ms})


def unit_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: units of work in, bounds of the sums per project and iteration out.

    The radii of a range serve all units of a batch that begin there, if they have more pairs than it has words.
    """
    held, radii, buffers = None, None, bound_buffers()
    for batch in batches:
        units, pairs, out = batch.to_pylist(), Counter(), []
        for unit in units:
            if "range" in unit:
                pairs[unit["range"]] += (unit["items"] + 1) // 2 * len(unit["listed"])
        for unit in units:
            project, iterations, drawn = _unit(unit)
            number = unit.get("range")
            if number != held and pairs[number] > 1 << RANGE_BITS:
                held, radii = number, range_radii(number)
            low, high = block_bounds(*drawn, iterations, radii if number is not None and number == held else None, buffers)
            out.append((pa.repeat(pa.scalar(project, pa.string()), len(low)), *map(pa.array, (iterations, low, high))))
            if unit is units[-1] or len(out) >= UNITS_PER_BATCH:
                yield pa.record_batch([pa.concat_arrays(c) for c in zip(*out)], names=["project_key", "iteration", "low", "high"])
                out = []
