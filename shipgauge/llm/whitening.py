"""Whitening along the leading principal components, found by spectrum slicing.

The covariance V is exact: whole numbers are centred on the whole number at their
mean before they are multiplied, products are added as whole numbers, and what the
mean lies beside that number is taken off at the end. The number of negative pivots
of L D L^T of V - s I is the number of eigenvalues below s (Sylvester), so halving an
interval by such counts isolates each leading eigenvalue. Rayleigh quotient iteration
then converges cubically from inside the interval; it is taken only if it stays
there, and counts on both sides of its result certify its number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shipgauge.llm.frames import Stored, pick
from shipgauge.llm.vectors import matrix, sound

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
# Numbers beyond are an error: their products would pass what whole numbers here hold.
LARGEST = 1 << 40
ROWS = 4_096
# Two-by-two pivots where the diagonal is small against its column (Bunch and Kaufman).
_ALPHA = (1 + math.sqrt(17)) / 8


def below(v: np.ndarray, s: float) -> int:
    """How many eigenvalues of the symmetric ``v`` are below ``s``: negative pivots of L D L^T of v - s I."""
    a = v - s * np.eye(len(v))
    negative = 0
    while len(a):
        column = np.abs(a[1:, 0])
        pair = False
        if len(column) and column.max() > 0:
            r = 1 + int(column.argmax())
            top = column[r - 1]
            if abs(a[0, 0]) < _ALPHA * top:
                row = np.abs(a[r])
                row[r] = 0
                other = row.max()
                if abs(a[0, 0]) * other >= _ALPHA * top * top:
                    pass
                elif abs(a[r, r]) >= _ALPHA * other:
                    _swap(a, 0, r)
                else:
                    _swap(a, 1, r)
                    pair = True
        if pair:
            negative += 1  # such a pivot has one negative and one positive eigenvalue
            c = a[2:, :2]
            a = a[2:, 2:] - c @ np.linalg.solve(a[:2, :2], c.T)
        else:
            pivot, c = a[0, 0], a[1:, 0]
            negative += pivot < 0
            a = a[1:, 1:] - np.outer(c, c / pivot) if pivot else a[1:, 1:]
    return int(negative)


def _swap(a: np.ndarray, i: int, j: int) -> None:
    a[[i, j]] = a[[j, i]]
    a[:, [i, j]] = a[:, [j, i]]


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of ``v``, falling, and their unit eigenvectors as rows.

    Equal eigenvalues, which no count tells apart, get orthogonal vectors. Eigenvalues
    that rounding does not tell from 0 are left out.
    """
    d, size = len(v), float(np.abs(v).sum(axis=1).max()) if len(v) else 0.0
    unsure = d * np.finfo(float).eps * size
    values, rows, seed = [], [], np.random.default_rng(0)
    # Per eigenvalue an interval with counts; the one for number j has at least j values above its lower end.
    for j in range(1, min(k, d) + 1 if size else 1):
        lo, hi = unsure, size + unsure
        if d - below(v, lo) < j:
            break
        inside = None
        while inside is None:
            middle = (lo + hi) / 2
            if d - below(v, middle) >= j:
                lo = middle
            else:
                hi = middle
            alone = below(v, hi) - below(v, lo) == 1
            narrow = hi - lo <= 4 * unsure
            if alone or narrow:
                inside = _quotient(v, lo, hi, rows, seed, narrow, unsure)
        value, row = inside
        # Certified: fewer than j eigenvalues above, at least j from a little below.
        if d - below(v, value + 8 * unsure) >= j or d - below(v, value - 8 * unsure) < j:
            raise ArithmeticError(f"eigenvalue {j} could not be certified")
        values.append(value)
        rows.append(row)
    return np.array(values), np.array(rows).reshape(len(rows), d)


def _quotient(v, lo, hi, rows, seed, narrow, unsure):
    """Eigenvalue and vector inside (lo, hi), None if the iteration leaves it."""
    d = len(v)

    def free(x):
        for _ in range(2):
            for r in rows:
                x = x - (x @ r) * r
        return x / np.linalg.norm(x)

    def solve(s, x):
        for beside in (0, 1, 4, 16):  # the shift may be an eigenvalue to the last bit
            try:
                return np.linalg.solve(v - (s + beside * unsure) * np.eye(d), x)
            except np.linalg.LinAlgError:
                continue
        raise ArithmeticError("a shifted covariance is singular on a whole interval")

    x = free(seed.standard_normal(d))
    for _ in range(3):
        x = free(solve((lo + hi) / 2, x))
    if narrow:  # a multiple eigenvalue, or one too near to another: any vector of its space
        return float(x @ v @ x), _signed(x)
    s = float(x @ v @ x)
    for _ in range(30):
        if not lo - unsure <= s <= hi + unsure:
            return None
        if np.linalg.norm(v @ x - s * x) <= unsure:
            break
        x = free(solve(s, x))
        s = float(x @ v @ x)
    return (s, _signed(x)) if lo - unsure <= s <= hi + unsure else None


def _signed(x: np.ndarray) -> np.ndarray:
    """The largest entry is positive."""
    x = x / np.linalg.norm(x)
    return x if x[np.abs(x).argmax()] > 0 else -x


def _sums(batches):
    for batch in batches:
        if len(batch):
            x = matrix(batch.column("x"), len(batch.column("x")[0]), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))], names=["n", "s"])


def _products(centre: np.ndarray):
    """Whole sums of products of centred numbers, a row i with its entries from i on."""
    d = len(centre)

    def rows(total):
        return pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array([total[i, i:].tolist() for i in range(d)], pa.list_(pa.int64()))], names=["i", "g"])

    def run(batches):
        total, bound = np.zeros((d, d), np.int64), 0
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                x = matrix(batch.column("x")[at:at + ROWS], d, np.int64) - centre
                most = int(np.abs(x).max()) ** 2 * len(x)
                if most < 1 << 53:  # exact in doubles, whatever the order
                    f = x.astype(np.float64)
                    some = (f.T @ f).astype(np.int64)
                elif most < 1 << 62:
                    some = x.T @ x
                else:
                    raise ArithmeticError("products of these numbers do not fit a BIGINT")
                bound += most
                if bound >= 1 << 62:
                    yield rows(total)
                    total, bound = np.zeros((d, d), np.int64), most
                total += some
        if bound:
            yield rows(total)

    return run


def _project(n: int, s: np.ndarray, components: np.ndarray, scales: np.ndarray):
    d = len(s)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                x = matrix(part.column("x"), d, np.int64)
                if n < (1 << 62) // (LARGEST * 2):
                    off = n * x - s
                else:
                    off = x.astype(object) * n - s.astype(object)
                if off.dtype != object and int(np.abs(off).max()) ** 2 * d < 1 << 63:
                    square = (off * off).sum(axis=1).tolist()
                else:
                    off = off.astype(object)
                    square = (off * off).sum(axis=1).tolist()
                y = (off / n).astype(np.float64)
                w = (y @ components.T) / scales
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array([str(q) for q in square]), *[pa.array(c) for c in w.T]],
                    names=["vec_id", "deviation", *[f"w{j}" for j in range(len(scales))]])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: up to ``components`` rows a vector.

    Entries c become whole numbers x = floor(SCALE * c) + SHIFT; n vectors have sums S
    by dimension. deviation is the sum of (n x - S)^2, exact, as DECIMAL(38,0);
    whitened the unrounded x - S / n projected on the component and divided by the
    root of its eigenvalue; explained that eigenvalue's share of the trace;
    identity_error, one value for all, the largest entry of the whitened columns'
    covariance minus the identity, measured on the result. Components are numbered by
    falling eigenvalue; their largest entry is positive. Equal eigenvalues have some
    orthogonal vectors of their space.

    Vectors that are null, empty or hold a null or a number that is not finite take no
    part; nor do those of another length than most (of equally frequent lengths, the
    longest). A null vec_id is kept; repeated rows count as often as they come. Only
    eigenvalues above rounding have a component: at most as many as dimensions, fewer
    if vectors lie in a smaller space, none (so no rows) if all are equal or for an
    empty table. Entries so large that sums of products do not fit are an error, and
    so is a deviation of more than 38 digits. Other columns are not looked at.

    What reaches the driver is one matrix of the dimensions' products.
    """
    spark = vectors.sparkSession
    rows = pick(vectors, vec_id="long", embedding="array<double>").where(sound()).where(F.size("embedding") > 0)
    whole = F.expr(f"transform(embedding, c -> CASE WHEN abs(c) < {LARGEST >> 10}D THEN bigint(floor({SCALE}D * c)) + {SHIFT} END)")
    stored = Stored(rows.select("vec_id", F.when(F.exists(whole, lambda x: x.isNull()), F.raise_error(F.lit("an entry is too large to whiten"))).otherwise(whole).alias("x")), "whole-numbers")
    lengths = stored.df.groupBy(F.size("x").alias("d")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    result = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if most is None:
        return spark.createDataFrame([], result)
    d = most["d"]
    same = stored.df.where(F.size("x") == d)
    sums = same.mapInArrow(_sums, "n long, s array<long>").select("n", F.posexplode("s").alias("i", "s"))
    by = {r["i"]: r for r in sums.groupBy("i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    n, s = int(by[0]["n"]), [int(by[i]["s"]) for i in range(d)]
    centre = [(2 * x + n) // (2 * n) for x in s]  # the whole number nearest to the mean
    grams = same.mapInArrow(_products(np.array(centre, np.int64)), "i int, g array<long>").select("i", F.posexplode("g").alias("j", "g"))
    gram = grams.groupBy("i", "j").agg(F.sum(F.col("g").cast("decimal(38,0)")).alias("g")).toArrow()
    v, rest = np.zeros((d, d)), [x - n * c for x, c in zip(s, centre)]
    for i, j, g in zip(*(gram.column(c).to_pylist() for c in "ijg")):
        j += i
        v[i, j] = v[j, i] = (n * int(g) - rest[i] * rest[j]) / (n * n)
    values, found = leading(v, components)
    if not len(values):
        return spark.createDataFrame([], result)
    columns = [f"w{j}" for j in range(len(values))]
    exact = np.array(s, np.int64 if max(map(abs, s)) < 1 << 62 else object)
    out = Stored(same.mapInArrow(_project(n, exact, found, np.sqrt(values)), ", ".join(["vec_id long", "deviation string", *[f"{c} double" for c in columns]])), "whitened")
    stored.drop()
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    error = out.df.agg(*[F.abs(F.covar_pop(a, b) - F.lit(float(a == b))).alias(f"{a}{b}") for a, b in pairs]).first()
    table = F.explode(F.array(*[
        F.struct(F.lit(j + 1).alias("component"), F.col(c).alias("whitened"), F.lit(float(values[j] / np.trace(v))).alias("explained")) for j, c in enumerate(columns)]))
    return out.df.select("vec_id", "deviation", table.alias("c")).select(
        "vec_id", "c.component", F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "c.whitened", "c.explained",
        F.lit(float(max(error))).alias("identity_error"))
