"""Exact top-k search by branch and bound over a vertical layout.

Vectors of integers stand in tiles, dimension by dimension. A query goes through
the dimensions block by block, those where it is largest first, and adds up partial
scores; after each block a candidate stays only if its partial score and the largest
score that the remaining dimensions can give (the product of the remaining norms)
reach the k-th best score known so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from shipgauge.llm.frames import materialize, pick

SCALE = 1024
# Dimensions per block, vectors per tile of candidates, queries per tile of queries.
BLOCK = 16
TILE = 8_192
QUERIES = 512
TILES = "kind int, dims int, tile long, ids binary, data binary"
HITS = "query_id long, vec_id long, score long"


def _integers(df: DataFrame) -> DataFrame:
    """vec_id and v: whole numbers floor(SCALE * x). A repeated vec_id counts once, with its smallest vector."""
    rows = pick(df, vec_id="long", embedding="array<double>").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    sound = rows.where(F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"))
    scaled = sound.select("vec_id", F.expr(f"transform(embedding, x -> bigint(floor({SCALE}D * x)))").alias("v"))
    return scaled.groupBy("vec_id").agg(F.min("v").alias("v"))


class Tile:
    """Candidates: ids ascending and one row of numbers per dimension."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray):
        self.ids, self.columns = ids, columns  # columns: dims x vectors
        self.cuts = list(range(0, len(columns), BLOCK)) or [0]
        parts = [columns[c:c + BLOCK].astype(np.float64) for c in self.cuts]
        self.mass = np.stack([np.einsum("dn,dn->n", p, p) for p in parts])  # squared norms by block

    def search(self, query_id: int, q: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and scores of the tile's k best at or above ``least``, and how many products that took."""
        own = [q[c:c + BLOCK] for c in self.cuts]
        q_mass = np.array([float(p.astype(np.float64) @ p) for p in own])
        order = np.argsort(-q_mass, kind="stable")
        alive = np.flatnonzero(self.ids != query_id)
        score, products = np.zeros(len(alive), np.int64), 0
        left, q_left = self.mass[:, alive].sum(axis=0), q_mass.sum()
        for b in order:
            cut = self.cuts[b]
            score = score + own[b] @ self.columns[cut:cut + BLOCK, alive]
            products += len(own[b]) * len(alive)
            left, q_left = np.maximum(left - self.mass[b, alive], 0), max(q_left - q_mass[b], 0.0)
            if b == order[-1]:
                break
            # A little over the bound, for what rounding takes from the norms.
            reach = np.sqrt(left * q_left) * (1 + 1e-9) + 1
            if len(alive) > k:
                least = max(least, float(np.partition(score - reach, len(alive) - k)[len(alive) - k]))
            stay = score + reach >= least
            if not stay.all():
                alive, score, left = alive[stay], score[stay], left[stay]
        stay = score >= least
        alive, score = alive[stay], score[stay]
        best = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive[best]], score[best], products


def _tiles(rows: DataFrame, kind: int, size: int) -> DataFrame:
    """Rows of ``size`` vectors each: ids and numbers, dimension by dimension."""
    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        made = 0

        def tile(dims):
            nonlocal made
            ids, vectors = held.pop(dims)
            ids, data = np.concatenate(ids), np.concatenate(vectors)
            by_id = np.argsort(ids, kind="stable")
            made += 1
            columns = [[kind], [dims], [made], [ids[by_id].astype("<i8").tobytes()], [_bytes(data[by_id].T)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in TILES.split(", ")])

        for batch in batches:
            vectors = batch.column("v")
            lengths, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy(zero_copy_only=False)
            ids, starts = batch.column("vec_id").to_numpy(), np.cumsum(lengths) - lengths
            for dims in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dims)
                data = flat[starts[own][:, None] + np.arange(dims)]
                for a in range(0, len(own), size):
                    got = held.setdefault(dims, ([], []))
                    room = size - sum(map(len, got[0]))
                    for x, y in ((a, min(a + room, a + size)), (min(a + room, a + size), a + size)):
                        if len(own[x:y]):
                            got = held.setdefault(dims, ([], []))
                            got[0].append(ids[own[x:y]])
                            got[1].append(data[x:y])
                            if sum(map(len, got[0])) >= size:
                                yield tile(dims)
        for dims in list(held):
            yield tile(dims)

    return rows.mapInArrow(run, TILES)


def _bytes(columns: np.ndarray) -> bytes:
    """Row by row, in 4 bytes a number where they suffice."""
    small = not columns.size or np.abs(columns).max() < 1 << 31
    return np.ascontiguousarray(columns).astype("<i4" if small else "<i8").tobytes()


def _load(ids: bytes, data: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    kind = "<i4" if len(data) == 4 * dims * len(ids) else "<i8"
    return ids, np.frombuffer(data, kind).reshape(dims, len(ids)).astype(np.int64)


def _meet(k: int):
    """Candidates of one tile against one tile of queries after the other."""
    def run(batches):
        key, tile = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if key != row["tile"]:
                    key, tile = row["tile"], Tile(*_load(row["ids"], row["data"], row["dims"]))
                q_ids, q = _load(row["q_ids"], row["q_data"], row["dims"])
                if row["dims"] and max(abs(int(q.min())), abs(int(q.max()))) * max(abs(int(tile.columns.min())), abs(int(tile.columns.max()))) * row["dims"] >= 1 << 62:
                    raise ArithmeticError("scores of these vectors may not fit a BIGINT")
                out = [[], [], []]
                for i, query_id in enumerate(q_ids.tolist()):
                    ids, scores, _ = tile.search(query_id, q[:, i], k, -np.inf)
                    for column, v in zip(out, (np.full(len(ids), query_id), ids, scores)):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=[c.split()[0] for c in HITS.split(", ")])

    return run


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest integer inner products, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows
    but the query's own. Vectors that are null, hold a null or a number that is not
    finite, or have no vec_id take no part; vectors of another length than the
    query's are not compared with it, empty ones have score 0 among themselves. A
    repeated vec_id counts once. Numbers so large that a score might not fit a BIGINT
    are an error. An empty table gives an empty result. Other columns are not looked at.

    Each tile of queries meets each tile of candidates of its length once; both are
    of bounded size, and a pair gives k rows per query.
    """
    spark = vectors.sparkSession
    sound = materialize(_integers(vectors), "integers")
    n = max(1, -(-sound.count() // TILE))
    spread = sound.repartition(n, F.xxhash64("vec_id") % F.lit(n))
    candidates = materialize(_tiles(spread, 0, TILE).withColumn("tile", F.xxhash64(F.monotonically_increasing_id())), "tiles")
    asked = sound.where(F.col("vec_id") % every == 0)
    q = max(1, -(-n // every)) * max(1, TILE // (QUERIES * every))
    queries = _tiles(asked.repartition(q, F.xxhash64("vec_id") % F.lit(q)), 1, QUERIES)
    # The stated queries against all rows, in blocks: every tile of queries is sent to every group of candidate tiles.
    groups = max(1, min(n, spark.sparkContext.defaultParallelism * 4))
    sent = queries.select("dims", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    dealt = candidates.withColumn("group", F.pmod(F.col("tile"), F.lit(groups)).cast("int"))
    pairs = dealt.join(sent, ["group", "dims"]).select("tile", "dims", "ids", "data", "q_ids", "q_data")
    hits = pairs.mapInArrow(_meet(k), HITS)
    by_query = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
