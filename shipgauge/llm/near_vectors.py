"""Near copies among vectors by a pigeonhole join over subspaces.

Two unit vectors of cosine c are sqrt(2 - 2 c) apart. Split into BLOCKS blocks of
dimensions after a fixed rotation, a linked pair is, in one block at least, no farther
apart than that block's share of the squared distance (its share of the dimensions).
Each block is joined on its own: cells cut its space at quantiles, a vector is at home
in one cell and visits those of higher number that its ball reaches, and a cell's
home vectors meet one another and the visitors. A cell is one task's, a large one is
split into tiles that are joined pair by pair. A pair counts in the first block
that finds it, after its cosine has been computed from the vectors themselves, so the
union over blocks has every pair once.

Equal vectors are one node. A cell goes in tiles of bounded size, and what leaves the
comparison of two tiles is a count for each vector and a spanning forest of the links,
never pairs. Tiles whose bounding balls prove that all their pairs are linked are
counted without a comparison. Rotated coordinates are whole numbers whose products
are exact in doubles, so all tasks place and measure a vector alike.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from shipgauge.llm.frames import Stored, materialize, pick
from shipgauge.llm.graph import components
from shipgauge.llm.vectors import sound
from shipgauge.session import tune

COSINE = 0.95
BLOCKS = 8
# Vectors at home in a cell, on average; vectors of a tile.
CELL = 2_048
TILE = 2_048
# Beyond so many vectors a cell is split.
LARGE = 32 * TILE
# Tiles that a task keeps at hand while it meets those of a cell.
TILES_SEEN = 16
UNIT = 1 << 20
_NO_ID = (1 << 63) - 1
KEY = "dims int, block int, cell long"
ROUTED = f"{KEY}, home boolean, share int, place int, node long, n long, v binary"
TILED = f"{KEY}, home boolean, tile long, size int, nodes binary, n binary, v binary"


@lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    """A fixed random rotation in whole numbers of 1 / UNIT."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return np.rint(q * np.sign(np.diag(r)) * UNIT)


def rotated(v: np.ndarray) -> np.ndarray:
    """Unit vectors after the rotation, in whole numbers of 1 / UNIT: sums of exact products, whatever their order."""
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    unit = np.rint(scaled / np.sqrt((scaled * scaled).cumsum(axis=1)[:, -1:]) * UNIT)
    return np.floor(unit @ rotation(v.shape[1]) / UNIT)


class Space:
    """Blocks of ``d`` dimensions, each with its squared distance, and the cells of ``bits`` cuts."""

    def __init__(self, d: int, cosine: float, blocks: int, bits: int):
        self.cuts = [0, *np.cumsum([len(x) for x in np.array_split(np.arange(d), min(blocks, d))]).tolist()]
        self.blocks = list(zip(self.cuts, self.cuts[1:]))
        # Rounding moves a coordinate by less than d / 2 + 2 units.
        off = 2 * (d / 2 + 2) * math.sqrt(d)
        self.far = (math.sqrt(max(0.0, 2 - 2 * cosine)) * UNIT + off) ** 2
        self.budget = [self.far * (b - a) / d for a, b in self.blocks]
        spread, self.slots = NormalDist(0, UNIT / math.sqrt(d)), []
        for a, b in self.blocks:
            levels = [(bits + (b - a) - 1 - i) // (b - a) for i in range(b - a)]
            self.slots.append([np.array([spread.inv_cdf(k / 2 ** n) for k in range(1, 2 ** n)]) for n in levels])

    def route(self, x: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vector, cell and whether it is at home there, for every cell that it enters."""
        a, _ = self.blocks[block]
        who, cell, cost, home = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x), np.int64)
        for i, cuts in enumerate(self.slots[block]):
            value, width = x[who, a + i], len(cuts) + 1
            at = np.searchsorted(cuts, value, side="right")
            home = home * width + at
            edges = np.concatenate([[-np.inf], cuts, [np.inf]])
            parts = []
            for k in range(width):
                apart = np.maximum(0, np.maximum(edges[k] - value, value - edges[k + 1])) ** 2
                total = cost + apart
                on = np.flatnonzero(total <= self.budget[block])
                parts.append((who[on], cell[on] * width + k, total[on], home[on]))
            who, cell, cost, home = (np.concatenate(c) for c in zip(*parts))
        on = cell >= home
        return who[on], cell[on], (cell == home)[on]


def _matrix(blobs: list[bytes], d: int) -> np.ndarray:
    """Vectors as doubles; those whose numbers fit come as 4-byte floats."""
    if all(len(b) == 4 * d for b in blobs):
        return np.frombuffer(b"".join(blobs), "<f4").reshape(len(blobs), d).astype(np.float64)
    return np.stack([np.frombuffer(b, "<f4" if len(b) == 4 * d else "<f8").astype(np.float64) for b in blobs])


def _nodes(batches):
    """Digest and bytes of each vector; null for those that link with nothing."""
    for batch in batches:
        digests, blobs, dims = [], [], []
        column = batch.column("embedding")
        bounds, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        for good, a, b in zip(batch.column("good").to_pylist(), bounds.tolist(), bounds[1:].tolist()):
            v = flat[a:b].astype(np.float64) + 0.0  # one zero
            good = good and b > a and bool(v.any())
            raw = v.tobytes()
            narrow = v.astype("<f4")
            digests.append(xxhash.xxh3_128_digest(raw) if good else None)
            blobs.append((narrow.tobytes() if (narrow.astype(np.float64) == v).all() else raw) if good else None)
            dims.append(b - a)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())],
            names=["row", "vec_id", "dims", "digest", "v"])


def _routes(batches, cosine: float, blocks: int, bits: dict[int, int]):
    """Batches of one length with, block by block, which vector enters which cell and whether it is at home there."""
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == d))
            space, x = Space(d, cosine, blocks, bits.get(d, 0)), rotated(_matrix(part.column("v").to_pylist(), d))
            for block in range(len(space.blocks)):
                yield part, x, d, block, *space.route(x, block)


def _sizes(cosine: float, blocks: int, bits: dict[int, int]):
    def run(batches):
        for _, _, d, block, _, cell, _ in _routes(batches, cosine, blocks, bits):
            cells, n = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), d, np.int32)), pa.array(np.full(len(n), block, np.int32)), pa.array(cells), pa.array(n)], names=["dims", "block", "cell", "n"])

    return run


def _route(cosine: float, blocks: int, bits: dict[int, int], large: dict[tuple[int, int], dict[int, int]], want: bool):
    """Vectors by cell, of large cells (with the share of a cell that a vector is in) or of the others."""
    def run(batches):
        for part, x, d, block, who, cell, home in _routes(batches, cosine, blocks, bits):
            # Neighbours in a tile should be near one another: by the signs of the first dimensions.
            place = ((x[:, :24] > 0) @ (1 << np.arange(min(d, 24)))).astype(np.int32)
            parts = large.get((d, block), {})
            split = np.array([parts.get(c, 0) for c in cell.tolist()], np.int64) if parts else np.zeros(len(cell), np.int64)
            who, cell, home, split = (x[(split > 0) == want] for x in (who, cell, home, split))
            share = ((part.column("node").to_numpy()[who] * 2654435761 >> 8) % np.maximum(split, 1)).astype(np.int32)
            for a in range(0, len(who), TILE):
                some, size = pa.array(who[a:a + TILE]), len(who[a:a + TILE])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(size, d, np.int32)), pa.array(np.full(size, block, np.int32)), pa.array(cell[a:a + TILE]), pa.array(home[a:a + TILE]),
                    pa.array(share[a:a + TILE]), pa.array(place[who[a:a + TILE]]), *[part.column(c).take(some) for c in ("node", "n", "v")]],
                    names=[c.split()[0] for c in ROUTED.split(", ")])

    return run


def _tiles(batches, most: int = TILE):
    """Up to ``most`` neighbouring rows of one cell as one row."""
    held, key, size = [], None, 0

    def tile():
        d = key[0]
        nodes, n = (b"".join(np.ascontiguousarray(h[i], "<i8").tobytes() for h in held) for i in (0, 1))
        wide = any(len(h[2]) > 4 * d * len(h[0]) for h in held)
        v = b"".join(h[2] if len(h[2]) == (8 if wide else 4) * d * len(h[0]) else _matrix(h[3].to_pylist(), d).astype("<f8").tobytes() for h in held)
        columns = [*key, 0, size, nodes, n, v]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in TILED.split(", ")])

    for batch in batches:
        keys = np.stack([batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("dims", "block", "cell")] + [batch.column("home").cast(pa.int8()).to_numpy(zero_copy_only=False)], axis=1)
        nodes, n, v = batch.column("node").to_numpy(), batch.column("n").to_numpy(), batch.column("v")
        large = v.cast(pa.large_binary())
        raw, offsets = large.buffers()[2], np.frombuffer(large.buffers()[1], np.int64)[large.offset:large.offset + len(v) + 1]
        ends = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)).tolist() if len(keys) else []
        a = 0
        for end in ends:
            own = (int(keys[a, 0]), int(keys[a, 1]), int(keys[a, 2]), bool(keys[a, 3]))
            if held and own != key:
                yield tile()
                held, size = [], 0
            key = own
            while a < end:
                b = min(end, a + most - size)
                held.append((nodes[a:b], n[a:b], raw[int(offsets[a]):int(offsets[b])].to_pybytes(), v.slice(a, b - a)))
                size, a = size + b - a, b
                if size == most:
                    yield tile()
                    held, size = [], 0
    if held:
        yield tile()


class Tile:
    def __init__(self, d: int, nodes: bytes, n: bytes, v: bytes):
        self.nodes, self.n = np.frombuffer(nodes, "<i8"), np.frombuffer(n, "<i8")
        v = np.frombuffer(v, "<f4" if len(v) == 4 * d * len(self.nodes) else "<f8").reshape(-1, d).astype(np.float64)
        self.x = rotated(v)
        self.v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])  # by powers of two, which changes no cosine
        self.norms = np.sqrt((self.v * self.v).sum(axis=1))

    def wide(self, lo: int, hi: int, right: bool) -> np.ndarray:
        x = (self.x[:, lo:hi] / UNIT).astype(np.float32)
        square, one = (x * x).sum(axis=1)[:, None], np.ones((len(x), 1), np.float32)
        return np.concatenate([-2 * x, one, square] if right else [x, square, one], axis=1)

    def ball(self, a: int, b: int) -> tuple[np.ndarray, float]:
        centre = self.x[:, a:b].mean(axis=0)
        return centre, float(np.sqrt(((self.x[:, a:b] - centre) ** 2).sum(axis=1).max()))


def _sure(a: Tile, b: Tile, cut: tuple[int, int], far: float) -> bool:
    """All pairs of two tiles are within ``far`` in these dimensions: their bounding balls say so."""
    (ca, ra), (cb, rb) = a.ball(*cut), b.ball(*cut)
    return float(np.sqrt(((ca - cb) ** 2).sum())) + ra + rb <= math.sqrt(max(far, 0.0)) - 1


def compare(a: Tile, b: Tile, same: bool, space: Space, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each vector of a and of b into the other, and edges of a spanning forest of the links."""
    for earlier in range(block):
        if _sure(a, b, space.blocks[earlier], space.budget[earlier]):
            return np.zeros(len(a.n), np.int64), np.zeros(len(b.n), np.int64), np.zeros((0, 2), np.int64)
    # Well inside the distance, by more than all roundings.
    inside = (math.sqrt(max(0.0, 2 - 2 * cosine)) * UNIT - 2 * (a.x.shape[1] / 2 + 2) * math.sqrt(a.x.shape[1]) - 2) ** 2
    if block == 0 and _sure(a, b, space.blocks[0], space.budget[0]) and cosine < 1 and _sure(a, b, (0, a.x.shape[1]), inside):
        star = np.concatenate([np.stack([np.full(len(t.nodes), a.nodes[0]), t.nodes], axis=1) for t in (a, b)])
        if same:
            return int(a.n.sum()) - a.n, np.zeros(len(b.n), np.int64), star[1:len(a.n)]
        return np.full(len(a.n), b.n.sum()), np.full(len(b.n), a.n.sum()), star[1:]
    lo, hi = space.blocks[block]
    # A coarse look at all pairs in 4-byte floats, in products of (x, x^2, 1) and (-2 y, 1, y^2); what rounding may add is far below a thousandth.
    near = a.wide(lo, hi, False) @ b.wide(lo, hi, True).T <= np.float32(space.budget[block] / UNIT ** 2 * 1.001 + 1e-6)
    if same:
        near = np.triu(near, 1)
    i, j = np.divmod(np.flatnonzero(near), near.shape[1])
    # The distances of all blocks tell whether the pair is near enough at all, and which block counts it.
    keep = np.zeros(len(i), bool)
    for s in range(0, len(i), 1 << 15):
        x, y = i[s:s + (1 << 15)], j[s:s + (1 << 15)]
        square = (a.x[x] - b.x[y]) ** 2
        parts = np.stack([square[:, lo:hi].sum(axis=1) for lo, hi in space.blocks], axis=1)
        first = (parts <= np.array(space.budget)).argmax(axis=1)
        on = np.flatnonzero((first == block) & (parts.sum(axis=1) <= space.far))
        x, y = x[on], y[on]
        keep[s + on] = np.einsum("ij,ij->i", a.v[x], b.v[y]) / (a.norms[x] * b.norms[y]) >= cosine
    i, j = i[keep], j[keep]
    in_a = np.bincount(i, weights=b.n[j], minlength=len(a.n)).astype(np.int64)
    in_b = np.bincount(j, weights=a.n[i], minlength=len(b.n)).astype(np.int64)
    return in_a, in_b, _forest(a.nodes, b.nodes, i, j)


def _forest(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edges that connect what the pairs (left[i], right[j]) connect, one less than nodes at most."""
    if len(i) < 2:
        return np.stack([left[i], right[j]], axis=1)
    nodes, at = np.unique(np.concatenate([left[i], right[j]]), return_inverse=True)
    x, y, root = at[:len(i)], at[len(i):], np.arange(len(nodes))
    while True:
        low, before = np.minimum(root[x], root[y]), root.copy()
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            break
    edges = np.stack([nodes[root], nodes], axis=1)
    return edges[edges[:, 0] != edges[:, 1]]


def _result(pairs) -> pa.RecordBatch | None:
    """Counts and edges of (tile, other tile, what compare gives)."""
    nodes, counts, edges = [], [], []
    for a, b, (in_a, in_b, forest) in pairs:
        for t, n in ((a, in_a), (b, in_b)):
            nodes.append(t.nodes[n > 0])
            counts.append(n[n > 0])
        edges.append(forest)
    if not edges:
        return None
    edges, linked = np.concatenate(edges), sum(map(len, nodes))
    columns = [np.concatenate([*x, edges[:, k]]).astype(np.int64) for k, x in ((0, nodes), (1, counts))]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(columns[0])) >= linked), *map(pa.array, columns)], names=["edge", "a", "b"])


def _cells(cosine: float, blocks: int, bits: dict[int, int], most: int):
    """Cells one after the other: tiles at home meet one another, then each tile of visitors meets them."""
    def run(batches):
        spaces, homes, key = {}, [], None
        for row in (b.to_pylist()[0] for b in _tiles(batches, most)):
            d, block = row["dims"], row["block"]
            if d not in spaces:
                spaces[d] = Space(d, cosine, blocks, bits.get(d, 0))
            if key != (d, block, row["cell"]):
                key, homes = (d, block, row["cell"]), []
            if row["home"] or homes:
                tile = Tile(d, row["nodes"], row["n"], row["v"])
                if row["home"]:
                    homes.append(tile)
                out = _result((home, tile, compare(home, tile, home is tile, spaces[d], block, cosine)) for home in homes)
                if out is not None and len(out):
                    yield out

    return run


def _meet(cosine: float, blocks: int, bits: dict[int, int]):
    """Pairs of tiles of large cells."""
    def run(batches):
        spaces, seen = {}, OrderedDict()

        def tile(key, d, *data):
            if key not in seen:
                seen[key] = Tile(d, *data)
                if len(seen) > TILES_SEEN:
                    seen.popitem(last=False)
            seen.move_to_end(key)
            return seen[key]

        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                d = row["dims"]
                if d not in spaces:
                    spaces[d] = Space(d, cosine, blocks, bits.get(d, 0))
                a, b = (tile(row[f"{p}tile"], d, row[f"{p}nodes"], row[f"{p}n"], row[f"{p}v"]) for p in ("", "b_"))
                yield _result([(a, b, compare(a, b, a is b, spaces[d], row["block"], cosine))])

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, cell: int = CELL, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``.

    Two rows are linked if the cosine of their vectors, in double precision, is at
    least ``cosine`` (from 0 to 1); n_links counts the rows linked with a row, component_id
    is the smallest vec_id that links reach from it, kept says that this is its own.
    Labels do not matter. Vectors that are null, empty, zero or hold a null or a number
    that is not finite link with nothing, and vectors of different lengths not with one
    another. Rows with equal vectors are linked, repeated rows too; each row of a
    repeated vec_id has its own result. A null vec_id is never the smallest one unless
    there is no other: then component_id is null and kept is true. An empty table gives
    an empty result. Other columns are not looked at.

    ``cell`` and ``tile`` set how many vectors cells and tiles have; they change the work, not the result.
    """
    tune(vectors.sparkSession)
    rows = pick(vectors, vec_id="long", embedding="array<double>").select(
        F.monotonically_increasing_id().alias("row"), "vec_id", F.coalesce("embedding", F.array().cast("array<double>")).alias("embedding"),
        F.coalesce(sound(), F.lit(False)).alias("good"))
    rows = rows.withColumn("embedding", F.when(F.col("good"), F.col("embedding")).otherwise(F.array().cast("array<double>")))
    stored = Stored(rows.mapInArrow(_nodes, "row long, vec_id long, dims int, digest binary, v binary"), "vectors")
    nodes = Stored(stored.df.where("digest IS NOT NULL").groupBy("dims", "digest").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n"), F.any_value("v").alias("v")), "nodes")
    placed = materialize(stored.df.select("row", "vec_id", "digest", "dims").join(nodes.df.select("dims", "digest", "node", "n"), ["dims", "digest"], "left"), "placed")
    stored.drop()
    bits = {r["dims"]: max(0, math.ceil(math.log2(r["count"] / cell))) for r in nodes.df.groupBy("dims").count().where(F.col("count") > cell).collect()}
    key = ["dims", "block", "cell"]
    plain = nodes.df.select("dims", "node", "n", "v")
    # Cells of very many vectors, at most a few thousandths of what there is, are dealt over several tasks.
    sizes = plain.mapInArrow(_sizes(cosine, blocks, bits), f"{KEY}, n long").groupBy(*key).agg(F.sum("n").alias("n")).where(F.col("n") > LARGE)
    large: dict[tuple[int, int], dict[int, int]] = {}
    for r in sizes.collect():
        large.setdefault((r["dims"], r["block"]), {})[r["cell"]] = -(-r["n"] // LARGE)
    links_of = "edge boolean, a long, b long"
    dealt = plain.mapInArrow(_route(cosine, blocks, bits, large, False), ROUTED).repartition(*key).sortWithinPartitions(*key, F.desc("home"), "place")
    found = dealt.mapInArrow(_cells(cosine, blocks, bits, tile), links_of)
    if large:
        dealt = plain.mapInArrow(_route(cosine, blocks, bits, large, True), ROUTED).repartition(*key, "share").sortWithinPartitions(*key, "home", "share", "place")
        tiles = materialize(dealt.mapInArrow(lambda batches: _tiles(batches, tile), TILED).withColumn("tile", F.monotonically_increasing_id()), "tiles")
        home = tiles.where("home").drop("home", "size")
        other = tiles.select(*key, "home", *[F.col(c).alias(f"b_{c}") for c in ("tile", "nodes", "n", "v")])
        met = home.join(other, key).where(~F.col("home") | (F.col("tile") <= F.col("b_tile"))).drop("home")
        found = found.union(met.mapInArrow(_meet(cosine, blocks, bits), links_of))
    found = Stored(found, "found")
    nodes.drop()
    links = found.df.where("NOT edge").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    roots = components(found.df.where("edge").select("a", "b").distinct())
    of_row = (
        placed.join(links, "node", "left").join(roots, "node", "left")
        .select("row", "vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("n_links"), F.coalesce("root", "node", "row").alias("root")))
    least = of_row.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return of_row.join(least, "root").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
