"""Near vectors and whitening against brute force."""

import math
import random

import numpy as np
import pytest

from shipgauge.llm import near_vectors as nv, whitening as wh

VECTORS = "vec_id long, embedding array<double>, label int"


def table(spark, rows, parts=5):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], VECTORS).repartition(parts)


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, cosine):
    rows, links, root = list(rows), [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if usable(a) and usable(b) and len(a) == len(b):
                x, y = np.array(a, float) / max(map(abs, a)), np.array(b, float) / max(map(abs, b))
                if float(x @ y) / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= cosine:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    root[find(i)] = find(j)
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(v, least.get(find(i), v))
    return sorted(((v, n, least.get(find(i)), v == least.get(find(i))) for i, ((v, _), n) in enumerate(zip(rows, links))), key=str)


def planted(seed, dims, n=300):
    """Centres, points around them at all distances near the limit, one tight group and copies."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((20, dims))
    out = [c + r.standard_normal(dims) * s * np.linalg.norm(c) / math.sqrt(dims) for c in centres for s in np.linspace(0.1, 0.5, n // 20)]
    tight = r.standard_normal(dims)
    out += [tight + r.standard_normal(dims) * 0.02 for _ in range(80)]
    out += [out[3]] * 5 + [out[7] * 3, out[8] * 0.25]
    return [(1000 + i, v.tolist()) for i, v in enumerate(out)]


def odd():
    far = [19.0, 5.0, 3.0, 2.0, 1.0]  # cosine 19 / 20 with the first axis
    return [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 2.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0]),
        (None, [5.0, -9.0, 2.0]), (8, [1e200, 1e200]), (9, [1e-200, 1e-200]), (9, [1e-200, 1e-200]), (10, [1.0, 1.0]), (11, [-0.0, 1.0]), (12, [0.0, 1.0]),
        (13, [1.0, 0.0, 0.0, 0.0, 0.0]), (14, far), (15, [19.0, 5.001, 3.0, 2.0, 1.0]), (16, [3.0]), (17, [7.0]), (18, [-7.0]), (19, [2.0 ** 0.5] * 3), (20, [1.0] * 3)]


@pytest.mark.parametrize("dims, blocks, cell, tile, large", [
    (64, 8, 2048, 2048, 1 << 16), (64, 8, 8, 16, 40), (64, 3, 2, 7, 5), (7, 4, 4, 9, 1), (2, 8, 10, 50, 20), (1, 8, 1, 5, 20)])
def test_near_vectors(spark, dims, blocks, cell, tile, large, monkeypatch):
    """Cells of any size, whole or split into tiles, give the same."""
    monkeypatch.setattr(nv, "LARGE", large)
    rows = planted(dims, dims, 300 if dims > 7 else 60)
    got = nv.near_vectors(table(spark, rows), blocks=blocks, cell=cell, tile=tile).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 0.95)


def test_odd_vectors(spark):
    rows = odd()
    for cosine in (0.95, 0.5):
        got = nv.near_vectors(table(spark, rows), cosine=cosine, cell=2).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, cosine)
    assert nv.near_vectors(table(spark, [], 1)).collect() == []
    wide = table(spark, rows).selectExpr("*", "1 AS row", "2 AS node", "3 AS VEC_ID", "'x' AS tile")
    assert nv.near_vectors(wide.toDF(*wide.columns)).count() == len(rows)


def test_tight_tiles_are_counted_without_comparison(monkeypatch):
    """Two tiles of one tight group: counts by product, links as a star."""
    r = np.random.default_rng(0)
    v = (np.ones(64) + r.standard_normal((40, 64)) * 0.001).astype("<f4")
    a, b = (nv.Tile(64, np.arange(s, s + 20).astype("<i8").tobytes(), np.full(20, 2, "<i8").tobytes(), v[s:s + 20].tobytes()) for s in (0, 20))
    space = nv.Space(64, 0.95, 8, 0)
    monkeypatch.setattr(nv.np, "nonzero", None)
    in_a, in_b, edges = nv.compare(a, b, False, space, 0, 0.95)
    assert in_a.tolist() == [40] * 20 and in_b.tolist() == [40] * 20 and len(edges) == 39
    in_a, _, edges = nv.compare(a, a, True, space, 0, 0.95)
    assert in_a.tolist() == [38] * 20 and len(edges) == 19
    assert all(nv.compare(a, b, False, space, block, 0.95)[0].sum() == 0 for block in range(1, 8))


def test_every_pair_counts_in_one_block():
    """Whatever the cells: a pair is met in its first block, and never twice."""
    r = np.random.default_rng(1)
    v = r.standard_normal((30, 16))
    v = np.concatenate([v, v + r.standard_normal((30, 16)) * 0.15])
    space = nv.Space(16, 0.95, 4, 6)
    x, met = nv.rotated(v), {}
    for block in range(4):
        who, cell, home = space.route(x, block)
        at = {}
        for w, c, h in zip(who.tolist(), cell.tolist(), home.tolist()):
            at.setdefault(c, ([], []))[0 if h else 1].append(w)
        assert sorted(w for hs, _ in at.values() for w in hs) == list(range(60))
        for hs, vs in at.values():
            for a in hs:
                for b in hs + vs:
                    if a < b or b in vs:
                        lo, hi = space.blocks[block]
                        if ((x[a] - x[b])[lo:hi] ** 2).sum() <= space.budget[block]:
                            met.setdefault((min(a, b), max(a, b)), []).append(block)
    assert all(len(set(m)) == len(m) for m in met.values())
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    assert {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.95, 1)))} <= set(met)


def check_whitening(rows, got, k=8):
    good = [(i, v) for i, v in rows if usable(v) or (v is not None and v and all(x is not None and math.isfinite(x) for x in v))]
    lengths = {}
    for _, v in good:
        lengths[len(v)] = lengths.get(len(v), 0) + 1
    d = max(lengths, key=lambda x: (lengths[x], x))
    good = [(i, v) for i, v in good if len(v) == d]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in good]
    n, s = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[float(n * c - t) / n for c, t in zip(row, s)] for row in x])
    v = y.T @ y / n
    values = np.linalg.eigvalsh(v)[::-1]
    rank = int((values > d * np.finfo(float).eps * np.abs(v).sum(axis=1).max()).sum())
    k = min(k, rank)
    assert len(got) == n * k
    deviation = sorted((str(i), sum((n * c - t) ** 2 for c, t in zip(row, s))) for (i, _), row in zip(good, x))
    assert sorted((str(r.vec_id), int(r.deviation)) for r in got if r.component == 1) == deviation
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    for j in range(k):
        own = [r for r in got if r.component == j + 1]
        assert abs(own[0].explained - values[j] / np.trace(v)) < 1e-12 * max(1, 1 / values[j])
        w = np.array([r.whitened for r in own])
        assert abs((w * w).mean() - 1) < 1e-9 and abs(w.mean()) < 1e-9
    return good, y, v, values


def test_whitening(spark):
    r = np.random.default_rng(2)
    rows = [(i, (r.standard_normal(12) * np.arange(1, 13) * 0.3 + 5).tolist()) for i in range(400)]
    rows += [(500, None), (501, [1.0] * 11 + [None]), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (504, []), (505, [1.0, 2.0]), (None, rows[0][1]), (3, rows[3][1])]
    got = wh.whiten(table(spark, rows)).collect()
    good, y, v, values = check_whitening(rows, got)
    _, vectors = np.linalg.eigh(v)
    for j in range(8):
        u = vectors[:, -1 - j]
        u = u if u[np.abs(u).argmax()] > 0 else -u
        expected = sorted((str(i), w) for (i, _), w in zip(good, (y @ u) / math.sqrt(values[j])))
        mine = sorted((str(x.vec_id), x.whitened) for x in got if x.component == j + 1)
        assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-8 for a, b in zip(expected, mine))


def test_whitening_of_small_and_flat_tables(spark):
    line = [(i, [float(i), 2.0 * i, 0.5]) for i in range(20)]
    check_whitening(line, wh.whiten(table(spark, line)).collect())
    assert wh.whiten(table(spark, [(1, [0.5, 0.25])] * 3)).collect() == []
    assert wh.whiten(table(spark, [], 1)).collect() == [] and wh.whiten(table(spark, [(1, None), (2, [])])).collect() == []
    with pytest.raises(Exception, match="too large"):
        wh.whiten(table(spark, [(1, [1e30]), (2, [1.0])])).collect()


def test_products_are_whole_whatever_their_size(spark):
    rows = [(i, [random.Random(i).uniform(-1e5, 1e5) for _ in range(3)]) for i in range(50)]
    check_whitening(rows, wh.whiten(table(spark, rows)).collect())


@pytest.mark.parametrize("dims", [1, 2, 5, 40])
def test_spectrum(dims):
    r = np.random.default_rng(dims)
    a = r.standard_normal((dims, dims))
    q, _ = np.linalg.qr(a)
    for values in (np.sort(r.uniform(0, 1, dims))[::-1], np.full(dims, 2.0), np.round(np.sort(r.uniform(0, 3, dims))[::-1]), np.r_[1.0, np.full(dims - 1, 1e-9)]):
        v = (q * values) @ q.T
        v = (v + v.T) / 2
        exact = np.linalg.eigvalsh(v)
        for s in (-1.0, 0.3, 0.9999, 1.0001, 2.5, 4.0):
            assert wh.below(v, s) == (exact < s).sum()
        e, u = wh.leading(v, 8)
        assert np.allclose(e, exact[::-1][:len(e)], rtol=0, atol=1e-13) and np.allclose(u @ u.T, np.eye(len(e)), atol=1e-12)
        assert np.abs(u @ v - e[:, None] * u).max() < 1e-12 if len(e) else True
