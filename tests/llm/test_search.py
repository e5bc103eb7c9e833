"""Top-k against brute force, the registered queries against SQL, and the pipeline stage by stage."""

import os
import random

import numpy as np
import pytest

import __spark_entry__ as contract
from checks.compare import connect, rows as plain
from shipgauge.llm import topk
from shipgauge.llm.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    sound, seen = {}, set()
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        ints = [int(np.floor(1024 * float(np.float32(x)))) for x in v]
        sound[i] = min(sound.get(i, ints), ints)
    out = set()
    for q, a in sound.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound.items() if i != q and len(a) == len(b))
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("tile, queries", [(16, 4), (8192, 512)])
def test_exact_top_k(spark, tile, queries, monkeypatch):
    monkeypatch.setattr(topk, "TILE", tile)
    monkeypatch.setattr(topk, "QUERIES", queries)
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(40)], 0) for i in range(150)]
    rows += [(200 + i, rows[0][1], 0) for i in range(30)]  # ties
    rows += [(300, None, 0), (301, [0.1, None], 0), (302, [float("nan")] * 40, 0), (303, [float("inf")] * 40, 0), (None, rows[0][1], 0)]
    rows += [(310, [], 0), (320, [], 0), (330, [0.5, 0.25], 0), (340, [1.0, -1.0], 0), (350, [1e5] * 3, 0), (360, [-1e5] * 3, 0)]
    rows += [(0, rows[5][1], 0), (10, rows[10][1], 0)]  # repeated ids
    got = topk.exact_top_k(spark.createDataFrame(rows, VECTORS).repartition(3), k=5, every=10).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute(rows, 5, 10) and len(got) == len(brute(rows, 5, 10))


def test_bounds_leave_work_out():
    """A good part of a clustered tile's candidates go before their last dimension."""
    r = np.random.default_rng(0)
    centres = r.integers(-400, 400, (20, 64))
    data = (centres[r.integers(0, 20, 4000)] + r.integers(-40, 40, (4000, 64))).T.astype(np.int64)
    tile = topk.Tile(np.arange(4000), np.ascontiguousarray(data))
    ids, scores, products = tile.search(0, data[:, 0], 10, -np.inf)
    order = np.lexsort((np.arange(4000), -(data.T @ data[:, 0])))
    assert ids.tolist() == [i for i in order if i][:10]
    assert products < 0.8 * data.size


def test_no_vectors_and_too_large_ones(spark):
    assert topk.exact_top_k(spark.createDataFrame([], VECTORS)).collect() == []
    big = spark.createDataFrame([(0, [3e12], 0), (1, [3e12], 0)], VECTORS)
    with pytest.raises(Exception, match="BIGINT"):
        topk.exact_top_k(big).collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    df, cur = QUERIES[name](spark, SF), connect(SF).execute(SQL[name])
    assert plain(df.columns, df.collect()) == plain([c[0] for c in cur.description], cur.fetchall())


def test_all_are_registered():
    own = [n for n in contract.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in own] == [f"op{i}" for i in range(1, 14)] and "pipeline" in contract.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    """Every stage against what its operator says of the stage's own input."""
    import corpus_pipeline
    from shipgauge.llm.exact_dup import exact_duplicates
    from shipgauge.llm.frames import materialize
    from shipgauge.llm.language import language_id
    from shipgauge.llm.near_dup import near_duplicates
    from tests.llm.test_tokens import check_pieces

    docs, names = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), "stage")
        before, after = ([r.doc_id for r in df.select("doc_id").collect()] for df in (docs, out))
        if name == "language ID":
            assert sorted(after) == sorted(r.doc_id for r in language_id(docs).collect() if r.lang_pred != "und")
        if name == "exact dedup":
            assert sorted(after) == sorted(r.doc_id for r in exact_duplicates(docs).collect() if r.kept)
        if name == "near dedup":
            assert sorted(after) == sorted(r.doc_id for r in near_duplicates(docs).collect() if r.kept)
        if name == "packing":
            check_pieces([r for r in out.collect()], [(r.doc_id, r.text) for r in docs.collect()], 4096)
        else:
            assert out.columns == columns and set(after) <= set(before)
        names.append(name)
        docs = out
    assert len(names) == 5 and corpus_pipeline.run(spark, SF).count() > 0
