"""Completion quantiles: edge cases, order, independence of partitioning."""

import statistics

import numpy as np
import pytest

from shipgauge.functions import draws
from shipgauge.operators import quantiles, rollup
from tests.util import by, item, items, now

CAPACITY = "project_key STRING, capacity DOUBLE"
DIST = "project_key STRING, size STRING, remaining BIGINT, mean DOUBLE, stddev DOUBLE"


def run(spark, *rows, capacity=8.0, **kw):
    sizes = rollup.size_distribution(rollup.size_facts(items(spark, *rows), now()))
    caps = spark.createDataFrame([("P", capacity)], CAPACITY)
    got = quantiles.completion_quantiles(sizes, caps, **{"iterations": 200, **kw}).collect()
    return {r["pct"]: r["days"] for r in got}


def test_levels_do_not_decrease(spark):
    got = run(spark, item("Done", cycle=4), item("Done", cycle=5), item("To Do"), iterations=10_000)
    assert got[50] <= got[70] <= got[85] <= got[95]


def test_nothing_remaining(spark):
    assert run(spark, item("Done", cycle=4), item("Done", cycle=5)) == {50: 0, 70: 0, 85: 0, 95: 0}


def test_one_sample_is_certain(spark):
    assert set(run(spark, item("Done", cycle=4), item("To Do")).values()) == {0.5}


def test_any_level_can_be_asked(spark):
    got = run(spark, item("Done", cycle=4), item("To Do"), percentiles=(1, 90, 99, 100))
    assert got == {1: 0.5, 90: 0.5, 99: 0.5, 100: 0.5}


def test_default_capacity(spark):
    assert run(spark, item("Done", cycle=4), item("To Do"), capacity=None)[50] == 0.5
    assert run(spark, item("Done", cycle=4), item("To Do"), capacity=4.0)[50] == 1.0


def test_default_distributions(spark):
    rows = [item("To Do", z) for z in ("S", "M", "L", "XL", "Huge", "")]
    sizes = rollup.size_distribution(rollup.size_facts(items(spark, *rows), now()))
    got = {k: (v["mean"], v["stddev"]) for k, v in by(quantiles.effective_distribution(sizes), "size").items()}
    assert got == {
        "S": (1.5, 0.5), "M": (4.0, 1.5), "L": (8.0, 2.5), "XL": (16.0, 5.0), "Huge": (4.0, 2.0), "": (4.0, 2.0),
    }


def test_floor_of_half_an_hour(spark):
    dist = spark.createDataFrame([("P", "S", 3, -50.0, 1.0)], DIST)
    got = {r["total_ms"] for r in quantiles.iteration_totals(dist, 20, 1).collect()}
    assert got == {3 * 1_800_000}


@pytest.mark.parametrize("n,pct,nearest,compat", [(10_000, 50, 5000, 5001), (10, 95, 10, 10), (1, 50, 1, 1), (7, 70, 5, 6)])
def test_ranks(n, pct, nearest, compat):
    assert quantiles.rank_of(pct, n, "nearest") == nearest
    assert quantiles.rank_of(pct, n, "compat") == compat


def test_result_does_not_depend_on_partitioning(spark):
    dist = spark.createDataFrame([("P", "S", 7, 5.0, 2.0), ("P", "M", 4, 9.0, 3.0), ("Q", "S", 1, 5.0, 2.0)], DIST)
    first = sorted(map(tuple, quantiles.iteration_totals(dist, 120, 42, tasks=1).collect()))
    again = sorted(map(tuple, quantiles.iteration_totals(dist.repartition(5), 120, 42, tasks=17).collect()))
    other = sorted(map(tuple, quantiles.iteration_totals(dist, 120, 43, tasks=3).collect()))
    assert first == again and len(first) == 240
    assert first != other


def test_prefix_of_iterations_is_stable(spark):
    dist = spark.createDataFrame([("P", "S", 5, 5.0, 2.0)], DIST)
    few = {tuple(r) for r in quantiles.iteration_totals(dist, 30, 42).collect()}
    many = {tuple(r) for r in quantiles.iteration_totals(dist, 130, 42).collect()}
    assert few < many


def test_items_beyond_one_chunk_are_all_drawn(spark, monkeypatch):
    monkeypatch.setattr(draws, "PAIRS_PER_CHUNK", 3)
    for n in range(1, 27):
        dist = spark.createDataFrame([("P", "S", n, 2.0, 0.0)], DIST)
        got = {r["total_ms"] for r in quantiles.iteration_totals(dist, 2, 42).collect()}
        assert got == {n * 7_200_000}, n


def test_draws_look_normal_and_uncorrelated(spark):
    """Totals of one item are mean + sd * z; check moments and neighbours."""
    dist = spark.createDataFrame([("P", "S", 1, 1000.0, 100.0), ("Q", "S", 1, 1000.0, 100.0)], DIST)
    rows = quantiles.iteration_totals(dist, 20_000, 42).orderBy("project_key", "iteration").collect()
    z = {p: [(r["total_ms"] / 3_600_000 - 1000) / 100 for r in rows if r["project_key"] == p] for p in "PQ"}
    for values in z.values():
        assert abs(statistics.fmean(values)) < 0.03
        assert abs(statistics.pstdev(values) - 1) < 0.02
        assert abs(statistics.correlation(values[:-1], values[1:])) < 0.03
        assert abs(sum(abs(v) < 1 for v in values) / len(values) - 0.6827) < 0.015
    assert abs(statistics.correlation(z["P"], z["Q"])) < 0.03


def test_items_of_one_iteration_are_uncorrelated(spark):
    """The deviation of a sum of n independent draws grows with sqrt(n)."""
    dist = spark.createDataFrame([("P", "S", 400, 1000.0, 100.0)], DIST)
    totals = [r["total_ms"] / 3_600_000 for r in quantiles.iteration_totals(dist, 4_000, 42).collect()]
    assert abs(statistics.fmean(totals) - 400_000) < 150
    assert abs(statistics.pstdev(totals) / 2000 - 1) < 0.06


def test_timeline_and_map(spark):
    sizes = rollup.size_distribution(rollup.size_facts(items(spark, item("Done", cycle=20), item("To Do")), now()))
    caps = spark.createDataFrame([("P", 8.0)], CAPACITY)
    q = quantiles.completion_quantiles(sizes, caps, iterations=10)
    rows = by(quantiles.timeline(q, now()), "pct")
    assert sorted(rows) == [0, 50, 70, 85, 95]
    assert str(rows[0]["target_date"]) == "2026-06-01" and str(rows[85]["target_date"]) == "2026-06-03"
    assert quantiles.percentile_map(q).collect()[0]["percentiles"] == {50: 2.5, 70: 2.5, 85: 2.5, 95: 2.5}


def test_result_does_not_depend_on_units_and_blocks(spark, monkeypatch):
    dist = spark.createDataFrame([("P", "S", 25, 5.0, 2.0), ("Q", "M", 4, 9.0, 3.0)], DIST)
    whole = sorted(map(tuple, quantiles.iteration_totals(dist, 90, 42).collect()))
    monkeypatch.setattr(quantiles, "PAIRS_PER_UNIT", 40)
    monkeypatch.setattr(draws, "PAIRS_PER_BLOCK", 16)
    assert sorted(map(tuple, quantiles.iteration_totals(dist, 90, 42).collect())) == whole


def test_a_unit_is_the_sum_of_its_items(spark):
    """Drawing the chunk item by item gives the same milliseconds."""
    import numpy as np

    its = np.arange(5, dtype=np.int32)
    sums = [draws.block_totals(11, 22, 3, n, 5.0, 2.0, its) for n in range(1, 9)]
    steps = np.diff(np.array(sums), axis=0)
    assert (steps >= 1_800_000).all() and len(np.unique(steps)) == steps.size


def test_classes_stand_between_observed_and_default(spark):
    """The finest level that has items; a project without a type, or of one without a class, goes by the default."""
    from shipgauge.operators import refclass

    old = spark.createDataFrame([(1, "web"), (2, "web"), (3, "app")], "project_id INT, type STRING")
    done = spark.createDataFrame(
        [(1, "Fix", "S", 2.0), (2, "Fix", "S", 4.0), (1, "Api", "S", 9.0), (2, "Api", "L", 10.0), (9, "Fix", "S", 99.0)],
        "project_id INT, item_type STRING, size STRING, cycle_hours DOUBLE")
    classes = refclass.backoff_distribution(old, done)
    got = by(classes, "type", "level", "item_type", "size")
    assert len(got) == 6 and got["web", 3, "Fix", "S"]["mean"] == 3.0 and got["web", 3, "Fix", "S"]["stddev"] == 1.0
    assert got["web", 2, None, "S"]["mean"] == 5.0 and got["web", 1, None, None]["n"] == 4
    sizes = spark.createDataFrame(
        [("P", "Fix", "S", 2, 7.0, 1.0, 1), ("P", "Fix", "L", 0, None, None, 2), ("P", "Fix", "XL", 0, None, None, 3), ("P", "Api", "L", 0, None, None, 4),
         ("Q", "Fix", "S", 0, None, None, 5), ("R", "Fix", "M", 0, None, None, 6)],
        "project_key STRING, item_type STRING, size STRING, n INT, mean DOUBLE, stddev DOUBLE, remaining INT")
    projects = spark.createDataFrame([("P", "web"), ("Q", "app"), ("R", None)], "project_key STRING, type STRING")
    rows = quantiles.backed_distribution(sizes, projects, classes).collect()
    assert {r["remaining"]: (r["source"], r["mean"]) for r in rows} == {
        1: ("observed", 7.0), 2: ("class-size", 10.0), 3: ("class-type", 6.25), 4: ("class", 10.0), 5: ("default", 1.5), 6: ("default", 4.0)}


@pytest.mark.parametrize("mean,stddev", [(4.0, 1.5), (26.0, 14.5), (0.2, 0.1), (0.2, 3.0), (-50.0, 1.0), (-5.0, 9.0), (3.0, 0.0), (300.0, 900.0)])
def test_bounds_hold_the_exact_sums(mean, stddev):
    for items, rows in ((1, 200), (2, 50), (7, 50), (3_001, 20), (40_000, 3)):
        iterations = np.arange(9, 9 + rows, dtype=np.int32)
        exact = draws.block_totals(11, 22, 3, items, mean, stddev, iterations)
        low, high = draws.block_bounds(11, 22, 3, items, mean, stddev, iterations)
        assert (low <= exact).all() and (exact <= high).all(), items
        assert (high - low <= 2 * items + 2 + 5e-5 * 3_600_000 * items * (stddev + abs(mean))).all()


def test_bounds_of_many_items_are_near_each_other():
    """They leave open few ranks: the width a draw is some 7e-6 deviations, and 2 milliseconds."""
    iterations = np.arange(40, dtype=np.int32)
    for items in (3_000, 39_999):
        low, high = draws.block_bounds(11, 22, 3, items, 26.0, 14.5, iterations)
        assert (high - low <= items * (2.1 + 8e-6 * 14.5 * 3_600_000)).all(), items


def test_bounds_do_not_depend_on_units_and_blocks(monkeypatch):
    """Those of other blocks hold the exact sums too, also where a unit is cut within an iteration."""
    iterations = np.arange(30, dtype=np.int32)
    for pairs in (8, 60, 1 << 15):
        monkeypatch.setattr(draws, "PAIRS_PER_BOUND", pairs)
        for items in (1, 9, 15, 16, 17, 333):
            for stddev in (14.5, -14.5):
                exact = draws.block_totals(5, 6, 1, items, 26.0, stddev, iterations)
                low, high = draws.block_bounds(5, 6, 1, items, 26.0, stddev, iterations)
                assert (low <= exact).all() and (exact <= high).all() and (high - low < 200_000).all(), (pairs, items)


@pytest.mark.parametrize("mode", ["nearest", "compat"])
def test_quantiles_are_ranks_of_all_exact_sums(spark, mode):
    """Few sums are drawn exactly, and the quantiles are those of drawing all of them."""
    sizes = spark.createDataFrame(
        [("P", "S", 5, 30.0, 14.0, 4_001), ("P", "M", 5, 2.0, 3.0, 977), ("Q", "S", 5, 4.0, 0.0, 50), ("R", "S", 5, 4.0, 1.0, 1), (None, "S", 5, 4.0, 1.0, 3)],
        "project_key STRING, size STRING, n BIGINT, mean DOUBLE, stddev DOUBLE, remaining BIGINT")
    caps = spark.createDataFrame([(p, 8.0) for p in "PQRS"], CAPACITY)
    iterations, levels = 2_000, (1, 50, 95, 100)
    got = by(quantiles.completion_quantiles(sizes, caps, percentiles=levels, iterations=iterations, rank_mode=mode), "project_key", "pct")
    every = quantiles.iteration_totals(sizes, iterations, 42).collect()
    for p in "PQR":
        ms = sorted(r["total_ms"] for r in every if r["project_key"] == p)
        assert len(ms) == iterations
        for pct in levels:
            assert got[p, pct]["days"] == ms[quantiles.rank_of(pct, iterations, mode) - 1] / (3_600_000.0 * 8.0), (p, pct)
    assert {got["S", pct]["days"] for pct in levels} == {0.0}
    drawn = by(quantiles.open_iterations(sizes, iterations, 42, [1_000, 1_900]), "project_key")
    assert 2 <= len(drawn["P"]["listed"]) < iterations // 10


def test_radii_of_a_range_serve_all_units_that_begin_there(monkeypatch):
    """Units cut by ranges keep every iteration, and bounds from shared radii are as narrow and hold the exact sums."""
    import pyarrow as pa

    monkeypatch.setattr(draws, "RANGE_BITS", 20)
    monkeypatch.setattr(draws, "PAIRS_PER_BOUND", 1 << 12)
    iterations = np.arange(40_000, dtype=np.int32)
    args = [("P", 11, 22, 0, 6_001, 26.0, 14.5), ("Q", 5, 6, 1, 40_000, 2.0, -3.0), (None, 8, 9, 0, 5, 4.0, 0.0)]
    names = "project_key", "key_a", "key_b", "chunk", "items", "mean", "stddev"
    units = pa.RecordBatch.from_pylist([{**dict(zip(names, a)), "first": 0, "last": 39_999, "listed": None} for a in args])
    cut = pa.Table.from_batches(draws.by_range([units]))
    assert sorted((r["project_key"] or "", i) for r in cut.to_pylist() for i in r["listed"]) == sorted((a[0] or "", i) for a in args for i in iterations.tolist())
    radii, sums = draws.range_radii(7)
    last = (1 << 20) - 1 + draws.PAIRS_PER_CHUNK  # of the chunk that begins with the range's last word
    assert len(radii) > last and draws.STRIDE * (len(sums) - 1) == len(radii) and abs(sums[-1] / radii.sum(dtype=np.float64) - 1) < 1e-9
    made = []
    monkeypatch.setattr(draws, "range_radii", lambda number, make=draws.range_radii: made.append(number) or make(number))
    one = pa.Table.from_pylist([{**r, "listed": r["listed"][:60]} for r in cut.to_pylist() if r["range"] in (0, 4_095)] * 6, schema=cut.schema)
    got = pa.Table.from_batches(draws.unit_bounds(one.sort_by("range").to_batches())).to_pylist()
    assert made == [0, 4_095] and len(got) == 6 * sum(len(r) for r in cut.filter(pa.compute.is_in(cut["range"], pa.array([0, 4_095], pa.int32())))["listed"])
    for project, *a in args:
        rows = [r for r in got if r["project_key"] == project]
        exact = draws.block_totals(*a, np.array([r["iteration"] for r in rows], np.int32))
        assert all(r["low"] <= e <= r["high"] for r, e in zip(rows, exact.tolist()))
        assert all(r["high"] - r["low"] <= a[3] * (2.1 + 3e-5 * (abs(a[4]) + abs(a[5])) * 3_600_000) for r in rows)


def test_quantiles_are_the_same_where_units_are_dealt_by_ranges(spark, monkeypatch):
    sizes = spark.createDataFrame(
        [("P", "S", 5, 30.0, 14.0, 401), ("P", "M", 5, 2.0, 3.0, 97), ("Q", "S", 5, 4.0, 0.0, 50), (None, "S", 5, 4.0, 1.0, 3)],
        "project_key STRING, size STRING, n BIGINT, mean DOUBLE, stddev DOUBLE, remaining BIGINT")
    def drawn():
        rows = quantiles.open_iterations(sizes, 500, 42, [250, 400]).collect()
        return {r["project_key"]: (sorted(r["listed"]), r["places"]) for r in rows}

    whole = drawn()
    monkeypatch.setattr(quantiles, "SHARED_PAIRS", 1)
    monkeypatch.setattr(draws, "RANGE_BITS", 29)
    assert drawn() == whole and set(whole) == {"P", "Q", None}
