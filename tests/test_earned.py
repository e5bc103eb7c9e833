"""Earned value: closed forms against the definitions."""

import pytest
from pyspark.sql import functions as F

from shipgauge.operators import earned, rollup
from tests.util import ago, by, item, items, now, one

PLAN = "project_key STRING, total BIGINT, done BIGINT, planned_weeks BIGINT"


def plan(spark, *rows):
    return spark.createDataFrame([(f"P{i}", *r) for i, r in enumerate(rows)], PLAN)


def test_linear_schedule(spark):
    got = {r["week"]: r["pv"] for r in earned.planned_schedule(plan(spark, (100, 0, 10))).collect()}
    assert got == {w: 10 * w for w in range(1, 11)}


def test_long_schedule_is_whole(spark):
    rows = earned.planned_schedule(plan(spark, (7, 0, 2503))).collect()
    assert sorted(r["week"] for r in rows) == list(range(1, 2504))
    assert all(r["pv"] == 7 * r["week"] // 2503 for r in rows)


@pytest.mark.parametrize("ev,expected", [(10, 1.0), (20, 2.0), (25, 2.5), (0, 1.0), (100, 10.0)])
def test_earned_schedule(spark, ev, expected):
    assert one(earned.earned_schedule(plan(spark, (100, ev, 10))))["earned_schedule"] == expected


def test_earned_schedule_matches_week_by_week_search(spark):
    cases = [(n, ev, w) for n in (0, 1, 3, 7, 10, 23) for ev in range(n + 1) for w in (1, 2, 5, 12, 40)]
    got = by(earned.earned_schedule(plan(spark, *cases)), "project_key")
    for i, (n, ev, weeks) in enumerate(cases):
        pv = [n * w // weeks for w in range(weeks + 1)]
        week = next((w for w in range(1, weeks + 1) if pv[w] >= ev), None)
        if week is None:
            expected = float(weeks)
        elif week == 1:
            expected = 1.0
        else:
            expected = week - 1 + (ev - pv[week - 1]) / (pv[week] - pv[week - 1])
        assert got[f"P{i}"]["earned_schedule"] == pytest.approx(expected), (n, ev, weeks)


def test_huge_plan_does_not_overflow(spark):
    n = 4 * 10**11
    got = one(earned.earned_schedule(plan(spark, (n, n // 2, 10**11))))
    assert got["earned_schedule"] == pytest.approx(5 * 10**10)


@pytest.mark.parametrize("spi,week", [(1.0, 10), (0.5, 20), (2.0, 5), (0.0, 0)])
def test_completion_week(spark, spi, week):
    row = spark.range(1).select(earned.completion_week(F.lit(10), F.lit(spi)).alias("w"))
    assert one(row)["w"] == week


@pytest.mark.parametrize("total,avg,capacity,weeks", [
    (100, 8.0, 8.0, 20), (1, 1.0, 8.0, 1), (100, 0.0, 8.0, 12), (100, 8.0, 0.0, 12), (109, 8.0, 8.0, 21),
])
def test_duration(spark, total, avg, capacity, weeks):
    got = spark.range(1).select(earned.duration_weeks(F.lit(total), F.lit(avg), F.lit(capacity)).alias("w"))
    assert one(got)["w"] == weeks


def eva(spark, *rows, mode="total"):
    facts = rollup.project_facts(items(spark, *rows), now()).withColumn("capacity", F.lit(8.0))
    return one(earned.eva_metrics(earned.with_plan(facts), now(), mode))


def test_cost_includes_every_positive_cycle(spark):
    got = eva(spark, item("Done", cycle=4), item("Done", cycle=6), item("Done", cycle=5),
              item("In Progress"), item("To Do"), item("Canceled", cycle=-2))
    assert (got["ev"], got["ac"]) == (3, 15.0)
    assert got["pv"] is None and got["spi"] is None


def test_cost_index(spark):
    assert eva(spark, item("Done", cycle=8), item("Done", cycle=8))["cpi"] == 0.125


def test_week_and_bands(spark):
    rows = [item("Done", cycle=40, created=ago(days=8))] + [item("To Do", created=ago(days=1))] * 3
    got = eva(spark, *rows)
    assert (got["planned_weeks"], got["week"], got["pv"]) == (4, 2, 2)
    assert (got["sv"], got["spi"], got["completion_week"]) == (-1, 0.5, 8)
    assert got["sv_band"] == "behind" and got["spi_band"] == "far-off"


def test_after_the_planned_end(spark):
    rows = [item("Done", cycle=8, created=ago(days=70)), item("To Do")]
    assert eva(spark, *rows)["pv"] == 2
    zero = eva(spark, *rows, mode="zero")
    assert (zero["pv"], zero["spi"], zero["completion_week"]) == (0, 0.0, 0)


def test_no_items_done(spark):
    got = eva(spark, item("To Do", created=ago(days=1)))
    assert (got["ev"], got["ac"], got["cpi"]) == (0, 0.0, 0.0)


def test_buffer_projection(spark):
    rows = [item("Done", cycle=8)] + [item("To Do")] * 10 + [item("In Progress")]
    facts = rollup.project_facts(items(spark, *rows), now()).withColumn("capacity", F.lit(None).cast("double"))
    got = one(earned.buffer_projection(facts))
    assert (got["days_70"], got["days_95"]) == (13, 18)
    none = rollup.project_facts(items(spark, item("Done", cycle=8), item("In Progress")), now())
    assert one(earned.buffer_projection(none.withColumn("capacity", F.lit(8.0))))["days_70"] is None
