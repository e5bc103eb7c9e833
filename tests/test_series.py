"""Ordered series, skew and history."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shipgauge.operators import series, trends
from shipgauge.plans import reports
from shipgauge.settings import Settings
from tests.util import NOW, ago, by, item, items, now, one


def test_running_position_spans_partitions(spark):
    """A group holding almost all rows is numbered without gaps over many partitions."""
    rows = spark.range(0, 5000, 1, 7).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("g"), (F.col("id") % 30).cast("string"))).otherwise("hot").alias("g"),
        ((F.col("id") * 7919) % 997).alias("t"), F.col("id"),
    )
    facts = rows.groupBy("g").agg(F.count("*").alias("size"))
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        out = series.running_position(rows, "g", ["t", "id"], "pos", facts).collect()
    finally:
        spark.conf.unset(conf)
    groups = {}
    for r in out:
        groups.setdefault(r["g"], []).append(r)
    assert len(out) == 5000
    for got in groups.values():
        got.sort(key=lambda r: r["pos"])
        assert [r["pos"] for r in got] == list(range(1, len(got) + 1))
        assert [(r["t"], r["id"]) for r in got] == sorted((r["t"], r["id"]) for r in got)
        assert {r["size"] for r in got} == {len(got)}


def test_burndown(spark):
    data = items(
        spark, item("Done", done=ago(days=3), key="a"), item("Done", done=ago(days=5), key="b"),
        item("Done", done=ago(days=3), key="c"), item("To Do", key="d"), item("Canceled", done=ago(days=9), key="e"),
        item("To Do", project="Q"), item("Canceled", project="R"),
    )
    rows = series.burndown(data, now()).collect()
    p = sorted((r["completed"], r["remaining"], r["ts"]) for r in rows if r["project_key"] == "P")
    assert p == [(0, 4, ago(days=6)), (1, 3, ago(days=5)), (2, 2, ago(days=3)), (3, 1, ago(days=3))]
    others = {r["project_key"]: (r["ts"], r["completed"], r["remaining"]) for r in rows if r["project_key"] != "P"}
    assert others == {"Q": (NOW, 0, 1), "R": (NOW, 0, 0)}


def test_recent_comments(spark):
    df = spark.createDataFrame([("A", i, "" if i == 3 else "bo", str(i)) for i in range(1, 5)] + [("B", 1, None, "x")], "issue_key STRING, seq INT, author STRING, body STRING")
    two = series.recent_comments(df, 2).collect()
    assert sorted((r["issue_key"], r["seq"], r["total_comments"]) for r in two) == [("A", 3, 4), ("A", 4, 4), ("B", 1, 1)]
    assert {r["author"] for r in two if r["seq"] != 4} == {"Unknown"}
    assert series.recent_comments(df).count() == 5


ENTRY = (
    "project_key STRING, ts TIMESTAMP, total BIGINT, completed BIGINT, remaining BIGINT, avg_cycle DOUBLE, "
    "throughput DOUBLE, percentiles MAP<INT, DOUBLE>"
)


def entries(spark, *rows):
    return spark.createDataFrame(
        [(p, ts, 100, done, 100 - done, 4.0, thr, q) for p, ts, done, thr, q in rows], ENTRY
    )


def test_retention(spark):
    h = entries(spark, *[("P", NOW - timedelta(hours=i), i % 100, 1.0, {}) for i in range(101)], ("Q", NOW, 1, 1.0, {}))
    kept = trends.retained(h)
    assert kept.where("project_key = 'P'").count() == 100 and kept.count() == 101
    assert kept.where(F.col("ts") == F.lit(NOW - timedelta(hours=100))).count() == 0


@pytest.mark.parametrize("second,p70,direction", [
    (50, 15.0, "improving"), (30, 20.0, "declining"), (42, 23.0, "declining"), (44, 10.0, "stable"), (50, 19.5, "stable"),
])
def test_trend(spark, second, p70, direction):
    h = entries(
        spark, ("P", ago(days=5), 40, 2.0, {70: 20.0}), ("P", ago(days=1), second, 3.0, {70: p70}),
        ("P", ago(days=31), 0, 9.0, {70: 99.0}), ("Q", ago(days=1), 1, 1.0, {}),
    )
    got = one(trends.history_trend(h, now()))
    assert got["progress_change"] == pytest.approx(second - 40)
    assert got["p70_change"] == pytest.approx((p70 - 20) / 20 * 100)
    assert got["throughput_change"] == 50.0 and got["direction"] == direction


def test_window_is_strict_and_levels_default_to_zero(spark):
    h = entries(spark, ("P", ago(days=30), 40, 2.0, {70: 20.0}), ("P", ago(days=29), 50, 2.0, {70: 15.0}))
    got = one(trends.history_window(h, now()))
    assert (got["progress_pct"], got["p70"], got["p95"]) == (50.0, 15.0, 0.0)


def test_drift_and_latest(spark):
    h = entries(spark, ("P", ago(days=6), 1, 1.0, {85: 10.0}), ("P", ago(days=1), 2, 1.0, {85: 7.5}), ("P", ago(days=8), 0, 1.0, {85: 1.0}), ("Q", ago(days=1), 1, 1.0, {}))
    assert one(trends.p85_drift(h, now()))["p85_drift"] == -2.5
    assert by(trends.history_latest(h), "project_key")["P"]["completed"] == 2


# Composite reports

PROJECT = "project_key STRING, epic_key STRING, name STRING, capacity DOUBLE, config_order INT"
QUICK = reports.Sampling(iterations=50)


def portfolio(spark):
    projects = spark.createDataFrame(
        [("A", "E", "Alpha", 4.0, 0), ("B", "E", "Beta", None, 1), ("", "C", "Gamma", None, 2), ("D", "E", "Empty", None, 3)], PROJECT
    )
    data = items(
        spark, item("Done", cycle=4, project="A", created=ago(days=20), done=ago(days=1)), item("To Do", project="A"),
        item("To Do", project="B"), item("Canceled", project="B"),
        item("Done", cycle=8, project="C"), item("Canceled", project="C"),
    )
    return data, projects


def test_eligibility(spark):
    data, projects = portfolio(spark)
    got = by(reports.eligibility(reports.base_facts(data, projects, now(), Settings()).projects), "project_key")
    assert {k: v["reason"] for k, v in got.items()} == {"A": None, "B": "no cycle time data", "C": None, "D": "no data"}


def test_portfolio_run_and_history_rows(spark):
    data, projects = portfolio(spark)
    run = reports.portfolio_run(data, projects, now(), how=QUICK)
    got = by(run, "project_key", "pct")
    assert {k[0] for k in got} == {"A", "C"}
    assert got["A", 85]["days"] == 1.0 and str(got["A", 85]["target_date"]) == "2026-06-02"
    assert got["C", 95]["days"] == 0.0 and got["A", 50]["throughput_per_day"] == 1 / 14
    rows = by(reports.history_entries(run, now()), "project_key")
    assert rows["A"]["percentiles"] == {50: 1.0, 70: 1.0, 85: 1.0, 95: 1.0} and rows["A"]["ts"] == NOW


def test_compare_and_summary(spark):
    data, projects = portfolio(spark)
    drift = spark.createDataFrame([("A", -2.0)], "project_key STRING, p85_drift DOUBLE")
    comparison = reports.project_compare(data, projects, drift, now(), how=QUICK)
    got = by(comparison, "project_key")
    assert {k: (v["health"], v["p85"], v["p85_drift"]) for k, v in got.items()} == {
        "A": ("on-track", 1.0, -2.0), "B": ("behind", 0.0, 0.0), "C": ("ahead", 0.0, 0.0),
    }
    assert one(reports.compare_summary(comparison)) == {
        "fastest_project": "A", "most_complete": "C", "highest_risk": "B", "total_remaining": 2, "average_progress": 50.0,
    }


def test_status_dashboard_and_list(spark):
    data, projects = portfolio(spark)
    got = by(reports.project_status(data, projects, now(), how=QUICK), "project_key")
    assert {k: (v["health"], v["p85"]) for k, v in got.items()} == {"A": ("warning", 1.0), "B": ("critical", None), "C": ("good", None)}
    board = by(reports.dashboard(data, projects, now()), "project_key")
    assert str(board["A"]["target_70"]) == "2026-06-02" and board["D"]["total"] == 0 and board["B"]["target_95"] is None
    listed = by(reports.projects_list(data, projects, now()), "project_key")
    assert {k: (v["total"], v["done"]) for k, v in listed.items()} == {"A": (2, 1), "B": (1, 0), "C": (1, 1), "D": (0, 0)}


def test_full_report(spark):
    data, projects = portfolio(spark)
    full = by(reports.report_full(reports.report_sections(data, projects, now(), how=QUICK)), "project_key", "section", "label", "metric")
    assert full["A", "overview", "", "progress_pct"]["value"] == 50.0
    assert full["A", "sizes", "M", "avg_hours"]["value"] == 4.0
    assert full["A", "completion", "85", "days"]["value"] == 1.0
    assert full["C", "types", "Component", "remaining"]["value"] == 0.0
    assert full["A", "eva", "", "week"]["value"] == 3.0
    assert ("B", "completion", "85", "days") not in full


def test_empty_portfolio(spark):
    data, projects = portfolio(spark)
    assert reports.portfolio_run(data.limit(0), projects, now(), how=QUICK).count() == 0
    none = reports.project_compare(data.limit(0), projects, spark.createDataFrame([], "project_key STRING, p85_drift DOUBLE"), now(), how=QUICK)
    assert one(reports.compare_summary(none))["total_remaining"] == 0


def scans(df):
    """Parquet scans in a plan, each source counted as often as it is read."""
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_each_table_is_read_once(spark, tmp_path):
    from shipgauge.operators import audit, tasks

    def stored(name, df):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    comments = stored("c", spark.createDataFrame([("A", 1, "x", "y")], "issue_key STRING, seq INT, author STRING, body STRING"))
    assert scans(series.recent_comments(comments)) == 2  # rows, and their counts
    changes = stored("t", spark.createDataFrame([], "issue_key STRING, ts TIMESTAMP, seq INT, author STRING, field STRING, from_status STRING, to_status STRING"))
    issues = stored("i", spark.createDataFrame([], "project_key STRING, issue_key STRING, summary STRING, raw_status STRING, story_points DOUBLE, override_hours DOUBLE, time_spent_s BIGINT"))
    assert scans(audit.missing_times(issues, changes)) == 2
    plan = stored("p", spark.createDataFrame([], "key STRING, tracker_key STRING, type STRING, status STRING"))
    assert scans(tasks.task_reconcile(plan, issues)) == 3  # with and without a tracker key, and the issues
